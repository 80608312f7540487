"""Registered queries of the training-data operators: whole tables, full results."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adit.llm import attribution, audit, bpe, chat, collocations, ctph, itq, langid, maxent, mixing, packing, simhash, toxicity

#: Folder of the public tokenizers' files.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
WORD_BPE = f"{TOKENIZERS}/word_bpe_49k.json"
BYTE_BPE = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_itq_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_toxicity_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learn = docs.where(~toxicity.held_out(F.col("doc_id"))).select("doc_id", "text")
    found = toxicity.score(docs.select("doc_id", "text"), toxicity.train(learn, labels=labels))
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), WORD_BPE)


def op4_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = maxent.scores(docs, ~maxent.held_out(F.col("doc_id")))
    return found.withColumn("held_out", maxent.held_out(F.col("doc_id")))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    probe = spark.range(1).select(F.inline(F.expr(f"array(struct(-7L, 0L, 'user', r'{said}'), struct(-7L, 1L, 'assistant', r'{said}'))")))
    done = chat.format_conversations(turns.union(probe))
    back, loss = chat.read_back(F.col("formatted")), chat.loss_text(F.col("formatted"), F.col("loss_spans"))
    read = done.select("conv_id", "formatted", back.alias("back"), loss.alias("loss"))
    joined = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document; a token across a line end goes to the line with most of it."""
    return attribution.attribute(table(spark, sf_dir, "documents"), BYTE_BPE)


def op7_packing_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), WORD_BPE)


def op8_simhash_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_piecewise_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.edit_trial(table(spark, sf_dir, "documents"))


def op10_language_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_toivonen_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_itq_embeddings": op1_itq_embeddings,
    "op2_toxicity_channel": op2_toxicity_channel,
    "op3_bpe_automaton": op3_bpe_automaton,
    "op4_maxent_scores": op4_maxent_scores,
    "op5_chat_format": op5_chat_format,
    "op6_section_tokens": op6_section_tokens,
    "op7_packing_islands": op7_packing_islands,
    "op8_simhash_balls": op8_simhash_balls,
    "op9_piecewise_hash": op9_piecewise_hash,
    "op10_language_svm": op10_language_svm,
    "op11_filter_audit": op11_filter_audit,
    "op12_toivonen_phrases": op12_toivonen_phrases,
    "op13_source_mix": op13_source_mix,
}

ORACLES: dict[str, str] = {
    "op1_itq_embeddings": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, e FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
            WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(e, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.98
        ), reach AS (
            SELECT vec_id AS node, vec_id AS component FROM embeddings
            UNION SELECT l.b, r.component FROM reach r JOIN links l ON l.a = r.node
        ), low AS (SELECT node, min(component) AS component_id FROM reach GROUP BY node),
        counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT e.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, l.component_id, e.vec_id = l.component_id AS kept
        FROM embeddings e JOIN low l ON l.node = e.vec_id LEFT JOIN counts c ON c.a = e.vec_id""",
    "op5_chat_format": r"""
        WITH raw AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ), placed AS (
            SELECT *, row_number() OVER w AS n, lag(role) OVER w AS before,
                   length(replace(replace(text, '\', '\\'), '<', '\l')) AS text_chars,
                   length(replace(replace(role, '\', '\\'), '<', '\l')) AS role_chars
            FROM raw WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(text_chars + CASE WHEN before IS NOT DISTINCT FROM role THEN length('<part>')
                   ELSE length('<turn><says></turn>') + role_chars END)::BIGINT AS formatted_chars
        FROM placed GROUP BY conv_id""",
    "op11_filter_audit": r"""
        WITH RECURSIVE orders AS (
            SELECT '' AS o UNION ALL SELECT o || f FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) WHERE NOT contains(o, f)
        ), steps AS (
            SELECT o AS filter_order, CAST(step AS INTEGER) AS step, substr(o, step, 1) AS f, substr(o, 1, step - 1) AS before
            FROM orders, (SELECT unnest(range(1, 6)) AS step) WHERE length(o) = 5
        ), marks AS (
            SELECT doc_id, coalesce(max(CASE WHEN quality = 1 THEN 1 ELSE 0 END), 0) AS good, coalesce(max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END), 0) AS toxic
            FROM labels GROUP BY doc_id
        ), texts AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
        ), flagged AS (
            SELECT doc_id, part,
                   CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
                   || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
                   || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
                   || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
                   || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS failed
            FROM texts
        ), sets AS (
            SELECT part, failed, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM flagged LEFT JOIN marks USING (doc_id) GROUP BY part, failed
        ), effect AS (
            SELECT part, filter_order, step, f,
                   sum(n) FILTER (length(translate(failed, before || f, '')) = length(failed)) AS kept,
                   sum(n) FILTER (contains(failed, f) AND length(translate(failed, before, '')) = length(failed)) AS removed,
                   sum(n) FILTER (contains(failed, f) AND length(translate(failed, before, '')) < length(failed)) AS redundant,
                   sum(n) FILTER (failed = f) AS unique_fails,
                   sum(good) FILTER (contains(failed, f) AND length(translate(failed, before, '')) = length(failed)) AS good_lost,
                   sum(toxic) FILTER (contains(failed, f) AND length(translate(failed, before, '')) = length(failed)) AS toxic_lost
            FROM sets, steps GROUP BY ALL
        )
        SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
               CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
               CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
               CAST(coalesce(sum(removed) OVER (PARTITION BY part, f), 0) AS BIGINT) AS shapley
        FROM effect""",
    "op12_toivonen_phrases": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM (
                SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
                FROM documents)
        ), totals AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM pieces GROUP BY lang),
        starts AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM pieces),
        f AS (
            SELECT lang, size, array_to_string(list_slice(words, i, i + size - 1), ' ') AS phrase, count(*) AS f
            FROM starts, (SELECT unnest(range(1, 6)) AS size) WHERE i + size - 1 <= len(words) GROUP BY ALL HAVING count(*) >= 100
        ), cuts AS (
            SELECT c.lang, c.phrase, c.size, c.f AS a, k, array_to_string(list_slice(string_split(phrase, ' '), 1, k), ' ') AS head,
                   array_to_string(list_slice(string_split(phrase, ' '), k + 1, size), ' ') AS tail
            FROM f c, (SELECT unnest(range(1, 5)) AS k) WHERE size > 1 AND k < size
        ), scored AS (
            SELECT c.*, x.f AS l, y.f AS r, n, CAST((1000 * CAST(a AS HUGEINT) * n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
            FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = head JOIN f y ON y.lang = c.lang AND y.phrase = tail JOIN totals t ON t.lang = c.lang
        ), lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        left_over AS (
            SELECT * FROM lowest c WHERE NOT EXISTS (
                SELECT 1 FROM f o WHERE o.lang = c.lang AND o.size > c.size AND 100 * o.f >= 100 * c.a AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' '))
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score, k
        FROM left_over QUALIFY rank <= 2000""",
    "op13_source_mix": r"""
        WITH sized AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                   md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
            FROM documents
        ), sums AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM sized GROUP BY source
        ), weighed AS (SELECT *, [3, 1, 2][no % 3 + 1] AS w, 2 * source_size AS top FROM sums),
        filled AS (
            SELECT *, coalesce(sum(top) OVER before, 0) AS tops, coalesce(sum(w) OVER before, 0) AS ws,
                   sum(source_size) OVER () AS everything, sum(w) OVER () AS all_ws
            FROM weighed WINDOW before AS (ORDER BY CAST(top AS DOUBLE) / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), water AS (SELECT max(CAST(everything * 3 - tops * 2 AS DOUBLE) / CAST((all_ws - ws) * 2 AS DOUBLE)) AS level FROM filled),
        targets AS (
            SELECT source, no, w, top, source_size, least(CAST(top AS DOUBLE), level * w) AS target, CAST((source_size + 31) // 32 AS BIGINT) AS blocks
            FROM weighed, water
        ), seats AS (
            SELECT (6 * sum(source_size) - coalesce(4 * sum(top) FILTER (target >= top), 0) + 64) // 128 AS n FROM targets
        ), asked AS (
            SELECT no, row_number() OVER (ORDER BY CAST(w AS DOUBLE) / (2 * j + 1) DESC, no, j) AS place
            FROM (SELECT no, w, unnest(range(2 * blocks)) AS j FROM targets WHERE target < top)
        ), won AS (SELECT no, count(*) AS n FROM asked, seats WHERE place <= seats.n GROUP BY no),
        quotas AS (
            SELECT t.*, CASE WHEN target >= top THEN 2 * blocks ELSE coalesce(won.n, 0) END AS quota FROM targets t LEFT JOIN won USING (no)
        ), dealt AS (
            SELECT no, b, b // 1024 AS shard, CAST(quota % blocks AS DOUBLE) AS rest, blocks,
                   row_number() OVER (PARTITION BY no, b // 1024 ORDER BY md5('mix|' || CAST(no AS VARCHAR) || '|' || CAST(b AS VARCHAR))) AS place
            FROM (SELECT no, quota, blocks, unnest(range(blocks)) AS b FROM quotas)
        ), chosen AS (
            SELECT no, b FROM dealt
            WHERE place <= floor(rest * least(blocks, (shard + 1) * 1024) / blocks + 0.5) - floor(rest * (shard * 1024) / blocks + 0.5)
        ), placed AS (
            SELECT doc_id, source, size, row_number() OVER () AS r,
                   CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
            FROM sized
        ), pieces AS (
            SELECT r, no, start, size, unnest(CASE WHEN size > 0 THEN range(start // 32, (start + size - 1) // 32 + 1) END) AS b
            FROM placed p JOIN quotas q ON p.source IS NOT DISTINCT FROM q.source
        ), more AS (
            SELECT r, sum(least(start + size, (b + 1) * 32) - greatest(start, b * 32)) AS n FROM pieces JOIN chosen USING (no, b) GROUP BY r
        )
        SELECT doc_id, size, source_size, target, CAST(size * CASE WHEN blocks > 0 THEN quota // blocks ELSE 0 END + coalesce(more.n, 0) AS BIGINT) AS taken,
               CAST(CASE WHEN blocks > 0 THEN quota // blocks ELSE 0 END AS BIGINT) AS whole_passes
        FROM placed p JOIN quotas q ON p.source IS NOT DISTINCT FROM q.source LEFT JOIN more USING (r)""",
}
