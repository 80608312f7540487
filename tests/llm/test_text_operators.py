"""Tokens, fingerprints, attribution and language models against plain versions."""

import hashlib
import json
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from adit.llm import attribution, bpe, ctph, langid, maxent, packing
from adit.llm.queries import BYTE_BPE, WORD_BPE
from tests.llm.conftest import ODD, words

RNG = random.Random(5)
TEXTS = [*ODD, *(words(RNG, RNG.randrange(1, 200)) for _ in range(40)), "same text here", "same text here"]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, None), (3, None)]


@pytest.fixture(scope="module")
def table(documents, spark):
    from pyspark.sql import functions as F

    # Columns that clash with the operators' own names.
    return documents(ROWS).withColumn("id", F.lit("x")).withColumn("h", F.lit(1)).withColumn("key", F.lit(2)).repartition(3)


# Tokenization


def plain_bpe(symbols, ranks):
    """Merge the pair of lowest rank, leftmost first, until none is left."""
    out = list(symbols)
    while len(out) > 1:
        rank, i = min((ranks.get((a, b), math.inf), i) for i, (a, b) in enumerate(zip(out, out[1:])))
        if rank == math.inf:
            break
        out[i : i + 2] = [out[i] + out[i + 1]]
    return out


@pytest.mark.parametrize("seed", range(20))
def test_automaton_accepts_exactly_what_merges_make(seed, tmp_path):
    rng = random.Random(seed)
    base = ["a", "b", "c", "a</w>", "b</w>", "c</w>"]
    vocab, merges = list(base), []
    while len(merges) < 25:
        a, b = rng.choice(vocab), rng.choice(vocab)
        if not a.endswith("</w>") and a + b not in vocab:
            merges.append([a, b])
            vocab.append(a + b)
    spec = {"model": {"end_of_word_suffix": "</w>", "vocab": {t: i for i, t in enumerate(vocab)}, "merges": merges}, "added_tokens": [{"content": "<|end|>", "id": 99}]}
    path = tmp_path / "t.json"
    path.write_text(json.dumps(spec))
    model = bpe.WordBPE(str(path))
    ranks = {tuple(m): i for i, m in enumerate(merges)}
    for _ in range(200):
        word = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 14)))
        want = plain_bpe([*word[:-1], word[-1] + "</w>"], ranks)
        assert [model.labels[i] for i in model.encode(word)] == want


def test_encoding_equals_the_library(table):
    reference = Tokenizer.from_file(WORD_BPE)
    found = {}
    for r in bpe.encode_decode(table, WORD_BPE).collect():
        found.setdefault(r["doc_id"], []).append((list(r["ids"]), r["decoded"]))
    assert sum(map(len, found.values())) == len(ROWS)
    for i, t in ROWS:
        ids = reference.encode(t or "", add_special_tokens=False).ids
        assert (ids, reference.decode(ids, skip_special_tokens=False)) in found[i]
    digests = bpe.digests(table.where("doc_id = 4"), WORD_BPE).first()
    ids = reference.encode(TEXTS[4], add_special_tokens=False).ids
    assert digests["n_tokens"] == len(ids)
    assert digests["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_word_memory_turns_over(monkeypatch):
    model = bpe.WordBPE(WORD_BPE)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    encode = model.remembered(lambda ids: ids)
    for text in TEXTS[:20]:
        assert [i for x in encode(text) for i in x] == model.encode(text)


# Packing


def test_pieces_and_places(table, spark):
    reference = Tokenizer.from_file(WORD_BPE)
    got = packing.packed_pieces(table, WORD_BPE, capacity=256).toPandas()
    want = Counter()
    for i, t in ROWS:
        ids = reference.encode(t or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 256)):
            part = ids[at : at + 256]
            want[(i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    rows = got[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(object).where(got[["doc_id"]].notna().to_numpy() | [[False, True, True, True, True]], None)
    assert Counter(tuple(None if x is None else int(x) for x in r) for r in rows.itertuples(index=False)) == want
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values(["offset", "length"])
        assert (g["length"].cumsum() - g["length"]).tolist() == g["offset"].tolist() and g["length"].sum() <= 256


@pytest.mark.parametrize("per_block", [40, 4096])
def test_packing_is_close_to_the_bound(spark, monkeypatch, per_block):
    monkeypatch.setattr(packing, "ITEMS_PER_BLOCK", per_block)
    rng = random.Random(3)
    items = [(k, rng.choice([100, 37, 12, 0, rng.randrange(1, 100)])) for k in range(400)]
    got = packing.pack(spark.createDataFrame(items, "key long, length long"), capacity=100).toPandas()
    assert sorted(got["key"]) == [k for k, _ in items]
    length = dict(items)
    load = Counter()
    for key, seq in zip(got["key"], got["sequence_id"]):
        load[seq] += length[key]
    assert max(load.values()) <= 100
    least = -(-sum(length.values()) // 100)
    assert len(load) <= least + 4
    assert packing.pack(spark.createDataFrame([], "key long, length long")).count() == 0


def test_crossover_keeps_every_item_once():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 60, 80).tolist()
    a = packing.best_fit(list(range(80)), lengths, 100)
    b = packing.best_fit(list(range(79, -1, -1)), lengths, 100)
    child = packing.crossover(a, b, lengths, 100, rng)
    assert sorted(i for x in child.bins for i in x) == list(range(80))
    assert [sum(lengths[i] for i in x) for x in child.bins] == child.loads and max(child.loads) <= 100


# Piecewise hashes


def test_edit_trial(table):
    def edited(t, after):
        k = len(t) // 2
        return t[: len(t) - k] + after[:k]

    got = ctph.edit_trial(table.where("doc_id IS NOT NULL AND text IS NOT NULL AND doc_id <> 3")).toPandas()
    rows = sorted([(i, t) for i, t in ROWS if i is not None and t is not None and i != 3], reverse=True)
    assert got["doc_id"].tolist() != [] and sorted(got["doc_id"]) == sorted(i for i, _ in rows)
    by_id = got.set_index("doc_id")
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        r = by_id.loc[i]
        e = edited(t, after)
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        f, g, h = ctph.fingerprint_all([t, e, after])
        assert (r["fingerprint"], r["edited_fingerprint"]) == (f, g)
        assert (r["near_edited"], r["near_next"]) == (ctph.likeness(f, g), ctph.likeness(f, h))
    assert ctph.edit_trial(table).count() == len(ROWS)
    assert ctph.edit_trial(table.limit(0)).count() == 0
    alone = ctph.edit_trial(table.where("doc_id = 4")).first()
    assert alone["near_next"] == 1.0


def test_fingerprints_follow_the_content():
    rng = random.Random(9)
    text, other = words(rng, 900), words(rng, 900)
    near = text[:1500] + " inserted words here " + text[1500:]
    a, b, c, same = ctph.fingerprint_all([text, near, other, text])
    assert a == same and ctph.likeness(a, b) > 0.8 and ctph.likeness(a, c) < 0.2
    # Neighbours in a batch do not matter, nor does how texts are grouped.
    assert ctph.fingerprint_all([other, text, near], at_once=10) == [c, a, b]
    assert ctph.fingerprint_all([text * 3])[0].split(":")[0] != a.split(":")[0]


def test_likeness_is_the_edit_distance():
    rng = random.Random(2)
    for _ in range(100):
        x = ["".join(rng.choice("abc") for _ in range(2)) for _ in range(rng.randrange(0, 9))]
        y = ["".join(rng.choice("abc") for _ in range(2)) for _ in range(rng.randrange(0, 9))]
        d = [[max(i, j) if not i * j else 0 for j in range(len(y) + 1)] for i in range(len(x) + 1)]
        for i in range(1, len(x) + 1):
            for j in range(1, len(y) + 1):
                d[i][j] = d[i - 1][j - 1] if x[i - 1] == y[j - 1] else 1 + min(d[i - 1][j], d[i][j - 1])
        want = 1 - d[-1][-1] / (len(x) + len(y)) if x and y else float(not x and not y)
        assert ctph._common("".join(x), "".join(y)) == pytest.approx(want)


# Attribution


def brute_attribution(text, spans, rule):
    """Characters to tokens by offsets of the tokenizers library, characters to sections by scan."""
    reference = Tokenizer.from_file(BYTE_BPE.replace("byte_bpe_50k.tiktoken", "byte_bpe_50k.json"))
    reference.encode_special_tokens = True
    counts = [0] * len(spans)
    for s, e in reference.encode(text, add_special_tokens=False).offsets:
        share = [max(0, min(e, b) - max(s, a)) for a, b in spans]
        if not any(share):
            continue
        met = [k for k, x in enumerate(share) if x]
        counts[{"start": met[0], "end": met[-1], "majority": share.index(max(share))}[rule]] += 1
    return counts


@pytest.mark.parametrize("rule", attribution.RULES)
def test_attribution(documents, spark, rule):
    from pyspark.sql import functions as F

    texts = ["one two three four five six", "Line one.\nLine  two\n\n\nlast ünïcödé", "abcdefgh" * 50, "plain"]
    cuts = [[(0, 5), (5, 6), (6, 20), (22, 27)], [(0, 12), (12, 19), (19, 36)], [(0, 33), (33, 34), (34, 390)], []]
    rows = documents(list(enumerate(texts)))
    spans = spark.createDataFrame([(i, [{"start": a, "stop": b} for a, b in c]) for i, c in enumerate(cuts)], "doc_id long, spans array<struct<start:long,stop:long>>")
    got = attribution.attribute(rows.join(spans, "doc_id"), BYTE_BPE, rule, spans_col="spans").orderBy("doc_id", "section").collect()
    for i, t in enumerate(texts):
        assert [r["n_tokens"] for r in got if r["doc_id"] == i] == brute_attribution(t, cuts[i], rule)
    assert sum(r["n_crossing"] for r in got) > 0
    with pytest.raises(ValueError):
        attribution.attribute(rows.withColumn("x", F.lit(1)), BYTE_BPE, "other")


def test_attribution_of_lines_loses_no_token(table):
    encoder = attribution.Encoder(BYTE_BPE)
    got = attribution.attribute(table, BYTE_BPE).groupBy("doc_id").agg({"n_tokens": "sum", "section": "max"}).collect()
    total = {r["doc_id"]: r["sum(n_tokens)"] for r in got}
    for i, t in enumerate(TEXTS):
        assert total[i] == len(encoder.spans(t)), i
    assert attribution.attribute(table.limit(0), BYTE_BPE).count() == 0


# Language models


def test_maxent_base_scores_and_distribution(table, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(maxent, "FREQUENT", 20)
    got = maxent.scores(table, F.coalesce(F.col("doc_id") % 3 != 0, F.lit(False))).collect()
    tokens = [(i, (t or "").encode().lower().split() + [None]) for i, t in ROWS]
    counts = Counter(w for i, x in tokens if i is not None and i % 3 for w in x)
    n, v = sum(counts.values()), len(counts)
    want = sorted((len(x), sum(counts[w] > 0 for w in x), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in x), 6)) for _, x in tokens)
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert {r["train_tokens"] for r in maxent.scores(table, F.lit(False)).collect()} == {0}


def test_token_hashes_depend_on_the_word_alone():
    h, sizes = maxent.tokens(["One two\tone", "", " two\x0bÉ one "])
    assert sizes.tolist() == [4, 1, 4]
    assert h[0] == h[2] == h[7] and h[1] == h[5] and h[3] == h[4] == h[8] and len(set(h.tolist())) == 4
    context = maxent.contexts(h, sizes)
    assert context[0].tolist() == context[4].tolist() == context[5].tolist()
    assert context[2].tolist() != context[7].tolist()


def test_training_learns_the_word_before():
    rng = np.random.default_rng(0)
    table = np.zeros((2, maxent.SLOTS, maxent.CLASSES), np.float32)
    bias = np.full(maxent.CLASSES, -math.log(maxent.CLASSES), np.float32)
    model = maxent.Weights(bias, np.tile(bias, (maxent.CLASSES, 1)), table)
    pairs = [("ab", "cd"), ("ef", "gh"), ("ij", "kl")]
    texts = [" ".join(w for k in rng.integers(0, 3, 300) for w in pairs[k]) for _ in range(5)]
    h, sizes = maxent.tokens(texts)
    trainer = maxent.Trainer(model)
    for _ in range(20):
        trainer.update(h, sizes)
    after = maxent.Weights(model.class_bias, model.bucket_bias, trainer.table)
    assert after.logs(h, sizes).mean() > model.logs(h, sizes).mean() + 1
    # Both factors are distributions.
    context = maxent.contexts(h, sizes)[:5]
    assert maxent._probabilities(after.class_bias, after.table[0], maxent.slots(context, 0)).sum(axis=1) == pytest.approx(1, abs=1e-5)


# Languages

SYLLABLES = {"en": "th he ing and er on re", "de": "ein sch ich der und ung ä", "fr": "eau que les è ment oi é", "es": "ción que los ñ mente ado ó", "xx": "qw zx vk jj kw"}


def invented(lang, rng, n=60):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_languages(documents):
    rng = random.Random(4)
    rows = [(i, invented(c, rng), c) for i, c in enumerate(list(SYLLABLES) * 30)]
    test = [(1000 + i, invented(c, rng), c) for i, c in enumerate(list(SYLLABLES) * 10)]
    odd = [(2000, None, "en"), (2001, "", "en"), (2002, "123 !!", "en"), (None, invented("fr", rng), None), (2003, invented("de", rng) * 300, None)]
    model = langid.train(documents([*rows, (5000, None, "en"), (5001, "text", None), rows[0]]))
    assert model.languages == sorted(SYLLABLES) and set(model.families) == {"germanic", "romance", "xx"}
    got = {r["doc_id"]: r for r in langid.predict(documents([*test, *odd]), model).collect()}
    assert sum(got[i]["lang_pred"] == c for i, _, c in test) == len(test)
    assert [got[i]["lang_pred"] for i in (2000, 2001, 2002, None, 2003)] == ["und", "und", "und", "fr", "de"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.keep_known(documents(odd), model).count() == 2


def test_much_copied_text_does_not_displace_a_language(documents):
    from pyspark.sql import functions as F

    rng = random.Random(6)
    few = documents([(i, invented(c, rng), c) for i, c in enumerate(["en", "fr"] * 60)])
    hot = documents([(0, invented("fr", rng), "fr")]).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(40_000)))).drop("k")
    plain, copied = langid.train(few, per_language=20), langid.train(few.union(hot), per_language=20)
    assert plain.languages == copied.languages == ["en", "fr"]
    test = documents([(i, invented(c, rng), c) for i, c in enumerate(["en", "fr"] * 20)])
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(test, copied).collect()}
    assert [got[i] for i in range(40)] == ["en", "fr"] * 20


def test_languages_without_training_rows(documents):
    model = langid.train(documents([(1, None, "en"), (2, "x", None)]))
    assert {(r["lang_pred"], r["score"]) for r in langid.predict(documents([(1, "text"), (2, None)]), model).collect()} == {("und", 0.0)}
    one = langid.train(documents([(1, "the only text", "en")]))
    assert langid.predict(documents([(1, "das ist")]), one).first()["lang_pred"] == "en"
