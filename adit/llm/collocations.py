"""Phrase collocations by Toivonen's sampling algorithm.

Phrases that are frequent in a sample, at a lowered threshold, are proposed.
A full pass counts the proposed phrases and their negative border: phrases that
were not proposed, but whose first and last words were. A border phrase that
turns out frequent is a failure: it is added to the proposal, and a further
pass counts what the larger proposal admits. Without failures the counts are
complete, since every part of a frequent phrase is frequent.

Most phrases of the border occur a few times only, so it is counted by hash. Two
phrases of one hash can only be taken for frequent; they are then counted by
their words, in the pieces of text that hold them. What a later pass admits
contains such a phrase, so later passes read these pieces alone.

The border is never written out. Each task holds the proposal as a bitmap of
hashes, of fixed size whatever the number of phrases, and counts the phrases of
its texts whose two parts are in it. A hash that another phrase has set only
admits more; counts are kept by the words themselves and stay exact.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adit.llm.wordbytes import byte_classes, cut, slices
from adit.workspace import materialize, new_path

LONGEST = 5
#: One in so many documents is in the sample; the threshold there is lowered by this factor.
SAMPLE, LOWERED = 8, 0.6
#: log2 of the bits of a proposal: 8 MB. More phrases than that admit more than they need.
FILTER_BITS = 26
#: Words that a task counts at a time, bytes of text cut at a time, and rows sent on at a time.
CHUNK_WORDS, SLICE_BYTES, SENT_ROWS = 1 << 19, 2 << 20, 1 << 16
#: Texts that go from Spark to a task's Python worker at a time.
TEXTS_AT_A_TIME = 500
BUCKET = 32768

CLASSES = byte_classes(b" \t", b".,;:!?\n\x0b\x0c\r")


class Proposal:
    """A set of phrases by hash; may hold more than was put in, never less."""

    def __init__(self, bits: np.ndarray | None = None, log2: int = FILTER_BITS):
        self.log2 = log2
        self.bits = np.zeros(max(1, (1 << log2) // 8), np.uint8) if bits is None else bits

    def __getstate__(self) -> tuple[int, bytes]:
        return self.log2, zlib.compress(self.bits, 1)

    def __setstate__(self, state: tuple[int, bytes]) -> None:
        self.log2, self.bits = state[0], np.frombuffer(zlib.decompress(state[1]), np.uint8)

    @property
    def some(self) -> bool:
        return bool(self.bits.any())

    def has(self, h: np.ndarray) -> np.ndarray:
        place = h & np.uint64((1 << self.log2) - 1)
        return (self.bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def with_phrases(self, phrases: DataFrame) -> Proposal:
        """A proposal with the hashes ``h`` of ``phrases`` added, itself without any; what is collected has the size of the bitmap."""
        place = F.col("h").bitwiseAND((1 << self.log2) - 1) + 1
        maps = phrases.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
        bits, maps = self.bits.copy(), maps.collect()
        for r in maps:
            at = (r["b"] - 1) * BUCKET // 8
            bits[at : at + BUCKET // 8] |= np.frombuffer(r["bits"], np.uint8)[: len(bits) - at]
        return Proposal(bits, self.log2) if maps else self


def _join(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of its first words and its last word."""
    x = h * np.uint64(0x9E3779B97F4A7C15) + word
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each key, the distinct keys)"""
    coded = pa.array(keys).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_numpy()


SENT = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("h", pa.int64()), ("n", pa.int64())])


class Admitted(NamedTuple):
    """Distinct phrases of one size in a run of words: those whose two parts a proposal has.

    ``at``: where they occur, ``number``: which of them occurs there, ``code``: the
    language of each, ``first``: its first words among the phrases a word shorter, ``last``: its last word.
    """

    at: np.ndarray
    number: np.ndarray
    h: np.ndarray
    code: np.ndarray
    first: np.ndarray
    last: np.ndarray


def admitted(word: np.ndarray, word_hash: np.ndarray, lang: np.ndarray, lang_hash: np.ndarray, piece: np.ndarray, current: Proposal) -> Iterator[Admitted]:
    """By size, the phrases in a run of words that ``current`` admits; first all single words."""
    wide = max(1, len(word_hash))
    gram, keys = _numbered(lang.astype(np.int64) * wide + word)
    code, last = keys // wide, keys % wide
    h = _join(lang_hash[code], word_hash[last])
    yield Admitted(np.arange(len(word)), gram, h, code, np.zeros(len(keys), np.int64), last)
    is_in = current.has(h)[gram]
    follows = piece[1:] == piece[:-1]
    for size in range(2, LONGEST + 1):
        both = is_in[:-1] & is_in[1:]
        if size == 2:
            both &= follows[: len(both)]
        at = np.flatnonzero(both)
        at = at[at + size <= len(word)]
        if not len(at):
            return
        number, keys = _numbered(gram[at].astype(np.int64) * wide + word[at + size - 1])
        first, last = keys // wide, keys % wide
        code, h = code[first], _join(h[first], word_hash[last])
        yield Admitted(at, number, h, code, first, last)
        gram, is_in = _spread(number, at, len(word)), _spread(current.has(h)[number], at, len(word))


def count_chunk(
    words: pa.StringArray, lang: np.ndarray, piece: np.ndarray, langs: pa.Array, current: Proposal, before: Proposal | None, late: bool = False
) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases in one run of words that ``current`` admits and ``before`` did not.

    Without ``before`` single words and, as the phrase of no words, all words are
    counted too. Then, if something is proposed, phrases that are not go by their
    hash alone. ``late``: those that ``before`` admitted and ``current`` adds are counted too, now by their words.
    """

    def send(code: np.ndarray, text: pa.StringArray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(n), SENT_ROWS):
            part = slice(k, k + SENT_ROWS)
            columns = [langs.take(pa.array(code[part])), text[part], pa.nulls(len(n[part]), pa.int64()), pa.array(n[part].astype(np.int64))]
            yield pa.record_batch(columns, SENT)

    def send_hashes(h: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(n), SENT_ROWS):
            own = n[k : k + SENT_ROWS]
            nothing = pa.nulls(len(own), pa.string())
            yield pa.record_batch([nothing, nothing, pa.array(h[k : k + SENT_ROWS].view(np.int64)), pa.array(own.astype(np.int64))], SENT)

    coded = words.dictionary_encode()
    vocabulary, word = coded.dictionary, coded.indices.to_numpy()
    if before is None:
        n = np.bincount(lang, minlength=len(langs))
        some = np.flatnonzero(n)
        yield from send(some, pa.array([""] * len(some), pa.string()), n[some])
    text = slot = was_in = None
    for size, p in enumerate(admitted(word, _hashes(vocabulary.to_pylist()), lang, _hashes(langs.to_pylist()), piece, current), 1):
        n, known = np.bincount(p.number, minlength=len(p.h)), current.has(p.h)
        # Phrases spelled out: those that are sent by their words and those that longer ones begin with.
        spelled = np.flatnonzero(known) if before is None and current.some else np.arange(len(p.h))
        last = vocabulary.take(pa.array(p.last[spelled]))
        text = last if size == 1 else pc.binary_join_element_wise(text.take(pa.array(slot[p.first[spelled]])), last, " ")
        slot = np.zeros(len(p.h), np.int64)
        slot[spelled] = np.arange(len(spelled))
        if before is None:
            yield from send(p.code[spelled], text, n[spelled])
            if len(spelled) < len(p.h):
                other = np.flatnonzero(~known)
                yield from send_hashes(p.h[other], n[other])
            continue
        held, old = before.has(p.h), np.full(len(p.h), size == 1)
        if size > 1:
            old[p.number] = was_in[p.at] & was_in[p.at + 1]
        new = np.flatnonzero(~old | (late & ~held & known))
        yield from send(p.code[new], text.take(pa.array(new)), n[new])
        # What the last pass did not admit, it did not go on from either.
        was_in = _spread((held & old)[p.number], p.at, len(word))


def pieces_with_added(words: pa.StringArray, lang: np.ndarray, piece: np.ndarray, langs: pa.Array, current: Proposal, before: Proposal) -> pa.RecordBatch:
    """(text, lang) of the pieces in a run of words that hold a phrase which ``before`` admitted and ``current`` adds.

    All phrases that ``current`` admits and ``before`` did not are in these.
    """
    coded = words.dictionary_encode()
    vocabulary, word = coded.dictionary, coded.indices.to_numpy()
    chosen = np.zeros(len(word), bool)
    for p in admitted(word, _hashes(vocabulary.to_pylist()), lang, _hashes(langs.to_pylist()), piece, before):
        added = current.has(p.h) & ~before.has(p.h)
        chosen[p.at[added[p.number]]] = True
    starts = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
    ends = np.r_[starts[1:], len(piece)]
    wanted = np.flatnonzero(np.logical_or.reduceat(chosen, starts))
    sizes = ends[wanted] - starts[wanted]
    inside = np.repeat(starts[wanted] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    listed = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), words.take(pa.array(inside)))
    return pa.record_batch([pc.binary_join(listed, " "), langs.take(pa.array(lang[starts[wanted]]))], ["text", "lang"])


def _spread(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, values.dtype)
    out[at] = values
    return out


def _runs(batches: Iterator[pa.RecordBatch], most_words: int, most_bytes: int) -> Iterator[tuple[pa.StringArray, np.ndarray, np.ndarray, pa.Array]]:
    """(words, lang, piece, langs) of runs of about ``most_words`` words from batches of (text, lang)."""
    held: list[tuple] = []
    langs: dict[str, int] = {}
    size = end = 0

    def run() -> tuple[pa.StringArray, np.ndarray, np.ndarray, pa.Array]:
        words = pa.chunked_array([w for w, _, _ in held]).combine_chunks()
        lang, piece = (np.concatenate([h[k] for h in held]) for k in (1, 2))
        held.clear()
        return words, lang, piece, pa.array(list(langs), pa.string())

    for batch in batches:
        for at, to in slices(batch.column(0), most_bytes):
            found = cut(batch.column(0).slice(at, to - at), CLASSES, lower=True)
            if not len(found.text):
                continue
            names = batch.column(1).slice(at, to - at).dictionary_encode()
            codes = np.array([langs.setdefault(x, len(langs)) for x in names.dictionary.to_pylist()], np.int32)
            piece = found.piece + np.int32(end)
            held.append((found.text, codes[names.indices.to_numpy()][found.row], piece))
            size, end = size + len(piece), int(piece[-1]) + 1
            if size >= most_words:
                yield run()
                langs.clear()
                size = end = 0
                pa.default_memory_pool().release_unused()
    if held:
        yield run()


def count_phrases(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """One pass over (text, lang): (lang, phrase, h, n), partial counts of each run of words, by phrase or by hash.

    ``shared`` holds the proposal, the one of the pass before, if any, and
    whether that pass sent hashes.
    """
    chunk_words, slice_bytes = CHUNK_WORDS, SLICE_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches, chunk_words, slice_bytes):
            yield from count_chunk(*part, *shared.value)

    return docs.mapInArrow(run, "lang string, phrase string, h long, n long")


def holding_added(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """(text, lang) of the pieces that hold a phrase which the first proposal shared adds to the second."""
    chunk_words, slice_bytes = CHUNK_WORDS, SLICE_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches, chunk_words, slice_bytes):
            yield pieces_with_added(*part, *shared.value[:2])

    return docs.mapInArrow(run, "text string, lang string")


def hashed(phrases: DataFrame, shared: Broadcast) -> DataFrame:
    """Append ``h``, the hash that a proposal knows a phrase by, and ``known``, whether the shared one has it.

    Rows without a phrase keep the ``h`` they have.
    """
    others = [c for c in phrases.columns if c != "h"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = pc.split_pattern(pc.fill_null(batch.column("phrase"), ""), " ")
            word, size = _hashes(split.flatten().to_pylist()), pc.list_value_length(split).to_numpy()
            at, h = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64), _hashes(pc.fill_null(batch.column("lang"), "").to_pylist())
            for k in range(LONGEST):
                more = np.flatnonzero(size > k)
                h[more] = _join(h[more], word[at[more] + k])
            if "h" in batch.schema.names:
                own = pc.fill_null(batch.column("h"), 0).to_numpy().view(np.uint64)
                h = np.where(batch.column("phrase").is_null().to_numpy(zero_copy_only=False), own, h)
            yield pa.record_batch([*(batch.column(c) for c in others), pa.array(h.view(np.int64)), pa.array(shared.value[0].has(h))], [*others, "h", "known"])

    return phrases.mapInArrow(run, f"{', '.join(f'{c} {t}' for c, t in phrases.dtypes if c != 'h')}, h long, known boolean")


@contextmanager
def smaller_batches(spark: SparkSession, rows: int = TEXTS_AT_A_TIME) -> Iterator[None]:
    """Fewer texts in an Arrow batch while a pass runs: tasks hold a batch on both sides of the pipe."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def frequent_phrases(docs: DataFrame, least: int, proposal: Proposal, folder: str) -> tuple[DataFrame, int]:
    """All phrases of one to five words found at least ``least`` times, and the number of passes.

    ``docs`` has ``text`` and ``lang``. The rows of no words count all words of a
    language. Any proposal gives the same rows; a good one saves passes.

    With a proposal the border of the first pass is counted by hash. Pieces that
    hold a phrase of a frequent hash are picked in a second scan; there such
    phrases are counted by their words, and the later passes read nothing else.
    """
    found, before, passes, late = None, None, 0, False
    spark = docs.sparkSession
    while True:
        shared = spark.sparkContext.broadcast((proposal, before, late))
        counted = count_phrases(docs, shared).groupBy("lang", "phrase", "h").agg(F.sum("n").alias("n"))
        words = F.when(F.col("phrase") == "", 0).when(F.col("phrase").isNotNull(), F.size(F.split("phrase", " ")))
        frequent = counted.where((F.col("n") >= least) | (F.col("phrase") == "")).withColumn("words", words)
        with smaller_batches(spark):
            rows = materialize(frequent, "phrases", inside=folder)
        failed = F.col("phrase").isNull() | (~F.col("known") & (F.col("words") < LONGEST))
        more = proposal.with_phrases(hashed(rows.where("phrase IS NULL OR words > 0"), shared).where(failed))
        shared.destroy()
        new = rows.where("phrase IS NOT NULL").drop("h")
        found, passes, late = new if found is None else found.union(new), passes + 1, before is None and proposal.some
        if more is proposal:
            return found, passes
        before, proposal = proposal, more
        if late:
            shared = spark.sparkContext.broadcast((proposal, before))
            with smaller_batches(spark):
                docs = materialize(holding_added(docs, shared), "pieces", inside=folder)
            shared.destroy()


def sampled(docs: DataFrame, one_in: int = SAMPLE) -> DataFrame:
    """About one in ``one_in`` rows, by a hash of the id or, without one, of the text."""
    return docs.where(F.pmod(F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("id")), F.lit(one_in)) == 0)


def scored(found: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, n, score, k, l, r): the cut with the lowest score of every phrase of two words or more."""
    counts = found.where("words > 0").select("lang", "phrase", F.col("n").alias("f"))
    totals = found.where("words = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    cuts = found.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select(
        "*", F.expr("substring_index(phrase, ' ', k)").alias("left_part"), F.expr("substring_index(phrase, ' ', k - words)").alias("right_part")
    )
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("left_part"), F.col("f").alias("l")), ["lang", "left_part"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("right_part"), F.col("f").alias("r")), ["lang", "right_part"])
    exact = "(1000 * cast(a AS decimal(19, 0)) * cast(n AS decimal(19, 0))) div (cast(l AS decimal(19, 0)) * cast(r AS decimal(19, 0)))"
    cuts = cuts.join(totals, "lang").withColumn("score", F.expr(exact))
    lowest = cuts.groupBy("lang", "phrase", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "phrase", "words", "a", "n", "cut.*")


def uncovered(candidates: DataFrame) -> DataFrame:
    """Candidates that no longer candidate holds just as often.

    If a longer one holds a phrase as often, so does one with a single word
    more: what lies between them in length lies between them in frequency.
    """
    longer = candidates.where("words > 2")
    parts = F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)"))
    covers = longer.select("lang", F.explode(parts).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("covered"))
    return candidates.join(covers, ["lang", "phrase"], "left").where("covered IS NULL OR 100 * covered < 100 * a").drop("covered")


def collocations(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    least: int = 100,
    top: int | None = 2000,
    one_in: int = SAMPLE,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """The ``top`` phrases of each language by score: lang, rank, phrase, a, l, r, n, score, k (words before the cut).

    A-Z count as a-z; pieces end at ``.,;:!?`` and line ends, words at blanks and
    tabs. Null languages are ``und``, together with those called so; null, empty
    and very short texts just have fewer phrases, a text of any length is read
    whole. Rows are counted one by one, ids may repeat or be null and only
    choose the sample, which does not change the result. Equal scores are
    ordered by ``a``, then by the phrase's bytes. Other columns are ignored; an
    empty table, or one without frequent phrases, gives an empty result.
    """
    folder = new_path(docs.sparkSession, "collocations")
    chosen = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    sample = materialize(sampled(chosen, one_in).select("text", "lang"), "sample", inside=folder)
    lowered = max(2, int(least / one_in * LOWERED))
    nothing = Proposal(log2=filter_bits)
    likely, _ = frequent_phrases(sample, lowered, nothing, folder)
    shared = docs.sparkSession.sparkContext.broadcast((nothing, None))
    proposal = nothing.with_phrases(hashed(likely.where("words > 0"), shared))
    shared.destroy()
    found, _ = frequent_phrases(chosen.select("text", "lang"), least, proposal, folder)

    best = uncovered(materialize(scored(found), "scored", inside=folder))
    if top is None:
        return best
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First within buckets of each language, so that the last sort sees a bounded number of rows.
    dealt = best.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    near = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))).where(F.col("rank") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", F.col("k").cast("long").alias("k"))
