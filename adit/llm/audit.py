"""Interaction of filters, audited on a sparse document-term matrix.

Documents become shards of a matrix in compressed sparse rows, each with a
dictionary of its own. The dictionaries, not the words, are shuffled: equal
words meet, get one global number, and the columns of every shard are
renumbered by it. Sums of rows and numbers of non-zero entries decide the two
filters on words; the other flags are attached and rows are counted by (part,
set of failed filters). Every order of the filters follows from those counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adit.llm.wordbytes import WHITE_SPACE, cut, slices
from adit.workspace import materialize, materialize_counted, new_path

#: Bytes of text in a shard; a longer text is a shard of its own.
SHARD_BYTES = 12 << 20
FILTERS = "ABCDE"


class Matrix(NamedTuple):
    """``shards``: (shard, docs, indptr, steps, counts, ids), entries packed, and ``dictionary``: (word, word_id).

    ``ids`` are the words of the shard by their numbers in the dictionary.
    """

    shards: DataFrame
    dictionary: DataFrame


def _pack(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, first all their low bytes, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, n * 4, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _one_list(values: pa.Array | np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values if isinstance(values, pa.Array) else pa.array(values))


def local_shards(docs: DataFrame, text_col: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Shards with their own dictionaries: (shard, docs, indptr, steps, counts, words).

    ``docs`` lists the other columns of each document as a struct; row k of a
    shard has the entries from ``indptr[k]`` up to ``indptr[k + 1]``. Columns
    are packed as steps from the one before in the row.
    """
    kept = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch.column(0)
            for at, to in slices(texts, shard_bytes):
                found = cut(texts.slice(at, to - at), WHITE_SPACE)
                coded = found.text.dictionary_encode()
                width = max(1, len(coded.dictionary))
                cell, counts = np.unique(found.row.astype(np.int64) * width + coded.indices.to_numpy(), return_counts=True)
                indptr = np.searchsorted(cell, np.arange(to - at + 1, dtype=np.int64) * width).astype(np.int32)
                column = cell % width
                steps = np.diff(column, prepend=0)
                heads = indptr[:-1][indptr[:-1] < indptr[1:]]
                steps[heads] = column[heads]
                one = [pa.array([_pack(steps)], pa.binary()), pa.array([_pack(counts)], pa.binary())]
                lists = [_one_list(batch.column(1).slice(at, to - at)), _one_list(indptr), *one, _one_list(coded.dictionary)]
                yield pa.record_batch([pa.array([number]), *lists], ["shard", "docs", "indptr", "steps", "counts", "words"])
                number += 1

    sent = docs.select(F.col(text_col).cast("string").alias("_text"), F.struct(*kept).alias("_doc"))
    doc = sent.schema["_doc"].dataType.simpleString()
    return sent.mapInArrow(run, f"shard long, docs array<{doc}>, indptr array<int>, steps binary, counts binary, words array<string>")


def _entries(row: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row bounds, global columns and counts of one shard of a matrix."""
    bounds, ids = row.column("indptr").flatten().to_numpy().astype(np.int64), row.column("ids").flatten().to_numpy()
    n = int(bounds[-1])
    if len(np.unique(ids)) < len(ids):
        raise AssertionError("two words of a shard have one number")
    total = np.concatenate([[0], np.cumsum(_unpack(row.column("steps")[0].as_py(), n))])
    local = total[1:] - np.repeat(total[bounds[:-1]], np.diff(bounds))
    columns = ids[local] if n else np.zeros(0, np.int64)
    return bounds, columns, _unpack(row.column("counts")[0].as_py(), n)


def unpacked(shards: DataFrame) -> DataFrame:
    """(shard, docs, indptr, columns, counts) of a matrix, as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1)
                _, columns, counts = _entries(row)
                lists = [_one_list(columns), _one_list(counts)]
                yield pa.record_batch([*row.select(["shard", "docs", "indptr"]).columns, *lists], ["shard", "docs", "indptr", "columns", "counts"])

    doc = shards.schema["docs"].dataType.simpleString()
    return shards.mapInArrow(run, f"shard long, docs {doc}, indptr array<int>, columns array<long>, counts array<long>")


def row_statistics(shards: DataFrame) -> DataFrame:
    """The documents of a matrix with ``n_words`` (sum of the row) and ``n_distinct`` (its non-zero entries)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1)
                bounds, _, counts = _entries(row)
                sums = np.concatenate([[0], np.cumsum(counts)])
                yield pa.record_batch([row.column("docs").flatten(), pa.array(sums[bounds[1:]] - sums[bounds[:-1]]), pa.array(np.diff(bounds))], ["doc", "n_words", "n_distinct"])

    doc = shards.schema["docs"].dataType.elementType.simpleString()
    return shards.mapInArrow(run, f"doc {doc}, n_words long, n_distinct long").select("doc.*", "n_words", "n_distinct")


def document_term_matrix(docs: DataFrame, text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> Matrix:
    """Matrix of word counts of whole texts, with one dictionary for all.

    Words lie between the six ASCII white spaces and keep their case; a null
    text is a row without entries. All other columns of ``docs`` go along. Words
    are numbered within buckets of a hash, as many as there are shards.
    """
    local, n = materialize_counted(local_shards(docs, text_col, shard_bytes), "shards", inside=new_path(docs.sparkSession, "terms"))
    buckets = F.lit(max(1, n)).cast("long")
    words = local.select("shard", F.posexplode("words").alias("place", "word"))
    dealt = words.withColumn("bucket", F.pmod(F.xxhash64("word"), buckets))
    rank = F.dense_rank().over(Window.partitionBy("bucket").orderBy("word")).cast("long") - 1
    coded = dealt.select("shard", "place", "word", (rank * buckets + F.col("bucket")).alias("word_id"))
    ids = coded.select("shard", "place", "word_id").groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("place", "word_id"))).alias("ids"))
    # A shard of blank texts has no words.
    none = F.array().cast("array<bigint>")
    shards = local.drop("words").join(ids.select("shard", F.col("ids.word_id").alias("ids")), "shard", "left")
    shards = shards.select("shard", "docs", "indptr", "steps", "counts", F.coalesce("ids", none).alias("ids"))
    return Matrix(shards, coded.groupBy("word").agg(F.min("word_id").alias("word_id")))


def failures(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id, part, failed): the bits of ``failed`` from the lowest on are filters A to E.

    A: under 200 words; B: under half of the words are distinct; C: over 2 in
    100 code points are A-Z; D: holds one of ``#$%&*|``; E: a smaller id has the
    same text. Null texts are empty. A null id is neither smaller nor larger
    than others; rows of one id do not fail E for each other.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    noted = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        (F.when(capitals * 100 > F.length(text) * 2, 4).otherwise(0) + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)).alias("signs"),
        text.alias("text"),
    )
    rows = row_statistics(document_term_matrix(noted).shards)
    words = F.when(F.col("n_words") < 200, 1).otherwise(0) + F.when(F.col("n_distinct") * 100 < F.col("n_words") * 50, 2).otherwise(0)
    rows = materialize(rows.select("doc_id", "part", "digest", (words + F.col("signs")).alias("own")), "audit-rows")
    # The first id of a text is found on both columns, so copies of one text do not meet in one task.
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copied = F.when(F.col("first").isNull() & F.col("doc_id").isNotNull(), 16).otherwise(0)
    return rows.join(firsts, ["digest", "doc_id"], "left").select(F.col("doc_id").alias(id_col), "part", (F.col("own") + copied).alias("failed"))


def interactions(counts: DataFrame) -> DataFrame:
    """All orders of the filters from (part, failed, n, good, toxic), one row per distinct part and set of failed filters.

    A filter is first among the k that a document fails in one of k orders, so
    its share of all orders is a k-th of them.
    """
    entry = F.struct("failed", "n", "good", "toxic")
    parts = counts.groupBy("part").agg(F.collect_list(entry).alias("sets"))  # at most 32 a part
    orders = ["".join(p) for p in permutations(FILTERS)]
    bit = lambda letter: F.call_function("shiftleft", F.lit(1), F.ascii(letter) - ord("A"))
    steps = parts.select("*", F.explode(F.array(*map(F.lit, orders))).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    earlier = F.aggregate(F.split(F.substring("filter_order", F.lit(1), F.col("step") - 1), ""), F.lit(0), lambda acc, x: acc.bitwiseOR(F.when(x != "", bit(x)).otherwise(0)))
    steps = steps.withColumn("own", bit(F.substring("filter_order", F.col("step"), F.lit(1)))).withColumn("earlier", earlier)

    def total(holds, of=lambda e: e["n"]) -> Column:
        return F.aggregate(F.filter("sets", holds), F.lit(0).cast("long"), lambda acc, e: acc + of(e))

    own, before = F.col("own"), F.col("earlier")
    fails = lambda e: e["failed"].bitwiseAND(own) != 0
    gone = lambda e: e["failed"].bitwiseAND(before) != 0
    removed = lambda e: fails(e) & ~gone(e)
    return steps.select(
        "part",
        "filter_order",
        "step",
        total(lambda e: ~fails(e) & ~gone(e)).alias("kept"),
        total(removed).alias("removed"),
        total(lambda e: fails(e) & gone(e)).alias("redundant"),
        total(lambda e: e["failed"] == own).alias("unique_fails"),
        total(removed, lambda e: e["good"]).alias("good_lost"),
        total(removed, lambda e: e["toxic"]).alias("toxic_lost"),
        total(fails, lambda e: e["n"] * F.floor(F.lit(len(orders)) / F.bit_count(e["failed"]))).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Effect of five filters in all 120 orders, per source and step; zeros included.

    ``labels`` has the id, ``quality`` and ``toxic``; where an id repeats there,
    any 1 counts. Rows of ``docs`` are counted one by one, ids may repeat or be
    null (then without labels). Null and empty sources are one part, null texts are empty, a text of
    any length is read whole. Other columns are ignored. An empty table gives
    an empty result.
    """
    is_one = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("long"), F.lit(0)))
    marks = labels.groupBy(F.col(id_col).alias("doc_id")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    rows = failures(docs, id_col, source_col, text_col).withColumnRenamed(id_col, "doc_id").join(marks, "doc_id", "left")
    counts = rows.groupBy("part", "failed").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")
    )
    return interactions(counts)
