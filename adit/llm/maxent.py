"""Language-model scores from a hashed maximum-entropy model.

A token's class and its bucket within the class are bits of its hash. The model
is class-factored::

    P(token | context) = P(class | context) P(bucket | class, context) P(token | bucket)

The first two factors are softmaxes over hashed features of the context: the
word before, the one before that (a skip), and both together. The last is the
add-one share of the token's count in its bucket, so the probabilities of all
training tokens and one unknown token per bucket add up to one.

Tokens are hashed a batch of texts at a time; no token becomes an object.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adit.workspace import materialize, materialize_counted

CLASSES = BUCKETS = 16
SLOTS = 1 << 15
FEATURES = 3
#: Passes of distributed updates; each takes an equal share of the training texts, together all of them.
ROUNDS = 2
RATE = 0.15
MINIBATCH = 16384
#: Tokens whose counts are broadcast at most, those with most occurrences; the rest are joined.
FREQUENT = 200_000
GROUP_BYTES = 1 << 20
BLOCKS = 64

_END = np.uint64(0x243F6A8885A308D3)
_BEFORE = np.uint64(0x13198A2E03707344)
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint64) + 1
_LOWER[65:91] += 32
_tables: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _tables
    if len(_tables[0]) < n:
        _tables = tuple(np.cumprod(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)], dtype=np.uint64) for base in (_STEP, _BACK))
    return _tables


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of some texts in order, and how many each text has.

    A-Z are lower-cased, words are separated by the six ASCII white spaces, each
    text closes with one end token.
    """
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    bounds = np.r_[0, np.cumsum([len(r) + 1 for r in raws])]
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True))  # words begin and end by turns; the text closes with a space
    starts, ends = edge[0::2], edge[1::2]
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LOWER[data] * power[: len(data)], out=sums[1:])
    words = _mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    per_text = np.diff(np.searchsorted(starts, bounds))
    sizes = per_text + 1
    out = np.full(len(words) + len(raws), _END)
    closing = np.zeros(len(out), bool)
    closing[np.cumsum(sizes) - 1] = True
    out[~closing] = words
    return out, sizes


def groups(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, texts) of about ``GROUP_BYTES`` characters; a longer text alone."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > GROUP_BYTES:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, texts[first:]


def classes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h & np.uint64(CLASSES - 1)).astype(np.int64), ((h >> np.uint64(4)) & np.uint64(BUCKETS - 1)).astype(np.int64)


def contexts(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of the context features of every token: (tokens, FEATURES)."""
    start = np.zeros(len(h), bool)
    start[np.cumsum(sizes)[:-1]] = True
    start[0] = True
    one = np.r_[_BEFORE, h[:-1]]
    one[start] = _BEFORE
    second = start | np.r_[True, start[:-1]]
    two = np.r_[_BEFORE, _BEFORE, h[:-2]][: len(h)]
    two[second] = _BEFORE
    return np.stack([_mix(one + np.uint64(1)), _mix(two + np.uint64(2)), _mix(one * np.uint64(3) + _mix(two))], axis=1)


def slots(context: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
    """Rows of a weight table."""
    return ((context + np.uint64(_STEP) * np.asarray(salt, np.uint64)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - 15)).astype(np.uint16)


def _probabilities(bias: np.ndarray, table: np.ndarray, at: np.ndarray) -> np.ndarray:
    z = bias + table[at[:, 0]]
    for k in range(1, FEATURES):
        z += table[at[:, k]]
    np.minimum(z, 60, out=z)  # far beyond what weights add up to
    np.exp(z, out=z)
    z /= (z @ np.ones(z.shape[1], z.dtype))[:, None]
    return z


class Weights:
    """Two softmaxes of fixed size."""

    def __init__(self, class_bias: np.ndarray, bucket_bias: np.ndarray, table: np.ndarray):
        self.class_bias, self.bucket_bias, self.table = class_bias, bucket_bias, table

    def logs(self, h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log10 of class and bucket probability of every token."""
        out = np.empty(len(h))
        context = contexts(h, sizes)
        c, b = classes(h)
        for i in range(0, len(h), MINIBATCH):
            cut = slice(i, i + MINIBATCH)
            row = np.arange(len(h[cut]))
            p = _probabilities(self.class_bias, self.table[0], slots(context[cut], 0))[row, c[cut]]
            q = _probabilities(self.bucket_bias[c[cut]], self.table[1], slots(context[cut], 1 + c[cut][:, None]))[row, b[cut]]
            out[cut] = np.log10(p.astype(np.float64)) + np.log10(q.astype(np.float64))
        return out


class Trainer:
    """Minibatch updates with a step size of its own for each row of the tables."""

    def __init__(self, weights: Weights):
        self.weights = weights
        self.table = weights.table.copy()
        self.power = np.full(self.table.shape[:2], 0.1, np.float32)
        self.seen = 0

    def update(self, h: np.ndarray, sizes: np.ndarray) -> None:
        context = contexts(h, sizes)
        c, b = classes(h)
        for i in range(0, len(h), MINIBATCH):
            cut = slice(i, i + MINIBATCH)
            self._step(0, self.weights.class_bias, slots(context[cut], 0), c[cut])
            self._step(1, self.weights.bucket_bias[c[cut]], slots(context[cut], 1 + c[cut][:, None]), b[cut])
        self.seen += len(h)

    def _step(self, level: int, bias: np.ndarray, at: np.ndarray, truth: np.ndarray) -> None:
        slope = _probabilities(bias, self.table[level], at)
        slope[np.arange(len(truth)), truth] -= 1
        flat = at.ravel()
        order = np.argsort(flat, kind="stable")  # 16-bit keys: a radix sort
        sorted_ = flat[order]
        first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
        total = np.add.reduceat(slope[order // FEATURES], first, axis=0)
        rows = sorted_[first]
        self.power[level, rows] += (total * total).mean(axis=1)
        self.table[level, rows] -= RATE * total / np.sqrt(self.power[level, rows])[:, None]


def _texts(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def count_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """(h, n): how often each token occurs in the whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, index = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(index, np.concatenate([n for _, n in held])).astype(np.int64)

        for batch in batches:
            for _, group in groups(batch.column(0).to_pylist()):
                held.append(np.unique(tokens(group)[0], return_counts=True))
                size += len(held[-1][0])
                if size > 2_000_000:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > 1_000_000:
                        yield from _rows(*held[0])
                        held, size = [], 0
        if held:
            yield from _rows(*merged())

    def _rows(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(keys), 100_000):
            yield pa.record_batch([pa.array(keys[i : i + 100_000].view(np.int64)), pa.array(n[i : i + 100_000])], ["h", "n"])

    return _texts(docs, text).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _updates(docs: DataFrame, weights: Weights, text: str) -> np.ndarray:
    """One round: every task updates its own copy on its texts; the changes are averaged by tokens seen.

    A task sends its change in blocks of rows; blocks are added up first within
    groups of tasks, then over the groups. What comes back has the size of the tables.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    shape = weights.table.shape

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer(shared.value)
        for batch in batches:
            for _, group in groups(batch.column(0).to_pylist()):
                trainer.update(*tokens(group))
        if trainer.seen:
            change = (trainer.table - shared.value.table).astype(np.float16).reshape(BLOCKS, -1)
            part = TaskContext.get().partitionId() % 64
            yield pa.record_batch([pa.array([part] * BLOCKS, pa.int32()), pa.array(np.arange(BLOCKS, dtype=np.int32)), pa.array([trainer.seen] * BLOCKS, pa.int64()), pa.array([x.tobytes() for x in change], pa.binary())], ["part", "block", "seen", "change"])

    def add(half: bool):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            total = 0.0
            for seen, raw in zip(group["seen"], group["change"]):
                total = total + (np.frombuffer(raw, np.float16).astype(np.float64) * seen if half else np.frombuffer(raw, np.float64))
            return pd.DataFrame({"block": group["block"][:1], "seen": [int(group["seen"].sum())], "change": [total.tobytes()]})

        return run

    kind = "block int, seen long, change binary"
    sent = _texts(docs, text).mapInArrow(learn, "part int, block int, seen long, change binary")
    partial = sent.groupBy("part", "block").applyInPandas(add(True), kind)
    found = partial.groupBy("block").applyInPandas(add(False), kind).collect()
    if not found:
        return weights.table
    size = shape[0] * shape[1] * shape[2] // BLOCKS
    change = np.zeros((BLOCKS, size))
    for r in found:
        change[r["block"]] = np.frombuffer(r["change"], np.float64) / r["seen"]
    return (weights.table + change.reshape(shape)).astype(np.float32)


def _frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and log10(count + 1) of at most ``FREQUENT`` tokens with the largest counts."""
    level = F.floor(F.log2("n") * 8)
    sizes = sorted(((r["level"], r["tokens"]) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("tokens")).collect()), reverse=True)
    total, least = 0, None
    for at, tokens_ in sizes:
        total += tokens_
        if total > FREQUENT:
            break
        least = at
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0)
    top = counts.where(level >= least).select("h", "n").toArrow()
    h = top["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], np.log10(top["n"].to_numpy()[order] + 1.0)


def scores(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score all whole texts by a model of those where ``learn`` holds.

    Returns the id, ``n_tokens``, ``n_known`` (tokens that occur in training),
    ``train_tokens``, ``base_score`` (add-one unigrams) and ``score``, both log10
    probabilities of the text. Null texts count as empty: one end token. Ids may
    repeat or be null. Without training texts every token is unknown.

    Counts of all training tokens are exact. Those of the most frequent tokens,
    a fixed number, are broadcast; occurrences of others are joined with their counts.
    """
    spark = docs.sparkSession
    train = docs.where(learn)
    counts = materialize(count_tokens(train, text_col), "maxent-counts")
    in_class, in_bucket = F.col("h").bitwiseAND(CLASSES - 1), F.shiftright("h", 4).bitwiseAND(BUCKETS - 1)
    totals = counts.groupBy(in_class.alias("c"), in_bucket.alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    mass = np.ones((CLASSES, BUCKETS))
    for r in totals:
        mass[r["c"], r["b"]] += r["n"] + r["v"]
    train_tokens = sum(r["n"] for r in totals)
    base_size = train_tokens + sum(r["v"] for r in totals) + 1
    weights = Weights(
        np.log(mass.sum(axis=1) / mass.sum()).astype(np.float32),
        np.log(mass / mass.sum(axis=1, keepdims=True)).astype(np.float32),
        np.zeros((2, SLOTS, CLASSES), np.float32),
    )
    share = F.pmod(F.xxhash64(text_col), F.lit(ROUNDS))
    for k in range(ROUNDS):
        weights.table = _updates(train.where(F.coalesce(share, F.lit(0)) == k), weights, text_col)
    frequent, logs = _frequent(counts)
    shared = spark.sparkContext.broadcast((weights, frequent, logs, np.log10(mass)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, frequent, logs, log_mass = shared.value
        for batch in batches:
            parts = []
            for first, group in groups(batch.column(1).to_pylist()):
                h, sizes = tokens(group)
                at = np.r_[0, np.cumsum(sizes)[:-1]]
                c, b = classes(h)
                place = np.minimum(np.searchsorted(frequent, h), max(0, len(frequent) - 1))
                found = frequent[place] == h if len(frequent) else np.zeros(len(h), bool)
                count = np.where(found, logs[place], 0.0) if len(frequent) else np.zeros(len(h))
                model = weights.logs(h, sizes) - log_mass[c, b]
                text = np.repeat(np.arange(len(sizes)), sizes)
                # Occurrences of the other tokens, once per text.
                rest = np.flatnonzero(~found)
                pairs = np.lexsort((h[rest], text[rest]))
                rest = rest[pairs]
                new = np.r_[True, (h[rest][1:] != h[rest][:-1]) | (text[rest][1:] != text[rest][:-1])] if len(rest) else np.zeros(0, bool)
                starts = np.flatnonzero(new)
                times = np.diff(np.r_[starts, len(rest)])
                offsets = np.searchsorted(text[rest[starts]], np.arange(len(sizes) + 1))
                columns = [
                    batch.column(0).slice(first, len(group)),
                    pa.array(sizes.astype(np.int64)),
                    pa.array(np.add.reduceat(found.astype(np.int64), at)),
                    pa.array(np.add.reduceat(count, at)),
                    pa.array(np.add.reduceat(model, at)),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(h[rest[starts]].view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(times.astype(np.int64))),
                ]
                parts.append(pa.record_batch(columns, ["id", "n_tokens", "known", "counted", "model", "h", "times"]))
            yield from parts

    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    scored = chosen.mapInArrow(run, f"id {kind}, n_tokens long, known long, counted double, model double, h array<long>, times array<long>")
    scored, _ = materialize_counted(scored.withColumn("row", F.monotonically_increasing_id()), "maxent-scored")
    rare = scored.select("row", F.explode(F.arrays_zip("h", "times")).alias("x")).select("row", F.col("x.h").alias("h"), F.col("x.times").alias("times"))
    met = rare.join(counts, "h").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("added"))
    added, more = F.coalesce("added", F.lit(0.0)), F.coalesce("more", F.lit(0))
    return scored.drop("h", "times").join(met, "row", "left").select(
        F.col("id").alias(id_col),
        "n_tokens",
        (F.col("known") + more).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("counted") + added - F.col("n_tokens") * F.log10(F.lit(float(base_size)))).alias("base_score"),
        (F.col("model") + F.col("counted") + added).alias("score"),
    )


def held_out(doc_id: Column, parts: int = 7, part: int = 2) -> Column:
    """Whether a document is kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))
