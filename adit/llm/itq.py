"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

Principal directions of a bounded sample are rotated so that signs lose as
little as possible (iterative quantisation); the signs are a vector's binary
code. The code is cut into substrings, one table each. Vectors are candidates
if a substring of theirs differs in at most ``radius`` bits; candidates are
compared by their original vectors.

Codes travel, vectors stay. A code goes to one group per table and label, or, if
labels are large, to one per piece of the substring that must agree. With it
goes a sketch, from which a lower bound of two vectors' distance follows; pairs
beyond the threshold by that bound are left out, which loses none. What is left
falls into clusters, and only their vectors are fetched and compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adit.llm.components import components, forest
from adit.workspace import materialize

#: Vectors that the rotation is fitted on, those with the smallest hashes.
SAMPLE = 20_000
TABLES = 5
#: Codes that a group is meant to receive; fuller ones are split.
PER_GROUP = 131_072
#: Vectors that are compared at once; larger clusters are split.
PER_BLOCK = 8_192
#: Fullest groups that are split; any other holds fewer vectors than each of these.
MOST_SPLIT = 1000
CANDIDATES_AT_ONCE = 50_000
#: Clusters up to this size are compared side by side, larger ones by themselves.
SMALL = 32
#: Bytes of a sketch and the width of their steps: a coordinate is at most 2.
SKETCH, STEP = 16, 2 / 127
CODES = [f"c{i}" for i in range(-(-TABLES // 2))]
SKETCHES = [f"s{i}" for i in range(SKETCH // 8)]


class Quantiser:
    """Rotations from vectors to binary codes of ``bits`` bits."""

    def __init__(self, sample: np.ndarray, bits: int, iterations: int = 40, seed: int = 7):
        self.bits, self.dim = bits, sample.shape[1]
        self.mean = sample.mean(axis=0)
        centred = sample - self.mean
        _, directions = np.linalg.eigh(centred.T @ centred)
        self.principal = directions[:, -SKETCH:]
        rng = np.random.default_rng(seed)
        projections = []
        # One rotation gives as many bits as there are dimensions; more bits come from further starts.
        for _ in range(-(-bits // self.dim)):
            flat = centred @ directions
            rotation, _ = np.linalg.qr(rng.normal(size=(self.dim, self.dim)))
            for _ in range(iterations):
                signs = np.where(flat @ rotation >= 0, 1.0, -1.0)
                u, _, v = np.linalg.svd(signs.T @ flat)
                rotation = (u @ v).T
            projections.append(directions @ rotation)
        self.projection = np.hstack(projections)[:, :bits]

    def centred(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors of other lengths are cut or padded with zeros."""
        x = np.zeros((len(vectors), self.dim))
        k = min(self.dim, vectors.shape[1])
        x[:, :k] = vectors[:, :k]
        return x - self.mean

    def substrings(self, vectors: np.ndarray, tables: int) -> np.ndarray:
        """(vectors, tables) integers."""
        signs = (self.centred(vectors) @ self.projection >= 0).reshape(len(vectors), tables, -1)
        return (signs.astype(np.int64) << np.arange(signs.shape[2])).sum(axis=2)

    def sketch(self, vectors: np.ndarray) -> np.ndarray:
        """(vectors, SKETCH) coordinates along the principal directions, in steps."""
        out = np.zeros((len(vectors), SKETCH), np.int8)
        out[:, : self.principal.shape[1]] = np.rint(self.centred(vectors) @ self.principal / STEP)
        return out


def sketch_limit(threshold: float) -> float:
    """Square of how far, in steps, the sketches of unit vectors with a cosine of ``threshold`` can be apart."""
    return ((math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6) / STEP + math.sqrt(SKETCH)) ** 2


def unit(vectors: list | np.ndarray) -> np.ndarray:
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def plan(n: int) -> tuple[int, int]:
    """(substring bits, radius) for ``n`` vectors: substrings grow with the logarithm of ``n`` so that strangers meet rarely."""
    length = min(28, max(12, math.ceil(math.log2(max(2, n)))))
    return length, 1 if length <= 18 else 2


def probes(length: int, radius: int, whole: bool) -> list[tuple[int, np.ndarray]]:
    """(mask, flips) of each piece: substrings meet if they agree under the mask, and differ by one of the flips.

    Of ``radius + 1`` pieces at least one agrees. Its flips touch all earlier
    ones, so two substrings meet in the first piece that agrees and nowhere else.
    """
    pieces = [0] if whole else [sum(1 << p for p in range(c, length, radius + 1)) for c in range(radius + 1)]
    flips = [sum(1 << p for p in places) for k in range(radius + 1) for places in combinations(range(length), k)]
    return [(mask, np.array([f for f in flips if not f & mask and all(f & before for before in pieces[:c])], np.int64)) for c, mask in enumerate(pieces)]


def _mix(*parts) -> np.ndarray:
    h = np.uint64(0x9E3779B97F4A7C15)
    for p in parts:
        h = (np.asarray(p).astype(np.int64).view(np.uint64) ^ h) * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> np.uint64(31))
    return h


def substrings_of(codes: list[np.ndarray]) -> np.ndarray:
    """(vectors, TABLES) integers, two of which travel in a number."""
    return np.stack([x for c in codes for x in (c & 0xFFFFFFFF, c >> 32)][:TABLES], axis=1)


def _spread(asking: np.ndarray, low: np.ndarray, many: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``asking[i]`` with each of the ``many[i]`` places from ``low[i]`` on, a bounded number at once."""
    ends = np.cumsum(many)
    total = int(ends[-1]) if len(ends) else 0
    for s in range(0, total, CANDIDATES_AT_ONCE):
        at = np.arange(s, min(total, s + CANDIDATES_AT_ONCE))
        i = np.searchsorted(ends, at, "right")
        yield asking[i], low[i] + at - (ends[i] - many[i])


def _pairs(cluster: np.ndarray, x: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows within a cluster, those of large clusters only if they are close; ``cluster`` is sorted."""
    _, starts, sizes = np.unique(cluster, return_index=True, return_counts=True)
    rest = np.where(sizes <= SMALL, sizes, 0)
    left = np.repeat(starts + rest, sizes) - np.arange(len(cluster))
    for apart in range(1, int(rest.max(initial=0))):
        a = np.flatnonzero(left > apart)
        for s in range(0, len(a), CANDIDATES_AT_ONCE):
            yield a[s : s + CANDIDATES_AT_ONCE], a[s : s + CANDIDATES_AT_ONCE] + apart
    for top in np.flatnonzero(sizes > SMALL):
        end = starts[top] + sizes[top]
        for i in range(starts[top], end, 1024):
            for j in range(i, end, 1024):
                a, b = np.nonzero(x[i : min(i + 1024, end)] @ x[j : min(j + 1024, end)].T >= threshold - 1e-9)
                a, b = a + i, b + j
                yield a[a < b], b[a < b]


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: id, ``n_links``, ``component_id``, ``kept``.

    Vectors link if their labels are equal and not null and their cosine, in
    double precision, is at least ``threshold``; candidates come from the
    tables, so a small share of links near the threshold may be missed. Vectors
    that are null, empty, zero or hold null or non-finite components, and
    vectors of different lengths, do not link. Equal vectors with one label are
    compared once and counted as often as they occur. Ids may repeat; the component
    of a row that links with nothing is its own id. Other columns are ignored.
    """
    spark = vectors.sparkSession
    v, label = F.col(vector_col), F.col(label_col)
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    sound = F.coalesce(label.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("id"), F.when(sound, F.xxhash64(label, v)).alias("ck"), F.when(sound, v).alias("v"), F.when(sound, F.xxhash64(label)).alias("label"))
    able = rows.where("ck IS NOT NULL")
    n = able.agg(F.countDistinct("ck")).first()[0]
    if not n:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    length, radius = plan(n)
    single = able.groupBy("ck").agg(F.first("v").alias("v"))
    share = F.pmod(F.xxhash64("ck"), F.lit(1 << 20)) / float(1 << 20)
    sample = single.where(share * n < 1.2 * SAMPLE).orderBy(share, "ck").limit(SAMPLE).select("v").toPandas()["v"].tolist()
    sample = sample or single.select("v").limit(1).toPandas()["v"].tolist()
    dim = int(np.bincount([len(x) for x in sample]).argmax())
    shared = spark.sparkContext.broadcast(Quantiser(unit([x for x in sample if len(x) == dim]), TABLES * length))
    numbers = [*CODES, *SKETCHES]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, values = batch.column(3).offsets.to_numpy(), batch.column(3).values.to_numpy(zero_copy_only=False)
            sizes = np.diff(starts)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                for i in range(0, len(at), 1024):
                    rows_at = at[i : i + 1024]
                    x = unit(values[starts[rows_at][:, None] + np.arange(size)])
                    subs = shared.value.substrings(x, TABLES)
                    codes = [subs[:, j] | (subs[:, j + 1] << 32 if j + 1 < TABLES else 0) for j in range(0, TABLES, 2)]
                    named = [batch.column(j).take(pa.array(rows_at)) for j in range(3)]
                    sketches = np.ascontiguousarray(shared.value.sketch(x)).view(np.int64).T
                    yield pa.record_batch([*named, pa.array(np.full(len(x), size, np.int32)), *map(pa.array, codes), *map(pa.array, sketches)], ["id", "ck", "label", "size", *numbers])

    kind = f"id {rows.schema['id'].dataType.simpleString()}, ck long, label long, size int, " + ", ".join(f"{c} long" for c in numbers)
    classes = able.select("id", "ck", "label", "v").mapInArrow(encode, kind).groupBy("ck").agg(F.count("*").alias("n"), F.min("id").alias("low"), *[F.min(c).alias(c) for c in ("label", "size", *numbers)])
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "itq-classes")

    labels = classes.groupBy("label", "size").count()
    # Few parts of whole substrings are less to send than their pieces.
    whole = labels.agg(F.max("count")).first()[0] <= (radius + 1) * PER_GROUP
    tests = probes(length, radius, whole)
    groups = max(1, 8 * n * TABLES * len(tests) // PER_GROUP)

    def keys(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
        """(table, piece, keys) of the codes."""
        label, size = (batch.column(c).to_numpy() for c in ("label", "size"))
        subs = substrings_of([batch.column(c).to_numpy() for c in CODES])
        for t in range(TABLES):
            for c, (mask, _) in enumerate(tests):
                yield t, c, _mix(label, size, t, c, subs[:, t] & mask).view(np.int64)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, key in keys(batch):
                yield pa.record_batch([pa.array(key)], ["k"])

    # Rows per group, to split the fullest.
    full = labels.where(F.col("count") > 2 * PER_GROUP).select("label", "size")
    load = classes.join(full, ["label", "size"], "left_semi").select("label", "size", *CODES).mapInArrow(narrow, "k long")
    load = load.groupBy("k").count().where(F.col("count") > 2 * PER_GROUP).orderBy(F.desc("count"), "k").limit(MOST_SPLIT).collect()
    split = {r["k"]: -(-r["count"] // PER_GROUP) for r in load}
    split_keys, split_parts = np.array(sorted(split), np.int64), np.array([split[k] for k in sorted(split)], np.int64)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Codes for the groups; any two parts of a split group meet in one."""
        for batch in batches:
            cid, others = batch.column("cid").to_numpy(), [batch.column(c).to_numpy() for c in numbers]
            for t, c, key in keys(batch):
                parts = np.ones(len(key), np.int64)
                if split:
                    place = np.minimum(np.searchsorted(split_keys, key), len(split_keys) - 1)
                    parts = np.where(split_keys[place] == key, split_parts[place], 1)
                at = np.repeat(np.arange(len(key)), parts)
                own, other = (cid % parts)[at], np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
                side = np.where(own == other, 3, np.where(own < other, 1, 2))
                k = _mix(key[at], np.minimum(own, other), np.maximum(own, other))
                yield pa.record_batch(
                    [pa.array((k % np.uint64(groups)).astype(np.int32)), pa.array(k.view(np.int64)), pa.array((side + 4 * t + 32 * c).astype(np.int32)), pa.array(cid[at]), *[pa.array(x[at]) for x in others]],
                    ["g", "k", "kind", "cid", *numbers],
                )

    limit = sketch_limit(threshold)

    def first_met(subs: np.ndarray, table: np.ndarray, piece: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pairs that share a group are brought together by it, and by none before."""
        apart = subs[a] ^ subs[b]
        near = np.bitwise_count(apart) <= radius
        here = np.take_along_axis(apart, table[a][:, None], 1)[:, 0]
        met = near[np.arange(len(a)), table[a]] & ~(near & (np.arange(TABLES)[None, :] < table[a][:, None])).any(axis=1)
        for c, (mask, _) in enumerate(tests):
            agrees = here & mask == 0
            met &= np.where(piece[a] == c, agrees, (piece[a] < c) | ~agrees)
        return met

    def candidates(group: pd.DataFrame) -> pd.DataFrame:
        """Clusters of what may be close enough: their blocks and members."""
        k, kind, cid = (group[c].to_numpy() for c in ("k", "kind", "cid"))
        side, table, piece = kind & 3, kind >> 2 & 7, kind >> 5
        subs = substrings_of([group[c].to_numpy() for c in CODES])
        sketch = np.ascontiguousarray(group[SKETCHES].to_numpy(np.int64)).view(np.int8).reshape(len(group), -1).astype(np.float32)
        word = np.unique(k, return_inverse=True)[1].astype(np.int64) << length | subs[np.arange(len(group)), table]
        order = np.argsort(word, kind="stable")
        index = order[side[order] & 2 > 0]
        known = word[index]
        edges = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for c, (_, flips) in enumerate(tests):
            asking = order[(side[order] & 1 > 0) & (piece[order] == c)]
            for flip in flips:
                asked = word[asking] ^ flip
                low = np.minimum(np.searchsorted(known, asked), len(known) - 1)
                hit = np.flatnonzero(known[low] == asked) if len(known) else np.zeros(0, np.int64)
                low = low[hit]
                for a, at in _spread(asking[hit], low, np.searchsorted(known, asked[hit], "right") - low):
                    b = index[at]
                    keep = (cid[a] < cid[b]) | (side[a] != 3)
                    a, b = a[keep], b[keep]
                    keep = np.square(sketch[a] - sketch[b]).sum(axis=1) <= limit
                    a, b = a[keep], b[keep]
                    met = first_met(subs, table, piece, a, b)
                    if met.any():
                        edges = forest(np.r_[edges[0], a[met]], np.r_[edges[1], b[met]])
        root = np.full(len(group), -1)
        root[edges[1]] = edges[1]
        root[edges[0]] = edges[1]
        members = np.flatnonzero(root >= 0)
        members = members[np.argsort(root[members], kind="stable")]
        tops, starts, sizes = np.unique(root[members], return_index=True, return_counts=True)
        name = _mix(k[tops], cid[tops], kind[tops]).view(np.int64)
        small = sizes <= 2 * PER_BLOCK
        at = members[np.repeat(small, sizes)]
        filled = np.cumsum(np.where(small, sizes, 0)) // PER_BLOCK
        block = _mix(k[:1], filled).view(np.int64)
        found = [pd.DataFrame({"block": np.repeat(block, np.where(small, sizes, 0)), "cluster": np.repeat(name, np.where(small, sizes, 0)), "kind": kind[at], "cid": cid[at]})]
        for top in np.flatnonzero(~small):
            at = members[starts[top] : starts[top] + sizes[top]]
            left, right = (np.array_split(x, -(-max(1, len(x)) // PER_BLOCK)) for x in (at[side[at] & 1 > 0], at[side[at] & 2 > 0]))
            alike = (side[at] == 3).all()
            for i, a in enumerate(left):
                for j, b in enumerate(right):
                    both = a if alike and i == j else np.r_[a, b]
                    new = side[both] if alike and i == j else np.repeat([1, 2], [len(a), len(b)])
                    if not alike or i <= j:
                        found.append(pd.DataFrame({"block": _mix(name[top : top + 1], i, j).view(np.int64)[0], "cluster": name[top], "kind": (kind[both] & ~3) + new, "cid": cid[both]}))
        return pd.concat(found)

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("cluster", kind="stable", ignore_index=True)
        cluster, kind, cid, size = (group[c].to_numpy() for c in ("cluster", "kind", "cid", "n"))
        side, table, piece = kind & 3, kind >> 2 & 7, kind >> 5
        subs = substrings_of([group[c].to_numpy() for c in CODES])
        longest = max(map(len, group["v"]))
        x = unit(np.stack([np.pad(np.asarray(y, np.float64), (0, longest - len(y))) for y in group["v"]]))
        links = np.zeros(len(group), np.int64)
        edges = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for a, b in _pairs(cluster, x, threshold):
            keep = (side[a] != side[b]) | (side[a] == 3)
            a, b = a[keep], b[keep]
            met = first_met(subs, table, piece, a, b)
            a, b = a[met], b[met]
            alike = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
            a, b = a[alike], b[alike]
            links += np.bincount(a, size[b], len(group)).astype(np.int64) + np.bincount(b, size[a], len(group)).astype(np.int64)
            if len(a):
                edges = forest(np.r_[edges[0], cid[a]], np.r_[edges[1], cid[b]])
        counted = np.flatnonzero(links)
        return pd.concat([pd.DataFrame({"a": cid[counted], "b": -1, "links": links[counted]}), pd.DataFrame({"a": edges[0], "b": edges[1], "links": 0})])

    sent = classes.select("label", "size", "cid", *numbers).mapInArrow(emit, "g int, k long, kind int, cid long, " + ", ".join(f"{c} long" for c in numbers))
    clusters = materialize(sent.groupBy("g").applyInPandas(candidates, "block long, cluster long, kind int, cid long"), "itq-clusters")
    asked = clusters.join(classes.select("cid", "ck", "n", *CODES), "cid").join(single, "ck")
    met = materialize(asked.select("block", "cluster", "kind", "cid", "n", *CODES, "v").groupBy("block").applyInPandas(compare, "a long, b long, links long"), "itq-links")
    links = met.where("b < 0").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    reach = components(met.where("b >= 0").select("a", "b")).withColumnRenamed("node", "cid")
    found = classes.select("cid", "ck", "n", "low").join(links, "cid", "left").join(reach, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    lowest = found.groupBy("component").agg(F.min("low").alias("component_id"))
    found = found.join(lowest, "component").select("ck", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    component = F.coalesce("component_id", F.col("id")).cast("long")
    return rows.select("id", "ck").join(found, "ck", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept")
    )
