"""SimHash near-duplicates by meeting in the middle of Hamming balls.

Two fingerprints at most ``2r`` bits apart have a word at most ``r`` bits from
both. Every distinct fingerprint emits all its variants within ``r`` bits and
fingerprints that share a variant are linked.

Variants travel by a prefix of their own: the parities of ``bits`` classes of
their bit positions. Flipping one bit turns one parity, so the variants of a
fingerprint fall into 1 + bits + bits (bits - 1) / 2 buckets. The shuffle sends
the fingerprint once to each of them, and the variants that lie in the bucket
are spelled out behind it. That is some forty rows instead of two thousand.
Parities also keep fingerprints that differ little apart, so groups of near
copies spread over the buckets.

All members of a variant are pairwise within ``2r`` bits, so linking each to
the smallest is enough; each bucket returns a spanning forest of its links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adit.llm.bpe import in_worker
from adit.llm.components import components, forest
from adit.workspace import materialize, materialize_counted

WIDTH = 64
#: Fingerprints that a bucket is meant to receive.
PER_BUCKET = 20_000


def fingerprint(text: str, shingle: int = 4) -> int:
    """SimHash of a text; ``None`` or no word: zero.

    A-Z are lower-cased, words are separated by the six ASCII white spaces,
    shingles are joined by a space and count as often as they occur; a text of
    fewer words is one shingle. A bit is set if it is set in more than half of
    the shingles' XXH64 hashes (UTF-8, seed 42).
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    if n == 1:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[: n - 1] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], 42) for s, e in zip(starts, ends[shingle - 1 :].tolist())]
    counts = np.zeros(WIDTH, np.int64)
    for k in range(0, n, 1 << 16):
        part = np.array(hashes[k : k + (1 << 16)], dtype=">u8")
        counts += np.unpackbits(part.view(np.uint8)).reshape(-1, WIDTH).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp) with the fingerprint as a signed long; whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_worker("no caches", tuple)
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(fps)], ["id", "fp"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, f"id {chosen.schema['id'].dataType.simpleString()}, fp long")


def _classes(bits: int) -> list[list[int]]:
    return [list(range(c, WIDTH, bits)) for c in range(bits)]


def _parities(fp: Column, bits: int) -> Column:
    total = F.lit(0).cast("int")
    for c, members in enumerate(_classes(bits)):
        mask = sum(1 << p for p in members)
        mask -= (mask >> 63) << 64
        total = total.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseAND(F.lit(mask))) % 2, c))
    return total


def _flips(bits: int, radius: int) -> dict[int, np.ndarray]:
    """Masks of at most ``radius`` bits by the parities that they turn."""
    found: dict[int, list[int]] = {}
    for k in range(radius + 1):
        for places in combinations(range(WIDTH), k):
            turned = mask = 0
            for p in places:
                turned ^= 1 << (p % bits)
                mask |= 1 << p
            found.setdefault(turned, []).append(mask)
    return {t: np.array(m, np.uint64) for t, m in found.items()}


def bucket_bits(n: int, radius: int) -> int:
    """Parities for ``n`` fingerprints, so that buckets keep their size as the input grows."""
    bits = 4
    while bits < 24 and n * sum(math.comb(bits, k) for k in range(radius + 1)) > PER_BUCKET * 2**bits:
        bits += 1
    return bits


def links(fps: DataFrame, n: int, distance: int = 4) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs within ``distance`` bits.

    ``fps`` has distinct longs ``fp``; ``n`` is about their number. ``distance``
    is even.
    """
    radius = distance // 2
    bits = bucket_bits(n, radius)
    flips = _flips(bits, radius)

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        fp, turned = group["fp"].to_numpy(np.int64).view(np.uint64), group["turned"].to_numpy()
        words, owners = [], []
        for t in np.unique(turned):
            members = fp[turned == t]
            words.append((members[:, None] ^ flips[int(t)][None, :]).ravel())
            owners.append(np.repeat(members, len(flips[int(t)])))
        word, owner = np.concatenate(words), np.concatenate(owners)
        order = np.argsort(word, kind="stable")
        word, owner = word[order], owner[order]
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        sizes = np.diff(np.r_[first, len(word)])
        met = sizes > 1
        if not met.any():
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        lowest = np.minimum.reduceat(owner, first)
        other = np.repeat(met, sizes)
        a, b = owner[other], np.repeat(lowest[met], sizes[met])
        if int(np.bitwise_count(a ^ b).max()) > distance:
            raise AssertionError("fingerprints that share a variant must lie within the distance")
        a, b = forest(a, b)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    sent = fps.select("fp", _parities(F.col("fp"), bits).alias("p"))
    sent = sent.select("fp", "p", F.explode(F.array(*map(F.lit, sorted(flips)))).alias("turned"))
    sent = sent.select(F.col("p").bitwiseXOR(F.col("turned")).alias("bucket"), "turned", "fp")
    return sent.groupBy("bucket").applyInPandas(meet, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, shingle: int = 4) -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 hexadecimal digits) and
    ``component_id``, the smallest id reachable over links of at most
    ``distance`` bits, itself included.

    Null and empty texts have fingerprint zero and are linked like others. Equal
    fingerprints meet once, whatever their number. Repeated ids stay repeated
    rows; a null id counts as larger than any other. Other columns of ``docs``
    are ignored, an empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash")
    classes, n = materialize_counted(prints.groupBy("fp").agg(F.min("id").alias("low")), "simhash-classes")
    reach = components(links(classes.select("fp"), n, distance))
    found = classes.join(reach.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    # The smallest id of a component; most components are one fingerprint.
    lowest = found.groupBy("component").agg(F.min("low").alias("component_id"))
    found = found.join(lowest, "component").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(found, "fp").select(F.col("id").alias(id_col), hexed, "component_id")
