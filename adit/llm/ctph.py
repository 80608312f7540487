"""Document fingerprints by context-triggered piecewise hashing.

A hash of the last seven bytes decides where a piece of the text ends, so
boundaries follow the content: an edit changes the pieces it touches and no
others. A fingerprint lists a 12-bit hash per piece (two base-64 digits each) at
a block size fitting the length, and again at twice that size::

    block size:pieces:pieces at twice the size

Two fingerprints are compared by edit distance at a block size they share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adit.workspace import materialize

WINDOW = 7
SMALLEST_BLOCK = 3
#: Pieces expected at most; a signature has at most twice as many, the last one being all that is left.
PIECES = 64
_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 2**64)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        _powers = tuple(np.cumprod(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)], dtype=np.uint64) for base in (_STEP, _BACK))
    return _powers


def block_size(n_bytes: int) -> int:
    size = SMALLEST_BLOCK
    while size * PIECES < n_bytes:
        size *= 2
    return size


def _signature(hashes: np.ndarray) -> str:
    return "".join([_DIGITS[h >> 6] + _DIGITS[h & 63] for h in hashes.tolist()])


def fingerprint_all(texts: list[str], at_once: int = 1 << 20) -> list[str]:
    """Fingerprints of texts, about ``at_once`` bytes together (a longer text alone)."""
    out: list[str] = []
    group: list[bytes] = []
    size = 0
    for text in texts:
        raw = text.encode("utf-8", "surrogatepass")
        if group and size + len(raw) > at_once:
            out += _fingerprints(group)
            group, size = [], 0
        group.append(raw)
        size += len(raw)
    return out + _fingerprints(group) if group else out


def _fingerprints(raws: list[bytes]) -> list[str]:
    lengths = np.array([len(r) for r in raws], np.int64)
    starts = np.r_[0, np.cumsum(lengths)]
    data = np.frombuffer(b"".join(raws), np.uint8)
    n = len(data)
    blocks = [block_size(int(k)) for k in lengths]
    wide = data.astype(np.uint32)
    roll = np.zeros(n, np.uint32)
    for back in range(min(WINDOW, n)):
        roll[back:] += wide[: n - back] * np.uint32(pow(0x01000193, back + 1, 2**32))
    roll ^= roll >> np.uint32(15)
    roll *= np.uint32(0x2C1B3C6D)
    limit = np.repeat(np.array([2**32 // b for b in blocks], np.uint32), lengths)
    ends = np.flatnonzero(roll < limit)
    roll_at = roll[ends]
    doc = np.searchsorted(starts, ends, side="right") - 1
    inside = (ends - starts[doc] >= WINDOW - 1) & (ends + 1 < starts[doc + 1])  # a full window; the end closes a piece anyway
    ends, doc, roll_at = ends[inside] + 1, doc[inside], roll_at[inside]
    power, inverse = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])

    def hashes(cuts: np.ndarray) -> np.ndarray:
        h = (sums[cuts[1:]] - sums[cuts[:-1]]) * inverse[cuts[:-1]]
        h ^= h >> np.uint64(29)
        return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(52)).astype(np.int64)

    bounds = np.searchsorted(doc, np.arange(len(raws) + 1))
    out = []
    for k, block in enumerate(blocks):
        a, b = int(starts[k]), int(starts[k + 1])
        if a == b:
            out.append(f"{block}::")
            continue
        mine = slice(bounds[k], bounds[k + 1])
        cuts = ends[mine]
        coarse = cuts[roll_at[mine] < 2**32 // (2 * block)]
        fine = hashes(np.r_[a, cuts[: 2 * PIECES - 1], b])
        out.append(f"{block}:{_signature(fine)}:{_signature(hashes(np.r_[a, coarse[: PIECES - 1], b]))}")
    return out


def _common(a: str, b: str) -> float:
    """2 LCS / (lengths): 1 less the edit distance of insertions and deletions per piece."""
    x = [a[i : i + 2] for i in range(0, len(a), 2)]
    y = [b[i : i + 2] for i in range(0, len(b), 2)]
    if not x or not y:
        return float(not x and not y)
    places: dict[str, int] = {}
    for i, s in enumerate(x):
        places[s] = places.get(s, 0) | 1 << i
    full = row = (1 << len(x)) - 1
    for s in y:
        if s in places:
            hit = row & places[s]
            row = ((row + hit) | (row - hit)) & full
    return 2 * (len(x) - row.bit_count()) / (len(x) + len(y))


def likeness(a: str, b: str) -> float:
    """0 to 1: nothing in common or no block size in common, to equal."""
    if a == b:
        return 1.0
    (p, p1, p2), (q, q1, q2) = a.split(":"), b.split(":")
    if p == q:
        return max(_common(p1, q1), _common(p2, q2))
    if int(p) == 2 * int(q):
        return _common(p1, q2)
    if 2 * int(p) == int(q):
        return _common(p2, q1)
    return 0.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``fingerprint``) of every whole text; null counts as empty. Equal texts have equal fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(fingerprint_all([t or "" for t in batch.column(1).to_pylist()]), pa.string())], ["id", "fingerprint"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, f"id {chosen.schema['id'].dataType.simpleString()}, fingerprint string").withColumnRenamed("id", id_col)


def _compare(texts: list[str], following: list[str], prints: list[str], next_prints: list[str]) -> dict[str, list]:
    edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(texts, following)]
    edited_prints = fingerprint_all(edited)
    return {
        "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
        "fingerprint": prints,
        "edited_fingerprint": edited_prints,
        "near_edited": list(map(likeness, prints, edited_prints)),
        "near_next": list(map(likeness, prints, next_prints)),
    }


_COMPARED = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _batch(columns: dict[str, list], kinds: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(columns[f.name], f.type) for f in kinds], schema=kinds)


def edit_trial(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text and its edited text, and compare.

    The edited text has the last half of the code points (rounded down)
    replaced by the first as many, or all, of the next document's in descending
    id; the last document is followed by the first. Null text counts as empty, rows
    with equal ids follow a hash of their texts, null ids come last, a single
    document follows itself.

    Texts are dealt by ranges of id once. Within a range the next document is
    the next row; the last row of each range meets the first of the next range
    in a join of one row per range.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    chosen = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))
    ranged = chosen.repartitionByRange(F.desc("id"), F.col("h")).sortWithinPartitions(F.desc("id"), "h").select("id", "text")
    compared = [f.split(" ")[0] for f in _COMPARED.split(", ")]

    def kinds_of(id_type: pa.DataType, *more: str) -> pa.Schema:
        types = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
        return pa.schema([("part", pa.int32()), ("id", id_type), *((f.split(" ")[0], types[f.split(" ")[1]]) for f in [*_COMPARED.split(", "), *more])])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: tuple | None = None  # id, text, fingerprint, text again if first of its range
        schema = None
        for batch in batches:
            if not batch.num_rows:
                continue
            schema = kinds_of(batch.schema.field(0).type, "head string", "tail string")
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            prints = fingerprint_all(texts)
            rows = list(zip(ids, texts, prints, [texts[0] if held is None else None] + [None] * (len(ids) - 1)))
            if held is not None:
                rows.insert(0, held)
            now, after = rows[:-1], rows[1:]
            held = rows[-1]
            if now:
                columns = _compare([r[1] for r in now], [r[1] for r in after], [r[2] for r in now], [r[2] for r in after])
                yield _batch(columns | {"part": [part] * len(now), "id": [r[0] for r in now], "head": [r[3] for r in now], "tail": [None] * len(now)}, schema)
        if held is not None:
            yield _batch({c: [None] for c in compared} | {"part": [part], "id": [held[0]], "fingerprint": [held[2]], "head": [held[3]], "tail": [held[1]]}, schema)

    walked = materialize(ranged.mapInArrow(walk, f"part int, id {kind}, {_COMPARED}, head string, tail string"), "ctph")
    heads = walked.where("head IS NOT NULL").select("part", "head", F.col("fingerprint").alias("next_print"))
    # One number per range is ordered here, no text.
    order = Window.orderBy("part")
    parts = heads.select("part", F.coalesce(F.lead("part").over(order), F.first("part").over(order)).alias("next_part"))
    tails = walked.where("tail IS NOT NULL").select("part", "id", "tail", "fingerprint")
    met = tails.join(parts, "part").join(heads.withColumnRenamed("part", "next_part"), "next_part")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = kinds_of(batch.schema.field("id").type)
            c = batch.to_pydict()
            yield _batch(_compare(c["tail"], c["head"], c["fingerprint"], c["next_print"]) | {"part": c["part"], "id": c["id"]}, schema)

    last = met.select("part", "id", "tail", "head", "fingerprint", "next_print").mapInArrow(finish, f"part int, id {kind}, {_COMPARED}")
    return walked.where("tail IS NULL").select("id", *compared).union(last.select("id", *compared)).withColumnRenamed("id", id_col)
