"""Packing documents into sequences with a grouping genetic algorithm.

Documents are dealt to blocks of bounded size, and every block evolves on
several islands. An individual is a set of bins. Crossover takes whole
well-filled bins of one parent into a copy of the other, removes the bins that
hold any of the same documents, and puts the documents that lost their place
back by best fit. Between epochs each island's best individual migrates to the
next island of its block. The poorly filled bins of all blocks are then opened
and their documents dealt to fewer blocks, until one block is left.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adit.llm.bpe import WordBPE, in_worker
from adit.workspace import materialize, materialize_counted

CAPACITY = 4096
END_OF_TEXT = 1
ITEMS_PER_BLOCK = 4096
ISLANDS, EPOCHS = 2, 2
POPULATION, CHILDREN = 4, 12
#: Bins filled less than this are opened for the next round.
OPEN_BELOW = 0.97


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END_OF_TEXT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenized documents cut where they exceed ``capacity``.

    One row per piece: id, ``piece`` from 0, ``start``, ``length`` and
    ``ids_crc32``, the checksum of the ids as little-endian unsigned 32-bit
    numbers. Each document ends in the id ``end``, so null and empty texts make
    one piece of length 1.
    """
    shared = docs.sparkSession.sparkContext.broadcast(WordBPE(tokenizer_path))
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = in_worker(("bytes", tokenizer_path), lambda: shared.value.remembered(lambda ids: struct.pack(f"<{len(ids)}I", *ids)))
        for batch in batches:
            row, piece, start, length, check = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = b"".join(encode(text or "")) + last
                n = len(ids) // 4
                for k, at in enumerate(range(0, n, capacity)):
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(min(capacity, n - at))
                    check.append(zlib.crc32(ids[4 * at : 4 * (at + capacity)]))
            yield pa.record_batch([batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(check, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("id", id_col)


class Bins:
    """An individual: bins as lists of items, with their loads."""

    def __init__(self, bins: list[list[int]], loads: list[int]):
        self.bins, self.loads = bins, loads

    def fitness(self, capacity: int) -> tuple[int, float]:
        """Fewer bins first; among equals, fuller full ones."""
        return -len(self.bins), sum((x / capacity) ** 2 for x in self.loads)


def best_fit(items: list[int], lengths: list[int], capacity: int, start: Bins | None = None) -> Bins:
    """Put ``items`` in order into the bin that they fill most, or into a new one."""
    bins = [list(b) for b in start.bins] if start else []
    loads = list(start.loads) if start else []
    room = sorted((capacity - load, b) for b, load in enumerate(loads) if load < capacity)
    for i in items:
        n = lengths[i]
        at = bisect_left(room, (n, -1))
        if at < len(room):
            space, b = room.pop(at)
            bins[b].append(i)
        else:
            space, b = capacity, len(bins)
            bins.append([i])
            loads.append(0)
        loads[b] += n
        if space > n:
            insort(room, (space - n, b))
    return Bins(bins, loads)


def crossover(giver: Bins, taker: Bins, lengths: list[int], capacity: int, rng: np.random.Generator) -> Bins:
    order = np.argsort(-np.array(giver.loads), kind="stable")
    full = order[: max(1, len(order) // 2)]
    chosen = full[rng.random(len(full)) < 0.5].tolist() or [int(full[0])]
    injected = {i for b in chosen for i in giver.bins[b]}
    kept, displaced = [], []
    for b, members in enumerate(taker.bins):
        if injected.isdisjoint(members):
            kept.append(b)
        else:
            displaced += [i for i in members if i not in injected]
    start = Bins([giver.bins[b] for b in chosen] + [taker.bins[b] for b in kept], [giver.loads[b] for b in chosen] + [taker.loads[b] for b in kept])
    displaced.sort(key=lambda i: (-lengths[i], i))
    return best_fit(displaced, lengths, capacity, start)


def evolve(lengths: list[int], capacity: int, seeds: list[Bins], rng: np.random.Generator, population: int = POPULATION, children: int = CHILDREN) -> Bins:
    """The best individual after some generations; stops at the least possible number of bins."""
    least = -(-sum(lengths) // capacity)
    down = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    people = list(seeds) or [best_fit(down, lengths, capacity)]

    def best() -> Bins:
        return max(people, key=lambda p: p.fitness(capacity))

    while len(people) < population and len(best().bins) > least:
        # Nearly decreasing: sizes are blurred before they are sorted.
        blurred = np.array(lengths) * rng.uniform(0.7, 1.3, len(lengths))
        people.append(best_fit(np.argsort(-blurred, kind="stable").tolist(), lengths, capacity))
    for _ in range(children):
        if len(best().bins) <= least:
            break
        a, b = rng.choice(len(people), 2, replace=False)
        child = crossover(people[a], people[b], lengths, capacity, rng)
        worst = min(range(len(people)), key=lambda k: people[k].fitness(capacity))
        if child.fitness(capacity) > people[worst].fitness(capacity):
            people[worst] = child
    return best()


def _individual(bin_of: np.ndarray, lengths: list[int]) -> Bins:
    _, index = np.unique(bin_of, return_inverse=True)
    bins: list[list[int]] = [[] for _ in range(int(index.max()) + 1)]
    for i, b in enumerate(index.tolist()):
        bins[b].append(i)
    return Bins(bins, [sum(lengths[i] for i in b) for b in bins])


def _epoch(dealt: DataFrame, capacity: int, epoch: int) -> DataFrame:
    """(block, island, key, length, bin, own, guest) to (block, island, key, length, bin, bins, fill)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("key", ignore_index=True)
        lengths = group["length"].tolist()
        rng = np.random.default_rng([epoch, int(group["block"][0]), int(group["island"][0])])
        seeds = [] if group["own"].isna().any() else [_individual(group[c].to_numpy(np.int64), lengths) for c in ("own", "guest")]
        found = evolve(lengths, capacity, seeds, rng)
        bin_of, load = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
        for b, members in enumerate(found.bins):
            bin_of[members], load[members] = b, found.loads[b]
        bins, fill = found.fitness(capacity)
        return group[["block", "island", "key", "length"]].assign(bin=bin_of, load=load, bins=-bins, fill=fill)

    return dealt.groupBy("block", "island").applyInPandas(run, "block long, island int, key long, length long, bin long, load long, bins long, fill double")


def _round(items: DataFrame, blocks: int, capacity: int) -> DataFrame:
    """Best islands' bins for (key, length): block, key, length, bin, load."""
    none = F.lit(None).cast("long")
    dealt = items.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), "key", "length")
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), none.alias("own"), none.alias("guest"))
    for epoch in range(EPOCHS):
        best = materialize(_epoch(dealt, capacity, epoch), "packing-epoch")
        # Migration: each island meets its own elite and its neighbour's.
        elites = best.groupBy("block", "key", "length").agg(F.sort_array(F.collect_list(F.struct("island", "bin"))).alias("e"))
        dealt = elites.select("block", "key", "length", F.posexplode("e").alias("island", "mine"), "e")
        dealt = dealt.select("block", "key", "length", "island", F.col("mine.bin").alias("own"), F.get("e", (F.col("island") + 1) % ISLANDS)["bin"].alias("guest"))
    ranks = best.groupBy("block").agg(F.min(F.struct("bins", (-F.col("fill")).alias("f"), "island")).alias("w")).select("block", F.col("w.island").alias("island"))
    return best.join(ranks, ["block", "island"]).select("block", "key", "length", "bin", "load")


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(key, ``sequence_id``, ``offset``) for (key, length).

    Keys are distinct longs of zero or more, lengths lie between 0 and
    ``capacity``; an empty table gives an empty one. Sequences have no gaps and
    start at 0. Items of full length are sequences of their own. Within a sequence
    items lie by length, longest first.
    """
    full = items.where(F.col("length") == capacity).select("key", (-1 - F.col("key")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, n = materialize_counted(items.where(F.col("length") < capacity).select("key", "length"), "packing-items")
    settled = []
    turn = 0
    while n:
        blocks = -(-n // ITEMS_PER_BLOCK)
        found = materialize(_round(rest, blocks, capacity), "packing-round")
        found = found.withColumn("sequence_id", (F.lit(turn).cast("long") * (1 << 56)) + F.col("block") * (1 << 20) + F.col("bin"))
        if blocks == 1:
            settled.append(found)
            break
        still = F.col("load") < OPEN_BELOW * capacity
        settled.append(found.where(~still))
        before = n
        rest, n = materialize_counted(found.where(still).select("key", "length"), "packing-items")
        if n == before:
            # Every bin stays poor at any choice of blocks: nothing is won by dealing again.
            settled.append(found)
            break
        turn += 1
    if not settled:
        return full
    placed = settled[0]
    for more in settled[1:]:
        placed = placed.unionByName(more)
    before = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "key").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset")
    return placed.select("key", "sequence_id", offset).union(full)


def packed_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END_OF_TEXT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`pieces` with the ``sequence_id`` and ``offset`` at which each lies."""
    cut = materialize(pieces(docs, tokenizer_path, capacity, end, id_col, text_col).withColumn("key", F.monotonically_increasing_id()), "packing-pieces")
    return cut.join(pack(cut.select("key", "length"), capacity), "key").drop("key")
