"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sources share a wanted number of words by weight, none beyond a multiple of
what it has. The words of a source, documents in a seeded order, form a line
that is cut into blocks of equal length. Blocks are seats: they go to sources
by the highest quotients weight / (2 j + 1). A source's quota is dealt to its
shards, runs of blocks, and a shard takes that many of its blocks by a seeded
order. A document is taken as often as the blocks that it lies in.

DataFrame functions only. The texts are read once, for the word counts; the
line is a running total over ranges, so a hot source is spread over tasks;
blocks exist only inside the row of their shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adit.operators.indexing import ordered_index
from adit.operators.running import running_totals
from adit.workspace import materialize, new_path, one_row, task_count

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the first, second, third source and so on, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix as a fraction of all words.
SHARE = (3, 2)
#: How often a word may be taken.
MOST = 2
BLOCK_WORDS = 32
SHARD_BLOCKS = 1024
SEED = "mix"


def n_words(text: Column) -> Column:
    """Words between the six ASCII white spaces; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST, inside: str | None = None
) -> DataFrame:
    """Targets of sources: ``source``, ``source_size`` to those plus ``source_no``, ``weight``, ``limit``, ``target``.

    With the sources ordered by limit / weight, the level of the water is the
    largest of (wanted - limits before) / (weights from here on): each such
    level is too low by what sources before can't take, and one is exact.
    """
    total = one_row(sizes, F.coalesce(F.sum("source_size"), F.lit(0)).alias("n"))["n"]
    table = F.array(*map(F.lit, weights))
    numbered = ordered_index(sizes.withColumn("_last", F.col("source").isNull()), ["_last", "source"], out="source_no").drop("_last")
    numbered = numbered.withColumn("weight", F.element_at(table, (F.col("source_no") % len(weights)).cast("int") + 1).cast("long"))
    numbered = numbered.withColumn("limit", F.col("source_size") * most).withColumn("_ratio", F.col("limit") / F.col("weight"))
    numbered = materialize(numbered, "mix-sources", inside=inside)
    filled = running_totals(numbered, {"_limits": "limit", "_weights": "weight"}, ["_ratio", "source_no"], inside=inside)
    all_weights = one_row(numbered, F.sum("weight").alias("n"))["n"]
    num, den = share
    level = (total * num - F.col("_limits") * den).cast("double") / ((all_weights - F.col("_weights")) * den)
    water = one_row(filled, F.max(level).alias("n"))["n"]
    return numbered.withColumn("target", F.least(F.col("limit").cast("double"), water * F.col("weight"))).drop("_ratio")


def quotas(targets: DataFrame, block_words: int = BLOCK_WORDS, share: tuple[int, int] = SHARE, most: int = MOST, inside: str | None = None) -> DataFrame:
    """Append ``blocks`` (of the source's line) and ``quota`` (blocks to take) to targets.

    A source at its limit takes every block ``most`` times. The words that
    remain are seats for the others. Two divisors bracket the result: seats
    below the first are sure, those beyond the second are out, and only the
    few quotients between are ranked.
    """
    num, den = share
    sized = targets.withColumn("blocks", F.ceil(F.col("source_size") / block_words)).withColumn("_open", F.col("target") < F.col("limit"))
    sized = materialize(sized, "mix-targets", inside=inside)
    sums = one_row(
        sized,
        F.coalesce(F.sum("source_size"), F.lit(0)).alias("all"),
        F.coalesce(F.sum(F.when(~F.col("_open"), F.col("limit"))), F.lit(0)).alias("closed"),
        F.coalesce(F.sum(F.when(F.col("_open"), F.col("weight"))), F.lit(0)).alias("weights"),
        F.count_if("_open").alias("n"),
    )
    seats = F.floor((sums["all"] * (2 * num) - sums["closed"] * (2 * den) + den * block_words) / (2 * den * block_words))
    counted = sized.withColumn("_seats", seats).withColumn("_n", sums["n"]).withColumn("_sum", sums["weights"])
    few, many = (F.col("_seats") - F.col("_n") / 2) / F.col("_sum"), (F.col("_seats") + F.col("_n") + 1) / F.col("_sum")
    most_blocks = F.col("blocks") * most
    sure = F.least(most_blocks, F.floor(F.col("weight") * F.greatest(F.lit(0.0), few) + 0.5))
    sure = F.when(F.col("_open"), F.when(few > 0, sure).otherwise(F.lit(0))).otherwise(most_blocks).cast("long")
    end = F.when(F.col("_open"), F.least(most_blocks, F.floor(F.col("weight") * many + 0.5))).otherwise(F.lit(0)).cast("long")
    bounds = materialize(counted.withColumn("_sure", sure).withColumn("_end", end), "mix-bounds", inside=inside)
    asked = bounds.where("_end > _sure").select("source_no", "weight", F.explode(F.sequence("_sure", F.col("_end") - 1)).alias("j"))
    asked = asked.select("source_no", "j", (-F.col("weight") / (F.col("j") * 2 + 1)).alias("_behind"))
    ranked = ordered_index(asked, ["_behind", "source_no", "j"], out="place")
    left = one_row(bounds, (F.max("_seats") - F.coalesce(F.sum(F.when(F.col("_open"), F.col("_sure"))), F.lit(0))).alias("n"))["n"]
    won = ranked.where(F.col("place") < left).groupBy("source_no").agg(F.count(F.lit(1)).alias("_won"))
    return bounds.join(won, "source_no", "left").select(
        *targets.columns, "blocks", (F.col("_sure") + F.coalesce("_won", F.lit(0))).alias("quota")
    )


def chosen_blocks(quota: DataFrame, shard_blocks: int = SHARD_BLOCKS, seed: str = SEED) -> DataFrame:
    """Shards of every source: ``source_no``, ``shard``, ``first`` (block) and ``extra``, 0 or 1 per block.

    Whole rounds of a source's blocks are left to the caller; the rest of the
    quota is dealt to the shards in even steps, and within a shard to the
    blocks that come first in a seeded order.
    """
    rest = (F.col("quota") % F.col("blocks")).cast("double")
    last = F.floor((F.col("blocks") - 1) / shard_blocks)
    some = quota.where("blocks > 0 AND quota % blocks > 0").withColumn("_rest", rest)
    dealt = some.select("source_no", "blocks", "_rest", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("shard"))
    # A fixed number of tasks: the rows are few and small, but each unfolds into its blocks.
    dealt = dealt.repartition(task_count(quota.sparkSession), "source_no", "shard").withColumn("first", F.col("shard") * shard_blocks)
    dealt = dealt.withColumn("n", F.least(F.lit(shard_blocks).cast("long"), F.col("blocks") - F.col("first")))
    upto = lambda block: F.floor(F.col("_rest") * block / F.col("blocks") + 0.5)
    dealt = dealt.withColumn("take", upto(F.col("first") + F.col("n")) - upto(F.col("first")))
    name = lambda i: F.md5(F.concat_ws("|", F.lit(seed), F.col("source_no"), F.col("first") + i))
    shuffled = F.array_sort(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.struct(name(i).alias("h"), i.alias("i"))))
    marked = F.array_sort(F.transform(shuffled, lambda x, place: F.struct(x["i"].alias("i"), (place < F.col("take")).cast("int").alias("extra"))))
    return dealt.select("source_no", "shard", "first", F.transform(marked, lambda x: x["extra"]).alias("extra"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple[int, ...] = WEIGHTS,
    share: tuple[int, int] = SHARE,
    most: int = MOST,
    block_words: int = BLOCK_WORDS,
    shard_blocks: int = SHARD_BLOCKS,
    seed: str = SEED,
) -> DataFrame:
    """One row per document: id, ``size``, ``source_size``, ``target`` of its source, ``taken``, ``whole_passes``.

    Null sources are one source, behind all others. Null, empty and blank texts
    have size 0 and nothing is taken of them. Ids may repeat or be null, each
    row is a document; rows alike in id, source and size share what is taken of
    them in any order. A text of any length is one row. Other columns are
    ignored; an empty table gives an empty result. The same rows give the same
    result in every run. What a source takes is within about two blocks of its
    target.
    """
    folder = new_path(docs.sparkSession, "mix")
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col).cast("string")).alias("size"))
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sizes = materialize(named.select("*", key.alias("_key"), F.monotonically_increasing_id().alias("_row")), "mix-sizes", inside=folder)
    targets = source_targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most, folder)
    quota = materialize(quotas(targets, block_words, share, most, folder), "mix-quotas", inside=folder)

    line = running_totals(sizes, {"start": "size"}, ["_key", "size", "_row"], ["source"], folder).drop("_key")
    of_source = quota.select("source", "source_no", "source_size", "target", F.coalesce(F.floor(F.col("quota") / F.expr("nullif(blocks, 0)")), F.lit(0)).alias("whole_passes"))
    rows = line.alias("l").join(of_source.alias("q"), F.col("l.source").eqNullSafe(F.col("q.source"))).select("l.*", *[f"q.{c}" for c in of_source.columns[1:]])

    chosen = materialize(chosen_blocks(quota, shard_blocks, seed), "mix-shards", inside=folder)
    shard_words = block_words * shard_blocks
    stop = F.col("start") + F.col("size")
    spans = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / shard_words), F.floor((stop - 1) / shard_words)))
    pieces = rows.select("*", F.explode_outer(spans).alias("shard")).join(chosen, ["source_no", "shard"], "left")
    low = F.greatest(F.col("first"), F.floor(F.col("start") / block_words))
    high = F.least(F.col("first") + F.size("extra") - 1, F.floor((stop - 1) / block_words))
    inside = lambda b: F.least(stop, (b + 1) * block_words) - F.greatest(F.col("start"), b * block_words)
    more = F.aggregate(F.sequence(low, high), F.lit(0).cast("long"), lambda sum_, b: sum_ + inside(b) * F.get("extra", (b - F.col("first")).cast("int")))
    per_doc = pieces.groupBy("_row", "doc_id", "size", "source_size", "target", "whole_passes").agg(F.coalesce(F.sum(F.when(F.col("extra").isNotNull(), more)), F.lit(0)).alias("_more"))
    return per_doc.select(
        F.col("doc_id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("whole_passes") + F.col("_more")).cast("long").alias("taken"), F.col("whole_passes").cast("long").alias("whole_passes")
    )
