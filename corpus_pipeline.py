"""Corpus pipeline: clean, identify, deduplicate, pack.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before
kept and returns a DataFrame that is written and read again. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adit.llm import langid, packing, simhash, toxicity
from adit.llm.queries import WORD_BPE, table
from adit.workspace import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below 0.7; the model learns from all labelled rows.

    Null texts stay; labels that repeat an id count once. Without rows or
    labels every text stays.
    """
    model = toxicity.train(docs.select("doc_id", "text"), labels=table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text gets a language; texts that are null or without a letter go.

    Where no row has a known language nothing can be told apart and all rows stay.
    """
    model = langid.train(docs.select("text", "lang"))
    return langid.keep_known(docs, model) if model.languages else docs


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group linked by SimHash, the row with the smallest id.

    A null id stands behind all others, by a hash of its text. Of rows that
    repeat id and text one stays; different texts under one id both stay.
    """
    behind = F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 61))
    key = F.coalesce(F.col("doc_id").cast("long"), behind)
    found = simhash.near_duplicates(docs.select(key.alias("key"), "text"), "key")
    kept = found.select(F.col("component_id").alias("key")).distinct()
    own = docs.select(F.struct("*").alias("doc"), key.alias("key"), F.xxhash64("text").alias("h")).join(kept, "key", "left_semi")
    first = Window.partitionBy("key", "h").orderBy("doc.text")
    return own.withColumn("nth", F.row_number().over(first)).where("nth = 1").select("doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows with their places in sequences of 4096 tokens."""
    return packing.packed_pieces(docs.select("doc_id", "text"), WORD_BPE)


STAGES = [("toxicity", drop_toxic), ("language", drop_unknown_language), ("simhash", drop_near_copies), ("packing", pack)]

#: Models and automata cannot be written in SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
