"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs, sorted, adjacent turns of one
role merged, and concatenated::

    <turn>role<says>text<part>text</turn><turn>role<says>text</turn>

Inside roles and texts a backslash becomes ``\\\\`` and ``<`` becomes ``\\l``.
Escaped text holds no ``<``, so every ``<`` starts a mark of the template and
the output can be read back whatever the texts contain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, SAYS, PART, CLOSE = "<turn>", "<says>", "<part>", "</turn>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    # In turn: double backslashes become "<", which escaped text lacks; the single ones left
    # stand for "<"; last, the two characters change places.
    single = F.replace(F.replace(text, F.lit("\\\\"), F.lit("<")), F.lit("\\l"), F.lit("\\"))
    return F.translate(single, "<\\", "\\<")


def format_conversations(turns: DataFrame, loss_role: str = "assistant", conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: id, ``merged`` (array of role and texts),
    ``formatted`` and ``loss_spans``, the stretches [start, stop) of
    ``formatted``, in code points, that hold texts of ``loss_role``.

    Rows are ordered by turn (null first), then role and text, so ties and
    repeated rows have one order. Null roles and texts count as empty; rows
    without a conversation id form one conversation. A conversation is one
    value of the result and is put together in one task.
    """
    rows = turns.select(
        F.col(conv).alias("id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("row"),
    )
    sorted_ = rows.groupBy("id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    # A merged turn starts where the role differs from the row before.
    starts = F.filter(
        F.sequence(F.lit(0), F.size("rows") - 1),
        lambda i: (i == 0) | (F.get(F.col("rows"), i)["role"] != F.get(F.col("rows"), F.greatest(i - 1, F.lit(0)))["role"]),
    )
    found = sorted_.select("id", "rows", starts.alias("starts"))
    merged = F.transform(
        "starts",
        lambda s, k: F.struct(
            F.get(F.col("rows"), s)["role"].alias("role"),
            F.transform(F.slice(F.col("rows"), s + 1, F.coalesce(F.get(F.col("starts"), k + 1), F.size("rows")) - s), lambda r: r["text"]).alias("texts"),
        ),
    )
    # Pieces alternate between marks and texts; only the lengths of the texts of one role make loss.
    pieces = F.flatten(
        F.transform(
            "merged",
            lambda t: F.concat(
                F.flatten(
                    F.transform(
                        t["texts"],
                        lambda x, i: F.array(
                            F.struct(F.when(i == 0, F.concat(F.lit(OPEN), escape(t["role"]), F.lit(SAYS))).otherwise(F.lit(PART)).alias("s"), F.lit(False).alias("loss")),
                            F.struct(escape(x).alias("s"), (t["role"] == loss_role).alias("loss")),
                        ),
                    )
                ),
                F.array(F.struct(F.lit(CLOSE).alias("s"), F.lit(False).alias("loss"))),
            ),
        )
    )
    none = F.array().cast("array<struct<start:int,stop:int>>")
    spans = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), none.alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.char_length(p["s"])).alias("at"),
            F.when(p["loss"], F.array_append(acc["spans"], F.struct(acc["at"].alias("start"), (acc["at"] + F.char_length(p["s"])).alias("stop")))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return (
        found.select("id", merged.alias("merged"))
        .withColumn("pieces", pieces)
        .select(F.col("id").alias(conv), "merged", F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"), spans.alias("loss_spans"))
    )


def read_back(formatted: Column) -> Column:
    """The original rows (role, text) of a formatted conversation."""
    closed = F.split(formatted, CLOSE)
    return F.flatten(
        F.transform(
            F.slice(closed, 1, F.size(closed) - 1),
            lambda t: F.transform(
                F.split(F.element_at(F.split(t, SAYS), 2), PART),
                lambda x: F.struct(unescape(F.replace(F.element_at(F.split(t, SAYS), 1), F.lit(OPEN), F.lit(""))).alias("role"), unescape(x).alias("text")),
            ),
        )
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["stop"] - s["start"]))), "")
