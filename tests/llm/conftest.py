import random

import pytest
from pyspark.sql import types as T

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def documents(spark):
    """Rows of (id, text[, lang]) as a documents table."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, "src", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOC)

    return make


def words(rng: random.Random, n: int, letters: str = "abcdeghilmnorst", most: int = 5) -> str:
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, most + 1))) for _ in range(n))


ODD = [
    "",
    "   \n\t ",
    "one",
    "a b c d",
    "ÀÉ ß ΑΣ İstanbul ﬁ é",
    "日本語 テスト ١٢٣ 🙂👍🏽",
    "x<|endoftext|>'m I'LL it's <|startoftext|>",
    "a\x1cb \x85c d\x00e",
    "word " * 30_000,
    "z" * 20_000,
]
