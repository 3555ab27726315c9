"""Small tables with all that may go wrong, and plain versions of the operators to compare with."""

import random

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark: SparkSession, texts: list, sources: list | None = None, first: int = 0) -> DataFrame:
    rows = [(first + i, t, "en", sources[i % len(sources)] if sources else "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def odd_documents(spark: SparkSession) -> DataFrame:
    """Null and empty texts, a null id, repeated rows, ties, one very long text, and columns that clash with names that
    operators use themselves."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    a = text(120)
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, "no id here but words"), (4, a), (4, a), (5, a), (6, a + " more"), (7, text(6000)), (8, "x" * 50_000), (9, "\u00e4\u4e2d\U0001f600 <|endoftext|>  b"), (10, "one two")]
    return spark.createDataFrame([(i, t, None if i == 2 else "en", None if i in (3, 7) else "s", None, "c", 1, 2.0, b"k") for i, t in rows], DOCS + ", same string, size int, score double, key binary")


def rows_by_id(df: DataFrame, key: str = "doc_id") -> dict:
    return {r[key]: r for r in df.collect()}
