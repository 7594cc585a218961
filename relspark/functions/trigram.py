"""Substring search through an index of trigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a text; a shorter text is its own."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda i: F.substring(text, i, F.lit(3))))


def index(df: DataFrame, key: str, text: str) -> DataFrame:
    """(gram, key), a relation to keep beside the table."""
    return df.select(key, F.explode(trigrams(F.col(text))).alias("gram")).distinct()


def search(df: DataFrame, grams: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """Rows whose text holds the pattern: all of its trigrams by the index, then the text itself."""
    if len(pattern) < 3:
        return df.filter(F.contains(F.col(text), F.lit(pattern)))
    want = sorted({pattern[i : i + 3] for i in range(len(pattern) - 2)})
    keys = grams.filter(F.col("gram").isin(want)).groupBy(key).agg(F.countDistinct("gram").alias("n")).filter(F.col("n") == len(want)).select(key)
    return df.join(keys, key, "left_semi").filter(F.contains(F.col(text), F.lit(pattern)))
