"""Columns that are worked out from a row's position instead of being stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def const(value) -> Column:
    """The same value in every row."""
    return F.lit(value)


def identity(position: Column) -> Column:
    """The position itself."""
    return position


def offset(position: Column, by: int) -> Column:
    return position + by


def interval(position: Column, starts: list[int]) -> Column:
    """The number of the interval that a position lies in: how many of the ascending starts are not beyond it, less one."""
    return F.size(F.filter(F.array(*map(F.lit, starts)), lambda s: s <= position)) - 1


def indirect(rows: DataFrame, at: str, values: DataFrame, position: str, value: str, into: str) -> DataFrame:
    """rows with the value that stands at the position in a column; beyond the ends null."""
    held = values.select(F.col(position).alias(at), F.col(value).alias(into))
    return rows.join(held, at, "left")


def subtable(rows: DataFrame, position: str, low: int, high: int) -> DataFrame:
    """Rows at the positions from low to high, the latter excluded, numbered anew."""
    return rows.filter((F.col(position) >= low) & (F.col(position) < high)).withColumn(position, F.col(position) - low)
