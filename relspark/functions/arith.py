"""Arithmetic relations: each solves for whichever argument is missing, or tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plus(a: Column | None = None, b: Column | None = None, c: Column | None = None) -> Column:
    """a + b = c: the missing one of the three, or whether it holds."""
    if c is None:
        return a + b
    if b is None:
        return c - a
    if a is None:
        return c - b
    return a + b == c


def times(a: Column | None = None, b: Column | None = None, c: Column | None = None) -> Column:
    """a * b = c over integers; a division that is not exact, or by zero, gives null."""
    if c is None:
        return a * b
    if a is not None and b is not None:
        return a * b == c
    d = a if b is None else b
    safe = F.when(d != 0, d)
    return F.when(F.pmod(c, safe) == 0, F.call_function("div", c, safe))


def floor(x: Column) -> Column:
    return F.floor(x)


def to_bytes(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def to_text(raw: Column) -> Column:
    return F.decode(raw, "UTF-8")
