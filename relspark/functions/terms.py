"""The total order over all terms, as sortable columns, and tests of a term's type.

Terms of mixed type are held as structs (rank, num, txt, bin, arr), whose order is the order of terms:
() < numbers < symbols < strings < bytes < pairs < vectors < false < true; vectors go by length first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranks of the kinds of terms in their order.
RANK = {"null": 0, "number": 1, "symbol": 2, "string": 3, "bytes": 4, "pair": 5, "vector": 6, "boolean": 7}

_ATOM = "struct<rank:tinyint,num:decimal(38,9),txt:string,bin:binary>"
TERM = f"struct<rank:tinyint,num:decimal(38,9),txt:string,bin:binary,size:int,items:array<{_ATOM}>>"


def _atom(kind: str, value: Column) -> Column:
    num = value.cast("decimal(38,9)") if kind == "number" else value.cast("int").cast("decimal(38,9)") if kind == "boolean" else F.lit(None)
    txt = value if kind in ("symbol", "string") else F.lit(None)
    return F.struct(F.lit(RANK[kind]).cast("tinyint").alias("rank"), num.cast("decimal(38,9)").alias("num"), txt.cast("string").alias("txt"), (value if kind == "bytes" else F.lit(None)).cast("binary").alias("bin"))


def term(kind: str, value: Column | None = None, items: str = "string") -> Column:
    """A value of one kind as a mixed term.  Pairs and vectors are given as arrays, whose elements, of the kind `items`,
    are ordered as terms of their own."""
    num = value.cast("decimal(38,9)") if kind == "number" else value.cast("int").cast("decimal(38,9)") if kind == "boolean" else F.lit(None)
    held = F.transform(value, lambda x: _atom(items, x)) if kind in ("pair", "vector") else F.lit(None)
    parts = {
        "rank": F.lit(RANK[kind]).cast("tinyint"),
        "num": num.cast("decimal(38,9)"),
        "txt": (value if kind in ("symbol", "string") else F.lit(None)).cast("string"),
        "bin": (value if kind == "bytes" else F.lit(None)).cast("binary"),
        "size": (F.size(value) if kind == "vector" else F.lit(None)).cast("int"),
        "items": held.cast(f"array<{_ATOM}>"),
    }
    return F.struct(*(c.alias(k) for k, c in parts.items()))


def is_kind(value: Column, kind: str) -> Column:
    return value["rank"] == RANK[kind]


def is_not_kind(value: Column, kind: str) -> Column:
    return value["rank"] != RANK[kind]


def is_integer(value: Column) -> Column:
    return F.floor(value) == value


def vector_key(value: Column) -> Column:
    """Sorts arrays as vectors: by length, then elementwise.  (Arrays themselves sort as lists.)"""
    return F.struct(F.size(value), value)


def between(value: Column, low=None, low_closed: bool = True, high=None, high_closed: bool = True) -> Column:
    """An interval of the order; an open end is None."""
    out = F.lit(True)
    if low is not None:
        out = out & (value >= low if low_closed else value > low)
    if high is not None:
        out = out & (value <= high if high_closed else value < high)
    return out


def intersect_bounds(a: tuple, b: tuple) -> tuple | None:
    """Of two intervals (low, low closed, high, high closed) the common one, or None if it is empty."""
    low = max((x for x in (a[:2], b[:2]) if x[0] is not None), key=lambda x: (x[0], not x[1]), default=(None, False))
    high = min((x for x in (a[2:], b[2:]) if x[0] is not None), key=lambda x: (x[0], x[1]), default=(None, False))
    if low[0] is not None and high[0] is not None and (low[0] > high[0] or low[0] == high[0] and not (low[1] and high[1])):
        return None
    return (*low, *high)


def finite_domain(low: int, high: int) -> list[int]:
    """A closed interval of integers as the values to choose from."""
    return list(range(low, high + 1))
