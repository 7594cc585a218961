"""List relations over array columns, one function for each mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append(xs: Column, ys: Column) -> Column:
    return F.concat(xs, ys)


def splits(zs: Column) -> Column:
    """All (xs, ys) with xs ++ ys = zs, as an array of structs."""
    return F.transform(F.sequence(F.lit(0), F.size(zs)), lambda i: F.struct(F.slice(zs, 1, i).alias("xs"), F.slice(zs, i + 1, F.size(zs)).alias("ys")))


def append_suffix(xs: Column, zs: Column) -> Column:
    """The ys with xs ++ ys = zs; null if there is none."""
    return F.when(F.slice(zs, 1, F.size(xs)) == xs, F.slice(zs, F.size(xs) + 1, F.size(zs)))


def append_prefix(ys: Column, zs: Column) -> Column:
    """The xs with xs ++ ys = zs; null if there is none."""
    cut = F.size(zs) - F.size(ys)
    return F.when((cut >= 0) & (F.slice(zs, F.greatest(cut, F.lit(0)) + 1, F.size(zs)) == ys), F.slice(zs, 1, F.greatest(cut, F.lit(0))))


def member(x: Column, xs: Column) -> Column:
    return F.exists(xs, lambda y: y.eqNullSafe(x))


def members(df: DataFrame, xs: str, into: str) -> DataFrame:
    """Each distinct member once."""
    return df.withColumn(into, F.explode(F.array_distinct(xs)))


def not_member(x: Column, xs: Column) -> Column:
    return ~member(x, xs)


def unique(xs: Column) -> Column:
    return F.size(F.array_distinct(xs)) == F.size(xs)


def remove(x: Column, xs: Column) -> Column:
    """xs without every x."""
    return F.filter(xs, lambda y: ~y.eqNullSafe(x))


def cons(head: Column, tail: Column) -> Column:
    return F.concat(F.array(head), tail)


def head(xs: Column) -> Column:
    return F.get(xs, F.lit(0))


def tail(xs: Column) -> Column:
    return F.when(F.size(xs) > 0, F.slice(xs, 2, F.size(xs)))


def length(xs: Column) -> Column:
    return F.size(xs)


def ref(xs: Column, i: Column) -> Column:
    """The element at a 0-based place; null beyond the ends."""
    return F.get(xs, i)


def absent(x: Column, xs: Column, depth: int = 1) -> Column:
    """Whether x occurs nowhere in a list, or, with depth, in lists of lists."""
    return not_member(x, xs) if depth == 1 else F.forall(xs, lambda ys: absent(x, ys, depth - 1))


def fold(xs: Column, start: Column, merge) -> Column:
    return F.aggregate(xs, start, merge)


def map_merge(a: Column, b: Column, merge, default: Column) -> Column:
    """Two maps as one: values of keys that both have are merged, a missing one counts as the default."""
    return F.map_zip_with(a, b, lambda _, x, y: merge(F.coalesce(x, default), F.coalesce(y, default)))


def map_append(xs: Column, f) -> Column:
    """The lists that f makes of each element, one after the other."""
    return F.flatten(F.transform(xs, f))


def bytes_to_list(value: Column) -> Column:
    """The bytes of a binary as numbers."""
    hexed = F.hex(value)
    # a sequence from 0 to -1 would descend
    places = F.when(F.octet_length(value) > 0, F.sequence(F.lit(0), F.octet_length(value) - 1)).when(value.isNotNull(), F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.conv(F.substring(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))


def bytes_ref(value: Column, i: Column) -> Column:
    """The byte at a 0-based place as a number; null beyond the ends."""
    return F.get(bytes_to_list(value), i)


def list_to_bytes(xs: Column) -> Column:
    return F.unhex(F.array_join(F.transform(xs, lambda x: F.lpad(F.hex(x), 2, "0")), ""))
