"""Joins, set operations, folds and ordered access.  Relations are sets: results are distinct where inputs are."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Names = Sequence[str]

# joins


def join(left: DataFrame, right: DataFrame, on: Names, hint: str | None = None) -> DataFrame:
    """Equi-join; hint: merge, shuffle_hash or none, which leaves the choice to Catalyst."""
    return left.join(right.hint(hint) if hint else right, list(on))


def natural_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """On all shared names; without any it is the product."""
    shared = [c for c in left.columns if c in right.columns]
    return left.join(right, shared) if shared else left.crossJoin(right)


def hash_join_grouped(left: DataFrame, right: DataFrame, on: Names, value: str, into: str) -> DataFrame:
    """Each left row with its key's sorted set of right values."""
    return left.join(group(right, on, value, into), list(on))


def semi_join(left: DataFrame, right: DataFrame, on: Names) -> DataFrame:
    return left.join(right, list(on), "left_semi")


def anti_join(left: DataFrame, right: DataFrame, on: Names) -> DataFrame:
    return left.join(right, list(on), "left_anti")


def theta_join(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    return left.join(right, condition)


def product(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.crossJoin(right)


def outer_default(left: DataFrame, right: DataFrame, on: Names, defaults: dict) -> DataFrame:
    """All left rows; where the right has none, its values are the defaults."""
    return left.join(right, list(on), "left").fillna(defaults)


def divide(df: DataFrame, key: Names, value: str, divisor: DataFrame) -> DataFrame:
    """Keys that go with every value of the divisor: those whose matching values are as many as there are.

    An empty divisor gives every key.  The divisor's values are numbered, and each key gathers the numbers it has as bits
    of a word (one word for each 64 values), so what a task holds is one word for a key and not its values.
    """
    numbered = row_position(divisor.select(value).distinct(), [value], into="__number")
    n = numbered.count()
    if n == 0:
        return df.select(*key).distinct()
    bits = F.bit_or(F.expr("shiftleft(1L, cast(__number % 64 as int))"))
    held = df.select(*key, value).join(numbered, value)
    if n <= 64:
        return held.groupBy(*key).agg(bits.alias("__bits")).filter(F.bit_count("__bits") == n).select(*key)
    words = held.groupBy(*key, F.floor(F.col("__number") / 64).alias("__word")).agg(bits.alias("__bits"))
    return words.groupBy(*key).agg(F.sum(F.bit_count("__bits")).alias("__n")).filter(F.col("__n") == n).select(*key)


# sets


def union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def append(*parts: DataFrame) -> DataFrame:
    """Bag union."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.subtract(right.select(left.columns))


def intersection(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.intersect(right.select(left.columns))


def key_union(left: DataFrame, right: DataFrame, on: Names) -> DataFrame:
    return left.select(*on).union(right.select(*on)).distinct()


def union_with(parts: Sequence[DataFrame], on: Names, combine: dict[str, Callable[[str], Column]]) -> DataFrame:
    """Union of keyed relations; values that meet are combined by aggregates, such as F.sum."""
    return append(*parts).groupBy(*on).agg(*(f(c).alias(c) for c, f in combine.items()))


def subtract_keys(left: DataFrame, right: DataFrame, on: Names) -> DataFrame:
    """left without the rows whose key prefix occurs in right."""
    return anti_join(left, right.select(*on).distinct(), on)


# order


def dedup_adjacent(df: DataFrame, partition: Names, order: Names, value: Names) -> DataFrame:
    """Rows whose value differs from the row before."""
    w = Window.partitionBy(*partition).orderBy(*order)
    same = F.struct(*value).eqNullSafe(F.lag(F.struct(*value)).over(w))
    return df.withColumn("__same", same & (F.row_number().over(w) > 1)).filter("not __same").drop("__same")


def group_adjacent(df: DataFrame, partition: Names, order: Names, value: Names, into: str = "run") -> DataFrame:
    """Numbers runs of equal neighbours from 0."""
    w = Window.partitionBy(*partition).orderBy(*order)
    starts = ~F.struct(*value).eqNullSafe(F.lag(F.struct(*value)).over(w)) | (F.row_number().over(w) == 1)
    return df.withColumn("__starts", starts.cast("long")).withColumn(into, F.sum("__starts").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("__starts")


def row_position(df: DataFrame, order: Names, partition: Names = (), into: str = "position") -> DataFrame:
    """0-based rank in the order.  Without a partition the ranks of all rows are found in two passes: rows are dealt
    by range, counted, and numbered inside their range, so no task gets all of them."""
    if partition:
        return df.withColumn(into, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)).cast("long") - 1)
    from ..storage import keep

    dealt = keep(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    # one row for each partition, so this window is small whatever the table
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.withColumn("__at", inside).join(F.broadcast(before), "__part").withColumn(into, F.col("__before") + F.col("__at") - 1).drop("__part", "__at", "__before")


def running(df: DataFrame, partition: Names, order: Names, aggregate: Column, into: str) -> DataFrame:
    return df.withColumn(into, aggregate.over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def chunk(df: DataFrame, partition: Names, order: Names, n: int, into: str = "chunk") -> DataFrame:
    """Numbers runs of n rows of each partition from 0."""
    return df.withColumn(into, F.floor((F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1) / n))


def order_limit(df: DataFrame, order: Sequence[Column | str], limit: int | None = None, offset: int = 0) -> DataFrame:
    out = df.orderBy(*order)
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit is not None else out


def seek_ge(df: DataFrame, key: str, low, inclusive: bool = True) -> DataFrame:
    """The least key from low on, in one row (null if there is none)."""
    return df.filter(F.col(key) >= low if inclusive else F.col(key) > low).agg(F.min(key).alias(key))


def seek_le(df: DataFrame, key: str, high, inclusive: bool = True) -> DataFrame:
    return df.filter(F.col(key) <= high if inclusive else F.col(key) < high).agg(F.max(key).alias(key))


def sorted_strictly(df: DataFrame, order: Names, position: str) -> bool:
    """Whether rows, in the order of position, ascend strictly.  Rows are compared inside ranges of positions, and the
    ranges by their first and last rows, so no task gets all of them."""
    from ..storage import drop, keep

    dealt = keep(df.select(F.struct(*order).alias("v"), F.col(position).alias("at")).repartitionByRange("at").withColumn("__part", F.spark_partition_id()), "ranges")
    w = Window.partitionBy("__part").orderBy("at")
    inside = dealt.withColumn("__ok", (F.col("v") > F.lag("v").over(w)) | (F.row_number().over(w) == 1)).filter("not __ok").isEmpty()
    ends = dealt.groupBy("__part").agg(F.min_by("v", "at").alias("low"), F.max_by("v", "at").alias("high"))
    # one row for each range
    across = ends.withColumn("__ok", (F.col("low") > F.lag("high").over(Window.orderBy("__part"))) | (F.row_number().over(Window.orderBy("__part")) == 1)).filter("not __ok").isEmpty()
    drop(dealt)
    return inside and across


# groups


def group(df: DataFrame, on: Names, value: str, into: str) -> DataFrame:
    """Each key with the sorted set of its values."""
    return df.groupBy(*on).agg(F.sort_array(F.collect_set(value)).alias(into))


def fold(df: DataFrame, on: Names, **aggregates: Column) -> DataFrame:
    return df.groupBy(*on).agg(*(c.alias(k) for k, c in aggregates.items()))


@dataclass(frozen=True)
class Merge:
    """A merge of one's own: an aggregate of a column that is associative and commutative.  An idempotent one, in which
    a value met again changes nothing, may stand inside a recursion."""

    aggregate: Callable[[str], Column]
    idempotent: bool = False


def is_idempotent(by: str | Merge) -> bool:
    return by.idempotent if isinstance(by, Merge) else by in IDEMPOTENT


def merge(df: DataFrame, by: str | Merge) -> DataFrame:
    """Facts that agree in all columns but the last become one, their last values merged."""
    *keys, last = df.columns
    if isinstance(by, Merge):
        return df.groupBy(*keys).agg(by.aggregate(last).alias(last))
    return top_merge(df, keys, last, by) if "_" in by and by.split("_")[0] in ("top", "bottom") else df.groupBy(*keys).agg(MERGES[by](last).alias(last))


#: Merges of facts.  Those of IDEMPOTENT may stand inside a recursion.
MERGES: dict[str, Callable[[str], Column]] = {
    "sum": F.sum,
    "product": F.product,
    "min": F.min,
    "max": F.max,
    "count": lambda c: F.count(F.lit(1)),
    "set_union": lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_set(c)))),
    "any": F.bool_or,
    "all": F.bool_and,
}
IDEMPOTENT = frozenset({"min", "max", "set_union", "any", "all"})


def top_merge(df: DataFrame, keys: Names, value: str, by: str) -> DataFrame:
    """top_n or bottom_n: each key's n greatest or least distinct values, one row each with its rank from 1."""
    kind, n = by.rsplit("_", 1)
    w = Window.partitionBy(*keys).orderBy(F.desc(value) if kind == "top" else F.asc(value))
    return df.select(*keys, value).distinct().withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= int(n))


def greatest_by_negation(df: DataFrame, on: Names, value: str) -> DataFrame:
    """Rows for whose key no greater value exists: an anti-join on the key with an inequality."""
    a, b = df.alias("a"), df.alias("b")
    condition = F.col(f"b.{value}") > F.col(f"a.{value}")
    for c in on:
        condition = condition & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    return a.join(b, condition, "left_anti")


def least_with(df: DataFrame, on: Names, order: str, value: str, into: str, greatest: bool = False) -> DataFrame:
    """Each key's value at its least (greatest) order; of several the least."""
    rank = F.struct(F.col(order), F.col(value))
    if greatest:
        most = df.groupBy(*on).agg(F.max(order).alias("__most"))
        return df.join(most, list(on)).filter(F.col(order) == F.col("__most")).groupBy(*on).agg(F.min(value).alias(into))
    return df.groupBy(*on).agg(F.min(rank)[value].alias(into))


def lookup(df: DataFrame, keys: DataFrame, on: Names, missing: dict) -> DataFrame:
    """The row of each key asked for; where there is none, the values of missing."""
    return keys.select(*on).distinct().join(df, list(on), "left").fillna(missing)


def pop_least(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows of the least key, and the others."""
    least = df.agg(F.min(key).alias("__least"))
    first = df.join(F.broadcast(least), F.col(key) == F.col("__least"), "left_semi")
    return first, df.join(F.broadcast(least), F.col(key) == F.col("__least"), "left_anti")


def zip_rows(left: DataFrame, right: DataFrame, left_order: Names, right_order: Names) -> DataFrame:
    """Rows of the same position side by side, as many as the shorter has."""
    return row_position(left, left_order).join(row_position(right, right_order), "position")


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Attributes by new names; unknown ones are an error."""
    if unknown := set(names) - set(df.columns):
        raise KeyError(f"no attribute {', '.join(sorted(unknown))}")
    return df.withColumnsRenamed(names)


def keep_attributes(df: DataFrame, names: Names) -> DataFrame:
    """Only these attributes, as a set."""
    return df.select(*names).distinct()


def drop_attributes(df: DataFrame, names: Names) -> DataFrame:
    if unknown := set(names) - set(df.columns):
        raise KeyError(f"no attribute {', '.join(sorted(unknown))}")
    return df.drop(*names).distinct()


def reorder_attributes(df: DataFrame, names: Names) -> DataFrame:
    """The same attributes in another order."""
    if sorted(names) != sorted(df.columns):
        raise ValueError(f"not an order of {', '.join(df.columns)}")
    return df.select(*names)


def statistics(df: DataFrame, columns: Names) -> DataFrame:
    """(attribute, cardinality, ratio): how many values each has, and how many for each row.  One pass."""
    counts = df.agg(F.count("*").alias("__rows"), *(F.countDistinct(c).alias(f"__{c}") for c in columns))
    rows = F.array(*(F.struct(F.lit(c).alias("attribute"), F.col(f"__{c}").alias("cardinality"), (F.col(f"__{c}") / F.col("__rows")).alias("ratio")) for c in columns))
    return counts.select(F.inline(rows))
