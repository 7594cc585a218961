"""Fixpoints and graph relations.

Semi-naive loops on the driver; each round's rows are written to the shared folder, which cuts the lineage and
survives lost executors.  Only row counts reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import drop, keep


class NoFixpoint(RuntimeError):
    """The round limit was reached while rows were still new."""


#: Rounds whose new rows are tables of their own before they are made one.
MERGED = 8


def _rounds(limit: int | None):
    return count() if limit is None else range(limit)


def fixpoint(seed: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], rounds: int | None = None, stop: bool = False) -> DataFrame:
    """Least set that holds seed and step(delta, total), where step may look at the last round's new rows only.

    A step that makes no new values ends by itself; for any other, rounds is the limit, at which it is an error that
    rows are still new, or, with stop, what there is by then is the result."""
    return _grow([keep(seed.distinct(), "delta")], step, rounds, stop)


def _grow(parts: list[DataFrame], step: Callable[[DataFrame, DataFrame], DataFrame], rounds: int | None = None, stop: bool = False) -> DataFrame:
    """fixpoint() from kept tables of which only the last holds rows whose steps are still to be made."""
    total, delta = reduce(DataFrame.unionByName, parts), parts[-1]
    for _ in _rounds(rounds):
        if delta.isEmpty():
            return total
        delta = keep(step(delta, total).select(total.columns).distinct().join(total, total.columns, "left_anti"), "delta")
        parts.append(delta)
        if len(parts) > MERGED:
            one = keep(reduce(DataFrame.unionByName, parts), "total")
            for p in parts[:-1]:
                drop(p)
            # the new rows stay a table of their own for the next step
            parts, total = [one], one
        else:
            total = total.unionByName(delta)
    if stop:
        return total
    raise NoFixpoint(f"rows were still new after {rounds} rounds")


def linear(seed: DataFrame, hop: DataFrame, at: str) -> DataFrame:
    """Least set that holds seed and, for a row whose column at is m and each (m, to) of hop, the row with to instead.
    hop is read every round: distinct pairs that are kept.

    Steps double: with all rows of fewer than n hops and the table of walks of n hops, one join gives the rows of fewer
    than 2n, so there are as many rounds as the longest way has bits.  Walks of 2n are made only if their join has no
    more rows than hop (forests, rings, functions); in denser graphs the rounds go on by new rows and walks of n.  In a
    forest, pairs that begin with its edges are not compared with those there are.
    """
    step = hop.toDF("__m", "__to")
    size = step.count()
    parts = [keep(seed.distinct(), "delta")]
    if not size:
        return parts[0]
    columns = parts[0].columns
    walks, most_in, most_out = _degrees(step)
    # a walk with one way into each place, or one way on, is known by its ends, and walks of twice the length are no more
    single = min(most_in, most_out) == 1
    made: list[DataFrame] = []

    def further(rows: DataFrame, _=None) -> DataFrame:
        return rows.join(step, F.col(at) == F.col("__m")).select(*(F.col("__to").alias(c) if c == at else c for c in columns))

    def twice(step: DataFrame) -> DataFrame:
        out = step.join(step.toDF("__n", "__end"), F.col("__to") == F.col("__n")).select("__m", F.col("__end").alias("__to"))
        made.append(keep(out if single else out.distinct(), "walks"))
        return made[-1]

    def done(out: DataFrame) -> DataFrame:
        for t in made:
            drop(t)
        return out

    steps = [step]
    if single:
        # until there are none, or as many as before: these come from a ring
        sizes = [size]
        while sizes[-1] and sizes[-2:] != [sizes[-1]] * 2:
            steps.append(twice(steps[-1]))
            sizes.append(steps[-1].count())
        if not sizes[-1] and len(columns) == 2:
            ways = hop.toDF(*(columns if columns[1] == at else reversed(columns)))
            if parts[0].join(ways, columns, "left_anti").isEmpty():
                # a forest: of two places there is one way at most, so longer ways find new pairs only, each once
                for step in steps[:-1]:
                    parts.append(keep(further(reduce(DataFrame.unionByName, parts)), "delta"))
                return done(reduce(DataFrame.unionByName, parts))
    for k in count():
        total, step = reduce(DataFrame.unionByName, parts), steps[k]
        # where nothing is led to from two sides, different rows lead to different ones
        new = further(total) if most_in == 1 else further(total).distinct()
        parts.append(keep(new.join(total, columns, "left_anti"), "delta"))
        if parts[-1].isEmpty():
            return done(total)
        if k + 1 < len(steps):
            continue
        if not walks:
            return done(reduce(DataFrame.unionByName, parts))
        if walks > size:
            return done(_grow(parts, further))
        steps.append(twice(step))
        if not single:
            walks, most_in, most_out = _degrees(steps[-1])


def _degrees(step: DataFrame) -> tuple[float, int, int]:
    """How many walks of two steps there are, and the most steps to a place and from one."""
    ends = step.select(F.col("__to").alias("n"), F.lit(1).alias("in"), F.lit(0).alias("out")).union(step.select("__m", F.lit(0), F.lit(1)))
    degrees = ends.groupBy("n").agg(F.sum("in").alias("in"), F.sum("out").alias("out"))
    return tuple(degrees.agg(F.sum(F.col("in").cast("double") * F.col("out")), F.max("in"), F.max("out")).first())


def best_fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str], value: str, least: bool = True, rounds: int | None = None) -> DataFrame:
    """Each key's least (or greatest) value, where better values go on to make others."""
    best = F.min if least else F.max
    total = delta = keep(seed.groupBy(*keys).agg(best(value).alias(value)), "delta")
    for _ in _rounds(rounds):
        if delta.isEmpty():
            return total
        before = (total, delta)
        new = step(delta).groupBy(*keys).agg(best(value).alias("__new"))
        better = F.col(value).isNull() | (F.col("__new") < F.col(value) if least else F.col("__new") > F.col(value))
        delta = keep(new.join(total, keys, "left").filter(better).select(*keys, F.col("__new").alias(value)), "delta")
        total = keep(total.unionByName(delta).groupBy(*keys).agg(best(value).alias(value)), "total")
        for old in {x._kept_at: x for x in before}.values():
            drop(old)
    raise NoFixpoint(f"values still improved after {rounds} rounds")


def closure(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Transitive closure: (a, b) with a path of one edge or more.

    Lengths double: of round k are known the pairs nearer than 2**k, and `far`, those at just that distance.  A pair
    between 2**k and 2**(k+1) is one nearer and one of far, a pair at 2**(k+1) is two of far, so a pair is made about
    once in all, and there are as many rounds as the longest distance has bits.
    """
    far = keep(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct(), "far")
    parts = [far]

    def new(left: DataFrame, known: list[DataFrame]) -> DataFrame:
        on = far.select(F.col("a").alias("m"), F.col("b").alias("to"))
        found = left.join(on, F.col("b") == F.col("m")).select("a", F.col("to").alias("b")).distinct()
        return keep(found.join(reduce(DataFrame.unionByName, known), ["a", "b"], "left_anti"), "paths")

    while not far.isEmpty():
        if parts[-1] is not far:
            between = new(reduce(DataFrame.unionByName, parts), [*parts, far])
            parts += [far, between]
        far = new(far, parts)
    return reduce(DataFrame.unionByName, parts)


def reach(edges: DataFrame, sources: DataFrame, a: str = "a", b: str = "b", steps: int | None = None) -> DataFrame:
    """(source, b): what each source reaches, in so many steps at most if given; only the sources' part of the closure
    is worked out."""
    hop = keep(edges.select(F.col(a).alias("m"), F.col(b).alias("to")).distinct(), "hops")
    start = sources.toDF("source").join(hop, F.col("source") == F.col("m")).select("source", F.col("to").alias("b"))
    if steps is None:
        return linear(start, hop, "b")
    return fixpoint(start, lambda delta, _: delta.join(hop, F.col("b") == F.col("m")).select("source", F.col("to").alias("b")), steps - 1, stop=True)


def shortest(edges: DataFrame, sources: DataFrame | None = None, a: str = "a", b: str = "b", d: str = "d") -> DataFrame:
    """(a, b, d): least total over the paths of one edge or more; weights must not be negative."""
    hop = keep(edges.groupBy(F.col(a).alias("m"), F.col(b).alias("to")).agg(F.min(d).alias("w")), "hops")
    start = hop.select(F.col("m").alias("a"), F.col("to").alias("b"), F.col("w").alias("d"))
    if sources is not None:
        start = start.join(sources.toDF("a"), "a", "left_semi")
    return best_fixpoint(start, lambda x: x.join(hop, F.col("b") == F.col("m")).select("a", F.col("to").alias("b"), (F.col("d") + F.col("w")).alias("d")), ["a", "b"], "d")


def shortest_routes(edges: DataFrame, sources: DataFrame | None = None, a: str = "a", b: str = "b", d: str = "d") -> DataFrame:
    """(a, b, d, route): shortest() with the nodes of a path of that total, both ends included; of several paths the one
    that comes, seen from its end, from the least node each time.  Weights must be positive."""
    best = keep(shortest(edges, sources, a, b, d), "best")
    hop = keep(edges.groupBy(F.col(a).alias("c"), F.col(b).alias("b")).agg(F.min(d).alias("w")), "hops")
    direct = best.join(hop, (best.a == hop.c) & (best.b == hop.b) & (best.d == hop.w)).select(best.a, best.b, F.col("c"))
    before = best.select(F.col("a").alias("a2"), F.col("b").alias("c2"), F.col("d").alias("d2"))
    through = best.join(hop, "b").join(before, (F.col("a") == F.col("a2")) & (F.col("c") == F.col("c2")) & (F.col("d2") + F.col("w") == F.col("d"))).select("a", "b", "c")
    last = keep(direct.union(through).groupBy("a", "b").agg(F.min("c").alias("c")), "last")
    now = best.select("a", "b", "d", F.col("b").alias("at"), F.array("b").alias("route"), F.lit(False).alias("done"))
    step = last.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("c").alias("pc"))
    out = None
    while True:
        now = keep(now.join(step, (F.col("a") == F.col("pa")) & (F.col("at") == F.col("pb"))).select("a", "b", "d", F.col("pc").alias("at"), F.concat(F.array("pc"), "route").alias("route"), (F.col("pc") == F.col("a")).alias("done")), "routes")
        ended = now.filter("done").select("a", "b", "d", "route")
        out = ended if out is None else out.union(ended)
        now = now.filter("not done")
        if now.isEmpty():
            return out


def routes(edges: DataFrame, below, sources: DataFrame | None = None, a: str = "a", b: str = "b", d: str = "d") -> DataFrame:
    """(a, b, d) of all walks with a total below the bound."""
    hop = keep(edges.select(F.col(a).alias("m"), F.col(b).alias("to"), F.col(d).alias("w")).distinct(), "hops")
    start = hop.select(F.col("m").alias("a"), F.col("to").alias("b"), F.col("w").alias("d")).filter(F.col("d") < below)
    if sources is not None:
        start = start.join(sources.toDF("a"), "a", "left_semi")
    return fixpoint(start, lambda x, _: x.join(hop, F.col("b") == F.col("m")).select("a", F.col("to").alias("b"), (F.col("d") + F.col("w")).alias("d")).filter(F.col("d") < below))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges u > v.  Large: the greater neighbours of each vertex go to its least one.  Small: the lesser
    neighbours and the vertex itself do."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def classes(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(member, representative): the least member of each undirected component.

    Alternating large and small stars: each step is a minimum for each vertex, combined before the shuffle, and an
    equi-join, which adaptive execution may split, so a vertex of high degree meets in no one task; the number of rounds
    is logarithmic in a component's size.  Self-edges make classes of one.
    """
    all_edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    now = keep(all_edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")
    seen = None
    while True:
        large = keep(_star(now, True), "large")
        after = keep(_star(large, False), "small")
        mark = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        drop(large)
        drop(now)
        now = after
        if mark == seen:
            break
        seen = mark
    least = now.select(F.col("v").alias("member"), F.col("v").alias("representative")).distinct()
    out = now.select(F.col("u").alias("member"), F.col("v").alias("representative")).unionByName(least)
    alone = all_edges.filter(F.col("a").eqNullSafe(F.col("b"))).select(F.col("a").alias("member")).distinct().join(out, "member", "left_anti")
    return out.unionByName(alone.withColumn("representative", F.col("member")))


def strong_pairs(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(a, b), a < b: pairs that reach each other."""
    paths = keep(closure(edges, a, b), "closure")
    return paths.join(paths.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_semi").filter("a < b")


def levels(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 1000) -> DataFrame:
    """(node, level): the most edges on a path from the node; the graph must have no cycles (rounds: where one is
    taken for a cycle)."""
    pairs = keep(edges.select(F.col(a).alias("p"), F.col(b).alias("node")).distinct(), "hops")
    nodes = pairs.select("node").union(pairs.select("p")).distinct().withColumn("level", F.lit(0).cast("long"))
    return best_fixpoint(nodes, lambda x: x.join(pairs, "node").select(F.col("p").alias("node"), (F.col("level") + 1).alias("level")), ["node"], "level", least=False, rounds=rounds)
