"""Compilation of formulas to DataFrames, one column for each free variable.

A conjunction joins its relations on shared variables, the smallest of those that share some first, and applies each
filter, computed term and negation as soon as its variables are there.  Parts of a quantified conjunction that share no
variable with what is asked for are tests of their own, never products.  Everything else is left to Catalyst.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .analyze import UnsafeFormulaError, body_components, bound, check
from .formula import ANY, Aggregate, And, Compare, Compute, Domain, Exists, Formula, Not, Or, Rel, Solve, Var, free
from .rewrite import expand_domains, factor, merge_cycles, simplify

#: A relation is a table, or a view: a function from its environment to one.
Relation = DataFrame | Callable[["Mapping[str, Relation]"], DataFrame]
Environment = Mapping[str, Relation]

_TESTS: dict[str, Callable[[Column, Column], Column]] = {
    "==": lambda a, b: a.eqNullSafe(b),
    "!=": lambda a, b: ~a.eqNullSafe(b),
    "<=": lambda a, b: a <= b,
    "<": lambda a, b: a < b,
}


def query(names: list[str], f: Formula, relations: Environment, spark: SparkSession) -> DataFrame:
    """The distinct answers: bindings of names under which f holds.  A subformula that occurs several times is worked
    out as a relation of its own, whose plan Spark reuses."""
    f = prepare(f)
    check(f, names)
    (f,), defined = factor([f])
    for name, part in defined.items():
        if bound(part) >= free(part):
            relations = {**relations, name: _view(part)}
        else:  # it only filters what is bound outside
            f = _inline(f, name, part)
    return _run(f, relations, spark).select(*names).distinct()


def _view(part: Formula) -> Relation:
    return lambda relations: _run(part, relations, SparkSession.active()).select(*sorted(free(part))).distinct()


def _inline(f: Formula, name: str, part: Formula) -> Formula:
    from .rewrite import _rebuild

    return part if isinstance(f, Rel) and f.name == name else _rebuild(f, lambda g: _inline(g, name, part))


def query_bag(names: list[str], f: Formula, relations: Environment, spark: SparkSession) -> DataFrame:
    """One row for each derivation of a formula without quantifiers."""
    f = prepare(f)
    check(f, names)
    return _run(f, relations, spark, bag=True).select(*names)


def prepare(f: Formula) -> Formula:
    f = expand_domains(simplify(f))
    return merge_cycles(f) if isinstance(f, And) else f


def _scan(rel: Rel, relations: Environment) -> DataFrame:
    source = relations[rel.name]
    df = source(relations) if callable(source) and not isinstance(source, DataFrame) else source
    if len(df.columns) < len(rel.args) or rel.rest is None and len(df.columns) != len(rel.args):
        raise ValueError(f"{rel.name} has {len(df.columns)} columns, not {len(rel.args)}")
    seen: dict[str, Column] = {}
    for c, a in zip(df.columns, rel.args):
        if not isinstance(a, Var):
            df = df.filter(df[c].eqNullSafe(F.lit(a)))
        elif a != ANY and a.name in seen:
            df = df.filter(df[c].eqNullSafe(seen[a.name]))
        elif a != ANY:
            seen[a.name] = df[c]
    if rel.rest is not None:
        seen[rel.rest.name] = F.struct(*(df[c] for c in df.columns[len(rel.args) :]))
    out = df.select(*(c.alias(n) for n, c in seen.items())) if seen else df.select(F.lit(1).alias("__holds"))
    return out


def _col(t) -> Column:
    return F.col(t.name) if isinstance(t, Var) else F.lit(t)


def _run(f: Formula, relations: Environment, spark: SparkSession, bag: bool = False) -> DataFrame:
    return _conjunction([f], None, relations, spark, bag)


def _table(f: Formula, relations: Environment, spark: SparkSession, bag: bool) -> DataFrame:
    """A part that binds all its variables by itself."""
    match f:
        case Rel():
            return _scan(f, relations)
        case Domain(var, low, high):
            return spark.range(low, high + 1).select(F.col("id").alias(var.name))
        case Or(parts):
            names = sorted(free(f))
            out = None
            for p in parts:
                one = _run(p, relations, spark, bag).select(*names)
                out = one if out is None else out.unionByName(one)
            if out is None:
                raise UnsafeFormulaError("an empty disjunction has no columns")
            return out if bag else out.distinct()
        case Exists(names, part):
            linked, *tests = body_components(free(f), list(part.parts) if isinstance(part, And) else [part])
            tests = [t for t in tests if bound(And(tuple(t))) >= free(And(tuple(t)))]
            if linked and tests:
                apart = {id(p) for t in tests for p in t}
                inner = _run(And(tuple(p for p in part.parts if id(p) not in apart)), relations, spark)
                for t in tests:
                    one = _run(And(tuple(t)), relations, spark).limit(1).select(F.lit(1).alias("__one"))
                    inner = inner.join(F.broadcast(one), F.lit(True), "left_semi")
            else:
                inner = _run(part, relations, spark)
            left = [c for c in inner.columns if c not in names and c != "__holds"]
            return inner.select(*left).distinct() if left else inner.select(F.lit(1).alias("__holds")).limit(1)
        case Aggregate(fn, value, part, by, out):
            inner = _run(part, relations, spark, bag=True)
            return inner.groupBy(*by).agg(fn(value.name).alias(out.name))
    return _run(f, relations, spark, bag)


def _conjunction(parts: list[Formula], base: DataFrame | None, relations: Environment, spark: SparkSession, bag: bool) -> DataFrame:
    todo: list[Formula] = []
    for p in parts:
        todo += p.parts if isinstance(p, And) else [p]
    now = base

    def have() -> set[str]:
        return set(now.columns) - {"__holds"} if now is not None else set()

    def apply(p: Formula) -> bool:
        """Apply p if it needs no more variables."""
        nonlocal now
        names = have()
        if isinstance(p, Compare):
            if p.op == "==":
                for x, y in ((p.left, p.right), (p.right, p.left)):
                    if isinstance(x, Var) and x.name not in names and (not isinstance(y, Var) or y.name in names):
                        now = (spark.range(1).select(F.lit(1).alias("__holds")) if now is None else now).withColumn(x.name, _col(y))
                        return True
            if free(p) <= names:
                now = (spark.range(1).select(F.lit(1).alias("__holds")) if now is None else now).filter(_TESTS[p.op](_col(p.left), _col(p.right)))
                return True
        elif isinstance(p, Compute) and free(p) - ({p.out.name} if p.out else set()) <= names:
            value = p.fn(*map(_col, p.inputs))
            now = spark.range(1).select(F.lit(1).alias("__holds")) if now is None else now
            if p.out is None:
                now = now.filter(value)
            elif p.many:
                other = now.withColumn("__out", F.explode(value))
                now = other.filter(F.col("__out").eqNullSafe(F.col(p.out.name))).drop("__out") if p.out.name in names else other.withColumnRenamed("__out", p.out.name)
            else:
                now = now.filter(value.eqNullSafe(F.col(p.out.name))) if p.out.name in names else now.withColumn(p.out.name, value).filter(F.col(p.out.name).isNotNull())
            return True
        elif isinstance(p, Solve) and (mode := p.ready(names)):
            place, fn = mode
            now = spark.range(1).select(F.lit(1).alias("__holds")) if now is None else now
            if place is None:
                now = now.filter(fn(*map(_col, p.args)))
            else:
                out = p.args[place].name
                now = now.withColumn(out, fn(*(_col(a) for i, a in enumerate(p.args) if i != place))).filter(F.col(out).isNotNull())
            return True
        elif isinstance(p, Not) and now is not None and free(p) <= names:
            shared = sorted(free(p))
            # inside the negation, the outer bindings are there for filters
            inner = _conjunction([p.part], now.select(*shared).distinct() if _needs(p.part) else None, relations, spark, False)
            now = now.join(inner.select(*shared).distinct(), shared, "left_anti") if shared else now.join(inner.limit(1).select(F.lit(1).alias("__no")), F.lit(True), "left_anti")
            return True
        return False

    while todo:
        done = [p for p in todo if apply(p)]
        if done:
            todo = [p for p in todo if p not in done]
            continue
        tables = [p for p in todo if not isinstance(p, (Compare, Compute, Not, Solve))]
        if not tables:
            raise UnsafeFormulaError(f"cannot be ordered: {todo}")
        ready = [p for p in tables if free(p) & have()] or tables
        p = min(ready, key=lambda p: _bytes(p, relations)) if len(ready) > 1 else ready[0]
        todo.remove(p)
        if isinstance(p, (Or, Exists)) and now is not None and _needs(p):
            # a part that only filters what is bound: worked out for the bindings at hand
            shared = sorted(free(p) & have())
            seeds = now.select(*shared).distinct()
            branches = p.parts if isinstance(p, Or) else (p.part,)
            keep = sorted(free(p))
            other = None
            for b in branches:
                one = _conjunction([b], seeds, relations, spark, bag).select(*keep)
                other = one if other is None else other.unionByName(one)
            now = now.join(other.distinct(), shared)
            continue
        table = _table(p, relations, spark, bag)
        if now is None:
            now = table
            continue
        shared = [c for c in table.columns if c in have()]
        if not bag and shared and set(table.columns) == set(shared):
            now = now.join(table, shared, "left_semi")
        elif shared:
            now = now.join(table, shared)
        else:
            now = now.drop("__holds").crossJoin(table) if "__holds" in table.columns and len(now.columns) > 1 else now.crossJoin(table.drop("__holds") if len(table.columns) > 1 else table.withColumnRenamed("__holds", "__also"))
            now = now.drop("__also")
    if now is None:
        now = spark.range(1).select(F.lit(1).alias("__holds"))
    return now


def _bytes(p: Formula, relations: Environment) -> int:
    """Catalyst's estimate of a relation's size, after its constants filter it; other parts come after relations."""
    if isinstance(p, Domain):
        return 8 * (p.high - p.low + 1)
    if not isinstance(p, Rel):
        return 1 << 200
    size = int(str(_scan(p, relations)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # an equation with a constant leaves few rows, which estimates from files do not see
    return size // 100 ** sum(not isinstance(a, Var) for a in p.args)


def _needs(f: Formula) -> bool:
    """Whether a part cannot be worked out without bindings from outside."""
    return bool(free(f) - bound(f))
