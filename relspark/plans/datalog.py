"""Datalog: rules, facts, strata, merged predicates."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce
from itertools import count
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.recursion import MERGED, NoFixpoint, linear
from ..operators.relational import Merge, is_idempotent, merge
from ..storage import drop, keep
from .analyze import UnsafeFormulaError, stratify
from .compile import Relation, query, query_bag
from .formula import ANY, TRUE, And, Compare, Compute, Domain, Exists, Formula, Not, Or, Rel, Solve, Var, free
from .rewrite import simplify


@dataclass(frozen=True)
class Rule:
    head: Rel
    body: tuple[Formula, ...]


@dataclass
class Program:
    """rules; merges: how the facts of a predicate that agree in all but the last argument are merged (a name, or a
    Merge of one's own); once: predicates whose rules run a single time, as merges that are not idempotent must."""

    rules: list[Rule]
    merges: dict[str, str | Merge] = field(default_factory=dict)
    once: set[str] = field(default_factory=set)


_TOKEN = re.compile(r"""\s*(?:(?P<text>"[^"]*"|'[^']*')|(?P<number>-?\d+(?:\.\d+)?)|(?P<name>[A-Za-z][A-Za-z0-9_]*)|(?P<op>:-|<=|>=|!=|=|<|>|\(|\)|,|\.(?!\d)|_|[-+*/]))""")
_ARITHMETIC: dict[str, Callable] = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b}


@dataclass(frozen=True)
class _Sum:
    """A term of arithmetic: its variables and constants, and what makes a column of theirs."""

    inputs: tuple
    column: Callable

    @staticmethod
    def of(op: str, left: Any, right: Any) -> _Sum:
        a, b = (x if isinstance(x, _Sum) else _Sum((x,), lambda c: c) for x in (left, right))
        n = len(a.inputs)
        return _Sum(a.inputs + b.inputs, lambda *c: _ARITHMETIC[op](a.column(*c[:n]), b.column(*c[n:])))


def parse(source: str) -> list[Rule]:
    """Rules such as  path(X, Z) :- path(X, Y), edge(Y, Z), not bad(Z), X != Z.  Terms of + - * / stand on either side
    of a comparison, as in  near(B, D) :- near(C, E), road(C, B, W), D = E + W.

    Names in capitals are variables, _ is anonymous, quoted texts and numbers are constants; % begins a comment.
    """
    source = re.sub(r"%[^\n]*", "", source)
    tokens: list[tuple[str, str]] = []
    at = 0
    while source[at:].strip():
        m = _TOKEN.match(source, at)
        if not m:
            raise ValueError(f"cannot read: {source[at : at + 30]!r}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    i = 0

    def take(value: str | None = None) -> tuple[str, str]:
        nonlocal i
        if i >= len(tokens) or value is not None and tokens[i][1] != value:
            raise ValueError(f"expected {value}, found {tokens[i : i + 3]}")
        i += 1
        return tokens[i - 1]

    def term() -> Any:
        kind, text = take()
        if kind == "text":
            return text[1:-1]
        if kind == "number":
            return float(text) if "." in text else int(text)
        if text == "_":
            return ANY
        return Var(text) if text[0].isupper() else text

    def atom() -> Formula:
        if tokens[i] == ("name", "not"):
            take()
            return Not(atom())
        if tokens[i][0] == "name" and i + 1 < len(tokens) and tokens[i + 1][1] == "(":
            name = take()[1]
            take("(")
            args = [] if tokens[i][1] == ")" else [term()]
            while tokens[i][1] == ",":
                take()
                args.append(term())
            take(")")
            return Rel(name, tuple(args))
        left, op, right = expression(), take()[1], expression()
        if op in (">", ">="):
            left, right, op = right, left, op.replace(">", "<")
        op = "==" if op == "=" else op
        if not isinstance(left, _Sum) and not isinstance(right, _Sum):
            return Compare(op, left, right)
        if op == "==" and isinstance(left, Var):
            return Compute(right.column, right.inputs, left)
        if op == "==" and isinstance(right, Var):
            return Compute(left.column, left.inputs, right)
        a, b = (x if isinstance(x, _Sum) else _Sum((x,), lambda c: c) for x in (left, right))
        n = len(a.inputs)
        test = {"==": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y}[op]
        return Compute(lambda *c: test(a.column(*c[:n]), b.column(*c[n:])), a.inputs + b.inputs)

    def product() -> Any:
        out = term()
        while i < len(tokens) and tokens[i][1] in ("*", "/"):
            out = _Sum.of(take()[1], out, term())
        return out

    def expression() -> Any:
        out = product()
        while i < len(tokens) and (tokens[i][1] in ("+", "-") or tokens[i][0] == "number" and tokens[i][1][0] == "-"):
            if tokens[i][0] == "number":  # X -1
                tokens[i] = ("number", tokens[i][1][1:])
                out = _Sum.of("-", out, product())
            else:
                out = _Sum.of(take()[1], out, product())
        return out

    rules = []
    while i < len(tokens):
        head = atom()
        body: list[Formula] = []
        if tokens[i][1] == ":-":
            take()
            body.append(atom())
            while tokens[i][1] == ",":
                take()
                body.append(atom())
        take(".")
        rules.append(Rule(head, tuple(body)))
    for r in rules:
        safe(r)
    return rules


def safe(rule: Rule) -> None:
    """Head and negated variables must occur in what the body binds."""
    from .analyze import check

    check(And(rule.body), free(rule.head))


def _used(f: Formula, negated: bool = False) -> list[tuple[str, bool]]:
    match f:
        case Rel(name, _):
            return [(name, negated)]
        case Not(part):
            return _used(part, True)
        case And(parts):
            return [x for p in parts for x in _used(p, negated)]
        case Compare() | Compute() | Domain() | Solve():
            return []
    parts = getattr(f, "parts", None) or (getattr(f, "part", None),)
    return [x for p in parts if p is not None for x in _used(p, True)]


def run(program: Program, facts: Mapping[str, DataFrame], spark: SparkSession, rounds: int | None = None) -> dict[str, DataFrame]:
    """All predicates' facts, by stratum, semi-naively inside a recursive one."""
    known: dict[str, Relation] = dict(facts)
    by_name: dict[str, list[Rule]] = {}
    for r in program.rules:
        by_name.setdefault(r.head.name, []).append(r)
    depends = {n: {u for r in rules for f in r.body for u, _ in _used(f)} for n, rules in by_name.items()}
    against = {n: {u for r in rules for f in r.body for u, neg in _used(f) if neg} for n, rules in by_name.items()}
    for n, kind in program.merges.items():
        # what reads a merged predicate waits for it, unless a better value can only add to what follows
        if not is_idempotent(kind):
            for reader in depends:
                if n in depends[reader]:
                    against.setdefault(reader, set()).add(n)
    for part, recursive in stratify(depends, against):
        if recursive and not part & program.once:
            for n in part:
                if not is_idempotent(program.merges.get(n, "min")):
                    raise UnsafeFormulaError(f"{n}: {program.merges[n]} inside a recursion has no fixpoint")
            _fixpoint(part, by_name, program, known, spark, rounds)
        else:
            for n in sorted(part):
                known[n] = _once(by_name[n], program.merges.get(n), known, spark, facts.get(n))
    return {n: known[n] for n in {*by_name, *facts}}


def define(head: Rel, body: Formula) -> list[Rule]:
    """Rules for a relation that is defined by any formula, which may use the relation itself: its disjunctions become
    rules, and what it quantifies becomes variables of their bodies."""
    fresh = iter(range(1 << 30))

    def normal(f: Formula) -> list[tuple[Formula, ...]]:
        match f:
            case Or(parts):
                return [x for p in parts for x in normal(p)]
            case And(parts):
                out: list[tuple[Formula, ...]] = [()]
                for p in parts:
                    out = [a + b for a in out for b in normal(p)]
                return out
            case Exists(names, part):
                return normal(_renamed(part, {n: f"{n}'{next(fresh)}" for n in names}))
        return [(f,)]

    rules = [Rule(head, body) for body in normal(simplify(body))]
    for r in rules:
        safe(r)
    return rules


def _renamed(f: Formula, names: dict[str, str]) -> Formula:
    from dataclasses import fields, replace

    def change(x):
        if isinstance(x, Var):
            return Var(names.get(x.name, x.name))
        if isinstance(x, Formula):
            return _renamed(x, names)
        return tuple(map(change, x)) if isinstance(x, tuple) and any(isinstance(y, (Var, Formula)) for y in x) else x

    if isinstance(f, Exists):
        return Exists(f.names, _renamed(f.part, {k: v for k, v in names.items() if k not in f.names}))
    return replace(f, **{x.name: change(getattr(f, x.name)) for x in fields(f) if x.name not in ("names", "by", "fns")})


def demand(program: Program, goal: Rel) -> tuple[Program, Rel]:
    """The program that works out only what the goal's constants ask for (magic sets), and the goal in it.

    A predicate that is asked for with some places bound gets a copy for them, guarded by a relation of the bindings
    that are asked for; bindings are passed from left to right.  Predicates asked for without any, or under a negation,
    are worked out whole, as are merged ones whose bound places include the merged value.
    """
    by_name: dict[str, list[Rule]] = {}
    for r in program.rules:
        by_name.setdefault(r.head.name, []).append(r)
    rules: list[Rule] = []
    merges, once = dict(program.merges), set(program.once)
    whole: set[str] = set()

    def keep_whole(name: str) -> None:
        if name in by_name and name not in whole:
            whole.add(name)
            rules.extend(by_name[name])
            for r in by_name[name]:
                for f in r.body:
                    for u, _ in _used(f):
                        keep_whole(u)

    def places(atom: Rel, have: set[str]) -> tuple[int, ...]:
        last = len(atom.args) - 1 if atom.name in program.merges else len(atom.args)
        return tuple(i for i, a in enumerate(atom.args[:last]) if not isinstance(a, Var) or a != ANY and a.name in have)

    def name_of(name: str, at: tuple[int, ...]) -> str:
        return f"{name}/{''.join(map(str, at))}"

    todo = [(goal.name, places(goal, set()))]
    done: set[tuple[str, tuple[int, ...]]] = set()
    if not todo[0][1] or goal.name in program.once:
        return program, goal
    start = name_of(goal.name, todo[0][1])
    rules.append(Rule(Rel(f"asked {start}", tuple(goal.args[i] for i in todo[0][1])), ()))
    while todo:
        name, at = todo.pop()
        if (name, at) in done:
            continue
        done.add((name, at))
        own = name_of(name, at)
        if name in program.merges:
            merges[own] = program.merges[name]
        for r in by_name[name]:
            asked = Rel(f"asked {own}", tuple(r.head.args[i] for i in at))
            body: list[Formula] = [asked]
            have = set(free(asked))
            for f in r.body:
                if isinstance(f, Rel) and f.name in by_name and f.name not in program.once and (to := places(f, have)):
                    inner = name_of(f.name, to)
                    wanted = tuple(f.args[i] for i in to)
                    if (f.name, to) != (name, at) or wanted != asked.args:
                        rules.append(Rule(Rel(f"asked {inner}", wanted), tuple(body)))
                    todo.append((f.name, to))
                    f = Rel(inner, f.args)
                else:
                    for u, _ in _used(f):
                        keep_whole(u)
                body.append(f)
                have |= free(f)
            rules.append(Rule(Rel(own, r.head.args), tuple(body)))
    return Program(rules, merges, once), Rel(start, goal.args)


def ask(program: Program, goal: Rel, facts: Mapping[str, DataFrame], spark: SparkSession, rounds: int | None = None) -> DataFrame:
    """The goal's answers, one column for each of its variables; only what its constants ask for is worked out."""
    seeded, atom = demand(program, goal)
    out = run(seeded, facts, spark, rounds)
    names = list(dict.fromkeys(a.name for a in goal.args if isinstance(a, Var) and a != ANY))
    return query(names, atom, out, spark)


def _columns(n: int) -> list[str]:
    return [f"c{i}" for i in range(n)]


def _apply(rule: Rule, known: Mapping[str, Relation], spark: SparkSession, bag: bool) -> DataFrame:
    names = _columns(len(rule.head.args))
    if not rule.body:
        return spark.range(1).select(*(F.lit(a).alias(n) for n, a in zip(names, rule.head.args)))
    wanted = sorted(free(rule.head))
    got = (query_bag if bag else query)(wanted, And(rule.body), known, spark)
    return got.select(*((F.col(a.name) if isinstance(a, Var) else F.lit(a)).alias(n) for n, a in zip(names, rule.head.args)))


def _once(rules: list[Rule], how: str | None, known: Mapping[str, Relation], spark: SparkSession, given: DataFrame | None) -> DataFrame:
    """One production: for a merged predicate every derivation counts, over sets of facts."""
    parts = [_apply(r, known, spark, bag=how is not None) for r in rules]
    if given is not None:
        parts.append(given.toDF(*_columns(len(given.columns))))
    out = reduce(lambda a, b: a.union(b), parts)
    return merge(out, how) if how else out.distinct()


def _kept(df: Relation) -> Relation:
    """df itself, or, where making it deals rows anew, a table of it for the rounds that read it."""
    return keep(df) if isinstance(df, DataFrame) and "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


def _hop(name: str, rules: list[Rule], part: set[str]) -> tuple[int, Rel, bool] | None:
    """For a predicate whose only recursive rule changes one place along a relation of two,
    p(X, Z) :- p(X, Y), e(Y, Z): the place, the relation, and whether it leads from its first column to its second."""
    recursive = [r for r in rules if any(u in part for f in r.body for u, _ in _used(f))]
    if part != {name} or len(recursive) != 1:
        return None
    head, body = recursive[0].head, recursive[0].body
    if len(body) != 2 or not all(isinstance(f, Rel) and f.rest is None for f in body) or [f.name == name for f in body].count(True) != 1:
        return None
    own, other = sorted(body, key=lambda f: f.name != name)
    places = [i for i, (x, y) in enumerate(zip(own.args, head.args)) if x != y]
    if len(own.args) != len(head.args) or len(places) != 1 or len(other.args) != 2:
        return None
    before, after = own.args[places[0]], head.args[places[0]]
    names = [*own.args, after]
    if not all(isinstance(a, Var) and a != ANY for a in names) or len(set(names)) != len(names) or set(other.args) != {before, after}:
        return None
    return places[0], other, other.args[0] == before


def _fixpoint(part: set[str], by_name: dict[str, list[Rule]], program: Program, known: dict[str, Relation], spark: SparkSession, rounds: int | None) -> None:
    recursive = [r for n in part for r in by_name[n] if any(u in part for f in r.body for u, _ in _used(f))]
    name = min(part)
    hop = _hop(name, by_name[name], part) if rounds is None and name not in program.merges else None
    if hop:
        at, other, forth = hop
        pairs = keep(query([a.name for a in other.args], other, known, spark), "hops")
        given = {**known, other.name: pairs}
    else:
        read = {u for r in recursive for f in r.body for u, _ in _used(f)} & known.keys() - part
        given = {**known, **{u: _kept(known[u]) for u in read}}
    seeds: dict[str, DataFrame] = {}
    for n in sorted(part):
        first = [r for r in by_name[n] if r not in recursive]
        parts = [_apply(r, given, spark, False) for r in first]
        if n in known:
            parts.append(known[n].toDF(*_columns(len(known[n].columns))))
        seeds[n] = reduce(lambda a, b: a.union(b), parts) if parts else None
    if hop and seeds[name] is not None:
        known[name] = linear(seeds[name], pairs if forth else pairs.select(*reversed(pairs.columns)), seeds[name].columns[at])
        return
    blank = next(d for d in seeds.values() if d is not None)
    total, delta = {}, {}
    for n in sorted(part):
        d = seeds[n]
        if d is None:  # starts empty, with the types its rules will give
            r = by_name[n][0]
            d = _apply(r, {**known, **{m: (s if s is not None else blank) for m, s in seeds.items()}}, spark, False).limit(0)
        how = program.merges.get(n)
        total[n] = delta[n] = keep(merge(d, how) if how else d.distinct(), n)
    parts = {n: [d] for n, d in total.items()}
    for _ in count() if rounds is None else range(rounds):
        if all(d.isEmpty() for d in delta.values()):
            known.update(total)
            return
        fresh: dict[str, list[DataFrame]] = {n: [] for n in part}
        for n in sorted(part):
            for r in by_name[n]:
                places = [i for i, f in enumerate(r.body) if isinstance(f, Rel) and f.name in part]
                for i in places:  # the i-th use sees the new facts only, the others all
                    body = list(r.body)
                    body[i] = Rel("delta " + r.body[i].name, r.body[i].args)
                    fresh[n].append(_apply(Rule(r.head, tuple(body)), {**given, **total, **{"delta " + m: d for m, d in delta.items()}}, spark, False))
        for n in sorted(part):
            names, how = total[n].columns, program.merges.get(n)
            if not fresh[n]:
                delta[n] = total[n].limit(0)
                continue
            new = reduce(lambda a, b: a.union(b), fresh[n])
            if not how:
                delta[n] = keep(new.distinct().join(total[n], names, "left_anti"), n)
                parts[n].append(delta[n])
                if len(parts[n]) > MERGED:
                    # a plan of many rounds' tables grows with the rounds: they are made one now and then
                    one = keep(reduce(DataFrame.unionByName, parts[n]), n)
                    for p in parts[n][:-1]:
                        drop(p)
                    parts[n], total[n] = [one], one
                else:
                    total[n] = total[n].unionByName(delta[n])
            else:
                both = keep(merge(total[n].union(new), how), n)
                delta[n] = keep(both.join(total[n], names, "left_anti"), n)
                total[n] = both
    raise NoFixpoint(f"facts were still new after {rounds} rounds: {', '.join(sorted(part))}")
