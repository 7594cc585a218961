"""Formulas: relations, comparisons, connectives, quantifiers, computed terms."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Var:
    name: str


#: An anonymous variable: a column that does not matter.
ANY = Var("_")


class Formula:
    def __and__(self, other: Formula) -> And:
        return And((self, other))

    def __or__(self, other: Formula) -> Or:
        return Or((self, other))

    def __invert__(self) -> Not:
        return Not(self)


@dataclass(frozen=True)
class Rel(Formula):
    """name(args): one argument for each column in order, a Var, ANY or a constant.  With rest, the columns after those
    of args are bound to it as one struct."""

    name: str
    args: tuple[Any, ...]
    rest: Var | None = None


@dataclass(frozen=True)
class Domain(Formula):
    """var is an integer from low to high, both included."""

    var: Var
    low: int
    high: int


@dataclass(frozen=True)
class Compare(Formula):
    """op is one of ==, !=, <=, <."""

    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class And(Formula):
    parts: tuple[Formula, ...]


@dataclass(frozen=True)
class Or(Formula):
    parts: tuple[Formula, ...]


@dataclass(frozen=True)
class Not(Formula):
    part: Formula


@dataclass(frozen=True)
class Imply(Formula):
    left: Formula
    right: Formula


@dataclass(frozen=True)
class Iff(Formula):
    left: Formula
    right: Formula


@dataclass(frozen=True)
class Exists(Formula):
    names: tuple[str, ...]
    part: Formula


@dataclass(frozen=True)
class ForAll(Formula):
    names: tuple[str, ...]
    part: Formula


@dataclass(frozen=True)
class Compute(Formula):
    """out = fn(*inputs) over columns; many: fn gives an array, of which out is each element in turn; with out None fn
    is a test."""

    fn: Callable
    inputs: tuple[Any, ...]
    out: Var | None = None
    many: bool = False


@dataclass(frozen=True)
class Solve(Formula):
    """A relation over args that works in several modes: fns maps the place of the one argument that is not bound to a
    function of the others' columns, in order, which gives it (null: no solution), and None to a test of all."""

    fns: tuple[tuple[int | None, Callable], ...]
    args: tuple[Any, ...]

    def ready(self, names: set[str] | frozenset[str]) -> tuple[int | None, Callable] | None:
        """The mode for these bound variables, if there is one."""
        open_ = [i for i, a in enumerate(self.args) if isinstance(a, Var) and a.name not in names]
        place = open_[0] if open_ else None
        return next(((i, fn) for i, fn in self.fns if i == place), None) if len(open_) <= 1 else None


@dataclass(frozen=True)
class Aggregate(Formula):
    """out = the aggregate fn(column of value) over the solutions of part, for each binding of part's other variables
    named in by."""

    fn: Callable
    value: Var
    part: Formula
    by: tuple[str, ...]
    out: Var


TRUE, FALSE = And(()), Or(())


def eq(a: Any, b: Any) -> Compare:
    return Compare("==", a, b)


def neq(a: Any, b: Any) -> Compare:
    return Compare("!=", a, b)


def le(a: Any, b: Any) -> Compare:
    return Compare("<=", a, b)


def lt(a: Any, b: Any) -> Compare:
    return Compare("<", a, b)


def _named(*terms: Any) -> set[str]:
    return {t.name for t in terms if isinstance(t, Var) and t != ANY}


def free(f: Formula) -> set[str]:
    """Names of the variables that are free in f."""
    match f:
        case Rel(_, args, rest):
            return _named(*args, rest)
        case Domain(var):
            return _named(var)
        case Solve(_, args):
            return _named(*args)
        case Compare(_, a, b):
            return _named(a, b)
        case And(parts) | Or(parts):
            return set().union(*map(free, parts))
        case Not(part):
            return free(part)
        case Imply(a, b) | Iff(a, b):
            return free(a) | free(b)
        case Exists(names, part) | ForAll(names, part):
            return free(part) - set(names)
        case Compute(_, inputs, out, _):
            return _named(*inputs, out)
        case Aggregate(_, _, _, by, out):
            return set(by) | {out.name}
    raise TypeError(f"not a formula: {f!r}")
