"""A small language of terms, compiled to columns: primitives, control, anonymous functions, templates.

A term is a Var (a column), a constant, or a tuple that begins with the name of a primitive or of a form:

    ("if", test, then, else)   ("cond", (test, value), ..., ("else", value))   ("when", test, value)
    ("unless", test, value)    ("and", ...)   ("or", ...)   ("let", (("x", term), ...), body), let* likewise
    ("lambda", ("x", ...), body), where a primitive takes a function
    ("quote", constant)        ("quasiquote", template), with ("unquote", term) in lists of the template
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.formula import Var
from . import arith, lists

#: By name: functions of columns.  Those of HIGHER take a function of columns first.
PRIMITIVES: dict[str, Callable[..., Column]] = {
    "+": lambda *x: _chain(x, lambda a, b: a + b),
    "-": lambda a, b=None: -a if b is None else a - b,
    "*": lambda *x: _chain(x, lambda a, b: a * b),
    "/": lambda a, b: a / b,
    "=": lambda a, b: a == b,
    "equal?": lambda a, b: a.eqNullSafe(b),
    "not": lambda a: ~a,
    "<=": lambda a, b: a <= b,
    "<": lambda a, b: a < b,
    ">=": lambda a, b: a >= b,
    ">": lambda a, b: a > b,
    "floor": arith.floor,
    "integer": lambda a: a.cast("bigint"),  # a fold's start has the type of its results
    "min": lambda *x: F.least(*x) if len(x) > 1 else F.array_min(x[0]),
    "max": lambda *x: F.greatest(*x) if len(x) > 1 else F.array_max(x[0]),
    "sum": lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, b: a + b),
    "cons": lists.cons,
    "car": lists.head,
    "cdr": lists.tail,
    "list": F.array,
    "vector": F.array,
    "length": lists.length,
    "vector-length": lists.length,
    "vector-ref": lists.ref,
    "append": lambda *x: F.concat(*x),
    "member": lists.member,
    "remove": lists.remove,
    "reverse": F.reverse,
    "list->set": lambda xs: F.sort_array(F.array_distinct(xs)),
    "set-union": lambda a, b: F.sort_array(F.array_union(a, b)),
    "set-subtract": lambda a, b: F.sort_array(F.array_except(a, b)),
    "set-count": lambda xs: F.size(F.array_distinct(xs)),
    "bytes->list": lists.bytes_to_list,
    "list->bytes": lists.list_to_bytes,
    "bytes-length": F.octet_length,
    "bytes-ref": lists.bytes_ref,
    "string->bytes": arith.to_bytes,
    "bytes->string": arith.to_text,
    "string-append": lambda *x: F.concat(*x),
    "dict-ref": lambda d, k, default=None: F.coalesce(F.try_element_at(d, k), default) if default is not None else F.try_element_at(d, k),
    "dict-count": F.size,
}
HIGHER: dict[str, Callable[..., Column]] = {
    "map": lambda f, xs: F.transform(xs, f),
    "filter": lambda f, xs: F.filter(xs, f),
    "filter-not": lambda f, xs: F.filter(xs, lambda x: ~f(x)),
    "map/append": lambda f, xs: lists.map_append(xs, f),
    "foldl": lambda f, start, xs: F.aggregate(xs, start, lambda a, x: f(x, a)),
    "foldr": lambda f, start, xs: F.aggregate(F.reverse(xs), start, lambda a, x: f(x, a)),
    "map/merge": lambda f, default, a, b: lists.map_merge(a, b, f, default),
}


def _chain(items, f) -> Column:
    out = items[0]
    for x in items[1:]:
        out = f(out, x)
    return out


def column(term: Any, env: Mapping[str, Column] | None = None) -> Column:
    """A term as a column; env: columns of variables, which else are those of their names."""
    env = env or {}
    if isinstance(term, Var):
        return env.get(term.name, F.col(term.name))
    if not isinstance(term, tuple):
        return F.lit(term)
    name, *args = term
    match name:
        case "if":
            test, then, other = (column(a, env) for a in args)
            return F.when(test, then).otherwise(other)
        case "cond":
            out = None
            for test, value in args:
                if test == "else":
                    return column(value, env) if out is None else out.otherwise(column(value, env))
                made = column(test, env), column(value, env)
                out = F.when(*made) if out is None else out.when(*made)
            return out
        case "when" | "unless":
            test = column(args[0], env)
            return F.when(test if name == "when" else ~test, column(args[1], env))
        case "and" | "or":
            parts = [column(a, env) for a in args] or [F.lit(name == "and")]
            return _chain(parts, (lambda a, b: a & b) if name == "and" else (lambda a, b: a | b))
        case "let" | "let*":
            inner = dict(env)
            for variable, value in args[0]:
                inner[variable] = column(value, inner if name == "let*" else env)
            return column(args[1], inner)
        case "quote":
            return _template(args[0], env, False)
        case "quasiquote":
            return _template(args[0], env, True)
    if name in HIGHER:
        return HIGHER[name](_function(args[0], env), *(column(a, env) for a in args[1:]))
    if name not in PRIMITIVES:
        raise NameError(f"no primitive {name}")
    return PRIMITIVES[name](*(column(a, env) for a in args))


def _function(term: Any, env: Mapping[str, Column]) -> Callable[..., Column]:
    if isinstance(term, str) and term in PRIMITIVES:
        return PRIMITIVES[term]
    if not (isinstance(term, tuple) and term[0] == "lambda"):
        raise TypeError(f"not a function: {term!r}")
    _, names, body = term
    # the host counts a function's arguments by its signature
    return {
        1: lambda a: column(body, {**env, names[0]: a}),
        2: lambda a, b: column(body, {**env, names[0]: a, names[1]: b}),
    }[len(names)]


def _template(term: Any, env: Mapping[str, Column], holes: bool) -> Column:
    if holes and isinstance(term, tuple) and term[:1] == ("unquote",):
        return column(term[1], env)
    return F.array(*(_template(x, env, holes) for x in term)) if isinstance(term, list) else F.lit(term)
