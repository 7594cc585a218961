"""Steps that double: whole results on graphs of several shapes, in few rounds."""

import random

import pytest

from relspark.operators import recursion as rec
from relspark.plans import datalog


def pairs_from(edges, sources):
    out = set()
    for s in sources:
        now = {b for a, b in edges if a == s}
        while now:
            out |= {(s, b) for b in now}
            now = {b for a, b in edges if a in now} - {b for x, b in out if x == s}
    return out


SHAPES = {
    "chains": [(i, i + 1) for i in range(21) if i % 9 != 5],
    "ring": [(i, (i + 1) % 13) for i in range(13)],
    "tree": [(i // 2, i) for i in range(1, 30)],
    "into a ring": [(i, i // 2 if i > 3 else (i + 1) % 4) for i in range(25)],
    "dense": [(r.randrange(14), r.randrange(14)) for r in [random.Random(3)] for _ in range(30)],
    "long and dense": [(i, i + k) for i in range(20) for k in (1, 2)],
    "itself": [(1, 1), (1, 2)],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_shapes(spark, shape):
    edges = SHAPES[shape]
    e = spark.createDataFrame(edges, "a long, b long")
    nodes = {x for p in edges for x in p}
    want = pairs_from(edges, nodes)
    some = sorted(nodes)[::3]
    sources = spark.createDataFrame([(s,) for s in [*some, some[0], 999]], "s long")
    assert sorted(map(tuple, rec.reach(e, sources).collect())) == sorted(p for p in want if p[0] in some)
    for rule in ("p(X, Z) :- p(X, Y), e(Y, Z).", "p(X, Z) :- e(X, Y), p(Y, Z)."):
        got = datalog.run(datalog.Program(datalog.parse(f"p(X, Y) :- e(X, Y). {rule}")), {"e": e}, spark)["p"]
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_a_place_in_the_middle(spark):
    """Other columns stay as they are; facts given for the predicate are a seed too."""
    rules = datalog.parse("p(S, X, W) :- s(S, X, W). p(S, Y, W) :- up(Y, X), p(S, X, W).")
    facts = {"s": spark.createDataFrame([("a", 3, 0.5), ("b", 1, 1.5)], "s string, x long, w double"), "up": spark.createDataFrame([(i + 1, i) for i in range(6)], "y long, x long"), "p": spark.createDataFrame([("c", 5, 2.5)], "s string, x long, w double")}
    got = sorted(map(tuple, datalog.run(datalog.Program(rules), facts, spark)["p"].collect()))
    assert got == sorted([("a", i, 0.5) for i in range(3, 7)] + [("b", i, 1.5) for i in range(1, 7)] + [("c", i, 2.5) for i in (5, 6)])


@pytest.mark.parametrize("starts", [[(0, 1), (0, 3)], [(0, 1), (2, 3), (2, 3)], [(9, 0), (9, 4), (0, 4)]])
def test_starts_on_a_chain(spark, starts):
    """Starts that are edges, and starts that are farther, whose ways meet."""
    rules = datalog.parse("p(X, Y) :- s(X, Y). p(X, Z) :- p(X, Y), e(Y, Z).")
    facts = {"s": spark.createDataFrame(starts, "a long, b long"), "e": spark.createDataFrame([(i, i + 1) for i in range(6)], "a long, b long")}
    got = datalog.run(datalog.Program(rules), facts, spark)["p"].collect()
    assert sorted(map(tuple, got)) == sorted({(x, z) for x, y in starts for z in range(y, 7)})


@pytest.fixture
def tables(monkeypatch):
    """The names of the tables that are kept."""
    made = []
    for module in (rec, datalog):
        own = module.keep
        monkeypatch.setattr(module, "keep", lambda df, name="kept", own=own: made.append(name) or own(df, name))
    return made


CHAIN = [(i, i + 1) for i in range(40)]


def test_reach_in_few_rounds(spark, tables):
    got = rec.reach(spark.createDataFrame(CHAIN, "a long, b long"), spark.createDataFrame([(0,), (7,)], "s long"))
    assert got.count() == 40 + 33 and len(tables) <= 16


def test_datalog_in_few_rounds(spark, tables):
    rules = datalog.parse("p(X, Y) :- e(X, Y). p(X, Z) :- p(X, Y), e(Y, Z).")
    got = datalog.run(datalog.Program(rules), {"e": spark.createDataFrame(CHAIN, "a long, b long")}, spark)["p"]
    assert got.count() == 40 * 41 // 2 and len(tables) <= 16


def test_what_rounds_read_is_made_once(spark, tables):
    """A recursion of another form reads a table of its edges, if they have to be dealt."""
    edges = spark.createDataFrame([(i, i + 1, k) for i in range(4) for k in range(3)], "a long, b long, k long").groupBy("a", "b").count().select("a", "b")
    rules = datalog.parse("p(X, Y) :- e(X, Y). p(X, Z) :- p(X, Y), e(Y, Z), X < Z.")
    got = datalog.run(datalog.Program(rules), {"e": edges}, spark)["p"]
    assert got.count() == 10 and tables.count("kept") == 1
