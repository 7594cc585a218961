import re

import pytest
from pyspark.sql import functions as F

from relspark.operators import recursion as rec
from relspark.operators import relational as ops
from relspark.plans import analyze, datalog
from relspark.plans.compile import query, query_bag
from relspark.plans.formula import ANY, And, Compute, Exists, ForAll, Iff, Imply, Not, Or, Rel, Solve, Var, eq, le, lt, neq
from relspark.plans.rewrite import clean, factor, merge_cycles, simplify

X, Y, Z = Var("x"), Var("y"), Var("z")
EDGES = [(1, 2), (2, 4), (1, 3), (3, 5), (2, 6), (1, 1), (3, 6), (6, 4)]
LETTERS = [("a", "b"), ("b", "c"), ("d", "e"), ("e", "f"), ("b", "f"), ("f", "a")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGES, "a long, b long")


def got(df):
    return {tuple(r) for r in df.collect()}


def test_scan_with_constants_and_repeats(spark, edge):
    env = {"edge": edge}
    assert got(query(["y"], Rel("edge", (2, Y)), env, spark)) == {(4,), (6,)}
    assert got(query(["x"], Rel("edge", (X, 6)), env, spark)) == {(2,), (3,)}
    assert got(query(["x"], Rel("edge", (X, X)), env, spark)) == {(1,)}


def test_connectives(spark, edge):
    env = {"edge": edge}
    f = And((Rel("edge", (X, Y)), Or((eq(X, 3), eq(Y, 4)))))
    assert got(query(["x", "y"], f, env, spark)) == {(3, 5), (3, 6), (2, 4), (6, 4)}
    f = And((Rel("edge", (X, ANY)), Not(Rel("edge", (X, 6)))))
    assert got(query(["x"], f, env, spark)) == {(1,), (6,)}
    f = And((Rel("edge", (X, ANY)), ForAll(("y",), Imply(Rel("edge", (X, Y)), lt(3, Y)))))
    assert got(query(["x"], f, env, spark)) == {(2,), (3,), (6,)}
    f = And((Rel("edge", (X, Y)), Iff(lt(X, 2), lt(Y, 4))))
    assert got(query(["x", "y"], f, env, spark)) == {(1, 2), (1, 3), (1, 1), (2, 4), (3, 5), (2, 6), (3, 6), (6, 4)}
    f = And((Rel("edge", (X, Y)), Compute(lambda a, b: a + b, (X, Y), Z), neq(Z, 6)))
    assert got(query(["z"], Exists(("x", "y"), f), env, spark)) == {(3,), (4,), (8,), (2,), (9,), (10,)}


def test_bag_and_disconnected_parts(spark, edge):
    env = {"edge": edge}
    f = Exists(("y",), Rel("edge", (X, Y)))
    assert query_bag(["x"], Rel("edge", (X, ANY)), env, spark).count() == 8
    assert query(["x"], f, env, spark).count() == 4
    f = And((Rel("edge", (X, 5)), Exists(("y", "z"), Rel("edge", (Y, Z)))))
    assert got(query(["x"], f, env, spark)) == {(3,)}


def test_unsafe(spark, edge):
    for names, f in ((["x"], lt(X, 3)), (["x", "y"], Rel("edge", (X, 1))), (["x"], And((Rel("edge", (X, 1)), Not(Rel("edge", (X, Y))))))):
        with pytest.raises(analyze.UnsafeFormulaError):
            query(names, f, {"edge": edge}, spark)


def test_rewrites():
    a, b = Rel("a", (X,)), Rel("b", (X,))
    assert simplify(Not(And((a, Not(b))))) == Or((Not(a), b))
    assert simplify(Not(le(X, Y))) == lt(Y, X)
    assert simplify(And((a, eq(X, X)))) == a
    assert merge_cycles(And((le(X, Y), le(Y, Z), le(Z, X)))) == And((eq(X, Y), eq(Y, Z), eq(Z, X)))
    both = And((a, b))
    changed, defined = factor([Or((both, Rel("c", (X,)))), Or((both, Rel("d", (X,))))])
    assert list(defined.values()) == [both] and changed[0].parts[0] == Rel("def0", (X,))
    assert clean(("-", "m", "m")) == () and clean(("-", ("-", "m", "l"), "u")) == ("-", "m", ("+", "l", "u"))
    assert clean(("+", "a", (), ("+", "b", "a"))) == ("+", "a", "b") and clean(("-", "a", ())) == "a"


def test_analysis():
    assert analyze.stratify({"p": {"e", "p"}, "q": {"p"}}, {"q": {"p"}}) == [({"p"}, True), ({"q"}, False)]
    with pytest.raises(analyze.UnsafeFormulaError):
        analyze.stratify({"p": {"q"}, "q": {"p"}}, {"q": {"p"}})
    plus = Compute(lambda a, b: a + b, (X, Y), Z)
    assert analyze.modes({"plus": [(("x", "y", "z"), plus)]}) == {"plus": [frozenset({0, 1})]}
    parts = analyze.body_components({"x"}, [Rel("a", (X,)), Rel("b", (Y,)), Rel("c", (X, Z))])
    assert parts == [[Rel("a", (X,)), Rel("c", (X, Z))], [Rel("b", (Y,))]]


def test_datalog(spark):
    edge = spark.createDataFrame(LETTERS, "a string, b string")
    rules = datalog.parse("path(X, Y) :- edge(X, Y). path(X, Z) :- edge(X, Y), path(Y, Z). from_a(Y) :- path('a', Y). lone(X) :- edge(X, _), not path(X, X).")
    out = datalog.run(datalog.Program(rules), {"edge": edge}, spark)
    assert out["path"].count() == 21
    assert got(out["from_a"]) == {("a",), ("b",), ("c",), ("f",)}
    assert got(out["lone"]) == {("d",), ("e",)}
    with pytest.raises(analyze.UnsafeFormulaError):
        datalog.parse("p(X) :- not q(X).")
    bad = datalog.Program(datalog.parse("p(X, N) :- q(X, N). p(X, N) :- p(X, N), q(X, N)."), {"p": "sum"})
    with pytest.raises(analyze.UnsafeFormulaError):
        datalog.run(bad, {"q": spark.createDataFrame([("a", 1)], "x string, n long")}, spark)


def test_datalog_merges(spark):
    item = spark.createDataFrame([(3, "milk"), (3, "pie"), (7, "milk")], "o long, f string")
    price = spark.createDataFrame([("milk", 3), ("pie", 5)], "f string, p long")
    rules = datalog.parse("cost(O, P) :- item(O, F), price(F, P). most(max, P) :- cost(O, P).")
    out = datalog.run(datalog.Program(rules, {"cost": "sum", "most": "max"}, {"cost"}), {"item": item, "price": price}, spark)
    assert got(out["cost"]) == {(3, 8), (7, 3)} and got(out["most"]) == {("max", 8)}


def test_graphs(spark, edge):
    closed = {(1, y) for y in range(1, 7)} | {(2, 4), (2, 6), (3, 4), (3, 5), (3, 6), (6, 4)}
    assert got(rec.closure(edge)) == closed
    assert got(rec.reach(edge, spark.createDataFrame([(3,)], "s long"))) == {(3, 4), (3, 5), (3, 6)}
    roads = spark.createDataFrame([("a", "b", 1), ("a", "c", 7), ("b", "c", 1), ("c", "d", 1), ("d", "a", 5)], "a string, b string, d long")
    want = "aa8 ab1 ac2 ad3 ba7 bb8 bc1 bd2 ca6 cb7 cc8 cd1 da5 db6 dc7 dd8".split()
    assert got(rec.shortest(roads)) == {(w[0], w[1], int(w[2])) for w in want}
    uedge = spark.createDataFrame([(0, 15), (10, 15), (15, 20), (17, 18), (17, 20), (20, 0), (50, 40)], "a long, b long")
    assert got(rec.classes(uedge)) == {(x, 0) for x in (0, 10, 15, 17, 18, 20)} | {(40, 40), (50, 40)}
    chain = spark.range(1, 61).selectExpr("id as a", "id + 1 as b")
    assert rec.closure(chain).count() == 60 * 61 // 2
    assert got(rec.classes(chain)) == {(i, 1) for i in range(1, 62)}
    assert got(rec.levels(chain.filter("a < 4"))) == {(1, 3), (2, 2), (3, 1), (4, 0)}
    with pytest.raises(rec.NoFixpoint):
        rec.levels(spark.createDataFrame([(1, 2), (2, 1)], "a long, b long"), rounds=5)


def test_joins_and_folds(spark):
    left = spark.createDataFrame([(5, 6), (10, 17), (8, 33), (1, 5), (0, 7), (18, 3)], "k long, v long")
    right = spark.createDataFrame([(7, 61), (10, 20), (18, 33), (11, 5), (20, 111), (0, 77), (8, 3)], "k long, w long")
    assert {r[0] for r in got(ops.join(left, right, ["k"]))} == {0, 8, 10, 18}
    assert {r[0] for r in got(ops.anti_join(left, right, ["k"]))} == {1, 5}
    assert {r[0] for r in got(ops.key_union(left, right, ["k"]))} == {0, 1, 5, 7, 8, 10, 11, 18, 20}
    fold = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (5, 2), (5, 7)], "k long, v long")
    assert got(ops.merge(fold, "sum")) == {(0, 6), (1, 3), (5, 9)}
    assert got(ops.greatest_by_negation(fold, ["k"], "v")) == got(ops.merge(fold, "max"))
    empty = fold.limit(0)
    assert ops.merge(empty, "max").count() == 0 and ops.divide(empty, ["k"], "v", fold).count() == 0
    assert got(ops.divide(fold, ["k"], "v", fold.filter("v < 3 and v > 0"))) == {(0,), (1,)}


def test_no_products_in_plans(spark, edge):
    env = {"edge": edge}
    plan = query(["x", "z"], Exists(("y",), And((Rel("edge", (X, Y)), Rel("edge", (Y, Z)), Not(Rel("edge", (X, Z)))))), env, spark)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "LeftAnti" in plan


def test_positions(spark):
    rows = spark.range(0, 1000).selectExpr("(id * 7919) % 1009 as x")
    assert ops.row_position(rows, ["x"]).agg(F.countDistinct("position"), F.max("position")).first()[:] == (1000, 999)


def test_parts_without_a_link_are_tests(spark, edge):
    env = {"edge": edge, "r": spark.createDataFrame([(1,), (2,)], "x long"), "s": spark.createDataFrame([(7,)], "x long")}
    f = Exists(("y",), And((Rel("r", (X,)), Rel("s", (Y,)))))
    df = query(["x"], f, env, spark)
    assert got(df) == {(1,), (2,)} and "Cartesian" not in df._jdf.queryExecution().toString()
    assert got(query(["x"], Exists(("y",), And((Rel("r", (X,)), Rel("s", (Y,)), lt(Y, 3)))), env, spark)) == set()


def test_small_relations_are_joined_first(spark, tmp_path):
    spark.range(0, 200_000).selectExpr("id as a", "id % 100 as b").write.parquet(str(tmp_path / "big"))
    spark.range(0, 3).selectExpr("id as b", "id as c").write.parquet(str(tmp_path / "small"))
    spark.range(0, 3).selectExpr("id as c").write.parquet(str(tmp_path / "tiny"))
    env = {n: spark.read.parquet(str(tmp_path / n)) for n in ("big", "small", "tiny")}
    f = Exists(("b", "c"), And((Rel("big", (Var("a"), Var("b"))), Rel("small", (Var("b"), Var("c"))), Rel("tiny", (Var("c"),)))))
    df = query(["a"], f, env, spark)
    plan = df._jdf.queryExecution().analyzed().toString()
    assert df.count() == 6000 and re.findall(r"Relation \[(\w)#", plan)[-1] == "a"


def test_finite_domains_and_modes(spark):
    f = And((le(2, X), le(X, 4)))
    assert got(query(["x"], f, {}, spark)) == {(2,), (3,), (4,)}
    plus = lambda a, b, c: Solve(((2, lambda a, b: a + b), (1, lambda a, c: c - a), (0, lambda b, c: c - b), (None, lambda a, b, c: a + b == c)), (a, b, c))
    assert got(query(["x", "y"], And((le(1, X), le(X, 3), plus(X, Y, 5))), {}, spark)) == {(1, 4), (2, 3), (3, 2)}
    assert got(query(["x", "y"], And((le(1, X), le(X, 3), le(1, Y), le(Y, 3), plus(X, Y, 5))), {}, spark)) == {(2, 3), (3, 2)}
    with pytest.raises(analyze.UnsafeFormulaError):
        query(["x", "y"], plus(X, Y, 5), {}, spark)


def test_shared_subformulas_are_one_relation(spark, edge):
    both = Exists(("y",), And((Rel("edge", (X, Y)), Rel("edge", (Y, Z)))))
    f = Or((And((both, lt(X, Z))), And((both, eq(X, 1)))))
    assert got(query(["x", "z"], f, {"edge": edge}, spark)) == {(a, d) for a, b in EDGES for c, d in EDGES if b == c and (a < d or a == 1)}


def test_rest_of_a_relation(spark):
    t = spark.createDataFrame([(1, "a", 2.0), (2, "b", 3.0)], "k long, s string, d double")
    rows = query(["rest"], Rel("t", (2,), Var("rest")), {"t": t}, spark).collect()
    assert [tuple(r.rest) for r in rows] == [("b", 3.0)]


def test_demand_works_out_only_what_is_asked_for(spark):
    chains = spark.range(0, 1000).selectExpr("id as a", "id + 1 as b").filter("a % 10 != 9")
    rules = datalog.parse("path(X, Y) :- edge(X, Y). path(X, Z) :- edge(X, Y), path(Y, Z).")
    program, goal = datalog.demand(datalog.Program(rules), Rel("path", (953, Y)))
    out = datalog.run(program, {"edge": chains}, spark)
    assert "path" not in out and out[goal.name].count() == sum(range(7)) and out[f"asked {goal.name}"].count() == 7
    back = datalog.parse("path(X, Y) :- edge(X, Y). path(X, Z) :- path(X, Y), edge(Y, Z).")
    assert got(datalog.ask(datalog.Program(back), Rel("path", (3, Y)), {"edge": chains}, spark)) == {(i,) for i in range(4, 10)}
    assert datalog.ask(datalog.Program(back), Rel("path", (X, Y)), {"edge": chains.filter("a < 5")}, spark).count() == 15
    least = datalog.parse("near(A, B, W) :- road(A, B, W). near(A, C, D) :- near(A, B, E), road(B, C, W), D = E + W.")
    roads = spark.createDataFrame([("a", "b", 1), ("a", "c", 7), ("b", "c", 1), ("c", "d", 1), ("d", "a", 5)], "a string, b string, d long")
    assert got(datalog.ask(datalog.Program(least, {"near": "min"}), Rel("near", ("a", Y, Z)), {"road": roads}, spark)) == {("b", 1), ("c", 2), ("d", 3), ("a", 8)}
    neg = datalog.parse("p(X, Y) :- e(X, Y), not q(X, Y). q(X, Y) :- e(Y, X).")
    e = spark.createDataFrame([(1, 2), (2, 1), (1, 3)], "a long, b long")
    assert got(datalog.ask(datalog.Program(neg), Rel("p", (1, Y)), {"e": e}, spark)) == {(3,)}


def test_routes(spark):
    roads = spark.createDataFrame([("a", "b", 1), ("a", "c", 7), ("b", "c", 1), ("c", "d", 1), ("d", "a", 5)], "a string, b string, d long")
    routes = {(r.a, r.b): (r.d, r.route) for r in rec.shortest_routes(roads).collect()}
    assert routes["a", "d"] == (3, ["a", "b", "c", "d"]) and routes["a", "a"] == (8, ["a", "b", "c", "d", "a"]) and len(routes) == 16


def test_long_paths_have_no_round_limit(spark):
    chain = spark.range(0, 20).selectExpr("id as a", "id + 1 as b")
    assert rec.reach(chain, spark.createDataFrame([(0,)], "s long")).count() == 20
    assert rec.reach(chain, spark.createDataFrame([(0,)], "s long"), steps=5).count() == 5


def test_definitions_by_formulas(spark, edge):
    rules = datalog.define(Rel("far", (X, Y)), Or((Rel("edge", (X, Y)), Exists(("z",), And((Rel("far", (X, Z)), Rel("edge", (Z, Y))))))))
    assert got(datalog.run(datalog.Program(rules), {"edge": edge}, spark)["far"]) == got(rec.closure(edge))


def test_arithmetic_in_rules(spark):
    t = spark.createDataFrame([(1, 2), (3, 5)], "a long, b long")
    rules = datalog.parse("s(X, Z) :- t(X, Y), Z = X + Y * 2 -1. u(X) :- t(X, Y), X * 2 < Y. v(X) :- t(X, Y), Y - X = 2.")
    out = datalog.run(datalog.Program(rules), {"t": t}, spark)
    assert got(out["s"]) == {(1, 4), (3, 12)} and got(out["u"]) == set() and got(out["v"]) == {(3,)}


def test_terms_and_lists(spark):
    from relspark.functions import lists, terms

    rows = spark.createDataFrame([([9, 9],), ([10, 9],), ([2],)], "v array<int>")
    assert [r.v for r in rows.orderBy(terms.term("vector", F.col("v"), items="number")).collect()] == [[2], [9, 9], [10, 9]]
    raw = spark.createDataFrame([(bytearray(b""),), (bytearray(b"\x00\xff"),), (None,)], "b binary")
    assert [r[0] for r in raw.select(lists.bytes_to_list(F.col("b"))).collect()] == [[], [0, 255], None]
    assert ops.sorted_strictly(spark.range(0, 500).selectExpr("id as p", "id * 2 as v"), ["v"], "p")
    assert not ops.sorted_strictly(spark.range(0, 500).selectExpr("id as p", "id % 499 as v"), ["v"], "p")


def test_a_merge_of_ones_own(spark):
    t = spark.createDataFrame([(1, 1), (1, 4), (2, 2)], "k long, v long")
    e = spark.createDataFrame([(1, 2)], "a long, b long")
    rules = datalog.parse("m(K, V) :- t(K, V). m(B, V) :- m(A, V), e(A, B).")
    out = datalog.run(datalog.Program(rules, {"m": ops.Merge(F.bit_or, idempotent=True)}), {"t": t, "e": e}, spark)["m"]
    assert got(out) == {(1, 5), (2, 7)}
    with pytest.raises(analyze.UnsafeFormulaError):
        datalog.run(datalog.Program(rules, {"m": ops.Merge(F.sum)}), {"t": t, "e": e}, spark)


def test_classes_of_any_shape(spark):
    import random

    rng = random.Random(5)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000, i) for i in range(1001, 1300)] + [(2000 + i, 2001 + i) for i in range(150)] + [(5000, 5000)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    assert got(rec.classes(spark.createDataFrame(pairs, "a long, b long"))) == {(x, root(x)) for x in parent}
