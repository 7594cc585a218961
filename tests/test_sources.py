import io

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relspark.cli import csv2tsv
from relspark.functions import arith, expr, lists, terms, trigram
from relspark.plans import datalog
from relspark.plans.formula import Rel, Var
from relspark.sources import files
from relspark.sources.catalog import Catalog
from relspark.streaming import ticks


def got(df):
    return {tuple(r) for r in df.collect()}


def test_delimited(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('k\tt\n1\t"x\n2\t\n')
    assert got(files.read(spark, f"{tmp_path}/a.tsv", "k long, t string", header=["k", "t"])) == {(1, '"x'), (2, "")}
    with pytest.raises(files.HeaderError):
        files.read(spark, f"{tmp_path}/a.tsv", "k long, t string", header="k\tu")
    (tmp_path / "a.csv").write_text('1,"a ""b"", c"\nx,d\n')
    rows = files.read(spark, f"{tmp_path}/a.csv", "k long, t string", strict=False)
    assert got(rows) == {(1, 'a "b", c'), (None, "d")}
    with pytest.raises(PySparkException):
        files.read(spark, f"{tmp_path}/a.csv", "k long, t string").collect()
    (tmp_path / "a.json").write_text('[{"k": 1, "t": "é"}, {"k": 2}]')
    assert got(files.read(spark, f"{tmp_path}/a.json", "k long, t string")) == {(1, "é"), (2, None)}
    doubled = files.read(spark, f"{tmp_path}/a.json", "k long, t string", map=lambda d: d.withColumn("k", F.col("k") * 2), filter="k > 2")
    assert got(doubled) == {(4, None)}


@pytest.mark.parametrize("fmt", ["tsv", "csv", "jsonl", "json", "parquet"])
def test_round_trip(spark, tmp_path, fmt):
    rows = spark.createDataFrame([(1, "a,b"), (-2, 'q"uote'), (3, "")], "k long, t string")
    files.write(rows, f"{tmp_path}/x.{fmt}")
    assert got(files.read(spark, f"{tmp_path}/x.{fmt}", "k long, t string")) == got(rows)
    with pytest.raises(PySparkException):
        files.write(rows, f"{tmp_path}/x.{fmt}")


def test_csv2tsv():
    out = io.StringIO()
    csv2tsv(io.StringIO('a,"b,c"\n1,""\n'), out)
    assert out.getvalue() == "a\tb,c\n1\t\n"


def test_catalog(spark, tmp_path):
    path = f"{tmp_path}/db"
    c = Catalog(spark, path)
    for name, lo, hi in (("main", 0, 500), ("lower", 0, 200), ("upper", 300, 500)):
        c.create(name, "value bigint")
        c.insert(name, spark.range(lo, hi).toDF("value"))
    c.commit()
    c.assign("main", ("-", ("-", "main", "lower"), "upper"))
    assert got(c.relation("main")) == {(i,) for i in range(200, 300)}
    c.revert()
    assert c.relation("main").count() == 500
    c.assign("main", ("-", "main", "main"))
    assert c.relation("main").isEmpty()
    c.revert()
    c.add_index("upper", ["value"])
    c.insert("upper", spark.range(0, 3).toDF("value"))
    c.compact("upper")
    c.rename("upper", "up")
    c.rename_attributes("up", ["v"])
    c.copy("up", "again")
    c.delete("lower")
    c.commit()
    again = Catalog(spark, path)
    assert again.names() == ["again", "main", "up"] and again.ordered("up", ["v"]).first()[0] == 0
    assert again.relation("again").count() == 203
    assert again.vacuum() and again.relation("up").count() == 203
    with pytest.raises(TypeError):
        again.insert("up", spark.createDataFrame([("x",)], "v string"))
    with pytest.raises(KeyError):
        again.relation("lower")
    (tmp_path / "s.tsv").write_text("b\na\n")
    build = lambda s, p: files.read(s, p, "t string")
    assert again.materialize("texts", f"{tmp_path}/s.tsv", build) and not again.materialize("texts", f"{tmp_path}/s.tsv", build)
    assert got(again.texts("texts")) == {("a", 0), ("b", 1)}
    again.export("texts", f"{tmp_path}/out")
    again.import_("copied", f"{tmp_path}/out")
    assert got(again.relation("copied")) == {("a",), ("b",)}


def test_lists(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 3, 5], [3, 5], [1, 2])], "xs array<int>, tail array<int>, head array<int>")
    xs = F.col("xs")
    row = df.select(
        F.size(lists.splits(xs)), lists.append_suffix(F.col("head"), xs), lists.append_prefix(F.col("tail"), xs), lists.append_prefix(F.col("head"), xs), lists.unique(xs), lists.remove(F.lit(3), xs),
        lists.member(F.lit(9), xs), lists.head(xs), lists.tail(F.col("tail")), lists.ref(xs, F.lit(3)), lists.fold(xs, F.lit(0), lambda a, b: a + b), lists.list_to_bytes(lists.bytes_to_list(F.encode(F.lit("hé"), "UTF-8"))),
    ).first()
    assert row[0] == 7 and row[1] == [3, 4, 3, 5] and row[2] == [1, 2, 3, 4] and row[3] is None and not row[4] and row[5] == [1, 2, 4, 5]
    assert not row[6] and row[7] == 1 and row[8] == [5] and row[9] == 4 and row[10] == 18 and bytes(row[11]) == "hé".encode()
    row = spark.range(1).select(arith.times(F.lit(3), None, F.lit(12)), arith.times(F.lit(5), None, F.lit(12)), arith.times(F.lit(0), None, F.lit(12)), arith.plus(None, F.lit(3), F.lit(10))).first()
    assert row[:] == (4, None, None, 7)


def test_term_order(spark):
    t = terms.term
    kinds = F.array(t("boolean", F.lit(True)), t("vector", F.array(F.lit("b"))), t("string", F.lit("Z")), t("number", F.lit(2)), t("null"), t("string", F.lit("a")), t("vector", F.array(F.lit("a"), F.lit("a"))), t("boolean", F.lit(False)), t("bytes", F.encode(F.lit("q"), "UTF-8")), t("symbol", F.lit("s")))
    found = spark.range(1).select(F.transform(F.array_sort(kinds), lambda x: x["rank"])).first()[0]
    assert found == [0, 1, 2, 3, 3, 4, 6, 6, 7, 7]
    assert terms.intersect_bounds((1, True, 5, True), (5, True, None, False)) == (5, True, 5, True)
    assert terms.intersect_bounds((1, True, 5, False), (5, True, None, False)) is None


def test_trigrams(spark):
    df = spark.createDataFrame([(1, "abcdef"), (2, "abdcef"), (3, "ab"), (4, None)], "k long, t string")
    grams = trigram.index(df, "k", "t")
    assert got(trigram.search(df, grams, "k", "t", "bcde").select("k")) == {(1,)}
    assert got(trigram.search(df, grams, "k", "t", "ab").select("k")) == {(1,), (2,), (3,)}


def test_tick_stream(spark, tmp_path):
    schema = spark.createDataFrame([], "x long").schema
    x = Var("x")
    program = ticks.TickProgram({"seen": schema}, insert=[datalog.Rule(Rel("seen", (x,)), (Rel("arrived", (x,)),))], send=[datalog.Rule(Rel("old", (x,)), (Rel("arrived", (x,)), Rel("seen", (x,))))])
    out = []
    p = ticks.Process(program, f"{tmp_path}/state", spark)
    for batch in ([1, 2], [2, 3]):
        spark.createDataFrame([(i,) for i in batch], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        p.start(stream, "arrived", f"{tmp_path}/checkpoint", lambda name, rows, version: out.append((name, sorted(r[0] for r in rows.collect())))).awaitTermination()
    assert out[0] == ("old", []) and out[-1] == ("old", [2])
    assert got(p.state(1)["seen"]) == {(1,), (2,), (3,)}
    votes = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 1)], "k string, v long")
    assert got(ticks.quorum(votes, ["k"], "v", 2)) == {("a", 2)}


def test_every_files_header_is_compared(spark, tmp_path):
    folder = tmp_path / "two.csv"
    folder.mkdir()
    (folder / "a.csv").write_text("v,k\n1,2\n")
    (folder / "b.csv").write_text("k,v\n30,40\n")
    with pytest.raises(files.HeaderError):
        files.read(spark, str(folder), "v int, k int", header=["v", "k"])
    (folder / "b.csv").write_text("v,k\n30,40\n")
    assert {tuple(r) for r in files.read(spark, str(folder), "v int, k int", header=["v", "k"]).collect()} == {(1, 2), (30, 40)}


def test_tsv_with_a_header_in_many_files(spark, tmp_path):
    rows = spark.range(0, 1000).selectExpr("id", "concat('\"a', id, ' ') as t")
    path = str(tmp_path / "x.tsv")
    files.write(rows.repartition(7), path, header=True)
    back = files.read(spark, path, "id bigint, t string", header=["id", "t"])
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in rows.collect()} and back.count() == 1000
    bad = spark.createDataFrame([(1, "a\tb")], "id long, t string")
    with pytest.raises(Exception, match="tab or line end"):
        files.write(bad, str(tmp_path / "y.tsv"), header=True)


def test_empty_lines_and_short_lines(spark, tmp_path):
    (tmp_path / "one.tsv").write_text("a\n\nb\r\n\n")
    assert sorted(r[0] for r in files.read(spark, str(tmp_path / "one.tsv"), "t string").collect()) == ["", "", "a", "b"]
    (tmp_path / "two.tsv").write_text("a\tb\nc\n")
    with pytest.raises(Exception, match="without 2 fields"):
        files.read(spark, str(tmp_path / "two.tsv"), "t string, u string").collect()


def test_csv_fields_keep_their_spaces_and_lines(spark, tmp_path):
    rows = spark.createDataFrame([(" a ", 'q"x'), ("", "two\nlines"), ("c,d", " ")], "a string, b string")
    path = str(tmp_path / "s.csv")
    files.write(rows, path)
    assert {tuple(r) for r in files.read(spark, path, "a string, b string", multi_line=True).collect()} == {tuple(r) for r in rows.collect()}


def test_processes_move_merge_and_answer(spark, tmp_path):
    schema = T._parse_datatype_string("k bigint")
    program = ticks.TickProgram({"seen": schema}, insert=[datalog.Rule(Rel("seen", (Var("k"),)), (Rel("new", (Var("k"),)),))], inputs={"new"}, outputs={"out"})
    a, b = (ticks.Process(program, str(tmp_path / n), spark) for n in "ab")
    a.step(0, {"new": spark.createDataFrame([(1,)], "k bigint")})
    b.step(0, {"new": spark.createDataFrame([(2,)], "k bigint")})
    both = a.merge(0, b, 0, str(tmp_path / "c")).move(str(tmp_path / "d")).modify(program)
    both.step(1, {"new": spark.createDataFrame([(3,)], "k bigint")})
    assert {r[0] for r in both.query(1, ["k"], Rel("seen", (Var("k"),))).collect()} == {1, 2, 3}
    for rules in ({"now": [datalog.Rule(Rel("new", (Var("k"),)), (Rel("seen", (Var("k"),)),))]}, {"insert": [datalog.Rule(Rel("seen", (Var("k"),)), (Rel("out", (Var("k"),)),))]}):
        with pytest.raises(ValueError, match="device"):
            ticks.TickProgram({"seen": schema}, inputs={"new"}, outputs={"out"}, **rules).check()


def test_terms_compile_to_columns(spark):
    row = spark.createDataFrame([([1, 2, 3], {"a": 1}, "xy", 5)], "v array<bigint>, d map<string,int>, s string, n int")
    v, n = Var("v"), Var("n")
    for term, want in [
        (("if", (">", n, 4), "big", "small"), "big"), (("when", ("<", n, 4), 1), None), (("unless", ("<", n, 4), 1), 1), (("and",), True), (("or", ("=", n, 5), ("=", n, 6)), True),
        (("let", (("n", 1), ("m", n)), ("+", n, Var("m"))), 6), (("let*", (("n", 1), ("m", n)), ("+", n, Var("m"))), 2), (("sum", v), 6), (("max", v), 3), (("min", 4, n), 4),
        (("foldr", ("lambda", ("x", "acc"), ("+", ("*", 10, Var("acc")), Var("x"))), ("integer", 0), v), 321), (("map/append", ("lambda", ("x",), ("list", Var("x"), Var("x"))), v), [1, 1, 2, 2, 3, 3]),
        (("quasiquote", [7, ("unquote", n)]), [7, 5]), (("quote", [1, 2]), [1, 2]), (("dict-ref", Var("d"), "b", 9), 9), (("dict-ref", Var("d"), "a"), 1), (("-", n), -5),
        (("bytes-ref", ("string->bytes", Var("s")), 1), 121), (("cons", 0, ("cdr", v)), [0, 2, 3]), (("set-subtract", v, ("quote", [2])), [1, 3]), (("filter", ("lambda", ("x",), (">", Var("x"), 1)), v), [2, 3]),
    ]:
        got = row.select(expr.column(term)).first()[0]
        assert got == want, term
    with pytest.raises(NameError):
        expr.column(("no-such", 1))
