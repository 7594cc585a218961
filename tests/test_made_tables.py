"""Queries over small tables made for one case each, against the SQL of the registry."""

import re

import duckdb
import pytest

from relspark.operators import relational as ops
from relspark.queries import ORACLE, QUERIES


@pytest.fixture
def same_as_sql(spark, tmp_path):
    """A function that makes tables, name to SQL, and tells a query's rows over them if they are those of its SQL."""

    def run(name, **tables):
        con = duckdb.connect()
        for table, sql in tables.items():
            con.execute(f"CREATE TABLE {table} AS {sql}")
            con.execute(f"COPY {table} TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
        got = QUERIES[name](spark, str(tmp_path))
        rows = sorted(map(tuple, got.collect()))
        assert rows == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLE[name]})").fetchall())
        return rows

    return run


def test_graph_of_lines_with_one_number(same_as_sql):
    """An order's two lines of one number: the other line's flag is not this one's."""
    rows = same_as_sql(
        "graph_known_to_x",
        lineitem="SELECT * FROM (VALUES (1::BIGINT, 10::BIGINT, 5::BIGINT, 3, 'A'), (1, 11, 6, 3, 'R'), (2, 10, 7, 1, 'R'), (2, 10, 8, 9, 'N'), (3, 10, 9, 1, 'N')) t(l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag)",
        part="SELECT * FROM (VALUES (10::BIGINT, 'Brand#12'), (11, 'Brand#13')) t(p_partkey, p_brand)",
        supplier="SELECT s_suppkey::BIGINT AS s_suppkey, 1 AS s_nationkey FROM range(5, 10) t(s_suppkey)",
        nation="SELECT 1 AS n_nationkey, 'FRANCE' AS n_name",
    )
    assert rows == [("supp:7", "FRANCE", "R")]


def test_division_holds_a_word_for_a_key(spark):
    """No task gathers pairs of key and value; a divisor of more values than a word has bits counts whole."""
    rows = [(k, v) for k in range(5) for v in range(130) if k < 3 or v != 64 + k]
    held = spark.createDataFrame([*rows, (7, 500), *rows[:40]], "k long, v long")
    for n, want in ((0, {0, 1, 2, 3, 4, 7}), (3, {0, 1, 2, 3, 4}), (64, {0, 1, 2, 3, 4}), (68, {0, 1, 2, 4}), (130, {0, 1, 2})):
        assert [r.k for r in ops.divide(held, ["k"], "v", held.filter(f"v < {n}")).orderBy("k").collect()] == sorted(want)
    plan = ops.divide(held, ["k"], "v", held.filter("v < 3"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Aggregate\(keys=\[k#\d+L?, v#", plan)
