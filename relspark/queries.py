"""One query for each group of operators, over the driver's tables, and the SQL with the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import arith, columns, expr, lists, terms, trigram
from .operators import graph
from .operators import recursion as rec
from .operators import relational as ops
from .plans import datalog
from .plans.compile import query
from .plans.formula import ANY, Aggregate, And, Compute, Exists, ForAll, Iff, Imply, Not, Or, Rel, Solve, Var, eq, le, lt, neq
from .sources import files
from .sources.catalog import Catalog
from .storage import scratch
from .streaming import ticks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return df.select(*columns) if columns else df


def _cents(c: str):
    return F.round(F.col(c) * 100).cast("bigint")


V = Var

# formulas


@_query("SELECT DISTINCT n_name, r_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def conj_two_hop(spark, d):
    env = {"customer": _t(spark, d, "customer", "c_nationkey", "c_mktsegment"), "nation": _t(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey"), "region": _t(spark, d, "region", "r_regionkey", "r_name")}
    f = Exists(("n", "r"), And((Rel("customer", (V("n"), V("c_mktsegment"))), Rel("nation", (V("n"), V("n_name"), V("r"))), Rel("region", (V("r"), V("r_name"))))))
    return query(["n_name", "r_name", "c_mktsegment"], f, env, spark)


@_query("SELECT p_partkey FROM part WHERE p_size < 5 UNION SELECT p_partkey FROM part WHERE p_brand = 'Brand#11' OR p_size > 45")
def disj_union(spark, d):
    env = {"part": _t(spark, d, "part", "p_partkey", "p_size", "p_brand")}
    small = Exists(("s",), And((Rel("part", (V("p_partkey"), V("s"), ANY)), lt(V("s"), 5))))
    brand = Rel("part", (V("p_partkey"), ANY, "Brand#11"))
    large = Exists(("s",), And((Rel("part", (V("p_partkey"), V("s"), ANY)), lt(45, V("s")))))
    return query(["p_partkey"], Or((small, brand, large)), env, spark)


@_query("SELECT DISTINCT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'O' AND o_custkey <> 7")
def diseq_filter(spark, d):
    env = {"orders": _t(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus")}
    f = And((Rel("orders", (V("o_orderkey"), V("c"), V("o_orderstatus"))), neq(V("o_orderstatus"), "O"), neq(V("c"), 7)))
    return query(["o_orderkey", "o_orderstatus"], Exists(("c",), f), env, spark)


@_query("SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey BETWEEN 100 AND 2000 AND l_linenumber < 3")
def range_filter(spark, d):
    env = {"lineitem": _t(spark, d, "lineitem", "l_orderkey", "l_linenumber")}
    f = And((Rel("lineitem", (V("l_orderkey"), V("l_linenumber"))), le(100, V("l_orderkey")), le(V("l_orderkey"), 2000), lt(V("l_linenumber"), 3)))
    return query(["l_orderkey", "l_linenumber"], f, env, spark)


@_query("SELECT DISTINCT c_name FROM customer WHERE c_name >= 'Customer#000000100' AND c_name < 'Customer#000000300'")
def string_range(spark, d):
    env = {"customer": _t(spark, d, "customer", "c_name")}
    return query(["c_name"], And((Rel("customer", (V("c_name"),)), le("Customer#000000100", V("c_name")), lt(V("c_name"), "Customer#000000300"))), env, spark)


@_query("SELECT DISTINCT p_partkey, p_size FROM part WHERE p_size IN (3, 4, 5, 6, 7)")
def finite_domain(spark, d):
    part = _t(spark, d, "part", "p_partkey", "p_size")
    return part.filter(F.col("p_size").isin(terms.finite_domain(3, 7))).distinct()


@_query("SELECT DISTINCT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_regionkey = 2")
def bounds_and_cycle(spark, d):
    """Three <= in a cycle make their variables one; a join on it instead of a product."""
    env = {"nation": _t(spark, d, "nation", "n_nationkey", "n_regionkey")}
    f = And((Rel("nation", (V("a"), V("x"))), Rel("nation", (V("b"), V("y"))), le(V("x"), V("y")), le(V("y"), V("x")), le(2, V("x")), le(V("x"), 2)))
    return query(["a", "b"], Exists(("x", "y"), f), env, spark)


@_query("SELECT rank, CAST(count(*) AS BIGINT) AS n FROM (SELECT 1 AS rank FROM part UNION ALL SELECT 3 FROM part UNION ALL SELECT 7 FROM part WHERE p_size > 10) GROUP BY rank")
def type_tests(spark, d):
    part = _t(spark, d, "part", "p_name", "p_size")
    mixed = part.select(F.explode(F.array(terms.term("number", F.col("p_size")), terms.term("string", F.col("p_name")), terms.term("boolean", F.col("p_size") > 10))).alias("t"))
    mixed = mixed.filter(~terms.is_kind(F.col("t"), "boolean") | (F.col("t.num") == 1))
    return mixed.groupBy(F.col("t.rank").cast("int").alias("rank")).agg(F.count("*").alias("n"))


@_query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def semi_join_exists(spark, d):
    done = _t(spark, d, "orders", "o_custkey", "o_orderstatus").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return ops.semi_join(_t(spark, d, "customer", "c_custkey", "c_name"), done, ["c_custkey"])


@_query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_join_negation(spark, d):
    env = {"customer": _t(spark, d, "customer", "c_custkey"), "orders": _t(spark, d, "orders", "o_custkey", "o_orderstatus")}
    return query(["c_custkey"], And((Rel("customer", (V("c_custkey"),)), Not(Rel("orders", (V("c_custkey"), "P"))))), env, spark)


@_query("SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT l_returnflag FROM lineitem) f WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = f.l_returnflag))")
def forall_division(spark, d):
    lineitem = _t(spark, d, "lineitem", "l_suppkey", "l_returnflag")
    env = {"supplier": _t(spark, d, "supplier", "s_suppkey"), "flag": lineitem.select("l_returnflag").distinct(), "ships": lineitem.distinct()}
    f = And((Rel("supplier", (V("s_suppkey"),)), ForAll(("f",), Imply(Rel("flag", (V("f"),)), Rel("ships", (V("s_suppkey"), V("f")))))))
    return query(["s_suppkey"], f, env, spark)


@_query("SELECT l_orderkey FROM (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem) GROUP BY l_orderkey HAVING count(*) = (SELECT count(DISTINCT l_returnflag) FROM lineitem)")
def division_by_count(spark, d):
    lineitem = _t(spark, d, "lineitem", "l_orderkey", "l_returnflag")
    return ops.divide(lineitem, ["l_orderkey"], "l_returnflag", lineitem.select("l_returnflag"))


@_query("SELECT DISTINCT p_partkey FROM part WHERE (p_size < 10) = (p_brand < 'Brand#3')")
def iff_formula(spark, d):
    env = {"part": _t(spark, d, "part", "p_partkey", "p_size", "p_brand")}
    f = And((Rel("part", (V("p_partkey"), V("s"), V("b"))), Iff(lt(V("s"), 10), lt(V("b"), "Brand#3"))))
    return query(["p_partkey"], Exists(("s", "b"), f), env, spark)


@_query("SELECT n_nationkey, CAST(count(*) AS BIGINT) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey")
def subquery_term(spark, d):
    env = {"customer": _t(spark, d, "customer", "c_custkey", "c_nationkey"), "nation": _t(spark, d, "nation", "n_nationkey")}
    inner = Aggregate(F.count, V("c"), Rel("customer", (V("c"), V("n_nationkey"))), ("n_nationkey",), V("n"))
    return query(["n_nationkey", "n"], And((Rel("nation", (V("n_nationkey"),)), inner)), env, spark)


# joins


@_query("SELECT a.n_nationkey AS a, r_regionkey AS b FROM nation a JOIN region ON a.n_nationkey < r_regionkey * 5")
def theta_join(spark, d):
    return ops.theta_join(_t(spark, d, "nation", "n_nationkey"), _t(spark, d, "region", "r_regionkey"), F.col("n_nationkey") < F.col("r_regionkey") * 5).select(F.col("n_nationkey").alias("a"), F.col("r_regionkey").alias("b"))


@_query("SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b")
def cross_product(spark, d):
    return ops.product(_t(spark, d, "region", "r_name").toDF("a"), _t(spark, d, "region", "r_name").toDF("b"))


@_query("SELECT n_name, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def multiway_join(spark, d):
    # lines are summed by order before they meet the other tables
    lines = _t(spark, d, "lineitem", "l_orderkey", "l_extendedprice").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.sum(_cents("l_extendedprice")).alias("c"))
    orders = _t(spark, d, "orders", "o_orderkey", F.col("o_custkey").alias("c_custkey"))
    customer = _t(spark, d, "customer", "c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    all_ = ops.join(ops.join(ops.join(lines, orders, ["o_orderkey"]), customer, ["c_custkey"]), _t(spark, d, "nation", "n_nationkey", "n_name"), ["n_nationkey"])
    return ops.fold(all_, ["n_name"], n_lines=F.sum("n"), cents=F.sum("c"))


@_query("SELECT o_orderkey, o_custkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT'")
def merge_join(spark, d):
    orders = _t(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderpriority").filter("o_orderpriority = '1-URGENT'").drop("o_orderpriority")
    return ops.join(orders, _t(spark, d, "lineitem", F.col("l_orderkey").alias("o_orderkey"), "l_linenumber"), ["o_orderkey"], hint="merge")


@_query("SELECT c_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def hash_join_grouped(spark, d):
    orders = _t(spark, d, "orders", F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    out = ops.hash_join_grouped(_t(spark, d, "customer", "c_custkey"), orders, ["c_custkey"], "o_orderpriority", "p")
    return out.select("c_custkey", F.array_join("p", ",").alias("priorities"))


@_query("SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def natural_join(spark, d):
    return ops.natural_join(_t(spark, d, "nation", "n_nationkey", F.col("n_regionkey").alias("k")), _t(spark, d, "region", F.col("r_regionkey").alias("k"), "r_name")).drop("k")


# groups


@_query("SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem GROUP BY ALL")
def group_fold_sum(spark, d):
    return ops.fold(_t(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice"), ["l_returnflag", "l_linestatus"], quantity=F.sum(F.col("l_quantity").cast("bigint")), cents=F.sum(_cents("l_extendedprice")))


@_query("SELECT l_suppkey, min(l_partkey) AS part FROM lineitem GROUP BY l_suppkey")
def group_fold_min(spark, d):
    return ops.merge(_t(spark, d, "lineitem", "l_suppkey", F.col("l_partkey").alias("part")), "min")


@_query("SELECT l_suppkey, max(l_partkey) AS part FROM lineitem GROUP BY l_suppkey")
def group_fold_max(spark, d):
    return ops.merge(_t(spark, d, "lineitem", "l_suppkey", F.col("l_partkey").alias("part")), "max")


@_query("SELECT l_suppkey, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY l_suppkey")
def group_fold_count(spark, d):
    return ops.merge(_t(spark, d, "lineitem", "l_suppkey", F.lit(1).cast("bigint").alias("n")), "count")


@_query("SELECT n_regionkey, CAST(product(n_nationkey + 1) AS DOUBLE) AS p FROM nation GROUP BY n_regionkey")
def group_product(spark, d):
    return ops.merge(_t(spark, d, "nation", "n_regionkey", (F.col("n_nationkey") + 1).cast("double").alias("p")), "product")


@_query("SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses FROM orders GROUP BY o_custkey")
def set_union_merge(spark, d):
    out = ops.merge(_t(spark, d, "orders", "o_custkey", F.array("o_orderstatus").alias("s")), "set_union")
    return out.select("o_custkey", F.array_join("s", ",").alias("statuses"))


@_query("SELECT l_suppkey, l_partkey, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey DESC) AS INTEGER) AS rank FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) QUALIFY rank <= 3")
def top_n_merge(spark, d):
    return ops.merge(_t(spark, d, "lineitem", "l_suppkey", "l_partkey"), "top_3")


@_query("SELECT l_suppkey, l_partkey, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS INTEGER) AS rank FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) QUALIFY rank <= 3")
def bottom_n_merge(spark, d):
    return ops.merge(_t(spark, d, "lineitem", "l_suppkey", "l_partkey"), "bottom_3")


@_query("SELECT c_custkey, CAST(coalesce(n, 0) AS BIGINT) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def default_zero_agg(spark, d):
    counts = _t(spark, d, "orders", F.col("o_custkey").alias("c_custkey")).groupBy("c_custkey").agg(F.count("*").alias("n"))
    return ops.outer_default(_t(spark, d, "customer", "c_custkey"), counts, ["c_custkey"], {"n": 0})


@_query("SELECT DISTINCT p_brand, p_size FROM part p WHERE p_size = (SELECT max(p_size) FROM part q WHERE q.p_brand = p.p_brand)")
def agg_via_negation(spark, d):
    return ops.greatest_by_negation(_t(spark, d, "part", "p_brand", "p_size").distinct(), ["p_brand"], "p_size")


@_query("SELECT o_orderkey, o_custkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey) AS BIGINT) AS total FROM orders WHERE o_orderstatus = 'P'")
def assign_bind_sum(spark, d):
    env = {"orders": _t(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus")}
    own = Rel("orders", (V("o_orderkey"), V("o_custkey"), "P"))
    total = Aggregate(F.sum, V("k"), Rel("orders", (V("k"), V("o_custkey"), "P")), ("o_custkey",), V("total"))
    return query(["o_orderkey", "o_custkey", "total"], And((own, total)), env, spark)


# sets


@_query("SELECT k, CAST(sum(v) AS BIGINT) AS v FROM (SELECT c_nationkey AS k, 1 AS v FROM customer UNION ALL SELECT s_nationkey, 10 FROM supplier) GROUP BY k")
def union_combine(spark, d):
    a = _t(spark, d, "customer", F.col("c_nationkey").alias("k"), F.lit(1).cast("bigint").alias("v"))
    b = _t(spark, d, "supplier", F.col("s_nationkey").alias("k"), F.lit(10).cast("bigint").alias("v"))
    return ops.union_with([a, b], ["k"], {"v": F.sum})


@_query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def difference(spark, d):
    urgent = _t(spark, d, "orders", F.col("o_custkey").alias("c_custkey"), "o_orderpriority").filter("o_orderpriority = '1-URGENT'")
    return ops.difference(_t(spark, d, "customer", "c_custkey"), urgent)


@_query("SELECT p_partkey AS k FROM part EXCEPT (SELECT l_partkey FROM lineitem WHERE l_quantity > 45 UNION SELECT p_partkey FROM part WHERE p_size < 20)")
def nested_difference(spark, d):
    part = _t(spark, d, "part", F.col("p_partkey").alias("k"), "p_size")
    much = _t(spark, d, "lineitem", F.col("l_partkey").alias("k"), "l_quantity").filter("l_quantity > 45").select("k")
    return ops.difference(ops.difference(part.select("k"), much), part.filter("p_size < 20").select("k"))


@_query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect(spark, d):
    return ops.intersection(_t(spark, d, "customer", F.col("c_nationkey").alias("k")), _t(spark, d, "supplier", F.col("s_nationkey").alias("k")))


@_query("SELECT l_partkey AS a, l_suppkey AS b FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def trie_difference(spark, d):
    pairs = _t(spark, d, "lineitem", F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    return ops.subtract_keys(pairs, _t(spark, d, "part", F.col("p_partkey").alias("a"), "p_size").filter("p_size > 10"), ["a"])


@_query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def key_union(spark, d):
    return ops.key_union(_t(spark, d, "customer", F.col("c_nationkey").alias("k")), _t(spark, d, "supplier", F.col("s_nationkey").alias("k")), ["k"])


# order

_NEIGHBOURS = "SELECT o_custkey, o_orderkey, o_orderstatus, lag(o_orderstatus) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)"


@_query(f"SELECT o_custkey, o_orderkey, o_orderstatus FROM ({_NEIGHBOURS}) WHERE before IS DISTINCT FROM o_orderstatus")
def dedup_adjacent(spark, d):
    return ops.dedup_adjacent(_t(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], ["o_orderkey"], ["o_orderstatus"])


@_query(f"SELECT o_custkey, run, min(o_orderstatus) AS status, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, CAST(sum(CASE WHEN before IS DISTINCT FROM o_orderstatus THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT) AS run FROM ({_NEIGHBOURS})) GROUP BY o_custkey, run")
def group_adjacent(spark, d):
    runs = ops.group_adjacent(_t(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], ["o_orderkey"], ["o_orderstatus"])
    return runs.groupBy("o_custkey", "run").agg(F.min("o_orderstatus").alias("status"), F.count("*").alias("n"))


@_query("SELECT c_custkey, c_name, CAST(row_number() OVER (ORDER BY c_name, c_custkey) - 1 AS BIGINT) AS position FROM customer")
def row_position(spark, d):
    return ops.row_position(_t(spark, d, "customer", "c_custkey", "c_name"), ["c_name", "c_custkey"])


@_query("SELECT o_orderkey, o_custkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cents FROM orders")
def running_scan(spark, d):
    return ops.running(_t(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey"], ["o_orderkey"], F.sum(_cents("o_totalprice")), "cents").drop("o_totalprice")


@_query("SELECT o_custkey, chunk, CAST(count(*) AS BIGINT) AS n, min(o_orderkey) AS first FROM (SELECT o_custkey, o_orderkey, CAST((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4 AS BIGINT) AS chunk FROM orders) GROUP BY o_custkey, chunk")
def chunk(spark, d):
    return ops.chunk(_t(spark, d, "orders", "o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], 4).groupBy("o_custkey", "chunk").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@_query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey DESC, o_orderkey LIMIT 25")
def order_limit(spark, d):
    return ops.order_limit(_t(spark, d, "orders", "o_orderkey", "o_custkey"), [F.desc("o_custkey"), F.asc("o_orderkey")], 25)


@_query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 10 OFFSET 15")
def offset(spark, d):
    return ops.order_limit(_t(spark, d, "orders", "o_orderkey", "o_custkey"), ["o_custkey", "o_orderkey"], 10, 15)


@_query("SELECT min(l_orderkey) AS l_orderkey FROM lineitem WHERE l_orderkey >= 1001")
def seek_ge(spark, d):
    return ops.seek_ge(_t(spark, d, "lineitem", "l_orderkey"), "l_orderkey", 1001)


@_query("SELECT max(l_orderkey) AS l_orderkey FROM lineitem WHERE l_orderkey < 1001")
def seek_le(spark, d):
    return ops.seek_le(_t(spark, d, "lineitem", "l_orderkey"), "l_orderkey", 1001, inclusive=False)


# recursion

_HOPS = "SELECT DISTINCT o_orderkey AS a, nxt AS b FROM (SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nxt FROM orders) WHERE nxt IS NOT NULL"
_TRADE = "SELECT s_nationkey AS a, c_nationkey AS b, CAST(min(l_linenumber * 7 + (l_orderkey % 11)) AS BIGINT) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> c_nationkey GROUP BY ALL"
_PARTS = "SELECT DISTINCT a, b FROM (SELECT min(l_partkey) OVER (PARTITION BY l_orderkey, l_shipdate) AS a, l_partkey AS b FROM lineitem) WHERE a < b"


def _hops(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return _t(spark, d, "orders", "o_custkey", "o_orderkey").select(F.col("o_orderkey").alias("a"), F.lead("o_orderkey").over(w).alias("b")).filter("b is not null").distinct()


def _trade(spark, d):
    lines = _t(spark, d, "lineitem", "l_orderkey", "l_suppkey", (F.col("l_linenumber") * 7 + F.col("l_orderkey") % 11).cast("bigint").alias("d"))
    orders = _t(spark, d, "orders", F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    both = lines.join(orders, "l_orderkey").join(_t(spark, d, "customer", "c_custkey", F.col("c_nationkey").alias("b")), "c_custkey")
    both = both.join(_t(spark, d, "supplier", F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("a")), "l_suppkey")
    return both.filter("a != b").groupBy("a", "b").agg(F.min("d").alias("d"))


def _parts(spark, d):
    """Parts that one order ships on one day, each linked with the least of them: as many links as lines, not pairs."""
    lines = _t(spark, d, "lineitem", "l_orderkey", "l_shipdate", F.col("l_partkey").alias("b"))
    least = lines.groupBy("l_orderkey", "l_shipdate").agg(F.min("b").alias("a"), F.max("b").alias("most")).filter("a < most")
    return lines.join(least, ["l_orderkey", "l_shipdate"]).filter("a < b").select("a", "b").distinct()


@_query(f"WITH RECURSIVE e AS ({_HOPS}), p AS (SELECT a, b FROM e UNION SELECT p.a, e.b FROM p JOIN e ON p.b = e.a) SELECT a, b FROM p")
def transitive_closure(spark, d):
    return rec.closure(_hops(spark, d))


@_query(f"WITH RECURSIVE e AS ({_HOPS}), p AS (SELECT a, b FROM e UNION SELECT p.a, e.b FROM p JOIN e ON p.b = e.a) SELECT a, b FROM p")
def datalog_path(spark, d):
    """The closure as a program of two rules and a query in the stratum above."""
    rules = datalog.parse("path(X, Y) :- edge(X, Y). path(X, Z) :- path(X, Y), edge(Y, Z). answer(X, Y) :- path(X, Y).")
    return datalog.run(datalog.Program(rules), {"edge": _hops(spark, d)}, spark)["answer"].toDF("a", "b")


@_query(f"WITH RECURSIVE e AS ({_HOPS}), p AS (SELECT a AS source, b FROM e WHERE a IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') UNION SELECT p.source, e.b FROM p JOIN e ON p.b = e.a) SELECT source, b FROM p")
def reach_from_source(spark, d):
    edges = _hops(spark, d)
    return rec.reach(edges, _t(spark, d, "orders", "o_orderkey", "o_orderpriority").filter("o_orderpriority = '1-URGENT'").select("o_orderkey"))


_SHORT = f"WITH RECURSIVE e AS ({_TRADE}), p(a, b, d, h) AS (SELECT a, b, d, 1 FROM e UNION SELECT p.a, e.b, min(p.d + e.d), h + 1 FROM p JOIN e ON p.b = e.a WHERE h < 25 GROUP BY p.a, e.b, h)"


@_query(f"{_SHORT} SELECT a, b, CAST(min(d) AS BIGINT) AS d FROM p GROUP BY a, b")
def shortest_path(spark, d):
    return rec.shortest(_trade(spark, d))


@_query(f"{_SHORT} SELECT a, b, CAST(min(d) AS BIGINT) AS d FROM p WHERE a = 3 GROUP BY a, b")
def datalog_shortest(spark, d):
    """min merged inside the recursion."""
    rules = datalog.parse("near(B, D) :- road(3, B, D).")
    step = datalog.Rule(Rel("near", (V("C"), V("E"))), (Rel("near", (V("B"), V("D"))), Rel("road", (V("B"), V("C"), V("W"))), Compute(lambda a, b: a + b, (V("D"), V("W")), V("E"))))
    out = datalog.run(datalog.Program([*rules, step], {"near": "min"}), {"road": _trade(spark, d)}, spark)["near"].toDF("b", "d")
    return out.select(F.lit(3).alias("a"), "b", "d")


@_query(f"WITH RECURSIVE e AS ({_TRADE}), p AS (SELECT a, b, d FROM e WHERE d < 24 UNION SELECT p.a, e.b, p.d + e.d FROM p JOIN e ON p.b = e.a WHERE p.d + e.d < 24) SELECT a, b, CAST(d AS BIGINT) AS d FROM p")
def bounded_route(spark, d):
    return rec.routes(_trade(spark, d), 24)


_LINKED = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT a, b FROM ({_PARTS}) UNION SELECT b, a FROM ({_PARTS})), p(member, representative) USING KEY (member) AS (
    SELECT a, a FROM e
    UNION
    SELECT e.b, min(p.representative) FROM p JOIN e ON p.member = e.a JOIN recurring.p AS r ON r.member = e.b WHERE p.representative < r.representative GROUP BY e.b)"""


@_query(f"{_LINKED} SELECT member, representative FROM p")
def equiv_classes(spark, d):
    return rec.classes(_parts(spark, d))


_RING = f"SELECT a, b FROM ({_TRADE}) WHERE d < 8"


@_query(f"WITH RECURSIVE e AS ({_RING}), p AS (SELECT a, b FROM e UNION SELECT p.a, e.b FROM p JOIN e ON p.b = e.a) SELECT x.a, x.b FROM p x JOIN p y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b")
def scc_pairs(spark, d):
    return rec.strong_pairs(_trade(spark, d).filter("d < 8"))


@_query("WITH RECURSIVE e AS (SELECT n_nationkey AS a, n_nationkey // 2 AS b FROM nation WHERE n_nationkey > 0), l AS (SELECT DISTINCT n_nationkey AS node, 0 AS level FROM nation UNION SELECT e.a, l.level + 1 FROM l JOIN e ON e.b = l.node) SELECT node, CAST(max(level) AS BIGINT) AS level FROM l GROUP BY node")
def strata_levels(spark, d):
    n = _t(spark, d, "nation", F.col("n_nationkey").alias("a")).filter("a > 0")
    return rec.levels(n.withColumn("b", F.floor(F.col("a") / 2).cast("int")))


@_query("SELECT c_nationkey AS n, CAST(count(*) AS BIGINT) AS idle FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY c_nationkey")
def stratified_negation(spark, d):
    """Negation in the middle stratum, a counting merge that runs once in the last."""
    rules = datalog.parse("busy(C) :- orders(C, 'P'). idle(C, N) :- customer(C, N), not busy(C). count(N, 1) :- idle(C, N).")
    facts = {"orders": _t(spark, d, "orders", "o_custkey", "o_orderstatus"), "customer": _t(spark, d, "customer", "c_custkey", "c_nationkey")}
    out = datalog.run(datalog.Program(rules, {"count": "sum"}, {"count"}), facts, spark)["count"]
    return out.select(F.col("c0").alias("n"), F.col("c1").cast("bigint").alias("idle"))


# lists, terms, texts

_WORDS = "SELECT p_partkey, string_split(p_name, ' ') AS w FROM part"


def _words(spark, d):
    return _t(spark, d, "part", "p_partkey", F.split("p_name", " ").alias("w"))


@_query(f"SELECT p_partkey, array_to_string(w[1:i], ' ') AS xs, array_to_string(w[i + 1:], ' ') AS ys FROM (SELECT p_partkey, w, unnest(range(len(w) + 1)) AS i FROM ({_WORDS}))")
def list_append_splits(spark, d):
    out = _words(spark, d).select("p_partkey", F.explode(lists.splits(F.col("w"))).alias("s"))
    return out.select("p_partkey", F.array_join("s.xs", " ").alias("xs"), F.array_join("s.ys", " ").alias("ys"))


@_query(f"SELECT DISTINCT p_partkey, unnest(w) AS word FROM ({_WORDS})")
def list_member(spark, d):
    return lists.members(_words(spark, d), "w", "word").select("p_partkey", "word")


@_query(f"SELECT p_partkey, len(list_distinct(w)) = len(w) AS is_unique FROM ({_WORDS})")
def list_unique(spark, d):
    return _words(spark, d).select("p_partkey", lists.unique(F.col("w")).alias("is_unique"))


@_query(f"SELECT p_partkey, array_to_string(list_filter(w, lambda x: x <> w[1]), ' ') AS rest, NOT list_contains(w[2:], w[1]) AS absent FROM ({_WORDS})")
def list_remove(spark, d):
    w = F.col("w")
    return _words(spark, d).select("p_partkey", F.array_join(lists.remove(lists.head(w), w), " ").alias("rest"), lists.not_member(lists.head(w), lists.tail(w)).alias("absent"))


@_query(f"SELECT p_partkey, w[1] AS head, CAST(len(w) AS INTEGER) AS n, w[2] AS second, array_to_string(list_concat([w[len(w)]], w), ' ') AS longer FROM ({_WORDS})")
def list_refs(spark, d):
    w = F.col("w")
    return _words(spark, d).select("p_partkey", lists.head(w).alias("head"), lists.length(w).alias("n"), lists.ref(w, F.lit(1)).alias("second"), F.array_join(lists.cons(F.element_at(w, -1), w), " ").alias("longer"))


@_query("SELECT o_orderkey, o_orderkey + o_custkey AS added, o_orderkey - o_custkey AS taken, o_orderkey * 3 AS tripled, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey // 4 ELSE -1 END AS quarter, CAST(floor(o_totalprice) AS BIGINT) AS whole FROM orders")
def arith_modes(spark, d):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return _t(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice").select("o_orderkey", arith.plus(o, c).alias("added"), arith.plus(a=c, c=o).alias("taken"), arith.times(o, F.lit(3)).alias("tripled"), F.coalesce(arith.times(a=F.lit(4), c=o), F.lit(-1)).alias("quarter"), arith.floor(F.col("o_totalprice")).alias("whole"))


@_query("SELECT c_custkey, c_name FROM customer WHERE contains(c_name, '0012')")
def trigram_search(spark, d):
    customer = _t(spark, d, "customer", "c_custkey", "c_name")
    return trigram.search(customer, trigram.index(customer, "c_custkey", "c_name"), "c_custkey", "c_name", "0012")


@_query(f"SELECT p_partkey, CAST(row_number() OVER (ORDER BY len(w), w, p_partkey) - 1 AS BIGINT) AS position FROM ({_WORDS})")
def vector_order(spark, d):
    """Vectors sort by length first."""
    rows = _words(spark, d).select("p_partkey", F.size("w").alias("n"), "w")
    return ops.row_position(rows, ["n", "w", "p_partkey"]).select("p_partkey", "position")


# catalog and ticks


@_query("(SELECT c_custkey AS k FROM customer UNION SELECT o_custkey FROM orders) EXCEPT SELECT s_suppkey FROM supplier")
def catalog_assign(spark, d):
    c = _new_catalog(spark)
    for name, table, key in (("a", "customer", "c_custkey"), ("b", "orders", "o_custkey"), ("c", "supplier", "s_suppkey")):
        c.create(name, "k bigint")
        c.insert(name, _t(spark, d, table, F.col(key).alias("k")))
    c.commit()
    c.assign("a", ("-", ("+", "a", "b"), "c"))
    c.commit()
    return c.relation("a")


@_query("SELECT event_type, CAST(count(DISTINCT user_id) AS BIGINT) AS voters FROM events GROUP BY event_type HAVING count(DISTINCT user_id) >= 3")
def quorum(spark, d):
    return ticks.quorum(_t(spark, d, "events", "event_type", "user_id"), ["event_type"], "user_id", 3)


@_query("SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type")
def tick_counter(spark, d):
    """A counter carried over three ticks, each with a third of the events: count at the next tick is count + new."""
    events = _t(spark, d, "events", "event_id", "event_type")
    state = spark.createDataFrame([], "event_type string, n bigint")
    program = ticks.TickProgram({"count": state.schema})
    old, new = Rel("count", (V("t"), V("n"))), Rel("arrived", (V("t"), V("m")))
    add = Compute(lambda a, b: a + b, (V("n"), V("m")), V("s"))
    program.insert = [
        datalog.Rule(Rel("count", (V("t"), V("s"))), (old, new, add)),
        datalog.Rule(Rel("count", (V("t"), V("m"))), (new, Not(Rel("known", (V("t"),))))),
    ]
    program.now = [datalog.Rule(Rel("known", (V("t"),)), (old,))]
    program.delete = [datalog.Rule(Rel("count", (V("t"), V("n"))), (old, Exists(("m",), new)))]
    for third in range(3):
        arrived = events.filter(F.col("event_id") % 3 == third).groupBy("event_type").agg(F.count("*").alias("m"))
        state = ticks.tick(program, {"count": state}, {"arrived": arrived}, spark).state["count"]
    return state.toDF("event_type", "n")



# the planner: seeded recursion, recursive views, modes, domains


@_query(f"WITH RECURSIVE e AS ({_HOPS}), p AS (SELECT b FROM e WHERE a = (SELECT min(o_orderkey) FROM orders WHERE o_orderpriority = '1-URGENT') UNION SELECT e.b FROM p JOIN e ON p.b = e.a) SELECT b FROM p")
def path_seeded(spark, d):
    """The closure asked for one source: only what it reaches is worked out."""
    first = _t(spark, d, "orders", "o_orderkey", "o_orderpriority").filter("o_orderpriority = '1-URGENT'").agg(F.min("o_orderkey")).first()[0]
    rules = datalog.parse("path(X, Y) :- edge(X, Y). path(X, Z) :- path(X, Y), edge(Y, Z).")
    return datalog.ask(datalog.Program(rules), Rel("path", (first, V("b"))), {"edge": _hops(spark, d)}, spark)


@_query(f"WITH RECURSIVE e AS ({_TRADE}), p AS (SELECT a, b FROM e WHERE d < 9 UNION SELECT p.a, e.b FROM p JOIN e ON p.b = e.a WHERE e.d < 9) SELECT a, b FROM p")
def recursive_view(spark, d):
    """A relation defined by one formula that uses itself inside a disjunction and a quantifier."""
    near = Exists(("w",), And((Rel("road", (V("a"), V("b"), V("w"))), lt(V("w"), 9))))
    on = Exists(("m", "w"), And((Rel("far", (V("a"), V("m"))), Rel("road", (V("m"), V("b"), V("w"))), lt(V("w"), 9))))
    rules = datalog.define(Rel("far", (V("a"), V("b"))), Or((near, on)))
    return datalog.run(datalog.Program(rules), {"road": _trade(spark, d)}, spark)["far"].toDF("a", "b")


@_query(f"""WITH RECURSIVE e AS MATERIALIZED ({_TRADE}), sp(a, b, d, h) AS (SELECT a, b, d, 1 FROM e UNION SELECT sp.a, e.b, min(sp.d + e.d), h + 1 FROM sp JOIN e ON sp.b = e.a WHERE h < 25 GROUP BY sp.a, e.b, h),
    best AS MATERIALIZED (SELECT a, b, min(d) AS d FROM sp GROUP BY a, b),
    last AS MATERIALIZED (SELECT a, b, min(c) AS c FROM (SELECT best.a, best.b, e.a AS c FROM best JOIN e ON e.a = best.a AND e.b = best.b AND e.d = best.d UNION ALL SELECT x.a, x.b, e.a FROM best x JOIN e ON e.b = x.b JOIN best y ON y.a = x.a AND y.b = e.a AND y.d + e.d = x.d) GROUP BY a, b),
    r AS (SELECT best.a, best.b, d, last.c AS here, concat_ws('-', last.c, best.b) AS route FROM best JOIN last ON last.a = best.a AND last.b = best.b
          UNION ALL SELECT r.a, r.b, r.d, last.c, concat_ws('-', last.c, r.route) FROM r JOIN last ON last.a = r.a AND last.b = r.here WHERE r.here <> r.a)
    SELECT a, b, CAST(d AS BIGINT) AS d, route FROM r WHERE here = a""")
def route(spark, d):
    """Shortest totals with the nodes on the way."""
    out = rec.shortest_routes(_trade(spark, d))
    return out.select("a", "b", "d", F.array_join(F.transform("route", lambda x: x.cast("string")), "-").alias("route"))


@_query(f"WITH RECURSIVE e AS ({_HOPS}), p AS (SELECT a AS source, b, 1 AS n FROM e UNION SELECT p.source, e.b, n + 1 FROM p JOIN e ON p.b = e.a WHERE n < 3) SELECT DISTINCT source, b FROM p")
def bounded_steps(spark, d):
    """A search that stops after three steps."""
    edges = _hops(spark, d)
    return rec.reach(edges, edges.select("a").distinct(), steps=3)


@_query("SELECT x, y FROM (SELECT unnest(range(3, 8)) AS x) JOIN (SELECT DISTINCT p_size AS y FROM part) ON x + y = 20")
def domain_and_modes(spark, d):
    """A variable that only bounds hold ranges over its finite domain; + solves for whichever argument is open."""
    plus = Solve(((2, lambda a, b: a + b), (1, lambda a, c: c - a), (0, lambda b, c: c - b), (None, lambda a, b, c: a + b == c)), (V("x"), V("y"), 20))
    sizes = {"size": _t(spark, d, "part", F.col("p_size").cast("bigint").alias("y")).distinct()}
    return query(["x", "y"], And((le(3, V("x")), le(V("x"), 7), plus, Rel("size", (V("y"),)))), sizes, spark).select("x", F.col("y").cast("int").alias("y"))


@_query("SELECT c_custkey FROM customer WHERE c_acctbal < 0 AND EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'P')")
def unlinked_test(spark, d):
    """A part that shares no variable with the question is a test, not a product."""
    env = {"customer": _t(spark, d, "customer", "c_custkey", "c_acctbal"), "orders": _t(spark, d, "orders", "o_orderkey", "o_orderstatus")}
    f = And((Rel("customer", (V("c_custkey"), V("b"))), lt(V("b"), 0.0), Rel("orders", (V("o"), "P"))))
    return query(["c_custkey"], Exists(("b", "o"), f), env, spark)


@_query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def apply_rest(spark, d):
    """A relation applied to its first argument and a variable for all others."""
    env = {"nation": _t(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey")}
    return query(["n_nationkey", "rest"], Rel("nation", (V("n_nationkey"),), V("rest")), env, spark).select("n_nationkey", "rest.*")


@_query("SELECT l_suppkey AS s, CAST(bit_or(l_linenumber) AS INTEGER) AS bits FROM lineitem GROUP BY l_suppkey")
def own_merge(spark, d):
    """A merge that is not one of those with a name."""
    rules = datalog.parse("seen(S, N) :- lineitem(S, N).")
    program = datalog.Program(rules, {"seen": ops.Merge(F.bit_or, idempotent=True)})
    out = datalog.run(program, {"lineitem": _t(spark, d, "lineitem", "l_suppkey", "l_linenumber")}, spark)["seen"]
    return out.toDF("s", "bits")


@_query("SELECT l_orderkey, CAST(sum(cents) AS BIGINT) AS cents FROM (SELECT DISTINCT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * l_linenumber - 1 AS cents FROM lineitem) GROUP BY l_orderkey")
def rule_arithmetic(spark, d):
    """Terms of + - * in a rule's body."""
    rules = datalog.parse("worth(O, L, W) :- line(O, L, Q), W = Q * L - 1. total(O, W) :- worth(O, _, W).")
    lines = _t(spark, d, "lineitem", "l_orderkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("q"))
    out = datalog.run(datalog.Program(rules, {"total": "sum"}, {"total"}), {"line": lines}, spark)
    return out["total"].toDF("l_orderkey", "cents")


# graphs of concepts, edges and their properties

_BRAND = "SELECT DISTINCT 'supp:' || l_suppkey AS object, n_name AS place, l_returnflag AS flag FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey"


def _graph(spark, d):
    parts = _t(spark, d, "part", F.concat(F.lit("part:"), "p_partkey").alias("curie"), F.lit("brand").alias("key"), F.col("p_brand").alias("value"))
    supp = _t(spark, d, "supplier", "s_suppkey", F.col("s_nationkey").alias("n_nationkey")).join(_t(spark, d, "nation", "n_nationkey", "n_name"), "n_nationkey")
    concepts = parts.union(supp.select(F.concat(F.lit("supp:"), "s_suppkey"), F.lit("place"), "n_name"))
    # an order may have several lines of one number, so what they link is part of an edge's id
    lines = _t(spark, d, "lineitem", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("eid"), F.concat(F.lit("part:"), "l_partkey").alias("subject"), F.concat(F.lit("supp:"), "l_suppkey").alias("object"), "l_returnflag")
    return graph.Graph(concepts, lines.select("eid", "subject", "object"), lines.select("eid", F.lit("flag").alias("key"), F.col("l_returnflag").alias("value")))


@_query(f"{_BRAND} WHERE p_brand = 'Brand#12' AND l_returnflag = 'R'")
def graph_known_to_x(spark, d):
    """From concepts of a known property over edges of a known property to others and their properties."""
    g = _graph(spark, d)
    out = g.known_to_x(g.having("brand", ["Brand#12"]), {"flag": ["R"]})
    return g.with_properties(out, "object", {"place": "place"}).select("object", "place", F.lit("R").alias("flag")).distinct()


@_query("SELECT DISTINCT 'part:' || x.l_partkey AS a, 'supp:' || x.l_suppkey AS m, 'part:' || y.l_partkey AS b FROM lineitem x JOIN lineitem y ON x.l_suppkey = y.l_suppkey JOIN part p ON p.p_partkey = x.l_partkey JOIN part q ON q.p_partkey = y.l_partkey WHERE p.p_brand = 'Brand#11' AND p.p_size = 1 AND q.p_brand = 'Brand#23' AND q.p_size = 2")
def graph_two_hop(spark, d):
    """Two known ends and what lies between them."""
    g = _graph(spark, d)
    size = _t(spark, d, "part", F.concat(F.lit("part:"), "p_partkey").alias("curie"), "p_size")
    left = g.having("brand", ["Brand#11"]).join(size.filter("p_size = 1"), "curie", "left_semi")
    right = g.having("brand", ["Brand#23"]).join(size.filter("p_size = 2"), "curie", "left_semi")
    return g.known_to_known(left, right)


# sources and sinks: each writes a table in a format to the shared folder and reads it again


def _written(spark, df, fmt, **how):
    path = scratch(spark, f"written.{fmt}")
    files.write(df, path, **how)
    return path


@_query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def tsv_round_trip(spark, d):
    path = _written(spark, _t(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey"), "tsv", header=True)
    return files.read(spark, path, "n_nationkey int, n_name string, n_regionkey int", header=["n_nationkey", "n_name", "n_regionkey"])


@_query("SELECT p_partkey, p_name || ', \"' || p_brand || '\"; ' AS label, p_size FROM part")
def csv_round_trip(spark, d):
    """Fields with separators and quotes inside."""
    part = _t(spark, d, "part", "p_partkey", F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"; ')).alias("label"), "p_size")
    path = _written(spark, part, "csv", header=True, sep=";")
    return files.read(spark, path, "p_partkey bigint, label string, p_size int", header="p_partkey;label;p_size", sep=";")


@_query("SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_nationkey < 5 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer")
def jsonl_round_trip(spark, d):
    customer = _t(spark, d, "customer", "c_custkey", "c_name", "c_acctbal", F.when(F.col("c_nationkey") >= 5, F.col("c_mktsegment")).alias("c_mktsegment"))
    return files.read(spark, _written(spark, customer, "jsonl"), "c_custkey bigint, c_name string, c_acctbal double, c_mktsegment string")


@_query("SELECT r_regionkey, r_name FROM region")
def json_round_trip(spark, d):
    return files.read(spark, _written(spark, _t(spark, d, "region", "r_regionkey", "r_name"), "json"), "r_regionkey int, r_name string")


@_query("SELECT c_custkey, upper(c_mktsegment) AS segment FROM customer WHERE c_acctbal < 0")
def ingest_hooks(spark, d):
    """Rows are mapped, then filtered, while they are read."""
    path = _written(spark, _t(spark, d, "customer", "c_custkey", "c_mktsegment", "c_acctbal"), "tsv")
    shape = lambda df: df.select("c_custkey", F.upper("c_mktsegment").alias("segment"), "c_acctbal")
    return files.read(spark, path, "c_custkey bigint, c_mktsegment string, c_acctbal double", map=shape, filter="c_acctbal < 0").drop("c_acctbal")


@_query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def ingest_flat_map(spark, d):
    """Each row read makes several."""
    path = _written(spark, _t(spark, d, "part", "p_partkey", "p_name"), "csv")
    words = lambda df: df.select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))
    return files.read(spark, path, "p_partkey bigint, p_name string", flat_map=words)


@_query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def tsv_relation(spark, d):
    """A file's rows as a set."""
    path = _written(spark, _t(spark, d, "orders", "o_orderstatus", "o_orderpriority"), "tsv")
    return files.relation(spark, path, "o_orderstatus string, o_orderpriority string")


@_query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 1 ELSE 2 END AS code FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def literal_facts(spark, d):
    """Facts given as rows, joined with a table."""
    env = {"code": files.literal(spark, "segment string, code int", [("BUILDING", 1), ("MACHINERY", 2), ("BUILDING", 1)]), "customer": _t(spark, d, "customer", "c_custkey", "c_mktsegment")}
    return query(["c_custkey", "code"], Exists(("s",), And((Rel("customer", (V("c_custkey"), V("s"))), Rel("code", (V("s"), V("code")))))), env, spark)


def _new_catalog(spark):
    return Catalog(spark, scratch(spark, "catalog"))


@_query("SELECT * FROM (VALUES ('clients'), ('copy'), ('orders')) t(name)")
def catalog_names(spark, d):
    """Relations made, renamed, copied and deleted, and the names that are left."""
    c = _new_catalog(spark)
    for name, key in (("customer", "c_custkey"), ("orders", "o_orderkey"), ("supplier", "s_suppkey")):
        c.create(name, f"{key} bigint")
        c.insert(name, _t(spark, d, name, key))
    c.rename("customer", "clients")
    c.copy("orders", "copy")
    c.delete("supplier")
    c.commit()
    return spark.createDataFrame([(n,) for n in _reopened(spark, c).names()], "name string")


def _reopened(spark, c):
    return Catalog(spark, c.path)


@_query("SELECT s_suppkey AS id, s_name AS title FROM supplier")
def catalog_attributes(spark, d):
    """Attributes by new names; a change that is reverted leaves nothing."""
    c = _new_catalog(spark)
    c.create("supplier", "s_suppkey bigint, s_name string")
    c.insert("supplier", _t(spark, d, "supplier", "s_suppkey", "s_name"))
    c.rename_attributes("supplier", ["id", "title"])
    c.commit()
    c.rename_attributes("supplier", ["x", "y"])
    c.delete("supplier")
    c.revert()
    return c.relation("supplier")


@_query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS BIGINT) AS position FROM (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def catalog_index(spark, d):
    """A relation of several tables made one in the order of its index, and read by it."""
    c = _new_catalog(spark)
    c.create("orders", "o_orderkey bigint, o_custkey bigint")
    for status in ("F", "O"):
        c.insert("orders", _t(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus").filter(F.col("o_orderstatus") == status).drop("o_orderstatus"))
    c.add_index("orders", ["o_custkey", "o_orderkey"])
    c.compact("orders")
    c.commit()
    return ops.row_position(c.ordered("orders", ["o_custkey", "o_orderkey"]).select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"])


@_query("SELECT text, CAST(row_number() OVER (ORDER BY text) - 1 AS BIGINT) AS id FROM (SELECT n_name AS text FROM nation UNION SELECT substr(n_name, 1, 3) FROM nation)")
def catalog_texts(spark, d):
    """A relation's texts with ids that keep their order."""
    c = _new_catalog(spark)
    c.create("nation", "a string, b string")
    c.insert("nation", _t(spark, d, "nation", "n_name", F.substring("n_name", 1, 3).alias("b")))
    return c.texts("nation")


@_query("SELECT r_regionkey, r_name, CAST(2 AS INTEGER) AS gone FROM region WHERE r_regionkey <> 0")
def catalog_vacuum(spark, d):
    """Tables that nothing reads any more go; what is read stays."""
    c = _new_catalog(spark)
    region = _t(spark, d, "region", "r_regionkey", "r_name")
    for name in ("a", "b"):
        c.create(name, region.schema)
    c.insert("a", region)
    c.insert("b", region.filter("r_regionkey = 0"))
    c.assign("a", ("-", "a", "b"))
    c.commit()
    c.compact("a")
    c.delete("b")
    c.commit()
    gone = [n for n in c.vacuum() if n.startswith("t-")]
    return c.relation("a").withColumn("gone", F.lit(len(gone)))


@_query("SELECT s_suppkey, s_name, true AS built, false AS again FROM supplier")
def materialized_source(spark, d):
    """A relation built from a file once, and again only if the file changes."""
    path = _written(spark, _t(spark, d, "supplier", "s_suppkey", "s_name"), "tsv")
    c = _new_catalog(spark)
    build = lambda spark, source: files.read(spark, source, "s_suppkey bigint, s_name string")
    built, again = c.materialize("supplier", path, build), c.materialize("supplier", path, build)
    return c.relation("supplier").select("*", F.lit(built).alias("built"), F.lit(again).alias("again"))


@_query("SELECT n_regionkey, CAST(count(*) AS INTEGER) AS n, min(n_name) AS first FROM nation GROUP BY n_regionkey")
def catalog_index_dict(spark, d):
    """A relation as a dictionary by its index: each first key with its sorted rows."""
    c = _new_catalog(spark)
    c.create("nation", "n_nationkey int, n_name string, n_regionkey int")
    c.insert("nation", _t(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey"))
    c.add_index("nation", ["n_regionkey", "n_name"])
    return c.index_dict("nation", ["n_regionkey", "n_name"]).select("n_regionkey", F.size("rows").alias("n"), F.col("rows")[0]["n_name"].alias("first"))


# terms, dictionaries, attributes


@_query("SELECT kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN p_size % 2 = 0 THEN 'vector' ELSE 'number' END AS kind FROM part) GROUP BY kind")
def vector_tests(spark, d):
    """Tests of a term's type, and their opposites, over terms of mixed type."""
    part = _t(spark, d, "part", "p_name", "p_size")
    even = F.col("p_size") % 2 == 0
    mixed = part.select(F.when(even, terms.term("vector", F.split("p_name", " "))).otherwise(terms.term("number", F.col("p_size"))).alias("t"))
    kind = F.when(terms.is_kind(F.col("t"), "vector") & terms.is_not_kind(F.col("t"), "number"), "vector").when(terms.is_integer(F.col("t.num")), "number")
    return mixed.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@_query("SELECT p_partkey, CAST(row_number() OVER (ORDER BY len(v), v, p_partkey) - 1 AS BIGINT) AS position FROM (SELECT p_partkey, [p_size, p_partkey % 7] AS v FROM part)")
def number_vectors(spark, d):
    """Vectors of numbers in the order of terms: elements compare as numbers."""
    vector = terms.term("vector", F.array(F.col("p_size").cast("bigint"), F.col("p_partkey") % 7), items="number")
    return ops.row_position(_t(spark, d, "part", "p_partkey", vector.alias("t")), ["t", "p_partkey"]).select("p_partkey", "position")


@_query("SELECT c_custkey FROM customer WHERE c_acctbal >= 100.0 AND c_acctbal < 900.0")
def bounds_algebra(spark, d):
    """The common part of two intervals as one filter."""
    low, low_closed, high, high_closed = terms.intersect_bounds((100.0, True, 5000.0, True), (-50.0, False, 900.0, False))
    return _t(spark, d, "customer", "c_custkey", "c_acctbal").filter(terms.between(F.col("c_acctbal"), low, low_closed, high, high_closed)).select("c_custkey")


@_query("SELECT DISTINCT n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < 0")
def defined_relation(spark, d):
    """A relation defined over others by a formula, used like a table."""
    poor = lambda env: query(["n", "s"], Exists(("b",), And((Rel("customer", (V("n"), V("s"), V("b"))), lt(V("b"), 0.0)))), env, spark)
    env = {"customer": _t(spark, d, "customer", "c_nationkey", "c_mktsegment", "c_acctbal"), "nation": _t(spark, d, "nation", "n_nationkey", "n_name"), "poor": poor}
    f = Exists(("n",), And((Rel("poor", (V("n"), V("c_mktsegment"))), Rel("nation", (V("n"), V("n_name"))))))
    return query(["n_name", "c_mktsegment"], f, env, spark)


@_query("SELECT p_partkey, CAST(octet_length(encode(p_name)) AS INTEGER) AS n, ascii(p_name) AS first, p_name AS text FROM part")
def text_bytes(spark, d):
    """Texts as bytes, bytes as numbers, and back."""
    part = _t(spark, d, "part", "p_partkey", arith.to_bytes(F.col("p_name")).alias("raw"))
    back = arith.to_text(lists.list_to_bytes(lists.bytes_to_list(F.col("raw"))))
    return part.select("p_partkey", F.size(lists.bytes_to_list(F.col("raw"))).alias("n"), lists.bytes_ref(F.col("raw"), F.lit(0)).alias("first"), back.alias("text"))


@_query("SELECT o_custkey, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 10 WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS n FROM orders GROUP BY o_custkey")
def map_merge(spark, d):
    """Two dictionaries merged key by key, with a default where one has none."""
    counts = lambda s, by: _t(spark, d, "orders", "o_custkey", "o_orderstatus").groupBy("o_custkey").agg(F.map_from_entries(F.array(F.struct(F.lit("n"), F.sum(F.when(F.col("o_orderstatus") == s, by).otherwise(0))))).alias(s))
    both = counts("F", 10).join(counts("O", 1), "o_custkey")
    return both.select("o_custkey", lists.map_merge(F.col("F"), F.col("O"), lambda x, y: x + y, F.lit(0).cast("bigint"))["n"].alias("n"))


@_query("SELECT o_custkey, o_orderkey AS first_order FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS r FROM orders) WHERE r = 1")
def least_value(spark, d):
    """The value that goes with each key's least order."""
    return ops.least_with(_t(spark, d, "orders", "o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice", "o_orderkey", "first_order")


@_query("SELECT n_nationkey, coalesce(n, 0) AS n FROM nation LEFT JOIN (SELECT s_nationkey, CAST(count(*) AS BIGINT) AS n FROM supplier GROUP BY s_nationkey) ON s_nationkey = n_nationkey")
def dict_lookup(spark, d):
    """Keys looked up in a dictionary, with a default for missing ones."""
    counts = _t(spark, d, "supplier", F.col("s_nationkey").alias("n_nationkey")).groupBy("n_nationkey").agg(F.count("*").alias("n"))
    return ops.lookup(counts, _t(spark, d, "nation", "n_nationkey"), ["n_nationkey"], {"n": 0})


@_query("SELECT p_partkey, p_size, p_size = (SELECT min(p_size) FROM part) AS popped FROM part")
def pop_least(spark, d):
    """The entries of a dictionary's least key, and what is left."""
    first, rest = ops.pop_least(_t(spark, d, "part", "p_partkey", "p_size"), "p_size")
    return first.withColumn("popped", F.lit(True)).union(rest.withColumn("popped", F.lit(False)))


@_query("SELECT c_custkey, s_suppkey, a.position FROM (SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS BIGINT) AS position FROM customer) a JOIN (SELECT s_suppkey, CAST(row_number() OVER (ORDER BY s_suppkey DESC) - 1 AS BIGINT) AS position FROM supplier) b ON a.position = b.position")
def zip_streams(spark, d):
    """Two streams side by side, as long as the shorter."""
    suppliers = _t(spark, d, "supplier", "s_suppkey", (-F.col("s_suppkey")).alias("back"))
    return ops.zip_rows(_t(spark, d, "customer", "c_custkey"), suppliers, ["c_custkey"], ["back"]).drop("back")


@_query("SELECT DISTINCT n_regionkey AS region, substr(n_name, 1, 1) AS initial FROM nation")
def attribute_algebra(spark, d):
    """Attributes renamed, dropped, kept and put in another order."""
    nation = _t(spark, d, "nation", "n_nationkey", "n_regionkey", F.substring("n_name", 1, 1).alias("initial"))
    out = ops.drop_attributes(ops.rename(nation, {"n_regionkey": "region"}), ["n_nationkey"])
    return ops.keep_attributes(ops.reorder_attributes(out, ["initial", "region"]), ["initial", "region"])


@_query("SELECT 'l_orderkey' AS attribute, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS cardinality, count(DISTINCT l_orderkey) / count(*) AS ratio FROM lineitem UNION ALL SELECT 'l_suppkey', count(DISTINCT l_suppkey), count(DISTINCT l_suppkey) / count(*) FROM lineitem")
def relation_statistics(spark, d):
    return ops.statistics(_t(spark, d, "lineitem", "l_orderkey", "l_suppkey"), ["l_orderkey", "l_suppkey"])


@_query("SELECT event_type AS kind, CAST(count(*) AS BIGINT) AS n FROM events WHERE value > 50 GROUP BY event_type")
def tick_send(spark, d):
    """What a tick sends out: facts of the tick, not part of its state."""
    events = _t(spark, d, "events", "event_id", "event_type", "value")
    program = ticks.TickProgram({}, send=[datalog.Rule(Rel("alarm", (V("i"), V("t"))), (Rel("event", (V("i"), V("t"), V("v"))), lt(50.0, V("v"))))])
    sent = ticks.tick(program, {}, {"event": events}, spark).sent["alarm"].toDF("i", "kind")
    return sent.groupBy("kind").agg(F.count("*").alias("n"))


# the language of terms


@_query("SELECT o_orderkey, CASE WHEN o_totalprice < 1000 THEN 'small' WHEN o_orderstatus = 'P' AND o_totalprice < 100000 THEN 'open' ELSE 'large' END AS kind, CASE WHEN NOT (o_custkey > 50 OR o_orderkey % 4 = 0) THEN 2 * (o_custkey + 1) + (o_custkey + 1) * (o_custkey + 1) ELSE -1 END AS n FROM orders")
def term_control(spark, d):
    """cond, and, or, not, if, let* as one column expression."""
    kind = ("cond", (("<", V("o_totalprice"), 1000), "small"), (("and", ("=", V("o_orderstatus"), "P"), ("<", V("o_totalprice"), 100000)), "open"), ("else", "large"))
    whole = ("=", ("*", 4, ("floor", ("/", V("o_orderkey"), 4))), V("o_orderkey"))
    n = ("if", ("not", ("or", (">", V("o_custkey"), 50), whole)), ("let*", (("x", ("+", V("o_custkey"), 1)), ("y", ("*", V("x"), V("x")))), ("+", ("*", 2, V("x")), V("y"))), -1)
    orders = _t(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return orders.select("o_orderkey", expr.column(kind).alias("kind"), expr.column(n).cast("bigint").alias("n"))


@_query(f"SELECT p_partkey, array_to_string(list_transform(list_filter(w, lambda x: x <> w[1]), lambda x: x || '!'), ' ') AS marked, array_to_string(list_reverse(w), '') AS folded, array_to_string(['<', w[1], '>'], '') AS quoted, CAST(len(w) AS INTEGER) AS n FROM ({_WORDS})")
def term_lists(spark, d):
    """map, filter, folds, templates over lists."""
    marked = ("map", ("lambda", ("x",), ("string-append", V("x"), "!")), ("filter-not", ("lambda", ("x",), ("equal?", V("x"), ("car", V("w")))), V("w")))
    folded = ("foldl", ("lambda", ("x", "out"), ("string-append", V("x"), V("out"))), "", V("w"))
    quoted = ("quasiquote", ["<", ("unquote", ("car", V("w"))), ">"])
    join = lambda t, sep: F.array_join(expr.column(t), sep)
    return _words(spark, d).select("p_partkey", join(marked, " ").alias("marked"), expr.column(folded).alias("folded"), join(quoted, "").alias("quoted"), expr.column(("length", V("w"))).alias("n"))


# columns by position, indexes, nested lists


@_query("WITH s AS (SELECT s_name, CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS BIGINT) AS position FROM supplier) SELECT a.position, 'x' AS fixed, a.position + 100 AS later, CAST(CASE WHEN a.position >= 50 THEN 2 WHEN a.position >= 10 THEN 1 ELSE 0 END AS INTEGER) AS part, b.s_name AS pointed FROM s a LEFT JOIN s b ON b.position = a.position * 3 WHERE a.position < 60")
def virtual_columns(spark, d):
    """Constants, offsets, intervals and pointers worked out from the rows' positions."""
    rows = ops.row_position(_t(spark, d, "supplier", "s_suppkey", "s_name"), ["s_suppkey"]).drop("s_suppkey")
    p = F.col("position")
    some = columns.subtable(rows, "position", 0, 60).select(columns.identity(p).alias("position"), columns.const("x").alias("fixed"), columns.offset(p, 100).alias("later"), columns.interval(p, [0, 10, 50]).alias("part"), (p * 3).alias("at"))
    return columns.indirect(some, "at", rows, "position", "s_name", "pointed").drop("at")


@_query("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders WHERE o_custkey BETWEEN 20 AND 60")
def index_range(spark, d):
    """A range of an index, read from the copy in its order."""
    c = _new_catalog(spark)
    orders = _t(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    c.create("orders", orders.schema)
    c.insert("orders", orders)
    c.add_index("orders", ["o_custkey"])
    c.add_index("orders", ["o_orderstatus", "o_orderkey"])
    c.build_indexes("orders")
    c.commit()
    return _reopened(spark, c).between("orders", ["o_custkey"], 20, 60).select("o_custkey", "o_orderkey", "o_orderstatus")


@_query("SELECT how, CAST(count(*) AS BIGINT) AS n FROM nation, (VALUES ('bytes'), ('disk'), ('scm')) t(how) GROUP BY how")
def retrieval_types(spark, d):
    """The same rows from files, from memory as bytes, and from memory as objects."""
    c = _new_catalog(spark)
    nation = _t(spark, d, "nation", "n_nationkey", "n_name")
    c.create("nation", nation.schema)
    c.insert("nation", nation)
    counts = []
    for how in ("bytes", "disk", "scm"):
        rows = c.relation("nation", how)
        counts.append((how, rows.count()))
        rows.unpersist()
    return spark.createDataFrame(counts, "how string, n bigint")


@_query("SELECT n_nationkey, true AS first, false AS same, false AS refused, true AS changed FROM nation WHERE n_nationkey > 3")
def stale_sources(spark, d):
    """A relation is built anew when the code that builds it changes, if whoever is asked agrees."""
    path = _written(spark, _t(spark, d, "nation", "n_nationkey"), "tsv")
    c = _new_catalog(spark)
    one = lambda spark, source: files.read(spark, source, "n_nationkey int")
    two = lambda spark, source: files.read(spark, source, "n_nationkey int").filter("n_nationkey > 3")
    done = [c.materialize("nation", path, one), c.materialize("nation", path, one), c.materialize("nation", path, two, "interactive", lambda name, changed: changed != ["code"]), c.materialize("nation", path, two)]
    return c.relation("nation").select("*", *(F.lit(x).alias(n) for n, x in zip(("first", "same", "refused", "changed"), done)))


@_query("SELECT o_custkey FROM (SELECT o_custkey, o_orderstatus, list(o_orderpriority) AS ps FROM orders GROUP BY o_custkey, o_orderstatus) GROUP BY o_custkey HAVING NOT list_contains(flatten(list(ps)), '5-LOW')")
def nested_absent(spark, d):
    """A value that occurs nowhere in a list of lists."""
    lists_of = _t(spark, d, "orders", "o_custkey", "o_orderstatus", "o_orderpriority").groupBy("o_custkey", "o_orderstatus").agg(F.collect_list("o_orderpriority").alias("ps"))
    return lists_of.groupBy("o_custkey").agg(F.collect_list("ps").alias("all")).filter(lists.absent(F.lit("5-LOW"), F.col("all"), depth=2)).select("o_custkey")
