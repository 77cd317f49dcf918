"""One registered query for each operator, over the driver's tables, with the SQL it must agree with.

lineitem stands in for postings (a supplier leg and an order leg of each line),
orders for holds and resolutions, events for an epoch stream, nation for edges.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import values
from .operators import subquery, zset
from .operators.fixpoint import fixpoint
from .operators.relation import Rel
from .plans.contracts import Contract, Rung
from .session import Engine
from .sources import ledger, storage
from .streaming import checkpoints as _checkpoints
from .streaming import telemetry
from .streaming.views import View

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
START = datetime.date(1995, 1, 1)

POSTINGS_SQL = """
    legs AS (
        SELECT l_orderkey AS txn, l_suppkey AS supp, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS cur,
               CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, l_orderkey || '-' || l_linenumber AS idem,
               CAST(l_shipdate AS DATE) AS value_date,
               CAST(datediff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) // 30 + l_linenumber AS BIGINT) AS epoch
        FROM lineitem),
    postings AS (
        SELECT txn, supp AS acct, cur, cents AS amt, idem, value_date, epoch FROM legs
        UNION ALL
        SELECT txn, 1000000 + txn % 1000, cur, -cents, idem, value_date, epoch FROM legs)"""
HOLDS_SQL = """
    holds AS (
        SELECT o_orderkey AS id, o_custkey AS acct, CAST(o_orderkey % 3 AS INTEGER) AS cur, CAST(round(o_totalprice * 100) AS BIGINT) AS amount,
               CAST(datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) // 30 AS BIGINT) AS epoch
        FROM orders WHERE o_orderstatus IN ('O', 'F')),
    resolutions AS (
        SELECT o_orderkey AS hold, CASE o_orderkey % 3 WHEN 0 THEN 'post' WHEN 1 THEN 'void' ELSE 'expire' END AS outcome,
               CAST(datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) // 30 + 1 + o_orderkey % 5 AS BIGINT) AS epoch
        FROM orders WHERE o_orderstatus = 'F')"""
WITH = f"WITH {POSTINGS_SQL} "
WITH_HOLDS = f"WITH {POSTINGS_SQL}, {HOLDS_SQL} "


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both legs of every line from one scan."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    cur = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    day = F.col("l_shipdate").cast("date")
    since = F.datediff(day, F.lit(START))
    epoch = ((since - since % 30) / 30).cast("long") + F.col("l_linenumber")
    legs = F.array(F.struct(F.col("l_suppkey").alias("acct"), cents.alias("amt")), F.struct((F.col("l_orderkey") % 1000 + 1000000).alias("acct"), (-cents).alias("amt")))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("txn"), cur.alias("cur"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("idem"), day.alias("value_date"), epoch.alias("epoch"), F.explode(legs).alias("leg"))
    return rows.select("txn", "leg.acct", "cur", "leg.amt", "idem", "value_date", "epoch")


def rel(spark: SparkSession, sf_dir: str) -> Rel:
    return Rel.source(postings(spark, sf_dir), "postings", ("acct",), epoch="epoch", valid="value_date")


def holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    since = F.datediff(F.col("o_orderdate").cast("date"), F.lit(START))
    epoch = ((since - since % 30) / 30).cast("long")
    return table(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin("O", "F")).select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("acct"), (F.col("o_orderkey") % 3).cast("int").alias("cur"), F.round(F.col("o_totalprice") * 100).cast("long").alias("amount"), epoch.alias("epoch"))


def resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    since = F.datediff(F.col("o_orderdate").cast("date"), F.lit(START))
    k = F.col("o_orderkey")
    outcome = F.when(k % 3 == 0, "post").when(k % 3 == 1, "void").otherwise("expire")
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(k.alias("hold"), outcome.alias("outcome"), (((since - since % 30) / 30).cast("long") + 1 + k % 5).alias("epoch"))


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def source(spark: SparkSession, sf_dir: str, name: str, *key: str) -> Rel:
    return Rel.source(table(spark, sf_dir, name), name, key)


# --- scans, projections, predicates, scalars ---


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan(spark, d):
    return source(spark, d, "nation", "n_nationkey").df


@query("SELECT c_custkey AS c0, c_nationkey + 1 AS c1 FROM customer")
def project(spark, d):
    return source(spark, d, "customer").map("c_custkey", F.col("c_nationkey") + 1).df


@query("SELECT l_orderkey, l_linenumber, l_orderkey * 7 - l_linenumber AS a, CAST((l_linenumber - 5) // 2 AS BIGINT) AS q, (l_linenumber - 5) % 2 AS r FROM lineitem")
def arith_checked(spark, d):
    n = F.col("l_linenumber") - 5
    return longs(source(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 7 - F.col("l_linenumber")).alias("a"), values.div(n, F.lit(2)).alias("q"), values.mod(n, F.lit(2)).alias("r")).df, "q")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE (CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END > 700 OR o_orderkey % 2 = 0) AND NOT (CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderkey END % 5 = 0)")
def filter_3vl(spark, d):
    a = F.when(F.col("o_orderstatus") != "P", F.col("o_custkey"))
    b = F.when(F.col("o_orderstatus") != "F", F.col("o_orderkey"))
    return source(spark, d, "orders").where(((a > 700) | (F.col("o_orderkey") % 2 == 0)) & ~(b % 5 == 0)).select("o_orderkey", "o_custkey").df


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%r%_d%'")
def like(spark, d):
    return source(spark, d, "part").where(values.like("p_name", "%r%_d%")).select("p_partkey", "p_name").df


@query("SELECT o_orderkey FROM orders LEFT JOIN supplier ON o_custkey = s_suppkey WHERE s_suppkey IS NULL")
def is_null(spark, d):
    return source(spark, d, "orders").left_join(source(spark, d, "supplier"), {"o_custkey": "s_suppkey"}).where(F.col("s_suppkey").isNull()).select("o_orderkey").df


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS number FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '1996-02-29'")
def date_literal(spark, d):
    day = F.col("o_orderdate").cast("date")
    return longs(source(spark, d, "orders").where(day <= F.lit(values.parse_date("1996-02-29"))).select("o_orderkey", day.cast("string").alias("day"), values.day_number(day).alias("number")).df, "number")


@query("SELECT s_suppkey, CAST(round(s_acctbal * 100) AS BIGINT) AS minor, 0 AS currency FROM supplier WHERE CAST(round(s_acctbal * 100) AS BIGINT) > 12345")
def money_literal(spark, d):
    known = values.standard_currencies()
    amount = F.struct(F.round(F.col("s_acctbal") * 100).cast(values.WIDE).alias("minor"), known.code("usd").alias("currency"))
    rows = source(spark, d, "supplier").select("s_suppkey", amount.alias("money"))
    return longs(rows.where(values.compare_money(F.col("money"), ">", known.money("123.45", "usd"))).select("s_suppkey", F.col("money.minor").alias("minor"), F.col("money.currency").alias("currency")).df, "minor")


@query(WITH + "SELECT txn, cur, amt FROM postings WHERE acct = 7")
def index_get(spark, d):
    return rel(spark, d).get(7).select("txn", "cur", "amt").df


@query(WITH + "SELECT acct, CAST(sum(amt) AS BIGINT) AS total FROM postings WHERE acct BETWEEN 10 AND 20 GROUP BY acct")
def index_range(spark, d):
    return longs(rel(spark, d).range(10, 20).group_by("acct").sum("amt", "total").df, "total")


# --- joins ---


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark, d):
    return source(spark, d, "orders").join(source(spark, d, "customer"), {"o_custkey": "c_custkey"}).select("o_orderkey", "c_name").df


@query("SELECT c_custkey, s_name FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey AND s_nationkey > 5")
def join_left(spark, d):
    return source(spark, d, "customer").left_join(source(spark, d, "supplier"), {"c_custkey": "s_suppkey"}, F.col("s_nationkey") > 5).select("c_custkey", "s_name").df


@query("SELECT c_custkey, s_suppkey FROM supplier RIGHT JOIN customer ON c_custkey = s_suppkey")
def join_right(spark, d):
    return source(spark, d, "supplier").right_join(source(spark, d, "customer"), {"s_suppkey": "c_custkey"}).select("c_custkey", "s_suppkey").df


@query("SELECT s_suppkey, p_partkey FROM supplier FULL JOIN (SELECT * FROM part WHERE p_partkey BETWEEN 50 AND 150) p ON s_suppkey = p_partkey")
def join_full(spark, d):
    return source(spark, d, "supplier").full_outer_join(source(spark, d, "part").where("p_partkey between 50 and 150"), {"s_suppkey": "p_partkey"}).select("s_suppkey", "p_partkey").df


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def join_semi(spark, d):
    return source(spark, d, "customer").semi_join(source(spark, d, "orders").where("o_orderstatus = 'F'"), {"c_custkey": "o_custkey"}).select("c_custkey").df


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def join_anti(spark, d):
    return source(spark, d, "customer").anti_join(source(spark, d, "orders").where("o_orderstatus = 'F'"), {"c_custkey": "o_custkey"}).select("c_custkey").df


@query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def join_cross(spark, d):
    return source(spark, d, "nation").cross_join(source(spark, d, "region")).select("n_name", "r_name").df


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
def join_theta(spark, d):
    n = source(spark, d, "nation")
    return n.theta_join(n, (F.col("n_nationkey") < F.col("n_nationkey_r")) & (F.col("n_regionkey") == F.col("n_regionkey_r"))).select(F.col("n_nationkey").alias("a"), F.col("n_nationkey_r").alias("b")).df


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def self_join(spark, d):
    n = source(spark, d, "nation")
    return n.join(n, ["n_regionkey"]).select(F.col("n_name").alias("a"), F.col("n_name_r").alias("b")).df


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_keyed(spark, d):
    return source(spark, d, "nation", "n_regionkey").join(source(spark, d, "region", "r_regionkey")).select("n_name", "r_name").df


# --- subqueries and CTEs ---


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def in_subquery(spark, d):
    return source(spark, d, "supplier").in_("s_nationkey", source(spark, d, "customer").where("c_mktsegment = 'BUILDING'"), "c_nationkey").select("s_suppkey").df


_NULLABLE = "(SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey END AS c FROM orders)"


@query(f"SELECT k FROM {_NULLABLE} o WHERE c NOT IN (SELECT s_suppkey FROM supplier)")
def not_in(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey")).alias("c"))
    return Rel.source(rows, "orders").not_in("c", source(spark, d, "supplier"), "s_suppkey").select("k").df


@query(f"SELECT k FROM {_NULLABLE} o WHERE c NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey < 0)")
def not_in_empty(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey")).alias("c"))
    return subquery.not_in(rows, "c", table(spark, d, "supplier").filter("s_suppkey < 0"), "s_suppkey").select("k")


@query(f"SELECT k FROM {_NULLABLE} o WHERE c IS NOT NULL AND c NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey < 0)")
def not_in_engine_rule(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey")).alias("c"))
    return Rel.source(rows, "orders").not_in("c", source(spark, d, "supplier").where("s_suppkey < 0"), "s_suppkey").select("k").df


@query("SELECT n_nationkey FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey)")
def exists(spark, d):
    return source(spark, d, "nation").exists(source(spark, d, "supplier"), {"n_nationkey": "s_nationkey"}).select("n_nationkey").df


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey)")
def not_exists(spark, d):
    return source(spark, d, "customer").not_exists(source(spark, d, "supplier"), {"c_custkey": "s_suppkey"}).select("c_custkey").df


@query("SELECT n_nationkey, (SELECT CAST(max(c_custkey) AS BIGINT) FROM customer WHERE c_nationkey = n_nationkey) AS top FROM nation")
def scalar_subquery_join(spark, d):
    return source(spark, d, "nation").scalar(source(spark, d, "customer"), {"n_nationkey": "c_nationkey"}, "max", "c_custkey", "top").select("n_nationkey", "top").df


def _engine(spark: SparkSession, d: str, *names: str) -> Engine:
    engine = Engine(spark)
    for name in names:
        engine.add(name, table(spark, d, name))
    return engine


@query("WITH x AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY s_nationkey) SELECT n_name, n FROM x JOIN nation ON k = n_nationkey WHERE n > 2")
def cte(spark, d):
    return _engine(spark, d, "supplier", "nation").sql("with x as (select s_nationkey as k, count(*) as n from supplier group by s_nationkey) select n_name, n from x join nation on k = n_nationkey where n > 2")


@query("SELECT s.k, s.n FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY s_nationkey) s WHERE s.n > 3")
def derived_table(spark, d):
    return _engine(spark, d, "supplier").sql("select s.k, s.n from (select s_nationkey as k, count(*) as n from supplier group by s_nationkey) s where s.n > 3")


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 3 OR EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey)")
def exists_under_or(spark, d):
    return _engine(spark, d, "customer", "supplier").sql("select c_custkey from customer where c_nationkey = 3 or exists (select 1 from supplier where s_suppkey = c_custkey)")


# --- aggregation ---


@query(WITH + "SELECT acct, CAST(sum(amt) AS BIGINT) AS total FROM postings GROUP BY acct")
def group_sum(spark, d):
    return longs(rel(spark, d).group_by("acct").sum("amt", "total").df, "total")


@query("SELECT k, count(*) AS n FROM (SELECT o_custkey AS k FROM orders) GROUP BY k")
def group_count_rows(spark, d):
    return source(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.when(F.col("o_orderkey") % 2 == 0, 1).alias("x")).group_by("k").count("x", "n").df


@query("SELECT l_suppkey, min(l_orderkey) AS low FROM lineitem GROUP BY l_suppkey")
def group_min(spark, d):
    return source(spark, d, "lineitem").group_by("l_suppkey").min("l_orderkey", "low").df


@query("SELECT n_regionkey, max(n_name) AS high FROM nation GROUP BY n_regionkey")
def group_max(spark, d):
    return source(spark, d, "nation").group_by("n_regionkey").max("n_name", "high").df


@query("SELECT l_suppkey, CAST(sum(l_linenumber - 6) // count(*) AS BIGINT) AS mean FROM lineitem GROUP BY l_suppkey")
def group_avg_int(spark, d):
    return source(spark, d, "lineitem").select("l_suppkey", (F.col("l_linenumber") - 6).alias("x")).group_by("l_suppkey").avg("x", "mean").df


@query("SELECT CAST(sum(l_orderkey) AS BIGINT) AS total, count(*) AS n, min(l_orderkey) AS low, max(l_orderkey) AS high FROM lineitem")
def global_agg(spark, d):
    return longs(source(spark, d, "lineitem").group_by().agg(total=("sum", "l_orderkey"), n=("count", None), low=("min", "l_orderkey"), high=("max", "l_orderkey")).df, "total")


@query("SELECT CAST(sum(l_orderkey) AS BIGINT) AS total, count(*) AS n FROM lineitem WHERE l_orderkey < 0")
def empty_global_agg(spark, d):
    return longs(source(spark, d, "lineitem").where("l_orderkey < 0").group_by().agg(total=("sum", "l_orderkey"), n=("count", None)).df, "total")


@query(WITH + "SELECT acct, CAST(sum(amt) AS BIGINT) AS total FROM postings GROUP BY acct HAVING sum(amt) > 100000000")
def having(spark, d):
    return longs(rel(spark, d).group_by("acct").sum("amt", "total").having(F.col("total") > 100000000).df, "total")


@query(WITH + "SELECT acct, cur, CAST(sum(amt) AS BIGINT) AS total FROM postings GROUP BY acct, cur")
def sum_one_currency(spark, d):
    return longs(rel(spark, d).df.groupBy("acct", "cur").agg(values.sum_in_currency("amt", "cur").alias("total")), "total")


@query("SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS a FROM lineitem GROUP BY l_returnflag")
def beyond_fragment(spark, d):
    return _engine(spark, d, "lineitem").sql("select l_returnflag, count(distinct l_suppkey) as suppliers, case when l_returnflag = 'A' then 1 else 0 end as a from lineitem group by l_returnflag")


# --- windows ---


@query("SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY round(s_acctbal), s_suppkey) AS rn FROM supplier")
def row_number(spark, d):
    rows = source(spark, d, "supplier").select(F.col("s_nationkey"), F.round("s_acctbal").alias("bal"), "s_suppkey")
    return rows.window("row_number", partition=("s_nationkey",), order=("bal",), name="rn").select("s_suppkey", "rn").df


@query("SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS r FROM part")
def rank(spark, d):
    return source(spark, d, "part").window("rank", partition=("p_brand",), order=(F.desc("p_size"),), name="r").select("p_partkey", "r").df


@query("SELECT p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r FROM part")
def dense_rank(spark, d):
    return source(spark, d, "part").window("dense_rank", partition=("p_brand",), order=("p_size",), name="r").select("p_partkey", "r").df


@query(WITH + "SELECT idem, acct, CAST(sum(amt) OVER (PARTITION BY acct, cur ORDER BY value_date) AS BIGINT) AS running FROM postings")
def running_sum(spark, d):
    return longs(rel(spark, d).window("sum", "amt", ("acct", "cur"), ("value_date",), "running").select("idem", "acct", "running").df, "running")


@query(WITH + "SELECT idem, acct, CAST(sum(amt) OVER (PARTITION BY cur ORDER BY value_date DESC) AS BIGINT) AS running FROM postings")
def running_sum_spread(spark, d):
    return longs(rel(spark, d).spread_window("sum", "amt", ("cur",), (("value_date", "desc"),), "running").select("idem", "acct", "running").df, "running")


@query("SELECT p_partkey, rank() OVER (ORDER BY p_size DESC) AS r, dense_rank() OVER (ORDER BY p_size) AS d, row_number() OVER (ORDER BY p_brand, p_partkey) AS n FROM part")
def ranks_spread(spark, d):
    rows = source(spark, d, "part").select("p_partkey", "p_size", "p_brand")
    rows = rows.spread_window("rank", order=(("p_size", "desc"),), name="r").spread_window("dense_rank", order=(("p_size", "asc"),), name="d")
    return rows.select("p_partkey", "p_brand", "r", "d").spread_window("row_number", order=(("p_brand", "asc"), ("p_partkey", "asc")), name="n").select("p_partkey", "r", "d", "n").df


@query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, min(o_orderkey) OVER (PARTITION BY o_custkey) AS low, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey) // count(*) OVER (PARTITION BY o_custkey) AS BIGINT) AS mean FROM orders")
def partition_total(spark, d):
    rows = source(spark, d, "orders")
    for function, name in (("count", "n"), ("min", "low"), ("avg", "mean")):
        rows = rows.window(function, "o_orderkey", ("o_custkey",), (), name)
    return rows.select("o_orderkey", "n", "low", "mean").df


# --- sets, order, recursion ---


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct(spark, d):
    return source(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct().df


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def distinct_by(spark, d):
    return source(spark, d, "orders").select("o_custkey", "o_orderkey").distinct_by("o_custkey").df


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(spark, d):
    return source(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union_all(source(spark, d, "supplier").select("s_nationkey")).df


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union(spark, d):
    return source(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(source(spark, d, "supplier").select("s_nationkey")).df


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT s_suppkey FROM supplier")
def except_(spark, d):
    return source(spark, d, "customer").select(F.col("c_custkey").alias("k")).except_(source(spark, d, "supplier").select("s_suppkey")).df


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect(spark, d):
    return source(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(source(spark, d, "supplier").select("s_nationkey")).df


@query("SELECT DISTINCT c_custkey, c_nationkey FROM customer WHERE c_custkey IN (SELECT s_suppkey FROM supplier)")
def intersect_by_key(spark, d):
    left = source(spark, d, "customer").select("c_custkey", "c_nationkey").index("c_custkey")
    return left.intersect_by_key(source(spark, d, "supplier", "s_suppkey")).df


@query(WITH + "SELECT acct, CAST(sum(amt) AS BIGINT) AS total FROM postings GROUP BY acct ORDER BY total DESC, acct LIMIT 10")
def top_k(spark, d):
    return longs(rel(spark, d).group_by("acct").sum("amt", "total").order_by(F.desc("total")).limit(10).df, "total")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 15 OFFSET 20")
def offset(spark, d):
    return source(spark, d, "orders").select("o_orderkey", "o_custkey").order_by("o_custkey").limit(15, 20).df


_EDGES_SQL = "edges AS (SELECT n_nationkey AS src, (n_nationkey * 2 + 1) % 25 AS dst FROM nation UNION ALL SELECT n_nationkey, n_regionkey FROM nation)"


def edges(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    return n.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 2 + 1) % 25).alias("dst")).union(n.select("n_nationkey", "n_regionkey"))


_CLOSURE = f"WITH RECURSIVE {_EDGES_SQL}, r AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM r JOIN edges e ON r.dst = e.src) SELECT src, dst FROM r"


@query(_CLOSURE)
def recursive_closure(spark, d):
    step = edges(spark, d).toDF("mid", "far")
    return fixpoint(edges(spark, d), lambda new: new.join(step, new.dst == step.mid).select("src", "far"))


@query(_CLOSURE)
def recursive_sql(spark, d):
    engine = Engine(spark)
    engine.add("edges", edges(spark, d))
    return engine.sql("with recursive r(src, dst) as (select src, dst from edges union select r.src, e.dst from r join edges e on r.dst = e.src) select src, dst from r")


# --- weighted sets ---

_MORE = "a AS (SELECT c_nationkey AS k FROM customer), b AS (SELECT s_nationkey AS k FROM supplier)"


@query(f"WITH {_MORE} SELECT k, CAST(sum(w) AS BIGINT) AS _w FROM (SELECT k, 1 AS w FROM a UNION ALL SELECT k, -3 FROM b) GROUP BY k HAVING sum(w) <> 0")
def zset_difference(spark, d):
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    b = zset.weighted(table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))).withColumn("_w", F.lit(3).cast("long"))
    return zset.difference(a, b)


@query(f"WITH {_MORE}, x AS (SELECT k, count(*) AS n FROM a GROUP BY k), y AS (SELECT k, count(*) AS n FROM b GROUP BY k) SELECT k, x.n * y.n AS _w FROM x JOIN y USING (k)")
def zset_join(spark, d):
    a = zset.consolidated(zset.weighted(table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))))
    return zset.join(a, zset.consolidated(zset.weighted(table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))), ["k"])


@query(WITH + "SELECT acct, cur, CAST(sum(amt) AS BIGINT) AS total, count(*) AS n FROM postings WHERE epoch <= 40 GROUP BY acct, cur")
def zset_integrate(spark, d):
    deltas = postings(spark, d).select("acct", "cur", "amt", "idem", "epoch")
    return longs(zset.aggregate(zset.integrate(deltas, upto=40), ["acct", "cur"], total=("sum", "amt"), n=("count", "amt")), "total")


@query(WITH + "SELECT idem, acct, amt FROM postings WHERE epoch = 33")
def zset_differentiate(spark, d):
    return zset.rows(zset.differentiate(postings(spark, d).select("idem", "acct", "amt", "epoch"), 33))


# --- time ---


@query(WITH + "SELECT acct, CAST(sum(amt) AS BIGINT) AS total FROM postings WHERE epoch <= 30 GROUP BY acct")
def as_of(spark, d):
    return longs(rel(spark, d).as_of(30).group_by("acct").sum("amt", "total").df, "total")


@query(WITH + "SELECT acct, CAST(sum(amt) AS BIGINT) AS total FROM postings WHERE epoch <= 30 AND acct IN (SELECT acct FROM postings WHERE epoch <= 30 AND cur = 1) GROUP BY acct")
def as_of_sql(spark, d):
    engine = Engine(spark)
    engine.add("postings", postings(spark, d), key=("acct",), epoch="epoch", valid="value_date")
    return engine.sql("select acct, cast(sum(amt) as bigint) as total from postings as of system time 30 where acct in (select acct from postings where cur = 1) group by acct")


@query(WITH + "SELECT acct, recorded_at, count(*) AS n FROM (SELECT acct, epoch AS recorded_at FROM postings) WHERE recorded_at <= 5 GROUP BY acct, recorded_at")
def recorded_at(spark, d):
    return rel(spark, d).recorded_at().where("recorded_at <= 5").group_by("acct", "recorded_at").count(name="n").df


@query(WITH + "SELECT acct, CAST(sum(amt) AS BIGINT) AS total FROM postings WHERE value_date <= DATE '1997-06-30' GROUP BY acct")
def valid_at(spark, d):
    return longs(rel(spark, d).valid_at("1997-06-30").group_by("acct").sum("amt", "total").df, "total")


@query(WITH + "SELECT acct, cur, CAST(sum(amt) AS BIGINT) AS balance FROM postings WHERE epoch <= 30 AND value_date <= DATE '1997-01-15' GROUP BY acct, cur")
def bitemporal(spark, d):
    return longs(ledger.bitemporal_balance(postings(spark, d), 30, F.lit(datetime.date(1997, 1, 15))), "balance")


# --- the ledger ---


@query(WITH + "SELECT acct, cur, CAST(sum(amt) AS BIGINT) AS balance FROM postings WHERE epoch <= 60 GROUP BY acct, cur")
def ledger_balance(spark, d):
    return longs(ledger.ledger_balance(postings(spark, d), 60), "balance")


@query(WITH_HOLDS + "SELECT acct, cur, CAST(sum(amount) AS BIGINT) AS held FROM holds WHERE epoch <= 50 AND id NOT IN (SELECT hold FROM resolutions WHERE epoch <= 50) GROUP BY acct, cur")
def unresolved_holds(spark, d):
    return longs(ledger.unresolved_holds(holds(spark, d), resolutions(spark, d), 50), "held")


@query(WITH_HOLDS + """SELECT acct, cur, CAST(sum(x) AS BIGINT) AS available FROM (
    SELECT acct, cur, amt AS x FROM postings WHERE epoch <= 50
    UNION ALL SELECT acct, cur, -amount FROM holds WHERE epoch <= 50 AND id NOT IN (SELECT hold FROM resolutions WHERE epoch <= 50)) GROUP BY acct, cur""")
def available_balance(spark, d):
    return longs(ledger.available_balance(postings(spark, d), holds(spark, d), resolutions(spark, d), 50), "available")


@query(WITH_HOLDS + "SELECT outcome, count(*) AS n, CAST(sum(amount) AS BIGINT) AS amount FROM resolutions JOIN holds ON hold = id GROUP BY outcome")
def hold_outcomes(spark, d):
    return longs(ledger.hold_outcomes(holds(spark, d), resolutions(spark, d)).select("outcome", "n", "amount"), "amount")


@query(WITH + "SELECT cur, CAST(sum(amt) AS BIGINT) AS total FROM postings GROUP BY cur")
def conservation(spark, d):
    return longs(ledger.conservation(postings(spark, d)), "total")


@query(WITH + "SELECT txn, cur, CAST(sum(amt) AS BIGINT) AS total FROM postings WHERE acct < 1000000 OR txn % 7 <> 0 GROUP BY txn, cur HAVING sum(amt) <> 0")
def unbalanced_txns(spark, d):
    return longs(ledger.unbalanced(postings(spark, d).filter("acct < 1000000 or txn % 7 <> 0")), "total")


_SEEN = "seen AS (SELECT user_id, event_type, datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS epoch, event_id FROM events)"


@query(f"WITH {_SEEN} SELECT user_id, event_type, event_id FROM seen s WHERE epoch = (SELECT min(epoch) FROM seen t WHERE t.user_id = s.user_id AND t.event_type = s.event_type)")
def idempotent_dedup(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", "event_id", F.concat_ws("/", "user_id", "event_type").alias("idem"), F.datediff(F.col("ts").cast("date"), F.lit(datetime.date(2024, 1, 1))).cast("long").alias("epoch"))
    return ledger.first_of_key(rows).select("user_id", "event_type", "event_id")


@query(f"""WITH RECURSIVE {_SEEN}, keyed AS (SELECT DISTINCT user_id || '/' || event_type AS k, epoch FROM seen),
    counted AS (SELECT k, min(epoch) AS epoch FROM keyed GROUP BY k
        UNION SELECT c.k, (SELECT min(n.epoch) FROM keyed n WHERE n.k = c.k AND n.epoch >= c.epoch + 7) FROM counted c WHERE c.epoch IS NOT NULL)
    SELECT s.event_id FROM seen s JOIN counted c ON c.k = s.user_id || '/' || s.event_type AND c.epoch = s.epoch""")
def idempotency_window(spark, d):
    rows = table(spark, d, "events").select("event_id", F.concat_ws("/", "user_id", "event_type").alias("idem"), F.datediff(F.col("ts").cast("date"), F.lit(datetime.date(2024, 1, 1))).cast("long").alias("epoch"))
    return ledger.first_of_key(rows, window=7).select("event_id")


@query(WITH + """, digests AS (SELECT epoch, sha256(length(txn || '') || ':' || txn || length(acct || '') || ':' || acct || length(amt || '') || ':' || amt) AS digest FROM postings),
    leaves AS (SELECT epoch, substr(digest, 1, 6) AS prefix, sha256(string_agg(digest, '' ORDER BY digest)) AS digest FROM digests GROUP BY ALL),
    nodes AS (SELECT epoch, substr(prefix, 1, 3) AS prefix, sha256(string_agg(prefix || digest, '' ORDER BY prefix || digest)) AS digest FROM leaves GROUP BY epoch, substr(prefix, 1, 3))
    SELECT epoch, sha256(string_agg(prefix || digest, '' ORDER BY prefix || digest)) AS digest FROM nodes GROUP BY epoch""".replace(" , digests", ", digests"))
def epoch_digests(spark, d):
    return ledger.rows_digest(postings(spark, d).select("epoch", ledger.row_digest("txn", "acct", "amt").alias("digest")), "epoch")


@query(WITH + "SELECT acct, count(*) AS updates FROM postings WHERE epoch <= 20 GROUP BY acct")
def key_update_count(spark, d):
    return ledger.key_update_count(postings(spark, d), 20)


@query(WITH + "SELECT cur, CAST(sum(amt) AS BIGINT) AS total FROM postings WHERE acct < 1000000 GROUP BY cur")
def position_by_product(spark, d):
    return longs(rel(spark, d).where("acct < 1000000").group_by("cur").sum("amt", "total").df, "total")


@query(WITH + "SELECT acct, cur, count(*) AS n, CAST(sum(amt) AS BIGINT) AS total FROM postings WHERE value_date BETWEEN DATE '1997-03-01' AND DATE '1997-03-31' GROUP BY acct, cur")
def statement_mtd(spark, d):
    month = (F.col("value_date") >= F.lit(datetime.date(1997, 3, 1))) & (F.col("value_date") <= F.lit(datetime.date(1997, 3, 31)))
    return longs(rel(spark, d).where(month).group_by("acct", "cur").agg(n=("count", None), total=("sum", "amt")).df, "total")


# --- the reference workloads' shapes ---


@query(WITH + "SELECT CAST(sum(amt) AS BIGINT) AS total FROM postings WHERE amt < 0")
def sum_negative(spark, d):
    return longs(rel(spark, d).where("amt < 0").sum("amt", "total").df, "total")


@query(WITH + "SELECT cur, CAST(sum(amt) AS BIGINT) AS total FROM postings WHERE acct % 16 = 3 GROUP BY cur")
def desk_exposure(spark, d):
    return longs(rel(spark, d).where("acct % 16 = 3").group_by("cur").sum("amt", "total").df, "total")


@query(WITH + "SELECT acct, CAST(sum(amt) AS BIGINT) AS total FROM postings WHERE acct = 7 GROUP BY acct")
def point_balance(spark, d):
    return longs(rel(spark, d).get(7).group_by("acct").sum("amt", "total").df, "total")


@query(WITH + "SELECT acct, CAST(sum(amt) AS BIGINT) AS total FROM postings WHERE acct = 7 AND epoch <= 40 GROUP BY acct")
def point_balance_as_of(spark, d):
    return longs(rel(spark, d).as_of(40).get(7).group_by("acct").sum("amt", "total").df, "total")


# --- maintained views ---


def _view(spark: SparkSession, **more) -> View:
    return View(spark, storage.shared_dir(spark), ("acct", "cur"), {"balance": "amt"}, **more)


@query(WITH + "SELECT acct, cur, CAST(sum(amt) AS BIGINT) AS balance, count(*) AS updates FROM postings WHERE epoch <= 70 GROUP BY acct, cur")
def checkpoint_reconstruct(spark, d):
    base = storage.written(postings(spark, d))
    view = _view(spark, checkpoint_every=30)
    for head in (29, 59, 89):
        view.maintain(base, head)
    rows, path = view.read(base, 70)
    assert path == "reconstruction"
    return longs(rows, "balance")


_NUMBERED = ", numbered AS (SELECT acct, epoch, amt, row_number() OVER w AS n, sum(amt) OVER w AS total FROM postings WINDOW w AS (PARTITION BY acct ORDER BY epoch, idem, amt ROWS UNBOUNDED PRECEDING))"


@query(WITH + _NUMBERED + " SELECT acct, epoch, n, CAST(total AS BIGINT) AS total FROM numbered WHERE n % 16 = 0")
def per_key_checkpoints(spark, d):
    held = _checkpoints.checkpoints(postings(spark, d), ("acct",), "amt", 16, order=("idem", "amt"), parted=True)
    return longs(held.select("acct", "epoch", "n", "total"), "n", "total")


@query(WITH + "SELECT acct, CAST(sum(amt) AS BIGINT) AS total, count(*) % 16 AS suffix FROM postings WHERE epoch <= 40 GROUP BY acct")
def per_key_reconstruct(spark, d):
    base = storage.written(postings(spark, d))
    held = storage.written(_checkpoints.checkpoints(base, ("acct",), "amt", 16, order=("idem", "amt")))
    return longs(_checkpoints.rebuilt(base, held, ("acct",), "amt", 40, order=("idem", "amt")), "total")


@query(WITH + "SELECT acct, cur, CAST(sum(amt) AS BIGINT) AS balance, count(*) AS updates FROM postings WHERE epoch <= 40 GROUP BY acct, cur")
def delta_maintained_view(spark, d):
    base = storage.written(postings(spark, d))
    view = _view(spark, contract=Contract(Rung.BOUNDED, bound_epochs=10))
    for head in range(5, 41, 5):  # due at every second of these
        view.maintain(base, head)
    view.apply(base.filter("epoch <= 40"), 40)  # once more: changes nothing
    return longs(view.state(), "balance")


@query("SELECT user_id, event_type, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS work, count(*) AS updates FROM events GROUP BY user_id, event_type")
def streamed_view(spark, d):
    events = table(spark, d, "events").select("user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("work"), F.datediff(F.col("ts").cast("date"), F.lit(datetime.date(2024, 1, 1))).cast("long").alias("epoch"))
    folder = storage.shared_dir(spark)
    for part in range(3):
        events.filter(F.col("epoch") % 3 == part).write.mode("append").parquet(f"{folder}/in")
    files = sum(n.endswith(".parquet") for n in storage.names(spark, f"{folder}/in"))
    view = View(spark, f"{folder}/view", ("user_id", "event_type"), {"work": "work"})
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", -(-files // 3)).parquet(f"{folder}/in")  # three micro-batches
    view.attach(stream, f"{folder}/checkpoint").awaitTermination()
    return longs(view.state(), "work")


@query("SELECT CAST(user_id % 3 AS VARCHAR) AS view_name, event_type AS kind, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS work FROM events GROUP BY ALL")
def work_by_view(spark, d):
    rows = table(spark, d, "events").select((F.col("user_id") % 3).cast("string").alias("view_name"), F.col("event_type").alias("kind"), F.round(F.col("value") * 100).cast("long").alias("work"))
    return longs(telemetry.work_by_view(rows), "work")


@query("SELECT CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS at_epoch, count(*) AS n FROM events WHERE datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) <= 20 GROUP BY 1")
def audit_trail(spark, d):
    rows = table(spark, d, "events").select(F.datediff(F.col("ts").cast("date"), F.lit(datetime.date(2024, 1, 1))).cast("long").alias("at_epoch"))
    return telemetry.audit_trail(rows, 20)


from . import conformance  # noqa: E402, F401  registers its queries too
