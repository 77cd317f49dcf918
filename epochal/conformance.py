"""Registered queries for what is more than a frame: writes, transactions, contracts, refusals, explanations.

Refusals are rows too: a case and the code it ends with, or ok. The SQL beside such a query lists the codes.
"""

from __future__ import annotations

import contextlib
import datetime
import io
import re
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __main__ as command_line_
from .functions import values
from .operators import zset
from .operators.fixpoint import fixpoint
from .operators.relation import Rel
from .plans.contracts import Contract, Lineage, Materialize, Retain, Rung, check_order
from .plans.nodes import verified
from .plans.refusal import CODES, NonTerminating, Refused
from .queries import _EDGES_SQL, WITH, WITH_HOLDS, edges, holds, longs, postings, query, rel, resolutions, source, table
from .session import Engine
from .sources import ledger, storage
from .sources.ledger import Ledger, Rejected
from .sources.relations import Catalog, Relation, changes, confidential
from .streaming import checkpoints, telemetry
from .streaming.views import View

_CODE = re.compile("|".join(map(re.escape, sorted(CODES, key=len, reverse=True))))


def _code(run: Callable) -> str:
    """The code that a case ends with, or ok."""
    try:
        out = run()
        if isinstance(out, DataFrame):
            out.collect()
    except Refused as e:
        return e.code
    except Rejected as e:
        return e.reason
    except NonTerminating:
        return "non-terminating"
    except PySparkException as e:
        found = _CODE.search(str(e))
        return found[0] if found else type(e).__name__
    return "ok"


def _cases(spark: SparkSession, cases: dict[str, Callable]) -> DataFrame:
    return spark.createDataFrame([(what, _code(run)) for what, run in cases.items()], "what string, code string")


def _codes(**cases: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{what}', '{code}')" for what, code in cases.items()) + ") t(what, code)"


# --- the ledger's commit rule, statements that write ---

_PAIRS = "txn long, acct long, cur int, amt long"


def _book(spark: SparkSession, **more) -> Ledger:
    return Ledger(spark, storage.shared_dir(spark), **more)


def _legs(spark: SparkSession, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), _PAIRS)


def _pair(spark: SparkSession, txn: int, amt: int = 5, cur: int = 0) -> DataFrame:
    return _legs(spark, (txn, 7, cur, amt), (txn, 8, cur, -amt))


@query(_codes(balanced="ok", duplicate="duplicate", unbalanced="unbalanced", across_currencies="unbalanced", hold="ok", resolved="ok", twice="bad_resolution", unknown_hold="bad_resolution", unknown_outcome="bad_resolution", two_at_once="bad_resolution", forgotten_key="ok"))
def commit_rule(spark, d):
    book = _book(spark, window=3)
    hold = spark.createDataFrame([(1, 7, 0, 3), (2, 7, 0, 4)], "id long, acct long, cur int, amount long")
    done = lambda *rows: spark.createDataFrame(list(rows), "hold long, outcome string")
    return _cases(spark, {
        "balanced": lambda: book.submit("a", _pair(spark, 1)),
        "duplicate": lambda: book.submit("a", _pair(spark, 2)),
        "unbalanced": lambda: book.submit("b", _legs(spark, (3, 7, 0, 5))),
        "across_currencies": lambda: book.submit("b", _legs(spark, (3, 7, 0, 5), (3, 8, 1, -5))),
        "hold": lambda: book.submit("c", holds=hold),
        "resolved": lambda: book.submit("d", resolutions=done((1, "post"))),
        "twice": lambda: book.submit("e", resolutions=done((1, "void"))),
        "unknown_hold": lambda: book.submit("e", resolutions=done((9, "void"))),
        "unknown_outcome": lambda: book.submit("e", resolutions=done((2, "lost"))),
        "two_at_once": lambda: book.submit("e", resolutions=done((2, "void"), (2, "expire"))),
        "forgotten_key": lambda: (book.submit("e", _pair(spark, 4)), book.submit("a", _pair(spark, 5))),
    })


@query(WITH + "SELECT acct, cur, CAST(sum(amt) AS BIGINT) AS balance, CAST(max(epoch % 3) AS BIGINT) AS last FROM postings WHERE txn % 50 = 0 GROUP BY acct, cur")
def ledger_append(spark, d):
    """Three submissions of the driver's postings, read back as sealed epochs."""
    book, rows = _book(spark), postings(spark, d).filter("txn % 50 = 0")
    for part in range(3):
        assert book.submit(f"part {part}", rows.filter(F.col("epoch") % 3 == part).drop("epoch")) == part
    out = book.table("postings").groupBy("acct", "cur").agg(F.sum("amt").alias("balance"), F.max("epoch").alias("last"))
    return longs(out, "balance")


@query("SELECT * FROM (VALUES ('writer', 0), ('rival', 1)) t(who, epoch)")
def two_writers(spark, d):
    """Both look at the head before either seals: one takes the epoch, the other the next one."""
    book = _book(spark)
    rival = Ledger(spark, book.root)
    assert book.head() == rival.head() == -1
    found = [("writer", book.submit("a", _pair(spark, 1))), ("rival", rival.submit("b", _pair(spark, 2)))]
    assert book.verify_chain() and book.table("postings").count() == 4
    return spark.createDataFrame(found, "who string, epoch int")


@query("SELECT 7 AS acct, cur, CAST(total AS BIGINT) AS total FROM (VALUES (0, -10), (1, 9)) t(cur, total)")
def fx_transaction(spark, d):
    """One transaction in two currencies, each of which balances through a clearing account."""
    book = _book(spark)
    book.submit("fx", _legs(spark, (1, 7, 0, -10), (1, 90, 0, 10), (1, 7, 1, 9), (1, 90, 1, -9)))
    out = book.table("postings").filter("acct = 7").groupBy("cur").agg(F.sum("amt").alias("total"))
    return longs(out.select(F.lit(7).alias("acct"), "cur", "total"), "total")


def _engine(spark: SparkSession) -> Engine:
    return Engine(spark, ledger=_book(spark), scales={0: 2, 1: 0, 2: 3})


@query(WITH + "SELECT acct, cur, CAST(sum(amt * CASE cur WHEN 0 THEN 1 ELSE 100 END) AS BIGINT) AS total FROM postings WHERE txn % 100 = 1 AND cur < 2 GROUP BY acct, cur")
def insert_statement(spark, d):
    """INSERT ... SELECT of decimal amounts, which become minor units of each currency's scale: 2 and 0."""
    engine = _engine(spark)
    engine.add("legs", postings(spark, d).select("txn", "acct", "cur", F.when(F.col("cur") == 0, F.col("amt").cast("decimal(30,2)") / 100).otherwise(F.col("amt") * 100).cast("decimal(30,2)").alias("amt"), "value_date"))
    engine.sql("insert into postings select txn, acct, cur, amt, value_date from legs where txn % 100 = 1 and cur < 2")
    return engine.sql("select acct, cur, cast(sum(amt) as bigint) as total from postings group by acct, cur")


@query(_codes(posted="ok", retried="duplicate", again_on_purpose="ok", too_precise="22003", no_currency="22023", unbalanced="unbalanced", width="NL0512", other_relation="0A000", update="NL0230", delete="NL0230", merge="NL0230"))
def statements_that_write(spark, d):
    engine = _engine(spark)
    posted = "insert into postings values (1, 7, 0, 1.50), (1, 8, 0, -1.50)"
    return _cases(spark, {
        "posted": lambda: engine.sql(posted),
        "retried": lambda: engine.sql(posted.replace("values", "  values")),
        "again_on_purpose": lambda: engine.sql(posted, key="another"),
        "too_precise": lambda: engine.sql("insert into postings values (2, 7, 1, 1.5), (2, 8, 1, -1.5)"),
        "no_currency": lambda: engine.sql("insert into postings values (2, 7, 9, 1), (2, 8, 9, -1)"),
        "unbalanced": lambda: engine.sql("insert into postings values (2, 7, 0, 1)"),
        "width": lambda: engine.sql("insert into postings values (2, 7)"),
        "other_relation": lambda: engine.sql("insert into somewhere values (2, 7, 0, 1)"),
        "update": lambda: engine.sql("update postings set amt = 0"),
        "delete": lambda: engine.sql("delete from postings"),
        "merge": lambda: engine.sql("merge into postings using x on 1 = 1"),
    })


@query("SELECT acct, CAST(total AS BIGINT) AS total, CAST(anchor AS BIGINT) AS anchor FROM (VALUES (7, 900, 1), (8, -900, 1)) t(acct, total, anchor)")
def transaction(spark, d):
    """What is posted between BEGIN and COMMIT is one epoch; what is rolled back is none."""
    engine = _engine(spark)
    engine.sql("insert into postings values (1, 7, 0, 4), (1, 8, 0, -4)")
    engine.sql("begin")
    engine.sql("insert into postings values (2, 7, 0, 5)")
    engine.sql("insert into postings values (2, 8, 0, -5)")
    engine.sql("commit")
    engine.sql("begin")
    engine.sql("insert into postings values (3, 7, 0, 6), (3, 8, 0, -6)")
    engine.sql("rollback")
    return engine.sql("select cast(acct as int) as acct, cast(sum(amt) as bigint) as total from postings group by acct", with_anchor=True)


@query(_codes(commit_outside="0A000", rollback_outside="0A000", begin="ok", begin_inside="0A000", commit="ok"))
def transaction_rules(spark, d):
    engine = _engine(spark)
    run = lambda text: lambda: engine.sql(text)
    return _cases(spark, {"commit_outside": run("commit"), "rollback_outside": run("rollback"), "begin": run("begin"), "begin_inside": run("begin"), "commit": run("commit")})


@query("SELECT * FROM (VALUES ('sealed', true), ('tampered', false)) t(state, verified)")
def chain_verified(spark, d):
    book = _book(spark)
    for i in range(3):
        book.submit(str(i), _pair(spark, i, 5 + i))
    found = [("sealed", book.verify_chain())]
    path = f"{book.root}/postings/epoch=1"
    storage.written(spark.read.parquet(path).withColumn("acct", F.col("acct") + 1), f"{book.root}/forged")
    storage.removed(spark, path)
    storage.moved(spark, f"{book.root}/forged", path)
    return spark.createDataFrame([*found, ("tampered", book.verify_chain())], "state string, verified boolean")


@query(WITH + "SELECT txn, cur, amt, epoch FROM postings WHERE acct = 7 AND epoch <= 40")
def postings_for(spark, d):
    return ledger.postings_for(postings(spark, d), 7, 40).select("txn", "cur", "amt", "epoch")


@query(WITH + "SELECT a.acct, a.cur, EXISTS (SELECT 1 FROM postings p WHERE p.acct = a.acct AND p.cur = a.cur AND p.epoch <= 3) AS there FROM (VALUES (7, 0), (7, 1), (1, 2), (-1, 0)) a(acct, cur)")
def key_exists(spark, d):
    rows = postings(spark, d)
    return spark.createDataFrame([(a, c, ledger.key_exists_at(rows, a, c, 3)) for a, c in ((7, 0), (7, 1), (1, 2), (-1, 0))], "acct int, cur int, there boolean")


@query(WITH_HOLDS + """SELECT outcome, count(*) AS n, CAST(sum(amount) AS BIGINT) AS amount, CAST(sum(CASE WHEN outcome = 'post' THEN amount // 3 ELSE 0 END) AS BIGINT) AS captured,
    CAST(sum(CASE WHEN outcome = 'post' THEN amount - amount // 3 ELSE amount END) AS BIGINT) AS released FROM resolutions JOIN holds ON hold = id WHERE resolutions.epoch <= 60 GROUP BY outcome""")
def hold_outcomes_captured(spark, d):
    """Holds that post a third of their amount."""
    held = holds(spark, d)
    third = resolutions(spark, d).join(held.select(F.col("id").alias("hold"), F.expr("amount div 3").alias("captured")), "hold")
    return longs(ledger.hold_outcomes(held, third, 60), "amount", "captured", "released")


# --- SQL and pipeline beyond plain frames ---


@query("SELECT o_custkey, sum(o_orderkey) AS s FROM orders GROUP BY o_custkey HAVING sum(o_orderkey) > 2000 AND count(*) > 3")
def having_sql(spark, d):
    engine = Engine(spark)
    engine.add("orders", table(spark, d, "orders"))
    return engine.sql("select o_custkey, sum(o_orderkey) as s from orders group by o_custkey having sum > 2000 and count(*) > 3 -- sum of what")


@query("SELECT n_nationkey, n_name, CAST(-1 AS BIGINT) AS anchor FROM nation")
def with_anchor(spark, d):
    engine = Engine(spark, head=-1)
    engine.add("nation", table(spark, d, "nation"))
    return engine.sql("select n_nationkey, n_name from nation", with_anchor=True)


@query("SELECT s_suppkey, s_suppkey * 3 + 1 AS y FROM supplier WHERE s_suppkey * 3 + 1 > 20")
def udf_call(spark, d):
    engine = Engine(spark)
    engine.add("supplier", table(spark, d, "supplier"))
    engine.udf("three", F.pandas_udf(lambda x: x * 3 + 1, "long"), "long", deterministic=True)
    return engine.sql("select s_suppkey, three(s_suppkey) as y from supplier where three(s_suppkey) > 20")


@query("SELECT n_name, r_name FROM nation JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM region) r USING (n_regionkey)")
def join_using(spark, d):
    engine = Engine(spark)
    engine.add("nation", table(spark, d, "nation"))
    engine.add("r", table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey"))
    return engine.sql("select n_name, r_name from nation join r using (n_regionkey)")


@query("SELECT a.n_nationkey AS a, b.r_regionkey AS b FROM nation a JOIN region b ON a.n_regionkey < b.r_regionkey")
def join_non_equi(spark, d):
    on = F.col("n_regionkey") < F.col("r_regionkey")
    return source(spark, d, "nation").theta_join(source(spark, d, "region"), on).select(F.col("n_nationkey").alias("a"), F.col("r_regionkey").alias("b")).df


@query("SELECT n_nationkey, (SELECT max(r_regionkey) FROM region) AS top, (SELECT sum(r_regionkey) FROM region WHERE r_regionkey > 99) AS none FROM nation")
def scalar_uncorrelated(spark, d):
    region = source(spark, d, "region")
    out = source(spark, d, "nation").scalar(region, {}, "max", "r_regionkey", "top").scalar(region.where("r_regionkey > 99"), {}, "sum", "r_regionkey", "none")
    return longs(out.select("n_nationkey", "top", "none").df, "none")


@query("SELECT r_regionkey, r_name FROM region ORDER BY r_name DESC")
def order_presented(spark, d):
    return source(spark, d, "region").select("r_regionkey", "r_name").order_by(F.desc("r_name")).presented()


@query("SELECT s_suppkey, s_nationkey, 'r' AS note FROM supplier WHERE s_nationkey > 3 AND 'as of system time 1' <> 'recorded_at'")
def clauses_in_literals(spark, d):
    engine = Engine(spark, head=3)
    engine.add("supplier", table(spark, d, "supplier"))
    return engine.sql("select s_suppkey, s_nationkey, 'r' as note from supplier where s_nationkey > 3 and 'as of system time 1' <> 'recorded_at' -- as of system time 9")


_SQL_REFUSALS = {
    "unknown_relation": ("NL0500", "select x from nowhere"),
    "unknown_predicate": ("NL0501", "select n_name from nation where nothing = 1"),
    "unknown_key": ("NL0509", "select n_name from nation order by nothing"),
    "limit_expression": ("NL0504", "select n_name from nation limit n_nationkey"),
    "set_width": ("NL0512", "select n_name, n_nationkey from nation union select r_name from region"),
    "no_from": ("NL0511", "select 1 as one"),
    "case": ("NL0508", "select case when n_nationkey = 1 then 1 else 0 end as x from nation"),
    "join_using": ("NL0001", "select n_name from nation a join nation b using (n_nationkey)"),
    "count_distinct": ("NL0002", "select count(distinct n_regionkey) as n from nation"),
    "group_by_other": ("NL0517", "select n_name, sum(n_nationkey) from nation group by n_regionkey"),
    "arithmetic_over_aggregate": ("NL0517", "select n_regionkey, sum(n_nationkey) + 1 from nation group by n_regionkey"),
    "having_other": ("NL0518", "select n_regionkey, sum(n_nationkey) from nation group by n_regionkey having max(n_nationkey) > 1"),
    "window_frame": ("NL0527", "select n_name, sum(n_nationkey) over (order by n_name rows between 1 preceding and current row) as s from nation"),
    "window_function": ("NL0527", "select n_name, ntile(3) over (order by n_name) as s from nation"),
    "window_outside": ("NL0526", "select n_name from nation where rank() over (order by n_name) = 1"),
    "window_over_groups": ("NL0526", "select n_regionkey, count(n_name), rank() over (order by n_regionkey) from nation group by n_regionkey"),
    "recursive_union_all": ("NL0524", "with recursive r(a) as (select n_nationkey from nation union all select a + 1 from r where a < 30) select a from r"),
    "recursive_aggregate": ("NL0525", "with recursive r(a) as (select n_nationkey from nation union select max(a) from r) select a from r"),
    "recursive_columns": ("NL0523", "with recursive r(a, b) as (select n_nationkey from nation union select a from r) select a from r"),
    "beyond_the_head": ("22023", "select n_name from nation as of system time 9"),
    "anchor_word": ("NL0510", "select n_name from nation as of system time now"),
    "confidential_filter": ("NL0260", "select c_custkey from customer where c_name = 'x'"),
    "confidential_group": ("NL0260", "select c_name, count(c_custkey) from customer group by c_name"),
    "confidential_renamed": ("NL0260", "select k from (select c_custkey as k, c_name as z from customer) x order by z"),
    "confidential_shown": ("ok", "select c_custkey, c_name from customer"),
    "command": ("0A000", "drop table nation"),
    "no_statement": ("42601", "selec n_name from nation"),
}


@query(_codes(**{k: code for k, (code, _) in _SQL_REFUSALS.items()}))
def refused_sql(spark, d):
    """The strict fragment's codes; nothing is run."""
    engine = Engine(spark, strict=True, head=5)
    for name in ("nation", "region"):
        engine.add(name, table(spark, d, name))
    engine.add("customer", confidential(table(spark, d, "customer"), "c_name", "e2ee", "c_custkey"))
    found = [(what, engine.check(text)) for what, (_, text) in _SQL_REFUSALS.items()]
    return spark.createDataFrame(found, "what string, code string")


@query(_codes(currencies_summed="22000", one_currency="ok", currencies_compared="NL0251", decimals="NL0240", undeclared="NL0506", overflow="22003", division="ArithmeticException", bad_date="NL0509", as_of="NL0510", no_valid_time="NL0510", limit="NL0504", union_width="NL0512", unknown_stage="NL0505", keyless_join="NL0503", key_widths="NL0519", ambiguous="NL0520", window="NL0527", unguarded="NL0400", measure="NL0507", no_function="NL0513", shape="NL0514", rounds="NL0528", negative_window="NL0526"))
def refused_pipeline(spark, d):
    nation, region, p = source(spark, d, "nation"), source(spark, d, "region", "r_regionkey"), rel(spark, d)
    known, n = values.standard_currencies(), table(spark, d, "nation")
    big = F.lit(2**62).cast("long")
    return _cases(spark, {
        "currencies_summed": lambda: p.df.groupBy("acct").agg(values.sum_in_currency("amt", "cur").alias("x")),
        "one_currency": lambda: p.df.groupBy("acct", "cur").agg(values.sum_in_currency("amt", "cur").alias("x")),
        "currencies_compared": lambda: n.select(values.compare_money(known.money(1, "usd"), "<", known.money(1, "eur")).alias("x")),
        "decimals": lambda: known.money("1.005", "usd"),
        "undeclared": lambda: known.named("xyz"),
        "overflow": lambda: n.select((big * (F.col("n_nationkey") + 2)).alias("x")),
        "division": lambda: n.select(values.div(F.col("n_nationkey"), F.lit(0)).alias("x")),
        "bad_date": lambda: values.parse_date("2026-02-30"),
        "as_of": lambda: nation.as_of(3),
        "no_valid_time": lambda: nation.valid_at("2020-01-01"),
        "limit": lambda: nation.limit(-1),
        "union_width": lambda: nation.union(region),
        "unknown_stage": lambda: nation.stage("nothing"),
        "keyless_join": lambda: nation.join(region),
        "key_widths": lambda: nation.index("n_nationkey", "n_name").join(region),
        "ambiguous": lambda: nation.join(region, ["n_regionkey"]),
        "window": lambda: nation.window("ntile"),
        "unguarded": lambda: fixpoint(n, lambda x: x, measure=None),
        "measure": lambda: fixpoint(n, lambda x: x, measure=0),
        "no_function": lambda: fixpoint(n, None),
        "shape": lambda: fixpoint(n, lambda x: x.select("n_name")),
        "rounds": lambda: fixpoint(n, lambda x: x, max_rounds=0),
        "negative_window": lambda: zset.window(zset.negate(n.select("n_nationkey")), "count", None, (), (("n_nationkey", "asc"),)),
    })


@query(f"WITH RECURSIVE {_EDGES_SQL}, r AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM r JOIN edges e ON r.dst = e.src) SELECT 'complete' AS what, CAST(count(*) AS VARCHAR) AS code FROM r UNION ALL SELECT * FROM (VALUES ('measure', 'non-terminating'), ('rounds', 'non-terminating')) t(what, code)")
def fixpoint_guard(spark, d):
    """A set is complete or there is none: a round below the measure breaks the guard, the last round may not find rows."""
    e = edges(spark, d)
    step = e.toDF("mid", "far")
    grow = lambda new: new.join(step, new.dst == step.mid).select("src", "far")
    whole = ("complete", str(fixpoint(e, grow).count()))
    broken = _cases(spark, {"measure": lambda: fixpoint(e, grow, measure=10**6), "rounds": lambda: fixpoint(e, grow, max_rounds=1)})
    return spark.createDataFrame([whole, *map(tuple, broken.collect())], "what string, code string")


# --- weighted sets ---


@query(WITH + "SELECT acct, cur, epoch + 2 AS epoch, CAST(sum(amt) AS BIGINT) AS amt FROM postings WHERE epoch BETWEEN 5 AND 6 GROUP BY acct, cur, epoch")
def zset_delay(spark, d):
    rows = zset.delay(postings(spark, d).select("acct", "cur", "amt", "epoch"), 2).filter("epoch between 7 and 8")
    return longs(rows.groupBy("acct", "cur", "epoch").agg(F.sum("amt").alias("amt")), "amt")


@query("""WITH z AS (SELECT s_nationkey AS k, count(*) AS w FROM supplier GROUP BY 1),
    x AS (SELECT s_nationkey AS k FROM supplier)
    SELECT z.k, z.w AS _w, (SELECT count(*) FROM x WHERE x.k <= z.k) AS run, 1 + (SELECT count(*) FROM x WHERE x.k > z.k) AS place FROM z""")
def zset_window(spark, d):
    z = zset.consolidated(zset.weighted(table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))))
    counted = zset.window(z, "count", None, (), (("k", "asc"),), "run")
    ranked = zset.window(z, "rank", None, (), (("k", "desc"),), "place").drop("_w")
    return counted.join(ranked, "k").select("k", "_w", "run", "place")


@query(WITH + "SELECT idem, acct, CAST(sum(amt) OVER (PARTITION BY cur ORDER BY value_date) AS BIGINT) AS run, rank() OVER (PARTITION BY acct, cur ORDER BY value_date) AS place FROM postings")
def window_by_size(spark, d):
    """Three partitions of currencies are spread over tasks, those of accounts are small enough for one."""
    rows = rel(spark, d).sized_window("sum", "amt", ("cur",), (("value_date", "asc"),), "run", limit=500)
    return longs(rows.sized_window("rank", None, ("acct", "cur"), (("value_date", "asc"),), "place").select("idem", "acct", "run", "place").df, "run", "place")


# --- changes, views, rungs ---


def _events(spark: SparkSession, d: str) -> DataFrame:
    epoch = F.datediff(F.col("ts").cast("date"), F.lit(datetime.date(2024, 1, 1))).cast("long")
    return table(spark, d, "events").select("event_id", "user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("work"), epoch.alias("epoch"))


@query("SELECT event_type, CAST(sum(CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END * CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS work, CAST(sum(CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END) AS BIGINT) AS updates FROM events GROUP BY event_type")
def change_stream(spark, d):
    """Change records in JSON lines, inserts and retractions, through a stream into a maintained view."""
    folder = storage.shared_dir(spark)
    op = F.when(F.col("event_id") % 3 == 0, "-").otherwise("+").alias("op")
    _events(spark, d).select("epoch", op, "event_type", "work").repartition(4, "epoch").write.json(f"{folder}/in")
    view = View(spark, f"{folder}/view", ("event_type",), {"work": "work"})
    stream = changes(spark, f"{folder}/in", "event_type string, work long", stream=True, files=2)
    view.attach(stream, f"{folder}/checkpoint").awaitTermination()
    return longs(view.state(), "work")


def _filled(spark: SparkSession, d: str, head: int, **more) -> tuple[View, DataFrame]:
    base = storage.written(postings(spark, d))
    view = View(spark, storage.shared_dir(spark), ("acct", "cur"), {"balance": "amt"}, relation="postings", **more)
    view.backfill(base, head)
    return view, base


@query(WITH + "SELECT acct, cur, CAST(sum(amt) AS BIGINT) AS balance, count(*) AS updates, CAST(44 AS BIGINT) AS anchor FROM postings WHERE epoch <= 44 GROUP BY acct, cur")
def view_emitted(spark, d):
    """A view filled at once and written to a sink below its anchor; emitting twice writes once."""
    view, _ = _filled(spark, d, 44)
    sink = storage.shared_dir(spark)
    assert view.emit(sink) and not view.emit(sink)
    return longs(spark.read.parquet(sink).select("acct", "cur", "balance", "updates", F.col("anchor").cast("long").alias("anchor")), "balance")


@query(WITH + "SELECT acct, cur, CAST(sum(amt) AS BIGINT) AS balance, count(*) AS updates FROM postings WHERE epoch <= 20 AND acct = 7 GROUP BY acct, cur")
def lineage_reproduce(spark, d):
    """Where the maintained rows are not what the base gives: one account's postings were kept out of the view's base."""
    base = storage.written(postings(spark, d))
    view = View(spark, storage.shared_dir(spark), ("acct", "cur"), {"balance": "amt"})
    view.backfill(base.filter("acct <> 7"), 20)
    return longs(view.reproduce(base), "balance")


@query(WITH + "SELECT DISTINCT acct, cur FROM postings WHERE txn = 64")
def lineage_impact(spark, d):
    view, base = _filled(spark, d, 20)
    return view.impact(base.filter("txn = 64"))


@query("SELECT * FROM (VALUES ('bounded', 7), ('monotonic', 5), ('read_your_writes', 6), ('snapshot', 3), ('serializable', 3), ('ledger_consistent', 9)) t(rung, anchor)")
def consistency_anchors(spark, d):
    """Of a head at 9, a view applied up to 2, a session that saw 5 and wrote 6, in a read set at 3: where each rung reads."""
    folder, found = storage.shared_dir(spark), []
    for rung in Rung:
        view = View(spark, f"{folder}/{rung.value}", ("acct",), {"balance": "amt"}, Contract(rung, bound_epochs=2))
        view.apply(spark.createDataFrame([(1, 5)], "acct long, amt long"), 2)
        found.append((rung.name.lower(), view.anchor_for(9, session=5, wrote=6, pinned=3)))
    return spark.createDataFrame(found, "rung string, anchor int")


@query(_codes(snapshot_of_an_older_epoch="ok", serializable_overtaken="40001", serializable_alone="ok", read_set_inside="0A000"))
def read_sets(spark, d):
    book = _book(spark)
    book.submit("a", _pair(spark, 1))
    made = lambda rung: View(spark, storage.shared_dir(spark), ("acct",), {"balance": "amt"}, Contract(rung), relation="postings")
    engine = Engine(spark, ledger=book, head=0, views={"snap": made(Rung.SNAPSHOT), "serial": made(Rung.SERIALIZABLE)})
    engine.add("postings", book.table("postings"), epoch="epoch", key=("acct",))

    def block(view: str, rival: str = "", at: int = 0):
        with engine.snapshot(at):
            assert engine.read(view)[0].first().anchor == at
            if rival:
                Ledger(spark, book.root).submit(rival, _pair(spark, 5))

    def nested():
        with engine.snapshot(), engine.snapshot():
            pass

    return _cases(spark, {"snapshot_of_an_older_epoch": lambda: block("snap", "b"), "serializable_overtaken": lambda: block("serial", "c", 1), "serializable_alone": lambda: block("serial", "", 2), "read_set_inside": nested})


@query("SELECT * FROM (VALUES (0, 4, 4), (1, 2, 4), (2, 7, 7)) t(step, seen, anchor)")
def session_anchor(spark, d):
    engine = Engine(spark)
    return spark.createDataFrame([(i, e, engine.observe(e)) for i, e in enumerate((4, 2, 7))], "step int, seen int, anchor int")


@query("SELECT view, CAST(reads AS BIGINT) AS reads, CAST(hits AS BIGINT) AS hits, CAST(misses AS BIGINT) AS misses, CAST(applied AS BIGINT) AS applied, CAST(parts AS BIGINT) AS parts, CAST(checkpoints AS BIGINT) AS checkpoints FROM (VALUES ('cold', 1, 0, 1, 5, 1, 0), ('warm', 2, 2, 0, 5, 1, 0)) t(view, reads, hits, misses, applied, parts, checkpoints)")
def statistics_relation(spark, d):
    cold, base = _filled(spark, d, 5, contract=Contract(Rung.LEDGER_CONSISTENT))
    warm, _ = _filled(spark, d, 5, contract=Contract(Rung.MONOTONIC))
    engine = Engine(spark, head=9, views={"warm": warm, "cold": cold})
    engine.add("postings", base, key=("acct",), epoch="epoch")
    for name in ("warm", "warm", "cold"):
        engine.read(name)
    return engine.statistics()


@query(WITH + "SELECT acct, CAST(sum(amt) AS BIGINT) AS total FROM postings WHERE epoch <= 40 AND acct = 7 GROUP BY acct")
def per_key_point(spark, d):
    """One account at an epoch from its newest checkpoint and at most 15 postings behind it."""
    base, order = storage.written(postings(spark, d).repartitionByRange("acct").sortWithinPartitions("acct", "epoch")), ("idem", "amt")
    held = storage.written(checkpoints.checkpoints(base, ("acct",), "amt", 16, order=order))
    out = checkpoints.point(base, held, {"acct": 7}, "amt", 40, order=order)
    assert out.filter("suffix > 15").isEmpty()
    return longs(out.select("acct", "total"), "total")


@query("SELECT event_type AS node, CAST(user_id % 3 AS VARCHAR) AS view_name, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS base_rows FROM events GROUP BY ALL")
def reconstruction_cost(spark, d):
    rows = _events(spark, d).select(F.col("event_type").alias("node"), (F.col("user_id") % 3).cast("string").alias("view_name"), F.col("work").alias("base_rows"))
    return longs(telemetry.reconstruction_cost(rows).select("node", "view_name", "base_rows"), "base_rows")


# --- contracts, properties, explanations ---


@query(_codes(spilled_strictest="NL0220", absent_pinned="NL0221", no_rounds="NL0528", weaker_below="NL0311", stronger_below="ok", infeasible="IR010", pinned_anchor="IR011", not_on_bases="IR012", no_key="IR013", not_incremental="NL0222", claims_conservation="IR016", conserves="ok", dependent_join="IR018", base_not_for_ever="NL0210", ledger_conserves_nothing="NL0211", window_of_time="NL0217", served="ok"))
def refused_contracts(spark, d):
    p, demand = rel(spark, d), Contract(materialize=Materialize.DEMAND)
    by_acct = p.group_by("acct").sum("amt", "total")
    loose = Rel.source(p.df, "postings", ("acct",), base=False).group_by("acct").sum("amt")
    n = table(spark, d, "nation")
    strict, weak = Contract(Rung.LEDGER_CONSISTENT), Contract(Rung.MONOTONIC)
    return _cases(spark, {
        "spilled_strictest": lambda: Contract(Rung.LEDGER_CONSISTENT, materialize=Materialize.SPILLED).checked(),
        "absent_pinned": lambda: Contract(materialize=Materialize.ABSENT, retain=Retain.PINNED).checked(),
        "no_rounds": lambda: Contract(max_rounds=0).checked(),
        "weaker_below": lambda: check_order("spendable", strict, {"balance": weak}),
        "stronger_below": lambda: check_order("report", weak, {"balance": strict}),
        "infeasible": lambda: verified(by_acct.node, Contract(materialize=Materialize.ABSENT, retain=Retain.PINNED)),
        "pinned_anchor": lambda: verified(p.as_of(3).group_by("acct").sum("amt").node, strict),
        "not_on_bases": lambda: verified(loose.node, demand),
        "no_key": lambda: verified(p.map("amt").node, demand),
        "not_incremental": lambda: verified(p.window("rank", partition=("acct",), order=("amt",)).node, demand),
        "claims_conservation": lambda: verified(p.where("amt > 0").node, claims_conservation=True),
        "conserves": lambda: verified(by_acct.node, claims_conservation=True),
        "dependent_join": lambda: verified(p._next(p.df, "apply", p).node),
        "base_not_for_ever": lambda: Relation("x", n, retain="30 days"),
        "ledger_conserves_nothing": lambda: Relation("x", n, kind="ledger"),
        "window_of_time": lambda: Ledger(spark, "file:///nowhere", window=0),
        "served": lambda: verified(by_acct.node, Contract(materialize=Materialize.DEMAND, lineage=Lineage.KEY)),
    })


@query("""SELECT * FROM (VALUES ('filter', true, false, 'acct', 'postings'), ('group_sum', true, true, 'acct', 'postings'), ('group_max', true, false, 'acct', 'postings'), ('window', false, true, 'acct', 'postings'),
    ('inner_join', true, true, 'n_regionkey', 'nation,region'), ('left_join', true, false, 'n_regionkey', 'nation,region'), ('union', true, true, 'acct', 'postings'), ('except', true, false, 'n_nationkey', 'nation,region'),
    ('intersect', true, false, 'n_nationkey', 'nation,region'), ('limit', false, false, 'acct', 'postings'), ('map', true, false, '', 'postings'), ('reindexed', true, true, 'txn', 'postings')) t(what, incremental, conserves, "key", bases)""")
def operator_properties(spark, d):
    """What the operator tree says of a query: maintained from deltas, conserving, its key, and the bases it reads."""
    p, nation, region = rel(spark, d), source(spark, d, "nation", "n_nationkey"), source(spark, d, "region", "r_regionkey")
    regions = region.select("r_regionkey")
    cases = {
        "filter": p.where("amt > 0"),
        "group_sum": p.group_by("acct").sum("amt"),
        "group_max": p.group_by("acct").max("amt"),
        "window": p.window("rank", partition=("acct",), order=("amt",)),
        "inner_join": nation.join(region, {"n_regionkey": "r_regionkey"}),
        "left_join": nation.left_join(region, {"n_regionkey": "r_regionkey"}),
        "union": p.union_all(p),
        "except": nation.select("n_nationkey").index("n_nationkey").except_(regions),
        "intersect": nation.select("n_nationkey").index("n_nationkey").intersect(regions),
        "limit": p.order_by("amt").limit(3),
        "map": p.map("amt"),
        "reindexed": p.index("txn"),
    }
    rows = [(what, r.node.incremental(), r.node.conserves(), ",".join(r.node.output_key() or ()), ",".join(sorted(r.node.bases()))) for what, r in cases.items()]
    return spark.createDataFrame(rows, "what string, incremental boolean, conserves boolean, key string, bases string")


@query("SELECT * FROM (VALUES ('sum_by_account', 'fold'), ('sum_of_an_account', 'index-fold'), ('kept_by_a_view', 'report-from-view'), ('one_key_of_a_view', 'view'), ('rows', 'materialise'), ('join', 'materialise'), ('recursion', 'materialise'), ('write', 'write'), ('refused', 'refused'), ('epochs_sealed', '0'), ('same_plan', 'fold')) t(what, path)")
def serve_paths(spark, d):
    """How statements would be answered. Nothing runs: no epoch is sealed by explaining an INSERT, no round of a recursion begins."""
    engine = _engine(spark)
    view, base = _filled(spark, d, 9)
    engine.head, engine.views = 9, {"balances": view}
    engine.add("legs", base, key=("acct",), epoch="epoch")
    engine.add("edges", edges(spark, d))
    texts = {
        "sum_by_account": "select acct, sum(amt) from legs group by acct",
        "sum_of_an_account": "select max(amt) from legs where acct = 7",
        "kept_by_a_view": "select acct, cur, sum(amt) from legs group by acct, cur",
        "one_key_of_a_view": "select acct, cur, sum(amt) from legs where acct = 7 and cur = 0 group by acct, cur",
        "rows": "select txn from legs",
        "join": "select count(*) from legs a join legs b on a.txn = b.txn",
        "recursion": "with recursive r(a, b) as (select src, dst from edges union select r.a, e.dst from r join edges e on r.b = e.src) select a, b from r",
        "write": "insert into postings values (1, 7, 0, 1), (1, 8, 0, -1)",
        "refused": "select nothing from nowhere",
    }
    found = [(what, engine.serve_path(text)) for what, text in texts.items()]
    engine.explain(texts["write"])
    found += [("epochs_sealed", str(engine.ledger.head() + 1)), ("same_plan", engine.explain(texts["sum_by_account"]).split("\n")[0])]
    return spark.createDataFrame(found, "what string, path string")


@query("SELECT * FROM (VALUES ('check', 'ok', 0), ('check a refusal', 'NL0511', 1), ('path', 'fold', 0), ('parse', 'Project', 0), ('explain', 'fold', 0), ('run', '25', 0), ('time', 'check analyse plan run', 0)) t(command, said, status)")
def command_line(spark, d):
    """What the commands print, in a word."""
    at = ["--strict", "--table", f"nation={d}/nation.parquet"]
    text = "select count(n_nationkey) as n from nation"

    def ran(*args: str) -> tuple[str, int]:
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            status = command_line_.main([*args, *at], spark)
        return out.getvalue(), status

    words = {"check": str.strip, "check a refusal": str.strip, "path": str.strip, "parse": lambda x: re.search(r"\w+", x)[0], "explain": lambda x: x.split("\n")[0], "run": lambda x: re.search(r"\d+", x)[0], "time": lambda x: " ".join(re.findall("[a-z]+", x))}
    found = []
    for what, word in words.items():
        said, status = ran(what.split()[0], "select 1 as one" if "refusal" in what else text)
        found.append((what, word(said), status))
    return spark.createDataFrame(found, "command string, said string, status int")


@query(_codes(known="ok", unknown="NL0500", change_of_a_base="NL0230", change_of_a_table="0A000"))
def catalog_rules(spark, d):
    catalog = Catalog(spark)
    catalog.parquet("nation", f"{d}/nation.parquet")
    catalog.add(Relation("region", table(spark, d, "region"), kind="table"))
    return _cases(spark, {"known": lambda: catalog.rel("nation").df, "unknown": lambda: catalog.rel("nothing"), "change_of_a_base": lambda: catalog.change("nation"), "change_of_a_table": lambda: catalog.change("region")})
