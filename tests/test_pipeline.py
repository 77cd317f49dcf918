"""Stages of the pipeline, and the values and plans behind them."""

from __future__ import annotations

import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from epochal.functions import values
from epochal.operators import subquery
from epochal.operators.fixpoint import fixpoint
from epochal.operators.relation import Rel
from epochal.plans import contracts, nodes
from epochal.plans.refusal import NonTerminating, Refused
from epochal.sources.relations import Catalog, Relation, changes, confidential


def rows(x) -> list[tuple]:
    return sorted((tuple(r) for r in (x.df if isinstance(x, Rel) else x).collect()), key=lambda r: [(v is not None, v) for v in r])


@pytest.fixture(scope="module")
def t(spark):
    return Rel.source(spark.createDataFrame([(1, 10, 100, 1), (1, 10, None, 2), (2, 20, 200, 2), (3, 30, None, 3)], "k long, v long, n long, epoch long"), "t", ("k",), epoch="epoch")


@pytest.fixture(scope="module")
def u(spark):
    return Rel.source(spark.createDataFrame([(1, 1), (2, 2), (4, 4)], "k long, w long"), "u", ("k",))


def test_stages(t, u):
    assert rows(t.where(F.col("v") > 10).map("k", F.col("v") + 1)) == [(2, 21), (3, 31)]
    assert rows(t.group_by("k").count("n")) == [(1, 2), (2, 1), (3, 1)]
    assert rows(t.group_by("k").avg("n")) == [(1, 100), (2, 200), (3, None)]
    assert rows(t.select("k").index("k").join(u)) == [(1, 1, 1), (1, 1, 1), (2, 2, 2)]
    assert rows(t.select("k").index("k").anti_join(u)) == [(3,)]
    assert rows(t.distinct_by("k").select("k", "v")) == [(1, 10), (2, 20), (3, 30)]
    assert rows(t.select("k", "v").index("k").intersect_by_key(u)) == [(1, 10), (2, 20)]
    assert rows(t.order_by(F.desc("v")).limit(2).select("k")) == [(2,), (3,)]
    assert rows(t.order_by("v").offset(3).select("k")) == [(3,)]
    assert rows(t.get(1).select("v")) == [(10,), (10,)]
    assert rows(t.range(2, None).select("k")) == [(2,), (3,)]
    assert rows(t.as_of(2).select("k")) == [(1,), (1,), (2,)]
    assert rows(t.stage("where", "k = 3").select("k")) == [(3,)]
    assert [r.k for r in t.order_by(F.desc("k")).presented().collect()] == [3, 2, 1, 1]


@pytest.mark.parametrize(
    ("code", "build"),
    [
        ("NL0505", lambda t, u: t.stage("rolling_median")),
        ("NL0504", lambda t, u: t.limit("n")),
        ("NL0509", lambda t, u: t.group_by("nope")),
        ("NL0509", lambda t, u: t.order_by("nope")),
        ("NL0509", lambda t, u: values.parse_date("2026-02-30")),
        ("NL0510", lambda t, u: u.as_of(1)),
        ("NL0510", lambda t, u: t.as_of(-1)),
        ("NL0503", lambda t, u: t.map("k").join(u)),
        ("NL0519", lambda t, u: t.index("k", "v").join(u)),
        ("NL0512", lambda t, u: t.union_all(u)),
        ("NL0520", lambda t, u: t.join(u, {"nope": "k"})),
        ("NL0400", lambda t, u: u.fixpoint(lambda a: a)),
        ("NL0507", lambda t, u: u.fixpoint(lambda a: a, measure=0)),
        ("NL0513", lambda t, u: u.fixpoint(None, measure=1)),
        ("NL0514", lambda t, u: u.fixpoint(lambda a: a.select("k"), measure=1)),
        ("NL0527", lambda t, u: t.window("ntile")),
        ("NL0502", lambda t, u: t.group_by("k").agg(x=("median", "v"))),
        ("NL0506", lambda t, u: values.standard_currencies().money("1.00", "xbt")),
        ("NL0240", lambda t, u: values.standard_currencies().money("1.005", "usd")),
        ("NL0240", lambda t, u: values.standard_currencies().money("100.50", "jpy")),
    ],
)
def test_refused(t, u, code, build):
    with pytest.raises(Refused) as e:
        build(t, u)
    assert e.value.code == code


def test_confidential(spark):
    p = Rel.source(confidential(spark.createDataFrame([(1, 700), (2, 800)], "who long, owner long"), "owner", "e2ee", "who"), "p")
    assert rows(p.select("who", "owner")) == [(1, 700), (2, 800)]
    for build in (lambda: p.where("owner = 1"), lambda: p.group_by("owner").count(), lambda: p.group_by("who").max("owner"), lambda: p.map(F.col("owner") + 1), lambda: p.window("rank", order=("owner",)), lambda: p.join(p, ["owner"])):
        with pytest.raises(Refused, match="NL0260"):
            build()


def test_subqueries_with_null(spark):
    o = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "g long, x long")
    i = spark.createDataFrame([(1, 5), (1, None), (3, 8)], "g long, y long")
    assert rows(subquery.in_(o, "x", i, "y").select("g")) == [(1,)]
    assert rows(subquery.not_in(o, "x", i, "y").select("g")) == []  # a null among the values
    assert rows(subquery.not_in(o, "x", i, "y", {"g": "g"}).select("g")) == [(2,), (3,)]  # group 2 has no values
    assert rows(subquery.not_in(o, "x", i, "y", {"g": "g"}, keep_null_probe=False).select("g")) == [(3,)]
    assert rows(subquery.exists(o, i, {}).select("g")) == [(1,), (2,), (3,)]
    assert rows(subquery.exists(o, i.filter("g > 9"), {}, negated=True).select("g")) == [(1,), (2,), (3,)]
    assert rows(subquery.scalar(o, i, {"g": "g"}, "count", "y", "n").select("g", "n")) == [(1, 2), (2, None), (3, 1)]


def test_fixpoint(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 6), (6, 5), (7, None)], "a long, b long")
    step = e.toDF("c", "d")
    got = fixpoint(e, lambda new: new.join(step, new.b == step.c).select("a", "d"))
    assert rows(got) == [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (5, 5), (5, 6), (6, 5), (6, 6), (7, None)]
    assert rows(fixpoint(e, lambda new: new)) == rows(e)
    with pytest.raises(NonTerminating) as x:
        fixpoint(e.select("a"), lambda new: new.select(F.col("a") + 10), max_rounds=3)
    assert x.value.rounds == 3 and x.value.tail[-1] > 0


def test_arithmetic(spark):
    spark.conf.set("spark.sql.ansi.enabled", "true")
    df = spark.createDataFrame([(-7, 2), (7, -2), (None, 0)], "a long, b long")
    assert [tuple(map(lambda x: None if x is None else int(x), r)) for r in df.filter("b <> 0").select(values.div("a", "b"), values.mod("a", "b")).collect()] == [(-3, -1), (-3, 1)]
    for bad in (F.lit(1) / F.lit(0), values.div(F.lit(1), F.lit(0)), F.lit(2**63 - 1) + F.lit(1), F.col("a") * F.lit(2**62)):
        with pytest.raises(PySparkException):
            df.filter("b > 0").select(bad).collect()
    text = spark.createDataFrame([("a%b",), ("a\\%b",), ("axb",), (None,)], "s string")
    assert [r[0] for r in text.filter(values.like("s", "a\\%")).collect()] == ["a\\%b"]
    assert spark.range(1).select(values.day_number(F.lit(datetime.date(1970, 1, 2))), values.day(F.lit(365))).first()[:] == (1, datetime.date(1971, 1, 1))


def test_money(spark):
    known = values.standard_currencies()
    assert known.minor("18.50", "usd") == 1850 and known.minor(100, "jpy") == 100 and known.minor("1.234", "bhd") == 1234
    df = spark.createDataFrame([(1, 0, 5), (1, 0, 7), (2, 0, 1), (2, 1, 1)], "g long, cur int, amt long")
    assert df.filter("g = 1").groupBy("g").agg(values.sum_in_currency("amt", "cur").alias("s")).first().s == 12
    with pytest.raises(PySparkException, match="22000"):
        df.groupBy("g").agg(values.sum_in_currency("amt", "cur").alias("s")).collect()
    assert df.filter("g > 9").agg(values.sum_in_currency("amt", "cur").alias("s")).first().s is None
    with pytest.raises(PySparkException, match="NL0251"):
        spark.range(1).select(values.compare_money(known.money(1, "usd"), "<", known.money(1, "eur"))).collect()
    assert spark.range(1).select(values.compare_money(known.money(1, "usd"), "<", known.money(2, "usd"))).first()[0]
    assert spark.range(1).select(known.scaled(F.lit("1.25").cast("decimal(10,4)"), "usd")).first()[0] == 125
    with pytest.raises(PySparkException, match="22003"):
        spark.range(1).select(known.scaled(F.lit("1.255").cast("decimal(10,4)"), "usd")).collect()


def test_attributes(t, u):
    total = t.group_by("k").sum("v")
    assert total.node.incremental() and total.node.conserves() and total.node.output_key() == ("k",) and total.node.additive()
    assert not t.where("k = 1").node.conserves() and t.where("k = 1").node.incremental()
    assert not t.group_by("k").min("v").node.conserves()
    assert not t.order_by("k").limit(1).node.incremental()
    assert not t.window("rank", order=("k",)).node.incremental() and t.window("rank", order=("k",)).node.conserves()
    assert t.map("k").node.output_key() is None and t.where("k = 1").node.output_key() == ("k",)
    assert t.join(u).node.conserves() and not t.left_join(u).node.conserves()
    assert t.join(u).node.bases() == {"t", "u"}
    assert "key=('k',)" in total.node.show()


def test_verifier(t):
    total, demand = t.group_by("k").sum("v").node, contracts.Contract(materialize=contracts.Materialize.DEMAND)
    assert nodes.verified(total, demand, claims_conservation=True) is total
    for node, contract, claims, code in (
        (t.where("k = 1").node, contracts.Contract(), True, "IR016"),
        (t.map("k").node, demand, False, "IR013"),
        (t.order_by("k").limit(1).node, demand, False, "NL0222"),
        (t.as_of(1).node, contracts.Contract(contracts.Rung.LEDGER_CONSISTENT), False, "IR011"),
        (total, contracts.Contract(contracts.Rung.LEDGER_CONSISTENT, materialize=contracts.Materialize.SPILLED), False, "IR010"),
        (Rel.source(t.df, "x", ("k",), base=False).node, demand, False, "IR012"),
        (nodes.Node("apply", (total, total)), contracts.Contract(), False, "IR018"),
        (nodes.Node("union", (total,)), contracts.Contract(), False, "IR001"),
    ):
        with pytest.raises(Refused) as e:
            nodes.verified(node, contract, claims)
        assert e.value.code == code


def test_contracts():
    c, r, m = contracts.Contract, contracts.Rung, contracts.Materialize
    for contract, code in ((c(r.LEDGER_CONSISTENT, materialize=m.SPILLED), "NL0220"), (c(materialize=m.ABSENT, retain=contracts.Retain.PINNED), "NL0221"), (c(max_rounds=0), "NL0528")):
        with pytest.raises(Refused) as e:
            contract.checked()
        assert e.value.code == code
    assert c(r.BOUNDED, bound_epochs=8).stride() == 8 and c().stride() == 1
    with pytest.raises(Refused, match="NL0311"):
        contracts.check_order("spendable", c(r.LEDGER_CONSISTENT), {"balance": c(r.READ_YOUR_WRITES)})
    contracts.check_order("report", c(r.BOUNDED), {"balance": c(r.READ_YOUR_WRITES)})


def test_catalog(spark, t, tmp_path):
    with pytest.raises(Refused, match="NL0210"):
        Relation("x", t.df, retain="30 days")
    with pytest.raises(Refused, match="NL0211"):
        Relation("x", t.df, kind="ledger")
    catalog = Catalog(spark)
    catalog.add(Relation("t", t.df, "ledger", ("k",), "epoch", conserves=("k",)))
    with pytest.raises(Refused, match="NL0230"):
        catalog.change("t")
    with pytest.raises(Refused, match="NL0500"):
        catalog.rel("nope")
    t.df.write.parquet(f"{tmp_path}/t")
    assert catalog.parquet("file", f"{tmp_path}/t").df.count() == 4
    (tmp_path / "c").mkdir()
    (tmp_path / "c/1.json").write_text('{"epoch":1,"op":"+","k":1}\n{"epoch":2,"op":"-","k":1}\n')
    assert rows(changes(spark, f"{tmp_path}/c", "k long")) == [(1, 1, 1), (2, 1, -1)]


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = f"{tmp_path}/wide"
    spark.range(100).select(F.col("id").alias("k"), *[(F.col("id") * i).alias(f"c{i}") for i in range(1, 9)]).write.parquet(path)
    plan = Rel.source(spark.read.parquet(path), "wide", ("k",)).get(7).select("k", "c1").df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<k:bigint,c1:bigint>" in plan and "PushedFilters" in plan and "EqualNullSafe(k,7)" in plan


@pytest.mark.parametrize("function", ["sum", "count", "min", "max", "rank", "dense_rank", "row_number"])
@pytest.mark.parametrize("partition", [("g",), ()])
def test_spread_windows_are_windows(spark, function, partition):
    data = [(None if i % 9 == 0 else i % 2, None if i % 7 == 0 else i * 5 % 11, None if i % 5 == 0 else i % 13, i // 2) for i in range(120)]
    r = Rel.source(spark.createDataFrame(data, "g long, o long, x long, id long").repartition(5), "r")
    for way in ("asc", "desc"):
        key = F.col("o").desc() if way == "desc" else F.col("o").asc()
        x = None if function in ("rank", "dense_rank", "row_number") else "x"
        plain = r.window(function, x, partition, (key,), "w")
        wide = r.spread_window(function, x, partition, (("o", way),), "w")
        assert rows(wide.select("g", "o", "x", "id", F.col("w").cast("long"))) == rows(plain.select("g", "o", "x", "id", F.col("w").cast("long")))


def test_command_line(spark, tmp_path, capsys):
    from epochal.__main__ import main

    spark.createDataFrame([(1, 10, 0), (2, 20, 1)], "k long, v long, epoch long").write.parquet(f"{tmp_path}/t")
    table = ["--table", f"t={tmp_path}/t:epoch"]
    assert main(["check", "--strict", "select k from t", *table]) == 0
    assert main(["check", "--strict", "select case when k = 1 then 1 else 0 end from t", *table]) == 1
    assert main(["run", "--anchor", "0", "select sum(v) as s from t", *table]) == 0
    assert main(["explain", "select k, sum(v) from t group by k", *table]) == 0
    out = capsys.readouterr().out
    assert "NL0508" in out and "|10 |" in out and "fold" in out


def test_sums_by_limbs_are_exact(spark):
    big = 2**63 - 1
    data = [(0, big), (0, big), (0, -1), (1, -big - 1), (1, -big - 1), (2, None), (3, 5), (3, -5), (4, -1), (4, None)]
    r = Rel.source(spark.createDataFrame(data, "g long, x long"), "r")
    want = [(0, 2 * big - 1), (1, -2 * big - 2), (2, None), (3, 0), (4, -1)]
    assert rows(r.group_by("g").sum("x")) == want
    assert rows(r.window("sum", "x", ("g",), (), "s").distinct_by("g").select("g", "s")) == want
    assert rows(r.where("g = 9").sum("x")) == [(None,)]
