"""The SQL surface against DuckDB on the same small tables, refusals by code, and statements that must not run."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from epochal.plans.refusal import Refused
from epochal.session import Engine
from epochal.sources.relations import confidential

SALES = [(10, "north", 5, 1), (10, "north", 5, 1), (11, "south", None, 2), (12, "south", 9, 2), (13, None, -4, 3), (14, "east", 0, 4)]
SHOPS = [("north", 3), ("south", 1), ("west", 2), (None, 7)]
ROADS = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("f", "f")]
SCHEMAS = {"sales": "day long, shop string, spend long, epoch long", "shops": "shop string, staff long", "roads": "head string, tail string"}
DATA = {"sales": SALES, "shops": SHOPS, "roads": ROADS}


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark, strict=True, head=6)
    e.add("sales", spark.createDataFrame(SALES, SCHEMAS["sales"]), key=("day",), epoch="epoch")
    e.add("shops", spark.createDataFrame(SHOPS, SCHEMAS["shops"]), key=("shop",))
    e.add("roads", spark.createDataFrame(ROADS, SCHEMAS["roads"]), key=("head",))
    e.add("people", confidential(spark.createDataFrame([("ann", "x1", 4), ("bob", "x2", 5)], "name string, card string, visits long"), "card", "e2ee", "name"))
    return e


@pytest.fixture(scope="module")
def duck():
    c = pytest.importorskip("duckdb").connect()
    for name, rows in DATA.items():
        c.execute(f"create table {name} ({SCHEMAS[name].replace('long', 'bigint').replace('string', 'varchar')})")
        c.executemany(f"insert into {name} values ({', '.join('?' * len(rows[0]))})", rows)
    return c


#: Statements that mean the same in DuckDB.
SAME = (
    "select day, shop, spend from sales",
    "select spend as s, day from sales where shop = 'south'",
    "select day from sales where spend > 0 or shop is null",
    "select day from sales where not (spend > 0)",
    "select distinct shop from sales",
    "select shop, sum(spend) as s from sales group by shop",
    "select shop, count(*) as n from sales group by shop",
    "select shop, min(spend) as low from sales group by shop",
    "select shop, max(day) as high from sales where day < 13 group by shop",
    "select sum(spend) as s from sales where day > 99",
    "select shop, sum(spend) as s from sales group by shop having sum(spend) > 3",
    "select shop from sales union select shop from shops",
    "select shop from sales union all select shop from shops",
    "select shop from shops except select shop from sales",
    "select shop from shops intersect select shop from sales",
    "select s.day, h.staff from sales s join shops h on s.shop = h.shop",
    "select s.day, h.staff from sales s left join shops h on s.shop = h.shop and h.staff > 1",
    "select s.day, h.staff from sales s right join shops h on s.shop = h.shop",
    "select s.day, h.staff from sales s full join shops h on s.shop = h.shop",
    "select h.staff, r.tail from shops h cross join roads r",
    "select s.day, h.staff from sales s join shops h on s.spend > h.staff",
    "select day from sales where exists (select 1 from shops where shops.shop = sales.shop)",
    "select day from sales where not exists (select 1 from shops where shops.shop = sales.shop)",
    "select day from sales where shop in (select shop from shops where staff > 1)",
    "select staff from shops where staff not in (select spend from sales)",
    "select day, spend from sales order by spend desc, day limit 3",
    "select shop, sum(spend) as s from sales where spend is not null group by shop order by s desc, shop limit 2",
    "with big as (select day, shop from sales where spend >= 5) select big.day, h.staff from big join shops h on big.shop = h.shop",
    "with recursive far(a, b) as (select head, tail from roads union select far.a, r.tail from far join roads r on far.b = r.head) select a, b from far",
    "select day, spend, rank() over (order by day) as r from sales",
    "select day, dense_rank() over (order by day desc) as r from sales",
    "select day, sum(day) over (partition by shop order by day) as run from sales",
    "select day, shop, row_number() over (partition by shop order by day) as n from sales where day > 10",
)

REFUSALS = {
    "select day from sales where nothing = 1": "NL0501",
    "select day from sales limit spend": "NL0504",
    "select day, shop from sales union select shop from shops": "NL0512",
    "select 7 as seven": "NL0511",
    "select staff, (select max(day) from sales where sales.shop = shops.shop) as last from shops": "NL0508",
    "select case when staff = 1 then 'one' else 'more' end as x from shops": "NL0508",
    "select staff from sales join shops using (shop)": "NL0001",
    "select count(distinct sales.shop) from sales": "NL0002",
    "select day from sales order by nothing": "NL0509",
    "select shop, max(spend) - 1 from sales group by shop": "NL0517",
    "select shop, max(spend) from sales group by nothing": "NL0509",
    "select shop, day, max(spend) from sales group by shop": "NL0517",
    "select shop, max(spend) from sales group by shop having min(spend) > 1": "NL0518",
    "select name from people where card = 'x1'": "NL0260",
    "select card, count(*) from people group by card": "NL0260",
    "select hidden from (select card as hidden, name from people) p where hidden = 'x2'": "NL0260",
    "select name from people order by card": "NL0260",
    "select l.name from people l join people r on l.card = r.card": "NL0260",
    "select upper(card) from people": "NL0260",
    "with recursive far(a, b) as (select head, tail from roads union all select far.a, r.tail from far join roads r on far.b = r.head) select a, b from far": "NL0524",
    "with recursive far(a, b) as (select head, tail from roads union select far.a, max(r.tail) from far join roads r on far.b = r.head group by far.a) select a, b from far": "NL0525",
    "with two(a, b) as (select shop from shops) select a from two": "NL0523",
    "select day from sales where row_number() over (order by day) = 1": "NL0526",
    "select shop, max(day), rank() over (order by shop) from sales group by shop": "NL0526",
    "select day, lead(day) over (order by day) from sales": "NL0527",
    "select x from elsewhere": "NL0500",
    "select day from sales as of system time 40": "22023",
    "select day from sales as of system time soon": "NL0510",
    "selec day from sales": "42601",
    "": "42601",
    "delete from sales": "NL0230",
    "drop table sales": "0A000",
    "create table more as select day from sales": "0A000",
}


def rows(found) -> Counter:
    return Counter(tuple(None if x is None else str(x) for x in r) for r in found)


@pytest.mark.parametrize("text", SAME)
def test_rows_are_those_of_duckdb(engine, duck, text):
    assert rows(engine.sql(text).collect()) == rows(duck.execute(text).fetchall())


@pytest.mark.parametrize("text", REFUSALS)
def test_refusals(engine, text):
    with pytest.raises(Refused) as e:
        engine.sql(text).collect()
    assert e.value.code == REFUSALS[text] == engine.check(text)


def test_bare_aggregate_names_in_having(engine):
    text = "select shop, sum(spend), 'having sum' as note from sales group by shop having sum > 3 -- sum"
    free = Engine(engine.spark, engine.catalog)
    assert rows(free.sql(text).collect()) == rows([("north", 10, "having sum"), ("south", 9, "having sum")])


def test_anchors(engine):
    assert rows(engine.sql("select day from sales as of system time 2").collect()) == rows([(10,), (10,), (11,), (12,)])
    assert rows(engine.sql("select count(*) as n from (select day from sales as of system time #1) x").collect()) == rows([(2,)])
    assert rows(engine.sql("select day, recorded_at from sales where recorded_at between 2 and 3").collect()) == rows([(11, 2), (12, 2), (13, 3)])
    assert engine.sql("select * from sales where recorded_at <= 1").columns == ["day", "shop", "spend"]
    assert engine.sql("select day from sales", anchor=1, with_anchor=True).first().anchor == 1
    for text in ("select day from sales as of system time 1", "select a.day from sales as of system time 1 a join sales as of system time 2 b on a.day = b.day"):
        with pytest.raises(Refused, match="22023"):
            engine.sql(text, anchor=3)


def test_literals_and_comments_are_not_read_as_clauses(engine):
    free = Engine(engine.spark, engine.catalog, head=6)
    got = free.sql("select 'as of system time 3 days' as note, day from sales /* as of system time 1 */ -- recorded_at").collect()
    assert len(got) == len(SALES) and {r.note for r in got} == {"as of system time 3 days"}
    assert free.sql("select 'recorded_at' as x, sales.* from sales").columns == ["x", "day", "shop", "spend"]


def test_beyond_the_fragment_without_strict(engine):
    free = Engine(engine.spark, engine.catalog)
    assert free.sql("select count(distinct shop) from sales").first()[0] == 3
    assert rows(free.sql("select staff, case when staff > 2 then 'many' else 'few' end as c from shops where shop is not null").collect()) == rows([(3, "many"), (1, "few"), (2, "few")])


def test_serve_paths(engine):
    assert engine.serve_path("select shop, sum(spend) from sales group by shop") == "fold"
    assert engine.serve_path("select max(spend) from sales where day = 12") == "index-fold"
    assert engine.serve_path("select day from sales") == "materialise"
    assert engine.serve_path("select shop, sum(spend) * 2 from sales group by shop") == "refused"
    assert engine.explain("select shop, sum(spend) from sales group by shop").startswith("fold\n== Physical Plan ==")
    assert set(engine.timed("select day from sales")) == {"check", "analyse", "plan", "run"}


def test_explaining_a_recursion_runs_no_round(engine, monkeypatch):
    text = "with recursive far(a, b) as (select head, tail from roads union select far.a, r.tail from far join roads r on far.b = r.head) select a, b from far"
    monkeypatch.setattr("epochal.session.fixpoint", None)
    assert engine.check(text) == "ok" and engine.serve_path(text) == "materialise" and "Physical Plan" in engine.explain(text)


def test_engines_do_not_see_each_other(spark):
    spark.range(1).createOrReplaceTempView("shops")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        a, b = Engine(spark), Engine(spark)
        a.add("shops", spark.createDataFrame([(1,)], "x long"))
        b.add("shops", spark.createDataFrame([(2,), (3,)], "x long"))
        first, second = a.sql("select x from shops"), b.sql("select x from shops")
        assert (first.count(), second.count()) == (1, 2) and spark.table("shops").columns == ["id"]
        assert spark.conf.get("spark.sql.ansi.enabled") == "false"
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
        spark.catalog.dropTempView("shops")


def test_udf_is_not_moved_unless_certified(spark):
    e = Engine(spark)
    e.add("shops", spark.createDataFrame(SHOPS, SCHEMAS["shops"]))
    e.udf("more", lambda x: x + 1, "long")
    e.udf("twice", lambda x: x * 2, "long", deterministic=True)
    e.udf("whole", F.pandas_udf(lambda x: x + 10, "long"), "long", deterministic=True)
    assert sorted(r[0] for r in e.sql("select more(staff) from shops").collect()) == [2, 3, 4, 8]
    assert sorted(r[0] for r in e.sql("select twice(staff) from shops").collect()) == [2, 4, 6, 14]
    assert sorted(r[0] for r in e.sql("select whole(staff) from shops").collect()) == [11, 12, 13, 17]
    plan = lambda f: e.sql(f"select {f}(staff) as y from shops where shop = 'west'")._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan("twice")
