"""The ledger and its maintained views against a plain Python model, under random schedules."""

from __future__ import annotations

import datetime
import random
from collections import Counter, defaultdict

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from epochal.operators.windows import stretched
from epochal.plans.contracts import Contract, Rung
from epochal.plans.refusal import Refused
from epochal.session import Engine
from epochal.sources import ledger, storage
from epochal.sources.ledger import Ledger, Rejected
from epochal.streaming import checkpoints
from epochal.streaming.views import View

POSTING = "txn long, acct long, cur int, amt long, value_date date"
DAY = datetime.date(2026, 1, 1)


def legs(spark, *rows):
    return spark.createDataFrame([(t, a, c, x, DAY + datetime.timedelta(d)) for t, a, c, x, d in rows], POSTING)


def balances(df) -> dict:
    return {(r.acct, r.cur): int(r[-1]) for r in df.collect()}


@pytest.fixture
def book(spark, tmp_path):
    return Ledger(spark, f"file://{tmp_path}/book")


def test_commit_rule(spark, book):
    assert book.head() == -1 and book.table("postings").count() == 0 and book.verify_chain()
    assert book.submit("a", legs(spark, (1, 7, 0, 100, 0), (1, 8, 0, -100, 0))) == 0
    with pytest.raises(Rejected, match="duplicate"):
        book.submit("a", legs(spark, (2, 7, 0, 1, 0), (2, 8, 0, -1, 0)))
    with pytest.raises(Rejected, match="unbalanced"):
        book.submit("b", legs(spark, (2, 7, 0, 100, 0), (2, 8, 1, -100, 0)))  # balanced only across currencies
    assert book.submit("fx", legs(spark, (3, 7, 0, -10, 1), (3, 8, 0, 10, 1), (3, 8, 1, -9, 1), (3, 7, 1, 9, 1))) == 1
    assert balances(ledger.ledger_balance(book.table("postings"))) == {(7, 0): 90, (8, 0): -90, (7, 1): 9, (8, 1): -9}
    assert balances(ledger.ledger_balance(book.table("postings"), 0)) == {(7, 0): 100, (8, 0): -100}
    assert balances(ledger.bitemporal_balance(book.table("postings"), 1, F.lit(DAY))) == {(7, 0): 100, (8, 0): -100}
    assert all(r.total == 0 for r in ledger.conservation(book.table("postings")).collect())
    assert ledger.key_exists_at(book.table("postings"), 7, 1, 1) and not ledger.key_exists_at(book.table("postings"), 7, 1, 0)


def test_holds(spark, book):
    hold = spark.createDataFrame([(1, 7, 0, 30), (2, 7, 0, 5)], "id long, acct long, cur int, amount long")
    book.submit("open", legs(spark, (1, 7, 0, 100, 0), (1, 8, 0, -100, 0)))
    book.submit("hold", holds=hold)
    out = lambda e=None: balances(ledger.available_balance(book.table("postings"), book.table("holds"), book.table("resolutions"), e))
    assert out() == {(7, 0): 65, (8, 0): -100} and out(0) == {(7, 0): 100, (8, 0): -100}
    done = spark.createDataFrame([(1, "post", 20)], "hold long, outcome string, captured long")
    book.submit("capture", legs(spark, (2, 7, 0, -20, 0), (2, 8, 0, 20, 0)), resolutions=done)
    assert out() == {(7, 0): 75, (8, 0): -80}
    for bad in ((1, "void"), (9, "void"), (2, "lost")):
        with pytest.raises(Rejected, match="bad_resolution"):
            book.submit(f"bad{bad}", resolutions=spark.createDataFrame([bad], "hold long, outcome string"))
    with pytest.raises(Rejected, match="bad_resolution"):
        book.submit("twice", resolutions=spark.createDataFrame([(2, "void"), (2, "void")], "hold long, outcome string"))
    assert book.head() == 2 and book.verify_chain()


def test_tampering_is_found(spark, book, tmp_path):
    for i in range(3):
        book.submit(str(i), legs(spark, (i, 7, 0, 10 + i, 0), (i, 8, 0, -10 - i, 0)))
    assert book.verify_chain()
    path = f"{book.root}/postings/epoch=1"
    changed = spark.read.parquet(path).withColumn("acct", F.when(F.col("acct") == 7, 70).otherwise(F.col("acct")))
    changed.write.parquet(f"file://{tmp_path}/changed")
    storage.removed(spark, path)
    storage.moved(spark, f"file://{tmp_path}/changed", path)
    assert not book.verify_chain()


def pair(spark, t, x=5):
    return legs(spark, (t, 7, 0, x, 0), (t, 8, 0, -x, 0))


def test_two_writers(spark, book, monkeypatch):
    """A second writer seals the epoch between the first one's look at the head and its claim."""
    rival, claimed, met = Ledger(spark, book.root), storage.claimed, []

    def late(session, path, text):
        if not met and path.endswith(f"{0:012d}.json"):
            met.append("now")
            met.append(rival.submit("rival", pair(spark, 1)))
        return claimed(session, path, text)

    monkeypatch.setattr(storage, "claimed", late)
    assert book.submit("own", pair(spark, 2)) == 1 and met == ["now", 0]
    rows = {(r.epoch, r.txn) for r in book.table("postings").collect()}
    assert rows == {(0, 1), (1, 2)} and book.verify_chain() and rival.verify_chain()


def test_a_rival_of_the_same_key_is_a_duplicate(spark, book, monkeypatch):
    rival, claimed, met = Ledger(spark, book.root), storage.claimed, []

    def late(session, path, text):
        if not met and path.endswith(f"{0:012d}.json"):
            met.append("now")
            rival.submit("same", pair(spark, 1))
        return claimed(session, path, text)

    monkeypatch.setattr(storage, "claimed", late)
    with pytest.raises(Rejected, match="duplicate"):
        book.submit("same", pair(spark, 1))
    assert book.table("postings").count() == 2 and book.verify_chain()
    assert not [x for x in storage.names(spark, f"{book.root}/_staged")]


def test_a_writer_that_dies_after_its_claim(spark, book, monkeypatch):
    """The epoch is sealed, its folders are not in place: the next one who looks puts them there."""
    monkeypatch.setattr(Ledger, "_settled", lambda self, epoch: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError, match="gone"):
        book.submit("a", pair(spark, 1))
    monkeypatch.undo()
    other = Ledger(spark, book.root)
    assert other.head() == 0 and other.table("postings").count() == 2 and other.verify_chain()
    with pytest.raises(Rejected, match="duplicate"):
        other.submit("a", pair(spark, 1))
    assert other.submit("b", pair(spark, 2)) == 1 and other.verify_chain()


def test_a_source_that_is_not_deterministic(spark, book):
    """What was checked is what is sealed: the rows are computed once."""
    x = F.floor(F.rand() * 1_000_000).cast("long")
    rows = spark.range(200).select(F.col("id").alias("txn"), F.explode(F.array(F.lit(7), F.lit(8))).alias("acct"), F.lit(0).alias("cur"), x.alias("amt"))
    with pytest.raises(Rejected, match="unbalanced"):
        book.submit("random", rows)
    half = spark.range(200).select(F.col("id").alias("txn"), x.alias("x"))
    even = half.select("txn", F.explode(F.array(F.struct(F.lit(7).alias("acct"), F.col("x").alias("amt")), F.struct(F.lit(8).alias("acct"), (-F.col("x")).alias("amt")))).alias("leg"))
    book.submit("even", even.select("txn", "leg.acct", F.lit(0).alias("cur"), "leg.amt"))
    assert book.verify_chain() and ledger.unbalanced(book.table("postings")).isEmpty()


def test_epochs_lie_in_account_order(spark, book):
    rows = [(t, a, 0, 1 if a % 2 else -1, 0) for t in range(50) for a in (2 * t + 1, 2 * t + 2)]
    book.submit("many", legs(spark, *rows))
    files = spark.read.parquet(f"{book.root}/postings/epoch=0").select("acct", F.input_file_name().alias("f")).collect()
    per_file = defaultdict(list)
    for r in files:
        per_file[r.f].append(r.acct)
    assert all(a == sorted(a) for a in per_file.values())
    assert [r.txn for r in ledger.postings_for(book.table("postings"), 41).collect()] == [20]
    plan = ledger.postings_for(book.table("postings"), 41)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(acct,41)" in plan


def test_digest_tree_does_not_depend_on_order_but_on_every_row(spark):
    rows = spark.range(500).select(F.lit(0).alias("g"), ledger.row_digest("id").alias("digest"))
    one = ledger.rows_digest(rows, "g", (2, 1, 0)).first().digest
    assert one == ledger.rows_digest(rows.repartition(7).orderBy("digest"), "g", (2, 1, 0)).first().digest
    assert one != ledger.rows_digest(rows.limit(499), "g", (2, 1, 0)).first().digest
    own = ledger.rows_digest(rows, "g").first().digest  # the company of a larger group changes nothing
    both = rows.unionByName(spark.range(9000).select(F.lit(1).alias("g"), ledger.row_digest("id").alias("digest")))
    assert own == ledger.rows_digest(both, "g").filter("g = 0").first().digest
    pair = spark.createDataFrame([("1", "23"), ("12", "3"), (None, "n")], "a string, b string")
    assert pair.select(ledger.row_digest("a", "b")).distinct().count() == 3


def test_idempotency_window(spark, tmp_path):
    book = Ledger(spark, f"file://{tmp_path}/w", window=2)
    send = lambda key, t: book.submit(key, legs(spark, (t, 1, 0, 1, 0), (t, 2, 0, -1, 0)))
    assert [send("a", 1), send("b", 2)] == [0, 1]
    with pytest.raises(Rejected):
        send("a", 3)
    assert [send("c", 4), send("a", 5)] == [2, 3]  # a is two epochs back and forgotten
    with pytest.raises(Refused, match="NL0217"):
        Ledger(spark, "file:///nowhere", window=0)
    rows = spark.createDataFrame([(k, e) for k, e in (("x", 0), ("x", 1), ("x", 3), ("x", 4), ("y", 2), ("y", 2))], "idem string, epoch long")
    assert sorted(map(tuple, ledger.first_of_key(rows).collect())) == [("x", 0), ("y", 2), ("y", 2)]
    assert sorted((r.idem, r.epoch) for r in ledger.first_of_key(rows, window=3).collect()) == [("x", 0), ("x", 3), ("y", 2), ("y", 2)]


def test_transaction(spark, book):
    with book.txn("both"):
        book.submit("x", legs(spark, (1, 7, 0, 5, 0)))
        book.submit("y", legs(spark, (1, 8, 0, -5, 0)))
    assert book.head() == 0 and book.table("postings").count() == 2
    with pytest.raises(RuntimeError), book.txn("dropped"):
        book.submit("z", legs(spark, (2, 7, 0, 5, 0), (2, 8, 0, -5, 0)))
        raise RuntimeError
    assert book.head() == 0 and book.open is None


def test_many_epochs_are_found_without_a_list(spark, book, monkeypatch):
    for i in range(6):
        book.submit(str(i), pair(spark, i))
    looks, exists = [], storage.exists
    monkeypatch.setattr(storage, "exists", lambda s, p: (looks.append(p), exists(s, p))[1])
    assert Ledger(spark, book.root).head() == 5 and len([p for p in looks if "/epochs/" in p]) < 10
    looks.clear()
    assert book.head() == 5 and len(looks) == 1


def test_hold_outcomes(spark):
    held = spark.createDataFrame([(1, 7, 0, 30), (2, 7, 0, 5), (3, 8, 0, 9), (4, 8, 0, 1)], "id long, acct long, cur int, amount long")
    done = spark.createDataFrame([(1, "post", 20), (2, "post", None), (3, "void", 4)], "hold long, outcome string, captured long")
    got = {r.outcome: (r.n, int(r.amount), int(r.captured), int(r.released)) for r in ledger.hold_outcomes(held, done).collect()}
    assert got == {"post": (2, 35, 25, 10), "void": (1, 9, 0, 9)}


def test_spaced_points_against_a_walk(spark):
    rng = random.Random(5)
    rows = [(f"k{rng.randrange(6)}", rng.randrange(400)) for _ in range(600)] + [("hot", e) for e in range(0, 3000, 2)]
    want = set()
    for k in {k for k, _ in rows}:
        last = None
        for e in sorted({e for x, e in rows if x == k}):
            if last is None or e >= last + 7:
                want.add((k, e))
                last = e
    frame = spark.createDataFrame([*rows, (None, 3)], "idem string, epoch long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = ledger.first_of_key(frame, window=7).distinct().collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {tuple(r) for r in got} == want


def test_scaled_amounts(spark):
    rows = spark.createDataFrame([(0, "1.50"), (1, "150")], "cur int, text string")
    assert [int(r.amt) for r in ledger.scaled(rows, "text", {0: 2, 1: 0}).collect()] == [150, 150]
    for bad in ((1, "1.5"), (7, "1")):
        with pytest.raises(PySparkException, match="22003|22023"):
            ledger.scaled(spark.createDataFrame([bad], "cur int, text string"), "text", {0: 2, 1: 0}).collect()


@pytest.mark.parametrize("seed", [1, 7])
def test_random_schedule(spark, tmp_path, seed):
    rng = random.Random(seed)
    base_rows: list[tuple] = []
    view = View(spark, f"file://{tmp_path}/v", ("acct", "cur"), {"balance": "amt"}, compact_every=3, checkpoint_every=4)
    head = -1

    def base():
        return spark.createDataFrame(base_rows or [(0, 0, 0, -5)], "acct long, cur int, amt long, epoch long").filter("epoch >= 0")

    def model(e):
        out: dict = defaultdict(lambda: [0, 0])
        for a, c, x, at in base_rows:
            if at <= e:
                out[a, c][0] += x
                out[a, c][1] += 1
        return {k: tuple(v) for k, v in out.items()}

    def read(df):
        return {(r.acct, r.cur): (int(r.balance), r.updates) for r in df.collect()}

    for _ in range(14):
        kind = rng.random()
        if kind < 0.6 or head < 0:
            head += 1
            a, b, c, x = rng.randint(0, 4), rng.randint(5, 8), rng.randint(0, 1), rng.randint(-9, 9)
            base_rows += [(a, c, x, head), (b, c, -x, head)]
            assert view.apply(base().filter(F.col("epoch") == head), head)
        elif kind < 0.8:
            e = rng.randint(0, head)
            assert read(view.read(base(), e)[0]) == model(e)
        else:
            assert not view.apply(base().filter(F.col("epoch") == head), head)  # a delta that comes twice
    assert read(view.state()) == model(head) and view.applied() == head
    assert view.reproduce(base()).isEmpty()
    rows, path = view.read(base(), head)
    assert path == "view" and read(rows) == model(head)


def test_view_contracts(spark, tmp_path):
    base = spark.createDataFrame([(1, 0, 5, e) for e in range(20)], "acct long, cur int, amt long, epoch long")
    view = View(spark, f"file://{tmp_path}/v", ("acct",), {"balance": "amt"}, Contract(Rung.BOUNDED, bound_epochs=8))
    assert [view.maintain(base, h) for h in (3, 7, 10, 15)] == [False, True, False, True]
    assert view.anchor_for(19) == 15 and view.anchor_for(30) == 22
    assert view.state().first().balance == 80
    assert view.read(base, 19, {"acct": 9})[0].isEmpty()  # a miss is not a zero
    assert view.impact(base).count() == 1
    with pytest.raises(Refused):
        View(spark, f"file://{tmp_path}/x", ("acct",), {"balance": "amt"}).state()
    engine = Engine(spark, head=15, views={"b": view})
    engine.add("base", base, key=("acct",), epoch="epoch")
    assert engine.serve_path("select acct, sum(amt) from base group by acct") == "report-from-view"
    assert engine.serve_path("select acct, sum(amt) from base where acct = 1 group by acct") == "view"


def test_stream(spark, tmp_path):
    src = f"{tmp_path}/in"
    for e in range(3):
        spark.createDataFrame([(1, 0, 10 * (e + 1))], "acct long, cur int, amt long").coalesce(1).write.mode("append").parquet(src)
    view = View(spark, f"file://{tmp_path}/v", ("acct", "cur"), {"balance": "amt"})
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema("acct long, cur int, amt long").option("maxFilesPerTrigger", 1).parquet(src)
        view.attach(stream, f"{tmp_path}/cp").awaitTermination()
    assert (int(view.state().first().balance), view.applied()) == (60, 2)


def test_statements(spark, tmp_path):
    engine = Engine(spark, ledger=Ledger(spark, f"file://{tmp_path}/book"), scales={0: 2, 1: 0})
    engine.sql("insert into postings values (1, 7, 0, 1.50, date'2026-01-01'), (1, 8, 0, -1.50, date'2026-01-01')")
    assert engine.head == 0
    engine.sql("begin")
    engine.sql("insert into postings values (2, 7, 1, 9)")
    engine.sql("insert into postings values (2, 8, 1, -9)")
    engine.sql("commit")
    engine.sql("begin")
    engine.sql("insert into postings values (3, 7, 0, 5)")
    engine.sql("rollback")
    assert engine.head == engine.anchor == 1
    rows = engine.sql("select acct, cur, cast(sum(amt) as bigint) as s from postings group by acct, cur", with_anchor=True).collect()
    assert sorted(map(tuple, rows)) == [(7, 0, 150, 1), (7, 1, 9, 1), (8, 0, -150, 1), (8, 1, -9, 1)]
    assert engine.sql("select * from postings as of system time 0").count() == 2
    for text, what in (("insert into postings values (4, 7, 0, 1.505), (4, 8, 0, -1.505)", "22003"), ("insert into postings values (4, 7, 9, 1), (4, 8, 9, -1)", "22023"), ("insert into postings values (4, 7, 0, 1)", "unbalanced")):
        with pytest.raises((PySparkException, Rejected), match=what):
            engine.sql(text)
    for text in ("delete from postings", "commit", "insert into other values (1, 2, 3, 4)", "insert into postings values (1)"):
        with pytest.raises(Refused):
            engine.sql(text)
    again = "insert into postings values (5, 7, 0, 2), (5, 8, 0, -2)"
    head = engine.head
    assert engine.serve_path(again) == "write" and engine.explain(again) == "write\ninsert" and engine.check(again) == "ok"
    assert engine.ledger.head() == engine.head == head  # explaining it posts nothing
    engine.sql(again)
    for retry in (again, again.replace("into ", "into  ")):
        with pytest.raises(Rejected, match="duplicate"):
            engine.sql(retry)
    engine.sql(again, key="on purpose")
    assert engine.head == head + 2 and engine.check("insert into postings values (1)") == "NL0512"
    engine.sql("create materialized view totals as select cur, cast(sum(amt) as bigint) as s from postings group by cur")
    assert sorted(map(tuple, engine.sql("select * from totals").collect())) == [(0, 0), (1, 0)]
    assert engine.ledger.verify_chain()


def test_session_reads(spark, tmp_path):
    base = spark.createDataFrame([(1, 0, 5, e) for e in range(10)], "acct long, cur int, amt long, epoch long")
    strict = View(spark, f"file://{tmp_path}/s", ("acct",), {"balance": "amt"}, Contract(Rung.LEDGER_CONSISTENT))
    session = View(spark, f"file://{tmp_path}/m", ("acct",), {"balance": "amt"}, Contract(Rung.MONOTONIC))
    engine = Engine(spark, head=9, views={"strict": strict, "session": session})
    engine.add("base", base, key=("acct",), epoch="epoch")
    strict.backfill(base, 5)
    session.backfill(base, 3)
    rows, path = engine.read("session")
    assert (path, rows.first().balance, rows.first().anchor) == ("view", 20, 3)
    rows, path = engine.read("strict", {"acct": 1})
    assert (path, rows.first().balance, rows.first().anchor) == ("reconstruction", 50, 9)
    assert engine.read("session")[0].first().anchor == 9  # anchors never go back
    assert strict.emit(f"file://{tmp_path}/sink") and not strict.emit(f"file://{tmp_path}/sink")
    assert spark.read.parquet(f"{tmp_path}/sink").first().anchor == 5


def test_read_sets(spark, tmp_path):
    """One anchor for the views of a read set; the strictest rung looks at the ledger itself; a serializable read guards its block."""
    book = Ledger(spark, f"file://{tmp_path}/book")
    book.submit("a", pair(spark, 1))
    made = lambda rung, name: View(spark, f"file://{tmp_path}/{name}", ("acct", "cur"), {"balance": "amt"}, Contract(rung), relation="postings")
    views = {"snap": made(Rung.SNAPSHOT, "1"), "serial": made(Rung.SERIALIZABLE, "2"), "strict": made(Rung.LEDGER_CONSISTENT, "3"), "mine": made(Rung.READ_YOUR_WRITES, "4")}
    engine = Engine(spark, ledger=book, head=0, views=views, scales={0: 0})
    engine.add("postings", book.table("postings"), kind="ledger", key=("acct",), epoch="epoch", conserves=("txn", "cur"))
    for v in views.values():
        v.backfill(book.table("postings"), 0)
    at = lambda name: engine.read(name)[0].first().anchor
    with engine.snapshot() as pinned:
        assert (pinned, at("snap")) == (0, 0)
        Ledger(spark, book.root).submit("b", pair(spark, 2))
        engine.add("postings", book.table("postings"), kind="ledger", key=("acct",), epoch="epoch", conserves=("txn", "cur"))
        assert (at("snap"), at("strict")) == (0, 1)
    with pytest.raises(Refused, match="40001"), engine.snapshot(1):
        assert at("serial") == 1
        Ledger(spark, book.root).submit("c", pair(spark, 3))
    with engine.snapshot(2):
        at("serial")
        engine.sql("insert into postings values (9, 7, 0, 1), (9, 8, 0, -1)")  # its own write is no one else's
    assert engine.head == 3 and at("mine") == 3 and at("snap") == 3
    stats = {r.view: (r.reads, r.hits, r.misses) for r in engine.statistics().collect()}
    assert stats == {"snap": (3, 2, 1), "serial": (2, 0, 2), "strict": (1, 0, 1), "mine": (1, 0, 1)}
    with pytest.raises(Refused, match="none has"):
        Engine(spark, views={"x": View(spark, f"file://{tmp_path}/5", ("nobody",), {"balance": "amt"})}).read("x")


def test_checkpoints_read_a_suffix(spark):
    rng = random.Random(3)
    rows = [(rng.choice([0, 0, 0, 1, 2]), rng.randrange(60), rng.randrange(3), rng.randrange(-9, 9)) for _ in range(700)] + [(3, None, 0, 4)]
    base = spark.createDataFrame(rows, "acct long, epoch long, place long, amt long")
    held = storage.written(checkpoints.checkpoints(base, ("acct",), "amt", 16, order=("place",)))
    for anchor in (0, 17, 59):
        got = {r.acct: (int(r.total), r.suffix) for r in checkpoints.rebuilt(base, held, ("acct",), "amt", anchor, order=("place",)).collect()}
        for acct in {a for a, e, _, _ in rows if e is not None and e <= anchor}:
            own = [x for a, e, _, x in rows if a == acct and e is not None and e <= anchor]
            assert got[acct][0] == sum(own) and got[acct][1] < 16 + 12  # and the last one's peers
            one = checkpoints.point(base, held, {"acct": acct}, "amt", anchor, order=("place",)).first()
            assert int(one.total) == sum(own)
    plan = checkpoints.rebuilt(base, held, ("acct",), "amt", 30, order=("place",))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_checkpoints_shuffle_the_rows_once(spark):
    base = spark.range(4000).selectExpr("id % 200 acct", "id % 37 epoch", "cast(id as string) place", "id % 91 - 45 amt")
    with storage.owned(spark) as folder:
        held = checkpoints.checkpoints(base, ("acct",), "amt", 16, order=("place",))
        plan = held._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1 and "Join" not in plan
        assert held.count() == 200 and sum(spark.read.parquet(f"{folder}/{name}").count() for name in storage.names(spark, folder)) == 0


def test_checkpoints_of_large_keys(spark):
    rng = random.Random(5)
    some = lambda n: rng.choice([None, *range(n)])
    rows = [(rng.choice([0, 0, 0, 1, None, *range(2, 9)]), some(40), str(some(30)), some(5)) for _ in range(3000)]
    for more in (0, 3000):  # as many rows of one place
        rows += [(0, 7, "7", 3)] * more
        base = spark.createDataFrame(rows, "acct long, epoch long, place string, amt long").repartition(3)
        dealt = stretched(base, ("acct",), ("epoch", "place", "amt"))
        assert "_stretch" in dealt.columns and ("_common" in dealt.columns) == bool(more)
        assert dealt.filter("acct = 0").select("_stretch").distinct().count() > 2
        parted, whole = Counter(), Counter()
        for acct in {r[0] for r in rows}:
            own = sorted((r for r in rows if r[0] == acct), key=lambda r: [(x is None, x) for x in r])
            total = None
            for n, row in enumerate(own, 1):
                total = total if row[3] is None else (total or 0) + row[3]
                if n % 16 == 0:
                    parted[(*row, n, total)] += 1
                if row != (own[n] if n < len(own) else None) and n // 16 > (n - own.count(row)) // 16:
                    whole[(*row, n, total)] += 1
        for way, expected in ((True, parted), (False, whole)):
            held = checkpoints.checkpoints(base, ("acct",), "amt", 16, order=("place", "amt"), parted=way)
            assert Counter(tuple(r) for r in held.collect()) == expected
    with pytest.raises(ValueError, match="parted"):
        checkpoints.checkpoints(base, ("acct",), "amt", 16, order=("place",), parted=True)


def test_intermediate_tables(spark, monkeypatch):
    with storage.owned(spark) as folder:
        assert storage.written(spark.range(3)).count() == 3 and storage.names(spark, folder)
    assert not storage.exists(spark, folder)
    assert f"epochal-{spark.sparkContext.applicationId}" in storage.shared_dir(spark)

    class Elsewhere:
        conf = {}
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.base_dir(Elsewhere)
