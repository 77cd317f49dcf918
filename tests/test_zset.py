"""Weighted sets against plain Python, with negative weights."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.errors import PySparkException

from epochal.operators import zset


def made(spark, z: Counter):
    return spark.createDataFrame([(*r, w) for r, w in z.items()], "k long, v long, _w long")


def got(df) -> dict:
    at = df.columns.index("_w")
    return {tuple(x for i, x in enumerate(r) if i != at): r[at] for r in map(tuple, df.collect())}


def some(rng: random.Random) -> Counter:
    out: Counter = Counter()
    for _ in range(rng.randint(1, 12)):
        out[rng.randint(0, 3), rng.choice([None, 0, 1])] += rng.choice([-2, -1, 1, 1, 2])
    return out


def clean(z) -> dict:
    return {r: w for r, w in z.items() if w}


@pytest.mark.parametrize("seed", range(8))
def test_algebra(spark, seed):
    rng = random.Random(seed)
    a, b = some(rng), some(rng)
    x, y = made(spark, a), made(spark, b)
    plus = Counter(a)
    for r, w in b.items():
        plus[r] += w
    minus = Counter(a)
    for r, w in b.items():
        minus[r] -= w
    assert got(zset.consolidated(zset.union(x, y))) == clean(plus)
    assert got(zset.difference(x, y)) == clean(minus)
    assert got(zset.distinct(x)) == {r: 1 for r, w in a.items() if w > 0}
    assert got(zset.except_(x, y)) == {r: 1 for r, w in a.items() if w > 0 and b[r] <= 0}
    assert got(zset.negate(zset.negate(x))) == got(x)
    key = Counter()
    for (k, _), w in b.items():
        key[k] += w
    assert got(zset.consolidated(zset.semi(x, y, ["k"]))) == {r: w for r, w in clean(a).items() if key[r[0]] > 0}
    assert got(zset.consolidated(zset.anti(x, y, ["k"]))) == {r: w for r, w in clean(a).items() if key[r[0]] <= 0}
    joined = Counter()
    for (k, v), w in a.items():
        for (k2, v2), w2 in b.items():
            if k == k2:
                joined[k, v, v2] += w * w2
    right = y.withColumnRenamed("v", "v2")
    assert got(zset.consolidated(zset.join(x, right, ["k"]).select("k", "v", "v2", "_w"))) == clean(joined)


@pytest.mark.parametrize("seed", range(6))
def test_aggregates(spark, seed):
    a = some(random.Random(100 + seed))
    out = zset.aggregate(made(spark, a), ["k"], s=("sum", "v"), n=("count", "v"), low=("min", "v"), high=("max", "v"), mean=("avg", "v"))
    want = {}
    for k in {k for k, _ in clean(a)}:
        own = [(v, w) for (q, v), w in clean(a).items() if q == k]
        known = [(v, w) for v, w in own if v is not None]
        up = [(v, w) for v, w in known if w > 0]
        n = sum(w for _, w in up)
        want[k] = (sum(v * w for v, w in known) if known else None, sum(w for _, w in own), min((v for v, _ in up), default=None), max((v for v, _ in up), default=None), sum(v * w for v, w in up) // n if n else None)
    assert {r.k: (None if r.s is None else int(r.s), r.n, r.low, r.high, r["mean"]) for r in out.collect()} == want


def test_time(spark):
    deltas = spark.createDataFrame([(1, 5, 1, 0), (2, 6, 1, 1), (1, 5, -1, 2), (3, 7, 1, 2)], "k long, v long, _w long, epoch long")
    assert got(zset.integrate(deltas, upto=1)) == {(1, 5): 1, (2, 6): 1}
    assert got(zset.integrate(deltas)) == {(2, 6): 1, (3, 7): 1}
    assert got(zset.differentiate(deltas, 2)) == {(1, 5): -1, (3, 7): 1}
    assert got(zset.integrate(zset.delay(deltas), upto=2)) == got(zset.integrate(deltas, upto=1))
    summed = zset.consolidated(zset.union(*[zset.differentiate(deltas, e) for e in range(3)]))
    assert got(summed) == got(zset.integrate(deltas))


def test_rows(spark):
    assert sorted(map(tuple, zset.rows(made(spark, Counter({(1, 2): 3}))).collect())) == [(1, 2)] * 3
    with pytest.raises(PySparkException, match="negative weight"):
        zset.rows(made(spark, Counter({(1, 2): -1}))).collect()


@pytest.mark.parametrize("how", ["left", "right", "full"])
def test_outer_joins(spark, how):
    a, b = Counter({(1, 5): 2, (2, 6): -1}), Counter({(1, 7): -3, (3, 8): 1})
    out = zset.outer_join(made(spark, a), made(spark, b).withColumnRenamed("v", "v2"), ["k"], how)
    want = {(1, 5, 7): -6}
    want |= {(2, 6, None): -1} if how != "right" else {}
    want |= {(3, None, 8): 1} if how != "left" else {}
    assert got(out.select("k", "v", "v2", "_w")) == want


def test_windows_over_weighted_rows(spark):
    rng = random.Random(11)
    z = Counter({(rng.randint(0, 2), rng.randint(0, 5)): rng.randint(1, 3) for _ in range(14)})
    plain = [r for r, w in z.items() for _ in range(w)]
    frame = made(spark, z)
    for function in ("sum", "count", "min", "max", "rank", "dense_rank", "row_number"):
        found = zset.window(frame, function, "v", ("k",), (("v", "asc"),), "out")
        rows = Counter()
        for r in found.collect():
            rows[r.k, r.v, int(r.out)] += r._w
        want = Counter()
        for k, v in plain:
            own = sorted(y for x, y in plain if x == k)
            upto = [y for y in own if y <= v]
            value = {"sum": sum(upto), "count": len(upto), "min": min(upto), "max": max(upto), "rank": own.index(v) + 1, "dense_rank": len(set(upto))}.get(function)
            if function != "row_number":
                want[k, v, value] += 1
        if function == "row_number":
            for k in {k for k, _ in plain}:
                want.update((k, y, i + 1) for i, y in enumerate(sorted(y for x, y in plain if x == k)))
        assert rows == want, function
    with pytest.raises(PySparkException, match="NL0526"):
        zset.window(made(spark, Counter({(1, 1): -1})), "sum", "v", (), (("v", "asc"),)).collect()
