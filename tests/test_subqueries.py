"""Correlated and plain subqueries over weighted rows, against a nested loop: 24 cases at two scales."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest

from epochal.operators import zset


def relations(k: int) -> dict[str, Counter]:
    """Blocks b of customers c = 100 b and orders o = 10 b, with retractions and nulls."""
    out = {n: Counter() for n in ("orders", "payments", "flags", "all_null", "empty")}
    for b in range(k):
        c, o = 100 * b, 10 * b
        for i, cust, amount, w in ((1, 10, 100, 1), (2, 10, 200, 1), (3, 20, 100, 2), (4, 20, None, 1), (5, 30, 300, 1), (6, 40, 400, 1), (7, 40, 999, 1), (8, 50, 500, 3), (9, 50, 500, -3)):
            out["orders"][o + i, c + cust, amount] += w
        for cust, amount, w in ((10, 100, 2), (10, 700, 1), (20, 100, 1), (40, None, 1), (40, 400, 1), (50, 500, 1), (60, 600, 1), (70, 700, 1), (70, 700, -1)):
            out["payments"][c + cust, amount] += w
        for cust, amount in ((10, 100), (20, 999), (40, 400)):
            out["flags"][c + cust, amount] += 1
        for cust in (10, 20, 40):
            out["all_null"][c + cust, None] += 1
    return out


def nested_loop(data, inner, kind, correlated, function=None):
    """What each outer row sees, one by one."""
    out = Counter()
    for row, w in data["orders"].items():
        _, cust, amount = row
        seen = [(a, x) for (c, a), x in data[inner].items() if x and (not correlated or c == cust)]
        if kind in ("exists", "not_exists"):
            keep = (sum(x for _, x in seen) > 0) == (kind == "exists")
            out[row] += w * keep
        elif kind == "in":
            out[row] += w * (amount is not None and sum(x for a, x in seen if a == amount) > 0)
        elif kind == "not_in":
            some_null = sum(x for a, x in seen if a is None) > 0
            out[row] += w * (amount is not None and not some_null and sum(x for a, x in seen if a == amount) <= 0)
        else:
            up = [a for a, x in seen if a is not None and x > 0]
            value = {"sum": lambda: sum(a * x for a, x in seen if a is not None) if any(a is not None for a, _ in seen) else None, "count": lambda: sum(x for _, x in seen), "max": lambda: max(up, default=None), "min": lambda: min(up, default=None)}[function]()
            out[*row, value if seen else None] += w
    return {r: w for r, w in out.items() if w}


CASES = [(kind, inner, True, None) for kind in ("exists", "not_exists") for inner in ("payments", "flags", "all_null", "empty")]
CASES += [("in", inner, correlated, None) for inner in ("payments", "flags") for correlated in (True, False)]
CASES += [("not_in", inner, correlated, None) for inner in ("payments", "flags", "all_null", "empty") for correlated in (True, False)]
CASES += [("scalar", "payments", True, f) for f in ("sum", "count", "max", "min")]


@pytest.fixture(scope="module", params=[1, 3])
def data(request, spark):
    rel = relations(request.param)
    schema = defaultdict(lambda: "cust long, amount long, _w long", orders="id long, cust long, amount long, _w long")
    return rel, {n: spark.createDataFrame([(*r, w) for r, w in z.items()], schema[n]) for n, z in rel.items()}


@pytest.mark.parametrize(("kind", "inner", "correlated", "function"), CASES)
def test_case(data, kind, inner, correlated, function):
    rows, frames = data
    on = {"cust": "cust"} if correlated else None
    o, i = frames["orders"], frames[inner]
    if kind in ("exists", "not_exists"):
        out = zset.exists(o, i, on, negated=kind == "not_exists")
    elif kind == "scalar":
        out = zset.scalar(o, i, on, function, "amount", "value")
    else:
        out = (zset.in_ if kind == "in" else zset.not_in)(o, "amount", i, "amount", on)
    columns = ["id", "cust", "amount", *(["value"] if kind == "scalar" else [])]
    got = Counter()
    for r in out.collect():
        got[tuple(None if r[c] is None else int(r[c]) for c in columns)] += r["_w"]
    assert {r: w for r, w in got.items() if w} == nested_loop(rows, inner, kind, correlated, function)
    if kind != "scalar":
        assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString() or not correlated
