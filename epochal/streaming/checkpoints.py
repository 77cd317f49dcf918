"""Per-key checkpoints: each key's running totals after every so many of its rows.

A checkpoint names the place of its last row, epoch and order columns, beside the
totals. A read of one key at an epoch then takes the newest checkpoint up to it
and the rows behind that place, fewer than ``every`` and their peers, however long
the key's history is: a comparison of places picks them, nothing is numbered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import WIDE
from ..operators.windows import stretched


def checkpoints(base: DataFrame, keys: tuple[str, ...], value: str, every: int, epoch: str = "epoch", order: tuple[str, ...] = (), parted: bool = False) -> DataFrame:
    """keys, epoch, order columns, n and total after each ``every`` rows of a key, in the order of epoch and ``order``, nulls last.

    Rows that are equal in these are peers and are not parted: a checkpoint stands behind the last of them, as reads need
    it. ``parted``: it stands after just so many rows, among peers too; they must be equal in the value, so name it in ``order``.

    The rows pass one shuffle, narrow, and nothing else is kept of them. A key with many rows is dealt in stretches, so
    one with a third of all rows is no task's work alone; what came before a stretch is a sum over the base.
    """
    if every < 1:
        raise ValueError("a checkpoint interval is 1 or more")
    place = (epoch, *order)
    if parted and value not in place:
        raise ValueError("peers are parted only where the order has the value")
    dealt = stretched(base.select(*dict.fromkeys((*keys, *place, value))), keys, place)
    large, common = "_stretch" in dealt.columns, "_common" in dealt.columns
    by = (*keys, "_stretch") if large else keys
    amount, one = F.col(value).cast(WIDE), F.lit(1).cast("long")
    rows = dealt
    if common:
        few = dealt.filter("_common").groupBy(*by, *place).agg(F.sum(amount).alias("_sum"), F.count(F.lit(1)).alias("_own"))
        rows = dealt.filter("not _common").select(*by, *place, amount.alias("_sum"), one.alias("_own")).unionByName(few)
        amount, one = F.col("_sum"), F.col("_own")
    at = Window.partitionBy(*by).orderBy(*[F.col(c).asc_nulls_last() for c in place])  # the frame has all peers
    run = rows.repartition(*by).select(
        *by, *place, one.alias("_one"), F.sum(one).over(at).alias("n"), F.sum(amount).over(at).alias("total"), F.row_number().over(at).alias("_row"), F.rank().over(at).alias("_rank"), F.count(F.lit(1)).over(at).alias("_rows")
    )
    run = run.filter("_row = _rows").withColumn("_before", F.expr("n - _one * (_rows - _rank + 1)"))  # the last of its peers, and rows before them
    if large:
        sums = dealt.filter("_stretch is not null").groupBy(*by).agg(F.sum(F.col(value).cast(WIDE)).alias("_sum"), F.count(F.lit(1)).alias("_n"))
        earlier = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
        past = sums.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.sum("_sum").over(earlier).alias("_sum"), F.sum("_n").over(earlier).alias("_n"))
        run = run.join(F.broadcast(past), [run[c].eqNullSafe(past[f"_k{i}"]) for i, c in enumerate(by)], "left")
        add = lambda x, more: F.coalesce(F.col(x) + F.col(more), F.col(x), F.col(more)).alias(x)
        run = run.select(*keys, *place, add("n", "_n"), add("_before", "_n"), add("total", "_sum"))
    run = run.filter(f"n div {every} > _before div {every}")
    if parted:
        run = run.withColumn("_at", F.explode(F.expr(f"sequence((_before div {every} + 1) * {every}, n div {every} * {every}, {every}L)")))
        total = F.col("total") - F.coalesce(F.col(value).cast(WIDE) * (F.col("n") - F.col("_at")), F.lit(0))
        run = run.withColumns({"n": F.col("_at"), "total": total})
    return run.select(*keys, *place, "n", F.col("total").cast(WIDE).alias("total"))


def _behind(place: tuple[str, ...], last: str) -> Column:
    """Whether a row's place lies behind the one in the struct ``last``; nulls come last."""
    out, same = F.lit(False), F.lit(True)
    for c in place:
        a, b = F.col(c), F.col(f"{last}.{c}")
        later = F.coalesce(a > b, a.isNull() & b.isNotNull())
        out = out | (same & later)
        same = same & a.eqNullSafe(b)
    return out


def rebuilt(base: DataFrame, held: DataFrame, keys: tuple[str, ...], value: str, anchor: int, epoch: str = "epoch", order: tuple[str, ...] = ()) -> DataFrame:
    """Every key's total at an epoch, from its newest checkpoint up to it and the rows since; suffix says how many those were.

    For some keys only, filter both frames: the filter reaches their scans.
    """
    place = (epoch, *order)
    newest = held.filter(F.col(epoch) <= anchor).groupBy(*keys).agg(F.max(F.struct("n", *place, "total")).alias("_at"))
    rows = base.filter(F.col(epoch) <= anchor).join(newest, [*keys], "left").filter(F.col("_at").isNull() | _behind(place, "_at"))
    suffix = rows.groupBy(*keys).agg(F.sum(F.col(value).cast(WIDE)).alias("_sum"), F.count(F.lit(1)).alias("_rows"))
    out = newest.select(*keys, F.col("_at.total").alias("_sum"), F.lit(0).cast("long").alias("_rows")).unionByName(suffix)
    return out.groupBy(*keys).agg(F.sum("_sum").cast(WIDE).alias("total"), F.sum("_rows").alias("suffix"))


def point(base: DataFrame, held: DataFrame, key: dict, value: str, anchor: int, epoch: str = "epoch", order: tuple[str, ...] = ()) -> DataFrame:
    """One key's total at an epoch: its newest checkpoint, then the rows of the key from that epoch on.

    The key and the epoch are values in the scan's filter, so a base in key order opens little else.
    """
    for c, v in key.items():
        base, held = (df.filter(F.col(c).eqNullSafe(F.lit(v))) for df in (base, held))
    last = held.filter(F.col(epoch) <= anchor).agg(F.max(F.struct("n", epoch)).alias("at")).first().at  # one row
    rows = base if last is None else base.filter(F.col(epoch) >= last[epoch])
    near = held if last is None else held.filter(F.col("n") == last.n)
    return rebuilt(rows, near, tuple(key), value, anchor, epoch, order)
