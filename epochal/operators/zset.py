"""Weighted sets: a DataFrame with a column _w that counts copies; negative weights are retractions.

Every function is a plan of built-in operators. Weights that cancel vanish only
on consolidation, one grouped sum over all columns with map-side combining;
functions that test for membership consolidate what they test.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.refusal import Refused
from .windows import spread, spread_row_number

W = "_w"


def columns(z: DataFrame) -> list[str]:
    return [c for c in z.columns if c != W]


def weighted(df: DataFrame) -> DataFrame:
    """Every row with weight 1."""
    return df if W in df.columns else df.withColumn(W, F.lit(1).cast("long"))


def consolidated(z: DataFrame) -> DataFrame:
    """One row for each distinct row, without those of weight zero."""
    return z.groupBy(*columns(z)).agg(F.sum(W).alias(W)).filter(F.col(W) != 0)


def rows(z: DataFrame) -> DataFrame:
    """Plain rows, each as often as its weight says; a negative weight fails the query."""
    z = consolidated(z)
    n = F.when(F.col(W) > 0, F.col(W)).otherwise(F.raise_error(F.lit("a row of negative weight is no row")).cast("long"))
    return z.withColumn(W, F.explode(F.sequence(F.lit(1).cast("long"), n))).drop(W)


def union(*sets: DataFrame) -> DataFrame:
    first, *rest = map(weighted, sets)
    return reduce(lambda a, b: a.union(b.select(*b.columns)), rest, first)


def negate(z: DataFrame) -> DataFrame:
    return weighted(z).withColumn(W, -F.col(W))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """a less b, without a floor: weights may be negative."""
    return consolidated(union(a, negate(b)))


def distinct(z: DataFrame) -> DataFrame:
    """Rows of positive weight, with weight 1."""
    return consolidated(weighted(z)).filter(F.col(W) > 0).withColumn(W, F.lit(1).cast("long"))


def except_(a: DataFrame, b: DataFrame) -> DataFrame:
    return distinct(union(distinct(a), negate(distinct(b))))


def select(z: DataFrame, *exprs: Column | str) -> DataFrame:
    return weighted(z).select(*exprs, W)


def where(z: DataFrame, predicate: Column | str) -> DataFrame:
    return weighted(z).filter(predicate)


def join(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Inner join on equal columns; weights multiply."""
    right = weighted(b).withColumnRenamed(W, "_w2")
    out = weighted(a).join(right, on)
    return out.withColumn(W, F.col(W) * F.col("_w2")).drop("_w2")


def outer_join(a: DataFrame, b: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Left, right or full join on equal columns; a row without partner keeps its weight and is null-extended.

    Partners are rows of any weight but zero.
    """
    left, right = consolidated(weighted(a)), consolidated(weighted(b)).withColumnRenamed(W, "_w2")
    out = left.join(right, on, how)
    return out.withColumn(W, F.coalesce(F.col(W), F.lit(1)) * F.coalesce(F.col("_w2"), F.lit(1))).drop("_w2")


def _present(b: DataFrame, on: list[str]) -> DataFrame:
    return weighted(b).groupBy(*on).agg(F.sum(W).alias(W)).filter(F.col(W) > 0).select(*on)


def semi(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Rows of a whose key has a positive total weight in b."""
    return weighted(a).join(_present(b, on), on, "left_semi")


def anti(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return weighted(a).join(_present(b, on), on, "left_anti")


def _matched(b: DataFrame, on: dict[str, str]) -> DataFrame:
    """The keys of positive total weight in b, under the outer names."""
    return _present(b.select(*[F.col(v).alias(k) for k, v in on.items()], W), list(on))


def exists(a: DataFrame, b: DataFrame, on: dict[str, str], negated: bool = False) -> DataFrame:
    """Rows of a, own weights, with (or without) present rows of b; on is outer to inner names."""
    return consolidated(weighted(a)).join(_matched(consolidated(weighted(b)), on), list(on), "left_anti" if negated else "left_semi")


def in_(a: DataFrame, probe: str, b: DataFrame, value: str, on: dict[str, str] | None = None) -> DataFrame:
    return exists(a, b, {**(on or {}), probe: value})


def not_in(a: DataFrame, probe: str, b: DataFrame, value: str, on: dict[str, str] | None = None) -> DataFrame:
    """Rows of a whose probe is known and is not among the present inner values, none of which is null."""
    rows, inner = weighted(a).filter(F.col(probe).isNotNull()), consolidated(weighted(b))
    nulls = inner.filter(F.col(value).isNull())
    if on:
        rows = exists(rows, nulls, on, negated=True)
    else:
        some = nulls.filter(F.col(W) > 0).agg(F.count(F.lit(1)).alias("_n"))
        rows = rows.join(F.broadcast(some)).filter("_n = 0").drop("_n")  # one row
    return exists(rows, inner, {**(on or {}), probe: value}, negated=True)


def scalar(a: DataFrame, b: DataFrame, on: dict[str, str], function: str, value: str, name: str) -> DataFrame:
    """a with an aggregate of its matching inner rows, null where there are none."""
    inner = weighted(b).select(*[F.col(v).alias(k) for k, v in on.items()], F.col(value).alias("_x"), W)
    grouped = aggregate(inner, list(on), **{name: (function, "_x")})
    return consolidated(weighted(a)).join(grouped, list(on), "left")


def aggregate(z: DataFrame, keys: list[str], **aggs: tuple[str, str]) -> DataFrame:
    """Grouped aggregates, name=(function, column): sum and count weigh, min, max and avg take rows of positive weight."""
    z, w = weighted(z), F.col(W)

    def one(function: str, column: str) -> Column:
        x = F.col(column)
        if function == "sum":
            return F.sum(x.cast("decimal(38,0)") * w.cast("decimal(19,0)")).cast("decimal(38,0)")
        if function == "count":
            return F.sum(w)
        x = F.when(w > 0, x)
        if function == "avg":
            total, n = F.sum(F.when(w > 0, x * w)), F.sum(F.when(x.isNotNull(), w))
            return F.when(n > 0, ((total - total % n) / n).cast("long"))
        return {"min": F.min, "max": F.max}[function](x)

    return consolidated(z).groupBy(*keys).agg(*[one(*f).alias(name) for name, f in aggs.items()])


def integrate(deltas: DataFrame, epoch: str = "epoch", upto: int | None = None) -> DataFrame:
    """The set that the deltas up to an epoch add up to."""
    deltas = weighted(deltas)
    deltas = deltas if upto is None else deltas.filter(F.col(epoch) <= upto)
    return consolidated(deltas.drop(epoch))


def differentiate(deltas: DataFrame, at: int, epoch: str = "epoch") -> DataFrame:
    """What changed at an epoch: the set there less the set one before."""
    return consolidated(weighted(deltas).filter(F.col(epoch) == at).drop(epoch))


def delay(deltas: DataFrame, by: int = 1, epoch: str = "epoch") -> DataFrame:
    """The same deltas, so many epochs later."""
    return deltas.withColumn(epoch, F.col(epoch) + by)


def window(z: DataFrame, function: str, x: str | None = None, partition: tuple[str, ...] = (), order: tuple[tuple[str, str], ...] = (), name: str | None = None) -> DataFrame:
    """z with a rank or a running aggregate over the copies that the weights stand for; a negative weight is refused.

    Copies of a row are peers, so they share their value and stay one weighted row; row_number, which tells them apart,
    gives rows of weight 1.
    """
    z = consolidated(weighted(z))
    checked = F.when(F.col(W) > 0, F.col(W)).otherwise(F.raise_error(F.lit("NL0526: a window over rows of negative weight")).cast("long"))
    z = z.withColumn(W, checked)
    name = name or function
    if function == "row_number":
        each = z.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(W)))).drop(W)
        return spread_row_number(each, partition, order, name).drop("_copy").withColumn(W, F.lit(1).cast("long"))
    if function in ("min", "max", "dense_rank"):
        return spread(z, function, x, partition, order, name).select(*columns(z), name, W)
    many = {"sum": F.col(x).cast("decimal(38,0)") * F.col(W).cast("decimal(19,0)") if x else None, "count": F.col(W), "rank": F.col(W)}
    if function not in many:
        raise Refused("NL0527", function)
    out = spread(z.withColumn("_x", many[function].cast("decimal(38,0)")), "sum", "_x", partition, order, name)
    if function == "rank":  # the copies ahead of this one's peers, and one more
        own = [*partition, *[c for c, _ in order]]
        peers = z.groupBy(*own).agg(F.sum(W).alias("_peers")).toDF(*[f"_k{i}" for i in range(len(own))], "_peers")
        same = [out[c].eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(own)]
        out = out.join(peers, same, "left").withColumn(name, F.col(name) - F.col("_peers") + 1)
    value = F.col(name).cast("long") if function != "sum" else F.col(name).cast("decimal(38,0)")
    return out.select(*columns(z), value.alias(name), W)
