"""Subquery operators as joins: exists, in, scalar, with SQL's treatment of null and, by name, the engine's own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import AGGREGATES


def _pairs(on: dict[str, str]) -> list[tuple[str, str]]:
    return list(on.items())


def _named(inner: DataFrame, names: list[str]) -> DataFrame:
    return inner.select([F.col(c).alias(f"_i{k}") for k, c in enumerate(names)])


def exists(outer: DataFrame, inner: DataFrame, on: dict[str, str], negated: bool = False) -> DataFrame:
    """Rows of outer with (or without) a row of inner on equal columns, outer name to inner name; null never matches."""
    right = _named(inner, [b for _, b in _pairs(on)])
    same = [outer[a] == right[f"_i{k}"] for k, (a, _) in enumerate(_pairs(on))]
    if not same:
        some = right.select(F.lit(1).alias("_one")).limit(1)
        found = some.agg(F.count(F.lit(1)).alias("_n"))
        out = outer.join(F.broadcast(found))  # one row
        return out.filter(F.col("_n") == 0 if negated else F.col("_n") > 0).drop("_n")
    return outer.join(right, same, "left_anti" if negated else "left_semi")


def in_(outer: DataFrame, probe: str, inner: DataFrame, value: str, on: dict[str, str] | None = None) -> DataFrame:
    """Rows of outer whose probe is among the inner values."""
    return exists(outer, inner, {**(on or {}), probe: value})


def not_in(outer: DataFrame, probe: str, inner: DataFrame, value: str, on: dict[str, str] | None = None, keep_null_probe: bool = True) -> DataFrame:
    """Rows of outer whose probe is certainly not among the inner values.

    A null among a row's inner values drops the row; a null probe is kept only
    where there are no inner values, and with keep_null_probe false (the engine's
    own rule) not even there.
    """
    on = on or {}
    outer = outer if keep_null_probe else outer.filter(F.col(probe).isNotNull())
    clean = exists(outer, inner.filter(F.col(value).isNull()), on, negated=True)
    clean = exists(clean, inner, {**on, probe: value}, negated=True)
    if not keep_null_probe:
        return clean
    empty = exists(clean.filter(F.col(probe).isNull()), inner, on, negated=True)
    return clean.filter(F.col(probe).isNotNull()).unionByName(empty)


def scalar(outer: DataFrame, inner: DataFrame, on: dict[str, str], function: str, value: str, name: str) -> DataFrame:
    """outer with one aggregate of its matching inner rows; null where there are none, whatever the aggregate."""
    if not on:
        rows = F.count(F.lit(1))
        one = inner.agg(F.when(rows > 0, AGGREGATES[function](value)).alias(name))
        return outer.join(F.broadcast(one))  # one row
    keys = [b for _, b in _pairs(on)]
    grouped = inner.groupBy(*keys).agg(AGGREGATES[function](value).alias(name))
    right = grouped.select([F.col(c).alias(f"_i{k}") for k, c in enumerate(keys)] + [name])
    same = [outer[a] == right[f"_i{k}"] for k, (a, _) in enumerate(_pairs(on))]
    return outer.join(right, same, "left").select(*[outer[c] for c in outer.columns], name)
