"""Aggregates in the engine's own sense, beside Spark's.

count_rows counts every row, whatever its argument; avg_int is the whole part of
sum over count; sums stay exact and fail on overflow.

A sum of whole numbers is kept as four sums of 16-bit limbs, which are longs that
generated code adds up, and put together as a 38-digit decimal once for each
group: about three times as fast as adding decimals, and exact for 2^47 rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .values import WIDE, column

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def sum_exact(x) -> Column:
    return F.sum(column(x).cast(WIDE))


def sum_limbs(x, over: Callable[[Column], Column] = lambda c: c) -> Column:
    """The exact sum of a whole number, null over nothing; over is applied to each of its aggregates."""
    x = column(x).cast("long")
    low = [over(F.sum(F.shiftright(x, 16 * i).bitwiseAND(F.lit(0xFFFF)) if i else x.bitwiseAND(F.lit(0xFFFF)))) for i in range(3)]
    out = over(F.sum(F.shiftright(x, 48))).cast(WIDE)
    for limb in reversed(low):
        out = (out * F.lit(65536).cast("decimal(5,0)") + limb.cast(WIDE)).cast(WIDE)
    return out


def total(df: DataFrame, x, over: Callable[[Column], Column] = lambda c: c) -> Column:
    """The exact sum of x over rows of df, by limbs if x is a whole column."""
    kind = next((f.dataType for f in df.schema.fields if f.name == x), None) if isinstance(x, str) else None
    return sum_limbs(x, over) if isinstance(kind, WHOLE) else over(sum_exact(x))


def count_rows(_=None) -> Column:
    return F.count(F.lit(1))


def avg_int(x) -> Column:
    total_, n = F.sum(column(x).cast("long")), F.count(column(x))
    return F.when(n > 0, ((total_ - total_ % F.greatest(n, F.lit(1))) / F.greatest(n, F.lit(1))).cast("long"))


AGGREGATES = {"sum": sum_exact, "count": count_rows, "min": lambda x: F.min(column(x)), "max": lambda x: F.max(column(x)), "avg": avg_int}
#: Aggregates whose value over a whole is the sum of the values over its parts.
ADDITIVE = frozenset({"sum", "count"})
