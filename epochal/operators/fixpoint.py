"""Least fixpoints over sets, semi-naive.

Each round applies the step to the rows that the last round found, drops what is
known by an anti join, and writes the rest to the shared folder. What is known is
kept in parts: two parts of like size are written together as one, so
after n rounds there are some log2(n) of them, each row is written log2(n) times at
most, and no round opens the files of all earlier ones. No lineage grows, and a
lost executor costs one round. Only the count of a round comes to the driver, and
the job that writes the round counts it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..plans.refusal import NonTerminating, Refused
from ..sources.storage import shared_dir

#: Rows in a file of a merged part, about.
ROWS_OF_A_FILE = 4_000_000


def fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame], measure: int | None = 1, max_rounds: int = 1000) -> DataFrame:
    """The smallest set that holds seed and what step makes of it.

    step must distribute over unions, as joins, filters and projections do: it
    gets only the newest rows. measure is the guard: how many new rows every round
    finds at least until it finds none. The set is complete when a round finds
    nothing new; a round that finds fewer than the measure breaks the guard, and
    so does the last of max_rounds if it still finds some.
    """
    if measure is None:
        raise Refused("NL0400")
    if not isinstance(measure, int) or measure < 1:
        raise Refused("NL0507", str(measure))
    if not callable(step):
        raise Refused("NL0513")
    if max_rounds < 1:
        raise Refused("NL0528", str(max_rounds))
    spark, names, folder = seed.sparkSession, seed.columns, shared_dir(seed.sparkSession)

    def read(*paths: str) -> DataFrame:
        return spark.read.schema(seed.schema).parquet(*paths)

    def kept(df: DataFrame, name: str) -> tuple[str, int]:
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{folder}/{name}")
        return f"{folder}/{name}", seen.get["rows"]

    parts = [kept(seed.distinct(), "round=0")]  # path and rows, larger ones first
    fresh, found = read(parts[0][0]), parts[0][1]
    tail = [found]
    for number in range(1, max_rounds + 1):
        made = step(fresh)
        if len(made.columns) != len(names):
            raise Refused("NL0514", f"{made.columns} for {names}")
        made = made.toDF(*names)
        made = made.select([made[c].cast(seed.schema[c].dataType).alias(c) for c in names]).distinct()
        known = read(*[path for path, _ in parts])
        same = [made[c].eqNullSafe(known[c]) for c in names]
        path, found = kept(made.join(known, same, "left_anti"), f"round={number}")
        if not found:
            return known
        tail.append(found)
        if found < measure:
            raise NonTerminating(number, tail[-4:], f"a round found {found} new rows where the guard promises {measure}")
        fresh = read(path)
        parts.append((path, found))
        while len(parts) > 1 and parts[-2][1] < 2 * parts[-1][1] and len(parts) > 4:
            (a, n), (b, m) = parts[-2:]
            read(a, b).coalesce(max(1, (n + m) // ROWS_OF_A_FILE)).write.parquet(f"{folder}/merged={number}-{len(parts)}")
            parts[-2:] = [(f"{folder}/merged={number}-{len(parts)}", n + m)]
    raise NonTerminating(max_rounds, tail[-4:])
