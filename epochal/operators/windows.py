"""Window functions that no single task has to hold: one partition key may own a third of all rows, or all of them.

Spark gives a window partition to one task. Here rows are first summed by peers
(partition and order keys), which combines before the shuffle; the peers are
dealt out by range of (partition, order), so a large partition spans many tasks;
each task runs along its own stretch; and the totals of the stretches, one row
for each partition key in each task, give what came before. The frame is the
engine's only one: from the start of the partition to the current row and its
peers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.refusal import Refused
from ..sources.storage import written

#: Sampled rows that make a stretch, stretches for each shuffle partition, and rows that a sample has at most.
CELL, CELLS, MOST = 25, 4, 100_000

#: For each function: how rows of a peer group, peer groups of a stretch, and stretches combine.
COMBINE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max, "rank": F.sum, "dense_rank": F.sum}


def _one(function: str, x: str | None) -> Column:
    if function in ("count", "rank"):
        return F.count(F.lit(1))
    if function == "dense_rank":
        return F.lit(1).cast("long")
    return F.sum(F.col(x).cast("decimal(38,0)")) if function == "sum" else {"min": F.min, "max": F.max}[function](x)


def _added(function: str, a: Column, b: Column) -> Column:
    """a and b combined; null is nothing."""
    if function in ("min", "max"):
        return (F.least if function == "min" else F.greatest)(a, b)
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)


def spread(df: DataFrame, function: str, x: str | None, partition: tuple[str, ...], order: tuple[tuple[str, str], ...], name: str) -> DataFrame:
    """df with the running value of a function; order is pairs of column and asc or desc, nulls first and last."""
    if function not in COMBINE:
        raise Refused("NL0527", function)
    keys = [*partition, *[c for c, _ in order]]
    sides = [F.col(c).asc() for c in partition] + [F.col(c).desc() if way == "desc" else F.col(c).asc() for c, way in order]
    own = [F.col(c).asc() if way == "asc" else F.col(c).desc() for c, way in order]
    peers = df.groupBy(*keys).agg(_one(function, x).alias("_one"))
    dealt = written(peers.repartitionByRange(*sides).withColumn("_part", F.spark_partition_id()))
    merge = COMBINE[function]
    totals = dealt.groupBy(*partition, "_part").agg(merge("_one").alias("_total"))
    earlier = Window.partitionBy(*partition).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*partition, "_part", merge("_total").over(earlier).alias("_before"))
    stretch = Window.partitionBy(*partition, "_part").orderBy(*own)
    local = dealt.withColumn("_local", merge("_one").over(stretch.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    same = [local[c].eqNullSafe(before[c]) for c in [*partition, "_part"]]
    run = local.join(before, same).select(*[local[c] for c in keys], "_one", _added(function, F.col("_before"), F.col("_local")).alias("_value"))
    if function == "rank":
        run = run.withColumn("_value", F.col("_value") - F.col("_one") + 1)
    elif function == "sum":
        run = run.withColumn("_value", F.col("_value").cast("decimal(38,0)"))
    run = run.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], F.col("_value").alias(name))
    return df.join(run, [df[c].eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)], "left").select(*df.columns, name)


def stretched(df: DataFrame, partition: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """df with _stretch, rising with the order (nulls last) in partitions that are large, null in the others; without it if none is.

    A sample says where stretches begin, and these places are written down: a row's stretch follows from its own values
    alone, in any plan, and peers share one. _common, if any is: the row's peers alone fill a stretch, to be summed before they are dealt.
    """
    at = F.struct(*[x.alias(f"_{i}{j}") for i, c in enumerate(order) for j, x in enumerate((F.col(c).isNull(), F.col(c)))])
    want = min(CELL * CELLS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), MOST)
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(partition)]
    some = df.select(*keys, at.alias("_at")).sample(min(1.0, want / max(1, df.count())), seed=1)
    places = some.groupBy(*some.columns[:-1]).agg(F.sort_array(F.collect_list("_at")).alias("_all")).filter(F.size("_all") >= 2 * CELL)
    cuts = written(places.select(*some.columns[:-1], F.filter("_all", lambda _, i: i % CELL == CELL - 1).alias("_cuts")))
    most, common = cuts.agg(F.max(F.size("_cuts")), F.max(F.size(F.array_distinct("_cuts")) < F.size("_cuts"))).first()
    if most is None:
        return df
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(most.bit_length()))])
    cut = lambda i: F.get("_cuts", i)
    up = lambda here: lambda i, step: F.when((i + step <= F.size("_cuts")) & (cut(i + step - 1) <= here), i + step).otherwise(i)
    end = lambda here: lambda i: F.struct(i.alias("_stretch"), F.coalesce((cut(i - 1) == here) & (cut(i - 2) == here), F.lit(False)).alias("_common"))
    found = F.transform(F.array(at), lambda here: F.aggregate(steps, F.lit(0), up(here), end(here)))  # a search for the cuts up to the row's place
    none = F.array(F.struct(F.lit(None).cast("int").alias("_stretch"), F.lit(False).alias("_common")))
    out = df.join(F.broadcast(cuts), [df[c].eqNullSafe(cuts[f"_k{i}"]) for i, c in enumerate(partition)], "left")
    out = out.select(*df.columns, F.inline(F.when(F.col("_cuts").isNotNull(), found).otherwise(none)))  # inlined, it runs once a row
    return out if common else out.drop("_common")


def spread_row_number(df: DataFrame, partition: tuple[str, ...], order: tuple[tuple[str, str], ...], name: str) -> DataFrame:
    """df with each row's number in its partition, ties in the order of all columns."""
    rest = [c for c in df.columns if c not in {*partition, *[c for c, _ in order]}]
    own = [F.col(c).desc() if way == "desc" else F.col(c).asc() for c, way in order] + [F.col(c).asc() for c in rest]
    dealt = written(df.repartitionByRange(*[F.col(c).asc() for c in partition], *own).withColumn("_part", F.spark_partition_id()))
    totals = dealt.groupBy(*partition, "_part").agg(F.count(F.lit(1)).alias("_total"))
    earlier = Window.partitionBy(*partition).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*partition, "_part", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    local = dealt.withColumn("_local", F.row_number().over(Window.partitionBy(*partition, "_part").orderBy(*own)))
    same = [local[c].eqNullSafe(before[c]) for c in [*partition, "_part"]]
    return local.join(before, same).select(*[local[c] for c in df.columns], (F.col("_before") + F.col("_local")).alias(name))


def spaced(points: DataFrame, key: str, at: str, distance: int) -> DataFrame:
    """Of each key's distinct points, the first, and then always the first that lies the distance or more beyond the last one taken.

    Each taken point depends on the one before, so a key's points pass by in order; only the last one taken is kept in mind.
    """
    rows = points.select(key, F.col(at).cast("long").alias(at)).repartition(key).sortWithinPartitions(key, at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last = object(), 0
        for batch in batches:
            keys, n = batch.column(0), len(batch)
            if not n:
                continue
            values = batch.column(1).to_numpy(zero_copy_only=False)
            change = np.r_[0, np.flatnonzero(pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)) + 1]
            taken: list[int] = []
            for low, high in zip(change.tolist(), [*change[1:].tolist(), n]):
                i, name = low, keys[low].as_py()
                if name == own:
                    i = low + int(np.searchsorted(values[low:high], last + distance))
                while i < high:
                    taken.append(i)
                    last = int(values[i])
                    i = i + int(np.searchsorted(values[i:high], last + distance))
                own = name
            yield batch.take(pa.array(taken, pa.int64()))

    return rows.filter(F.col(key).isNotNull()).mapInArrow(run, rows.schema)
