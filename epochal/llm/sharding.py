"""Contiguous shards of nearly equal bytes, cut from global prefix sums.

Documents are taken in order of (doc_id, size, CRC). A range shuffle of the
narrow rows (id, size, checksum, never the text) gives every partition one
stretch of that order; each partition sums its own stretch as it streams by,
and the totals of the partitions, one row each, give the offset at which each
stretch starts. A document goes to the shard whose equal share of all bytes
holds the document's middle, so a shard is off its target by one document at
most, and shards are contiguous in the order.

Defined results: the size of a document is its UTF-8 bytes plus one, a null
text has no bytes, and a null doc_id comes first. Rows alike in doc_id, size
and CRC are interchangeable. Equal texts are not kept together: the law is
``bytes``, and a group may hold more than a shard. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import mapped, pick, positional, written

ORDER = ("doc_id", "size", "text_crc32")


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes and rows that stand before each row in its partition."""
    done, rows = 0, 0
    for batch in batches:
        size = batch.column("size").to_numpy(zero_copy_only=False)
        before = done + np.cumsum(size) - size
        out = [*batch.columns, pa.array(before, pa.int64()), pa.array(np.arange(rows, rows + len(size)), pa.int64())]
        yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names, "bytes_before", "rows_before"])
        done, rows = done + int(size.sum()), rows + len(size)


def byte_shards(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = pick(docs, "doc_id", "text").select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    narrow = written(narrow)  # so that sampling for the ranges does not read the texts again
    part = narrow.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).withColumn("part", F.spark_partition_id())
    part = written(mapped(part, _running, part.schema.simpleString()[7:-1].replace(":", " ") + ", bytes_before long, rows_before long"))
    totals = part.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = totals.select("part", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_at"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_at"))
    total = part.agg(F.sum("size")).first()[0] or 1
    middle = (F.col("bytes_at") + F.col("bytes_before")) * 2 + F.col("size")
    wide = "decimal(38,0)"
    shard = F.least(F.floor(middle.cast(wide) * n_shards / F.lit(2 * total).cast(wide)).cast("int"), F.lit(n_shards - 1))
    placed = part.join(F.broadcast(offsets), "part").select(*ORDER, shard.alias("shard"), (F.col("rows_at") + F.col("rows_before")).alias("place"))
    starts = placed.groupBy("shard").agg(F.min("place").alias("start"))  # n_shards rows
    return placed.join(F.broadcast(starts), "shard").select(*ORDER, "shard", (F.col("place") - F.col("start")).alias("slot"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 8) -> None:
    """The documents with their shards, as a Parquet table partitioned by shard."""
    names = docs.columns
    key = f"c{names.index('doc_id')}"
    plan = written(byte_shards(docs, n_shards)).select(F.col("doc_id").alias("plan_id"), F.col("size").alias("plan_size"), F.col("text_crc32").alias("plan_crc"), "shard", "slot").dropDuplicates(["plan_id", "plan_size", "plan_crc"])
    text = F.coalesce(F.col(f"c{names.index('text')}"), F.lit(""))
    rows = positional(docs)
    rows = rows.join(plan, F.col(key).eqNullSafe(F.col("plan_id")) & ((F.octet_length(text) + 1) == F.col("plan_size")) & (F.crc32(text) == F.col("plan_crc")))
    shard, kept = F.col("shard").alias("shard"), [(i, n) for i, n in enumerate(names) if n.lower() != "shard"]
    rows.select(*[F.col(f"c{i}").alias(n) for i, n in kept], shard).repartition("shard", F.pmod("slot", F.lit(64))).write.partitionBy("shard").parquet(path)
