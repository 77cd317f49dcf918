"""The engine's views about itself: work by view and kind, what rebuilding cost, and what happened at an epoch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import total


def work_by_view(events: DataFrame) -> DataFrame:
    """The work of engine events (view_name, kind, work) by view and kind."""
    return events.groupBy("view_name", "kind").agg(total(events, "work").alias("work"))


def reconstruction_cost(upqueries: DataFrame) -> DataFrame:
    """Base rows that rebuilding read (view_name, node, base_rows), by view and node."""
    return upqueries.groupBy("view_name", "node").agg(total(upqueries, "base_rows").alias("base_rows"))


def audit_trail(events: DataFrame, epoch: int | None = None) -> DataFrame:
    """Events by the epoch they happened at, up to one."""
    rows = events if epoch is None else events.filter(F.col("at_epoch") <= epoch)
    return rows.groupBy("at_epoch").agg(F.count(F.lit(1)).alias("n"))
