"""Incrementally maintained views: grouped sums and counts over an append-only base.

State is a sequence of Parquet increments below a folder, named by the epochs they
cover. Applying an epoch writes the grouped delta, in proportion to the delta and
not to the state; every ``compact_every`` increments, and at every checkpoint, the
state is summed into one. A name is taken once, so an epoch that comes twice, as
after a restart, changes nothing.

A key that ever had a row is present, at zero too; a key without rows is absent.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.aggregates import total
from ..functions.values import WIDE
from ..operators.zset import W
from ..plans.contracts import Contract, Rung
from ..plans.refusal import Refused
from ..sources import storage


@dataclass
class View:
    """sums: output name to summed column. updates counts the base rows of a key. relation names the base in a catalog."""

    spark: SparkSession
    root: str
    keys: tuple[str, ...]
    sums: dict[str, str]
    contract: Contract = Contract()
    epoch: str = "epoch"
    compact_every: int = 16
    checkpoint_every: int = 0
    relation: str | None = None
    _schema: StructType | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        self.contract.checked()

    # --- state ---

    def fold(self, rows: DataFrame) -> DataFrame:
        """Base rows, summed by key; weighted rows, such as changes, count as often as their weight says."""
        if W in rows.columns:
            sums = [F.sum(F.col(c).cast(WIDE) * F.col(W).cast("decimal(19,0)")).cast(WIDE).alias(n) for n, c in self.sums.items()]
            return rows.groupBy(*self.keys).agg(*sums, F.sum(W).alias("updates"))
        totals = [total(rows, c).alias(n) for n, c in self.sums.items()]
        return rows.groupBy(*self.keys).agg(*totals, F.count(F.lit(1)).alias("updates"))

    def merge(self, *parts: DataFrame) -> DataFrame:
        """States over disjoint rows, as one; a single one has each key once already."""
        if len(parts) == 1:
            return parts[0]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        totals = [F.sum(n).cast("decimal(38,0)").alias(n) for n in self.sums]
        return out.groupBy(*self.keys).agg(*totals, F.sum("updates").alias("updates"))

    def _parts(self, kind: str) -> list[tuple[int, int, str]]:
        """(first epoch, last epoch, path) of the written parts, by place."""
        out = []
        for name in storage.names(self.spark, f"{self.root}/{kind}"):
            if "-" in name and not name.startswith(("_", ".")):
                low, high = name.split("-")
                out.append((int(low), int(high), f"{self.root}/{kind}/{name}"))
        return sorted(out)

    def _write(self, df: DataFrame, kind: str, low: int, high: int) -> None:
        staged, name = f"{self.root}/_staged/{kind}-{low}-{high}", f"{self.root}/{kind}/{low:012d}-{high:012d}"
        storage.removed(self.spark, staged)
        df.write.parquet(staged)
        if storage.exists(self.spark, name):
            storage.removed(self.spark, staged)
        else:
            storage.moved(self.spark, staged, name)

    def _read(self, path: str) -> DataFrame:
        """A written part; footers are looked into once for all parts."""
        if self._schema is None:
            self._schema = self.spark.read.parquet(path).schema
        return self.spark.read.schema(self._schema).parquet(path)

    def _current(self) -> list[tuple[int, int, str]]:
        """The fewest parts that cover all applied epochs: of parts from one epoch on, the longest."""
        longest: dict[int, tuple[int, int, str]] = {}
        for low, high, path in self._parts("state"):
            if low not in longest or high > longest[low][1]:
                longest[low] = (low, high, path)
        out, done = [], -1
        for low, high, path in sorted(longest.values()):
            if low > done or not out:
                if high > done:
                    out.append((low, high, path))
                    done = high
        return out

    def applied(self) -> int:
        """The epoch through which deltas are applied; -1 before the first."""
        return max((high for _, high, _ in self._current()), default=-1)

    # --- maintenance ---

    def apply(self, delta: DataFrame, epoch: int) -> bool:
        """Apply the rows of an epoch once; whether there was anything to do."""
        done = self.applied()
        if epoch <= done:
            return False
        self._write(self.fold(delta), "state", done + 1, epoch)
        parts = self._current()
        checkpoint = self.checkpoint_every and (epoch + 1) // self.checkpoint_every > (done + 1) // self.checkpoint_every
        if len(parts) >= self.compact_every or checkpoint:
            state = self.merge(*[self._read(p) for _, _, p in parts])
            self._write(state, "state", parts[0][0], epoch)
            if checkpoint:
                self._write(self._read(f"{self.root}/state/{parts[0][0]:012d}-{epoch:012d}"), "checkpoint", 0, epoch)
        return True

    def maintain(self, base: DataFrame, head: int) -> bool:
        """Bring the view up to the head, once its contract's stride is due."""
        done = self.applied()
        if head - done < self.contract.stride():
            return False
        return self.apply(base.filter((F.col(self.epoch) > done) & (F.col(self.epoch) <= head)), head)

    def attach(self, stream: DataFrame, checkpoint: str, epoch_of: Callable[[int], int] = lambda batch: batch):
        """A started streaming query that applies each micro-batch as one epoch, once."""
        return (
            stream.writeStream.option("checkpointLocation", checkpoint)
            .foreachBatch(lambda df, batch: self.apply(df, epoch_of(batch)) and None)
            .trigger(availableNow=True)
            .start()
        )

    def backfill(self, base: DataFrame, upto: int) -> bool:
        """Apply everything up to an epoch at once, whatever the stride."""
        done = self.applied()
        return self.apply(base.filter((F.col(self.epoch) > done) & (F.col(self.epoch) <= upto)), upto)

    def emit(self, path: str) -> bool:
        """Write the state to a sink below its anchor, once; whether it was new."""
        at = f"{path}/anchor={self.applied()}"
        if storage.exists(self.spark, at):
            return False
        staged = f"{path}/_staged-{self.applied()}"
        storage.removed(self.spark, staged)
        self.state().write.parquet(staged)
        storage.moved(self.spark, staged, at)
        return True

    # --- reads ---

    def state(self) -> DataFrame:
        """The maintained rows, as of the applied epoch."""
        parts = self._current()
        if not parts:
            raise Refused("NL0500", "no epoch is applied yet")
        return self.merge(*[self._read(p) for _, _, p in parts])

    def reconstruct(self, base: DataFrame, anchor: int) -> DataFrame:
        """The view at an epoch: the newest checkpoint up to it and the base rows since."""
        held = [(high, path) for _, high, path in self._parts("checkpoint") if high <= anchor]
        since, path = max(held, default=(-1, None))
        suffix = self.fold(base.filter((F.col(self.epoch) > since) & (F.col(self.epoch) <= anchor)))
        return self.merge(self._read(path), suffix) if path else suffix

    def read(self, base: DataFrame, anchor: int, key: dict | None = None) -> tuple[DataFrame, str]:
        """The rows at an epoch, and how they were had: view, or reconstruction."""
        hit = self.applied() == anchor
        rows = self.state() if hit else self.reconstruct(base, anchor)
        for name, value in (key or {}).items():
            rows = rows.filter(F.col(name).eqNullSafe(F.lit(value)))
        return rows, "view" if hit else "reconstruction"

    def anchor_for(self, head: int, session: int = -1, wrote: int = -1, pinned: int | None = None) -> int:
        """The epoch that a read at the contract's rung is answered at.

        session is the newest epoch that the session has seen, wrote the newest it has written, pinned the anchor of the
        read set it is in. bounded: what is applied, if that lies within the bound, or else the oldest epoch that does.
        monotonic: nothing older than seen. read your writes: nothing older than written. snapshot and serializable:
        the read set's anchor, or without one the head. ledger-consistent: the head, in a read set too.
        """
        rung, done = self.contract.consistency, self.applied()
        if rung is Rung.BOUNDED:
            return max(done, head - self.contract.bound_epochs, session)
        if rung is Rung.MONOTONIC:
            return max(done, session)
        if rung is Rung.READ_YOUR_WRITES:
            return max(done, wrote)
        if rung in (Rung.SNAPSHOT, Rung.SERIALIZABLE) and pinned is not None:
            return pinned
        return head

    def counted(self) -> tuple[int, int]:
        """Written parts that cover the state, and checkpoints."""
        return len(self._current()), len(self._parts("checkpoint"))

    # --- lineage ---

    def reproduce(self, base: DataFrame) -> DataFrame:
        """Keys whose maintained row is not what the base gives; empty if all is well."""
        now = self.state()
        full = self.fold(base.filter(F.col(self.epoch) <= self.applied()))
        return now.exceptAll(full).unionByName(full.exceptAll(now))

    def impact(self, rows: DataFrame) -> DataFrame:
        """The keys that rows of the base contribute to."""
        return rows.select(*self.keys).distinct()
