"""The pipeline: lazy stages over a DataFrame, with the tree of operators beside it.

Stages build Catalyst plans and nothing runs until an action. The tree carries
what Catalyst does not know: keys, incrementality, conservation, pins.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import AGGREGATES, total
from ..functions.values import column, parse_date
from ..plans.catalyst import check_confidential
from ..plans.nodes import Node
from ..plans.refusal import Refused
from . import fixpoint as _fixpoint
from . import subquery as _subquery
from . import windows as _windows

WINDOW_FUNCTIONS = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}


def everything(df: DataFrame) -> list[Column]:
    """All columns in order, which makes any order total up to equal rows."""
    return [F.col(f"`{c}`").asc_nulls_first() for c in df.columns]


def _keys(order: tuple) -> list[Column]:
    return [column(k) for k in order]


@dataclass(frozen=True)
class Rel:
    """A relation: its rows, its operator tree, the order to present it in, and its time columns."""

    df: DataFrame
    node: Node
    order: tuple = ()
    epoch: str | None = None
    valid: str | None = None

    @classmethod
    def source(cls, df: DataFrame, name: str, key: tuple[str, ...] = (), base: bool = True, epoch: str | None = None, valid: str | None = None) -> Rel:
        return cls(df, Node("source", relation=name, key=key, base=base), (), epoch, valid)

    def _next(self, df: DataFrame, kind: str, *others: Rel, **more) -> Rel:
        check_confidential(df)
        order = self.order if kind in ("filter", "as_of", "valid_at", "distinct") else ()
        time = {k: v for k, v in (("epoch", self.epoch), ("valid", self.valid)) if v in df.columns}
        return Rel(df, Node(kind, (self.node, *[o.node for o in others]), **more), order, **time)

    # --- rows ---

    def where(self, predicate: Column | str) -> Rel:
        """Rows for which the predicate is true; unknown counts as false."""
        return self._next(self.df.filter(predicate), "filter")

    filter = having = where

    def map(self, *exprs) -> Rel:
        """New columns c0, c1, ..."""
        return self._next(self.df.select(*[column(e).alias(f"c{i}") for i, e in enumerate(exprs)]), "map")

    def select(self, *exprs) -> Rel:
        """Columns under their own names."""
        return self._next(self.df.select(*[column(e) for e in exprs]), "map")

    def index(self, *key: str) -> Rel:
        """The same rows, found by another key."""
        return self._next(self.df, "index", key=key)

    def get(self, *values) -> Rel:
        """Rows of one key."""
        key = self._key()
        if len(values) != len(key):
            raise Refused("NL0500", f"{len(key)} key values are needed")
        same = [F.col(k).eqNullSafe(F.lit(v)) for k, v in zip(key, values)]
        return self.where(_all(same))

    def range(self, low, high) -> Rel:
        """Rows whose first key column lies between two values, both included; None is open."""
        first = F.col(self._key()[0])
        bounds = [first >= low] * (low is not None) + [first <= high] * (high is not None)
        return self.where(_all(bounds)) if bounds else self

    def _key(self) -> tuple[str, ...]:
        key = self.node.output_key()
        if not key:
            raise Refused("NL0503")
        return key

    # --- aggregation ---

    def group_by(self, *keys: str) -> Grouped:
        for k in keys:
            if isinstance(k, str) and k not in self.df.columns:
                raise Refused("NL0509", k)
        return Grouped(self, keys)

    def sum(self, x, name: str = "sum") -> Rel:
        return Grouped(self, ()).agg(**{name: ("sum", x)})

    def count(self, x=None, name: str = "count") -> Rel:
        return Grouped(self, ()).agg(**{name: ("count", x)})

    def min(self, x, name: str = "min") -> Rel:
        return Grouped(self, ()).agg(**{name: ("min", x)})

    def max(self, x, name: str = "max") -> Rel:
        return Grouped(self, ()).agg(**{name: ("max", x)})

    def avg(self, x, name: str = "avg") -> Rel:
        return Grouped(self, ()).agg(**{name: ("avg", x)})

    # --- joins ---

    def join(self, other: Rel, on=None, residual: Column | None = None, how: str = "inner") -> Rel:
        """Equi-join on pairs of columns, or on the two sides' keys; residual is a further condition.

        on: a list of names that both sides have, or a dict from left to right names.
        Both sides keep all columns; right ones that clash get the suffix _r.
        """
        if on is None:
            mine, theirs = self._key(), other._key()
            if len(mine) != len(theirs):
                raise Refused("NL0519", f"{mine} and {theirs}")
            on = dict(zip(mine, theirs))
        on = on if isinstance(on, dict) else {c: c for c in on}
        for side, names in ((self, on), (other, on.values())):
            for c in names:
                if c not in side.df.columns:
                    raise Refused("NL0520", c)
        renamed = {c: f"{c}_r" if c in self.df.columns else c for c in other.df.columns}
        right = other.df.toDF(*renamed.values())
        same = [self.df[a] == right[renamed[b]] for a, b in on.items()]
        condition = _all([*same, *([residual] if residual is not None else [])]) if same or residual is not None else None
        spark_how = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti", "cross": "cross"}[how]
        out = self.df.crossJoin(right) if condition is None else self.df.join(right, condition, "inner" if how == "cross" else spark_how)
        return self._next(out, "join", other, how=how, key=tuple(on))

    def left_join(self, other, on=None, residual=None) -> Rel:
        return self.join(other, on, residual, "left")

    def right_join(self, other, on=None, residual=None) -> Rel:
        return self.join(other, on, residual, "right")

    def full_outer_join(self, other, on=None, residual=None) -> Rel:
        return self.join(other, on, residual, "full")

    def semi_join(self, other, on=None, residual=None) -> Rel:
        return self.join(other, on, residual, "semi")

    def anti_join(self, other, on=None, residual=None) -> Rel:
        return self.join(other, on, residual, "anti")

    def cross_join(self, other: Rel) -> Rel:
        return self.join(other, {}, None, "cross")

    def theta_join(self, other: Rel, condition: Column, how: str = "inner") -> Rel:
        """A join on any condition over both sides' columns, right ones that clash with the suffix _r."""
        return self.join(other, {}, condition, how)

    # --- subqueries ---

    def exists(self, inner: Rel, on: dict[str, str]) -> Rel:
        return self._next(_subquery.exists(self.df, inner.df, on), "join", inner, how="semi", key=tuple(on))

    def not_exists(self, inner: Rel, on: dict[str, str]) -> Rel:
        return self._next(_subquery.exists(self.df, inner.df, on, negated=True), "join", inner, how="anti", key=tuple(on))

    def in_(self, probe: str, inner: Rel, value: str, on: dict[str, str] | None = None) -> Rel:
        return self._next(_subquery.in_(self.df, probe, inner.df, value, on), "join", inner, how="semi", key=(probe,))

    def not_in(self, probe: str, inner: Rel, value: str, on: dict[str, str] | None = None) -> Rel:
        """The engine's own rule: a null probe is never kept."""
        return self._next(_subquery.not_in(self.df, probe, inner.df, value, on, keep_null_probe=False), "join", inner, how="anti", key=(probe,))

    def scalar(self, inner: Rel, on: dict[str, str], function: str, value: str, name: str) -> Rel:
        """One aggregate of the matching inner rows, of all of them without ``on``; null where there are none."""
        return self._next(_subquery.scalar(self.df, inner.df, on, function, value, name), "join", inner, how="left", key=tuple(on))

    # --- sets ---

    def _same_width(self, other: Rel) -> None:
        if len(self.df.columns) != len(other.df.columns):
            raise Refused("NL0512", f"{len(self.df.columns)} and {len(other.df.columns)}")

    def union_all(self, other: Rel) -> Rel:
        self._same_width(other)
        return self._next(self.df.union(other.df), "union", other)

    def union(self, other: Rel) -> Rel:
        return self.union_all(other).distinct()

    def except_(self, other: Rel) -> Rel:
        self._same_width(other)
        return self._next(self.df.subtract(other.df), "except", other)

    def intersect(self, other: Rel) -> Rel:
        """Distinct rows that both sides have."""
        self._same_width(other)
        return self._next(self.df.intersect(other.df), "intersect", other)

    def intersect_by_key(self, other: Rel) -> Rel:
        """Distinct rows whose key the other side has too."""
        return self.semi_join(other).distinct()

    def distinct(self) -> Rel:
        return self._next(self.df.distinct(), "distinct")

    def distinct_by(self, *keys: str) -> Rel:
        """One row for each key: the first in the order of all columns."""
        rest = [c for c in self.df.columns if c not in keys]
        if not rest:
            return self.distinct()
        first = F.min(F.struct(*rest)).alias("_first")
        picked = self.df.groupBy(*keys).agg(first).select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in self.df.columns])
        return self._next(picked, "distinct")

    # --- order ---

    def order_by(self, *keys) -> Rel:
        """Presentation order, and the order in which limit takes rows."""
        for k in keys:
            if isinstance(k, str) and k not in self.df.columns:
                raise Refused("NL0509", k)
        out = self._next(self.df, "order_by")
        return Rel(out.df, out.node, keys, out.epoch, out.valid)

    def limit(self, count: int, offset: int = 0) -> Rel:
        """So many rows in the order of the keys, then of all columns."""
        if not isinstance(count, int) or not isinstance(offset, int) or count < 0 or offset < 0:
            raise Refused("NL0504", f"{count}, {offset}")
        rows = self.df.orderBy(*_keys(self.order), *everything(self.df))
        rows = rows.offset(offset) if offset else rows
        out = self._next(rows.limit(count), "limit")
        return Rel(out.df, out.node, self.order, out.epoch, out.valid)

    def offset(self, offset: int) -> Rel:
        if not isinstance(offset, int) or offset < 0:
            raise Refused("NL0504", str(offset))
        out = self._next(self.df.orderBy(*_keys(self.order), *everything(self.df)).offset(offset), "limit")
        return Rel(out.df, out.node, self.order, out.epoch, out.valid)

    def presented(self) -> DataFrame:
        """The rows in their presentation order."""
        return self.df.orderBy(*_keys(self.order), *everything(self.df)) if self.order else self.df

    # --- windows ---

    def spread_window(self, function: str, x: str | None = None, partition: tuple[str, ...] = (), order: tuple[tuple[str, str], ...] = (), name: str | None = None) -> Rel:
        """window() for partitions that no task can hold; order is pairs of column and asc or desc."""
        if function == "row_number":
            out = _windows.spread_row_number(self.df, partition, order, name or function)
        else:
            out = _windows.spread(self.df, function, x, partition, order, name or function)
        return self._next(out, "window")

    def sized_window(self, function: str, x: str | None = None, partition: tuple[str, ...] = (), order: tuple[tuple[str, str], ...] = (), name: str | None = None, limit: int = 4_000_000) -> Rel:
        """window(), or spread_window() if a partition has more rows than the limit: the partitions are counted first, by a grouped count."""
        largest = self.df.groupBy(*partition).count().agg(F.max("count")).first()[0] or 0
        if largest > limit and order:
            return self.spread_window(function, x, partition, order, name)
        return self.window(function, x, partition, tuple(F.desc(c) if way == "desc" else F.asc(c) for c, way in order), name)

    def window(self, function: str, x=None, partition: tuple[str, ...] = (), order: tuple = (), name: str | None = None) -> Rel:
        """One more column: a rank, or an aggregate over the rows up to the current one and its peers.

        Rows of row_number that tie are numbered in the order of all columns.
        Without an order an aggregate covers the partition. A partition is one
        task's work; for very large ones there is spread_window(), and
        sized_window() chooses.
        """
        spec = Window.partitionBy(*partition)
        if function in WINDOW_FUNCTIONS:
            ties = everything(self.df) if function == "row_number" else []
            value = WINDOW_FUNCTIONS[function]().over(spec.orderBy(*_keys(order), *ties)).cast("long")
        elif function in AGGREGATES:
            over = spec.orderBy(*_keys(order)) if order else spec
            if function == "avg":
                whole, n = F.sum(column(x).cast("long")).over(over), F.count(column(x)).over(over)
                value = F.when(n > 0, ((whole - whole % F.greatest(n, F.lit(1))) / F.greatest(n, F.lit(1))).cast("long"))
            elif function == "sum":
                value = total(self.df, x, lambda c: c.over(over))
            else:
                value = AGGREGATES[function](x).over(over)
        else:
            raise Refused("NL0527", function)
        return self._next(self.df.withColumn(name or function, value), "window")

    # --- time ---

    def as_of(self, epoch: int) -> Rel:
        """What was recorded up to an epoch. Pins the source, so it comes before any other stage."""
        if not isinstance(epoch, int) or epoch < 0:
            raise Refused("NL0510", str(epoch))
        if self.epoch is None:
            raise Refused("NL0510", "the relation carries no epoch")
        return self._next(self.df.filter(F.col(self.epoch) <= epoch), "as_of", pinned=True)

    def valid_at(self, date: str | datetime.date) -> Rel:
        """What held up to a date in the world's calendar."""
        date = parse_date(date) if isinstance(date, str) else date
        if self.valid is None:
            raise Refused("NL0510", "the relation carries no valid time")
        return self._next(self.df.filter(F.col(self.valid) <= F.lit(date)), "valid_at")

    def recorded_at(self, name: str = "recorded_at") -> Rel:
        """The rows with the epoch that recorded each."""
        if self.epoch is None:
            raise Refused("NL0500", "the relation carries no epoch")
        return self._next(self.df.withColumnRenamed(self.epoch, name), "map")

    # --- recursion ---

    def fixpoint(self, step: Callable[[Rel], Rel], measure: int | None = None, max_rounds: int = 1000) -> Rel:
        """The least set that holds these rows and what step makes of them; step joins, filters and projects."""
        last: list[Node] = [self.node]

        def run(df: DataFrame) -> DataFrame:
            out = step(Rel(df, self.node, (), self.epoch, self.valid))
            last[0] = out.node
            return out.df

        if not callable(step):
            raise Refused("NL0513")
        out = _fixpoint.fixpoint(self.df, run, measure, max_rounds)
        return Rel(out, Node("fixpoint", (self.node, last[0])))

    def stage(self, name: str, *args, **more):
        """A stage by its name, as in written pipelines."""
        known = {"except": "except_", "in": "in_"}
        if name.startswith("_") or name in ("df", "node", "order", "epoch", "valid", "source", "stage") or not hasattr(self, known.get(name, name)):
            raise Refused("NL0505", name)
        return getattr(self, known.get(name, name))(*args, **more)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


@dataclass(frozen=True)
class Grouped:
    """Groups that wait for their aggregate."""

    rel: Rel
    keys: tuple

    def agg(self, **aggs: tuple[str, object]) -> Rel:
        """name=(function, argument), functions sum, count, min, max, avg."""
        for function, _ in aggs.values():
            if function not in AGGREGATES:
                raise Refused("NL0502", function)
        out = self.rel.df.groupBy(*self.keys).agg(*[(total(self.rel.df, x) if f == "sum" else AGGREGATES[f](x)).alias(n) for n, (f, x) in aggs.items()])
        key = tuple(str(k) for k in self.keys)
        return self.rel._next(out, "aggregate", key=key, aggregates=tuple((f, str(x)) for f, x in aggs.values()))

    def sum(self, x, name: str = "sum") -> Rel:
        return self.agg(**{name: ("sum", x)})

    def count(self, x=None, name: str = "count") -> Rel:
        return self.agg(**{name: ("count", x)})

    def min(self, x, name: str = "min") -> Rel:
        return self.agg(**{name: ("min", x)})

    def max(self, x, name: str = "max") -> Rel:
        return self.agg(**{name: ("max", x)})

    def avg(self, x, name: str = "avg") -> Rel:
        return self.agg(**{name: ("avg", x)})
