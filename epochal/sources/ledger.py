"""A double-entry ledger over append-only Parquet, one folder for each epoch.

A submission writes its rows to a folder of its own first, in account order, and
everything after that reads those files: three set queries validate them, and
their digest goes into the epoch's record. The record is created exclusively and
names the folder, so of two writers one seals the epoch and the other validates
again for the next one; nobody writes below a sealed epoch. The sealed folder is
then renamed into place, by its writer or, if that died, by whoever comes next: no
epoch is sealed before the one ahead of it is in place. Reads are folds over a
prefix of epochs: a partition filter, then a grouped sum.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import uuid
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.aggregates import total
from ..functions.values import WIDE
from ..operators.windows import spaced
from ..plans.refusal import Refused
from . import storage

POSTINGS = "txn long, acct long, cur int, amt decimal(38,0), idem string, value_date date"
HOLDS = "id long, acct long, cur int, amount decimal(38,0), value_date date"
RESOLUTIONS = "hold long, outcome string, captured decimal(38,0), value_date date"
EPOCHS = "epoch long, idem string, parent string, hash string, sealed_at timestamp"
TABLES = {"postings": POSTINGS, "holds": HOLDS, "resolutions": RESOLUTIONS}
OUTCOMES = ("post", "void", "expire")
#: The order in which a sealed epoch lies, so that a read of one account skips most of it.
LAID = {"postings": ("acct", "cur"), "holds": ("id",), "resolutions": ("hold",)}
#: Leading digits of the row digests that share a node of the digest tree, from the leaves to the root.
LEVELS = (6, 3, 0)
#: Holds that a submission resolves and that are looked up by value; more are joined.
FEW_IDS = 1000


class Rejected(ValueError):
    """A submission that the commit rule turns down: duplicate, unbalanced or bad_resolution."""

    def __init__(self, reason: str, detail: str = ""):
        self.reason = reason
        super().__init__(f"{reason} {detail}".strip())


# --- folds over postings, holds and resolutions that carry an epoch ---


def upto(rows: DataFrame, epoch: int | None) -> DataFrame:
    return rows if epoch is None else rows.filter(F.col("epoch") <= epoch)


def ledger_balance(postings: DataFrame, epoch: int | None = None, keys: tuple[str, ...] = ("acct", "cur")) -> DataFrame:
    """Settled postings up to an epoch; a key without postings has no row, which is not a balance of zero."""
    return upto(postings, epoch).groupBy(*keys).agg(total(postings, "amt").alias("balance"))


def open_holds(holds: DataFrame, resolutions: DataFrame, epoch: int | None = None) -> DataFrame:
    """Holds placed up to an epoch and not resolved by then."""
    resolved = upto(resolutions, epoch).select(F.col("hold").alias("id"))
    return upto(holds, epoch).join(resolved, "id", "left_anti")


def unresolved_holds(holds: DataFrame, resolutions: DataFrame, epoch: int | None = None, keys: tuple[str, ...] = ("acct", "cur")) -> DataFrame:
    return open_holds(holds, resolutions, epoch).groupBy(*keys).agg(total(holds, "amount").alias("held"))


def available_balance(postings: DataFrame, holds: DataFrame, resolutions: DataFrame, epoch: int | None = None, keys: tuple[str, ...] = ("acct", "cur")) -> DataFrame:
    """Balance less open holds, for every key that has either.

    Both kinds of rows go into one grouped sum, so there is one shuffle and no join of two aggregates.
    """
    legs = upto(postings, epoch).select(*keys, F.col("amt").alias("x"))
    held = open_holds(holds, resolutions, epoch).select(*keys, (-F.col("amount")).alias("x"))
    both = legs.unionByName(held)
    return both.groupBy(*keys).agg(total(both, "x").alias("available"))


def bitemporal_balance(postings: DataFrame, epoch: int, valid: Column | datetime.date, keys: tuple[str, ...] = ("acct", "cur")) -> DataFrame:
    """What was believed at an epoch about the world up to a date."""
    return ledger_balance(postings.filter(F.col("value_date") <= valid), epoch, keys)


def unbalanced(postings: DataFrame) -> DataFrame:
    """Transactions whose legs in one currency do not add up to zero."""
    return postings.groupBy("txn", "cur").agg(total(postings, "amt").alias("total")).filter("total <> 0")


def conservation(postings: DataFrame, epoch: int | None = None) -> DataFrame:
    """The total of each currency, which is zero on a closed book."""
    return upto(postings, epoch).groupBy("cur").agg(total(postings, "amt").alias("total"))


def first_of_key(rows: DataFrame, key: str = "idem", epoch: str = "epoch", window: int | None = None) -> DataFrame:
    """Rows whose identity was not seen before within a window of epochs; the first stays.

    With a window, an identity counts again once the latest one that counted lies so many epochs back. That
    depends on which earlier ones counted, so each identity's epochs are walked in order; without one a minimum will do.
    """
    first = rows.groupBy(key).agg(F.min(epoch).alias("_first"))
    if window is None:
        return rows.join(first, key).filter(F.col(epoch) == F.col("_first")).drop("_first")
    counted = spaced(rows.select(key, epoch).distinct(), key, epoch, window)
    return rows.join(counted, [key, epoch], "left_semi")


def key_exists_at(postings: DataFrame, acct: int, cur: int, epoch: int) -> bool:
    return not upto(postings, epoch).filter((F.col("acct") == acct) & (F.col("cur") == cur)).isEmpty()


def postings_for(postings: DataFrame, acct: int, epoch: int | None = None) -> DataFrame:
    """The postings of one account up to an epoch; sealed epochs lie in account order, so little else is read."""
    return upto(postings, epoch).filter(F.col("acct") == acct)


def hold_outcomes(holds: DataFrame, resolutions: DataFrame, epoch: int | None = None) -> DataFrame:
    """For each outcome: holds resolved up to an epoch, their amount, what was captured, and what was released.

    A hold posts what it captures, all of it where nothing else is said; the rest is released.
    """
    rows = upto(resolutions, epoch).join(upto(holds, epoch).select(F.col("id").alias("hold"), "amount"), "hold")
    given = F.col("captured") if "captured" in resolutions.columns else F.lit(None)
    taken = F.when(F.col("outcome") == "post", F.coalesce(given.cast(WIDE), F.col("amount").cast(WIDE))).otherwise(F.lit(0).cast(WIDE))
    rows = rows.select("outcome", F.col("amount").cast(WIDE).alias("amount"), taken.alias("captured"))
    sums = [F.sum(c).cast(WIDE).alias(c) for c in ("amount", "captured")]
    return rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), *sums).withColumn("released", (F.col("amount") - F.col("captured")).cast(WIDE))


def key_update_count(postings: DataFrame, epoch: int | None = None) -> DataFrame:
    return upto(postings, epoch).groupBy("acct").agg(F.count(F.lit(1)).alias("updates"))


def scaled(postings: DataFrame, text: str, scales: dict[int, int]) -> DataFrame:
    """Decimal amounts as minor units of each row's currency; too many decimals or an unknown currency fail the query."""
    amount = F.col(text).cast("decimal(38,10)")
    out = F.raise_error(F.concat(F.lit("22023: no currency "), F.coalesce(F.col("cur").cast("string"), F.lit("null")))).cast(WIDE)
    for code, scale in scales.items():
        units = amount * F.lit(10**scale).cast("decimal(19,0)")
        exact = F.when(F.round(units, 0) == units, F.round(units, 0).cast(WIDE)).otherwise(F.raise_error(F.lit(f"22003: more than {scale} decimals")).cast(WIDE))
        out = F.when(F.col("cur") == code, exact).otherwise(out)
    return postings.withColumn("amt", out)


def row_digest(*fields: Column | str) -> Column:
    """SHA-256 of a row's fields, each with its length, so that no two rows look alike."""
    parts = []
    for f in fields:
        text = (F.col(f) if isinstance(f, str) else f).cast("string")
        parts.append(F.when(text.isNull(), F.lit("n")).otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts), 256)


def rows_digest(digests: DataFrame, group: str, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """One digest for each group over the multiset of its row digests (column digest).

    Digests that share their leading digits are a node, hashed in sorted order, level by level. The tree is the
    same for every group, whatever its size or its company: a leaf has one row of 16 million on average and a node
    above has at most 4096 children, so no task holds all rows of a group.
    """
    level = digests.select(group, F.substring("digest", 1, levels[0]).alias("prefix"), "digest")
    for at, digits in enumerate(levels):
        level = level.groupBy(group, "prefix").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("digest")), ""), 256).alias("digest"))
        if at + 1 < len(levels):
            level = level.select(group, F.substring("prefix", 1, levels[at + 1]).alias("prefix"), F.concat("prefix", "digest").alias("digest"))
    return level.select(group, "digest")


# --- the ledger ---


@dataclass
class Ledger:
    """A ledger below a folder.

    window: epochs for which an idempotency key is remembered; None for ever.
    """

    spark: SparkSession
    root: str
    window: int | None = None
    open: dict | None = field(default=None, repr=False)
    _seen: int = field(default=-1, repr=False)

    def __post_init__(self) -> None:
        if self.window is not None and self.window < 1:
            raise Refused("NL0217", str(self.window))

    # --- records ---

    def _record(self, epoch: int) -> str:
        return f"{self.root}/epochs/{epoch:012d}.json"

    def _key(self, key: str) -> str:
        return f"{self.root}/keys/{hashlib.sha256(key.encode()).hexdigest()}"

    def record(self, epoch: int) -> dict | None:
        """What an epoch's record says, None if the epoch is not sealed."""
        text = storage.said(self.spark, self._record(epoch))
        return None if text is None else json.loads(text)

    def head(self) -> int:
        """The newest epoch, -1 before the first. Records have no gaps, so a few looks find it; nothing is listed."""
        there = lambda e: storage.exists(self.spark, self._record(e))
        if not there(self._seen + 1):
            return self._seen
        low, step = self._seen + 1, 1
        while there(low + step):
            low, step = low + step, 2 * step
        high = low + step
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if there(middle) else (low, middle)
        self._settled(low)
        self._seen = low
        return low

    def _settled(self, epoch: int) -> None:
        """Put a sealed epoch in place: its folders, and the note of its idempotency key. Doing it twice changes nothing."""
        said = self.record(epoch)
        for name, staged in said["data"].items():
            target = f"{self.root}/{name}/epoch={epoch}"
            if storage.exists(self.spark, staged):
                try:
                    storage.moved(self.spark, staged, target)
                except Exception:
                    if not storage.exists(self.spark, target):  # else another one was faster
                        raise
        storage.claimed(self.spark, f"{self._key(said['idem'])}/{epoch:012d}", "")

    def table(self, name: str) -> DataFrame:
        """The sealed rows of postings, holds or resolutions, with their epoch."""
        schema, head = f"{TABLES[name]}, epoch long", self.head()
        if not storage.exists(self.spark, f"{self.root}/{name}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(f"{self.root}/{name}").filter(F.col("epoch") <= head)

    def epochs(self) -> DataFrame:
        """One record for each epoch: its idempotency key, its parent's digest and its own."""
        if self.head() < 0:
            return self.spark.createDataFrame([], EPOCHS)
        return self.spark.read.schema(EPOCHS).option("pathGlobFilter", "*.json").json(f"{self.root}/epochs")

    # --- the commit rule ---

    def _known(self, name: str, column: str, asked: DataFrame, n: int) -> DataFrame:
        """Those of the n asked ids that are in a sealed table, found by value where they are few."""
        rows = self.table(name).select(F.col(column).alias("id"))
        if n <= FEW_IDS:
            return rows.filter(F.col("id").isin([r.id for r in asked.collect()])).distinct()
        return rows.join(F.broadcast(asked) if n <= 1_000_000 else asked, "id", "left_semi").distinct()  # 8 bytes an id

    def _admitted(self, key: str, resolutions: DataFrame, head: int) -> None:
        """What depends on the epochs before: the idempotency window, and whether the holds are open."""
        last = max(map(int, storage.names(self.spark, self._key(key))), default=-1)
        if last >= 0 and (self.window is None or last > head - self.window):
            raise Rejected("duplicate", key)
        asked = resolutions.select(F.col("hold").alias("id"))
        n = asked.count()
        if n:
            unknown = asked.join(self._known("holds", "id", asked, n), "id", "left_anti")
            bad = unknown.unionByName(self._known("resolutions", "hold", asked, n))
            if found := bad.limit(1).collect():
                raise Rejected("bad_resolution", f"hold {found[0].id}")

    def _balanced(self, rows: dict[str, DataFrame]) -> None:
        """What depends on the rows alone: conservation, known outcomes, one resolution a hold."""
        wrong = unbalanced(rows["postings"]).limit(1).collect()
        if wrong:
            raise Rejected("unbalanced", f"transaction {wrong[0].txn}, currency {wrong[0].cur}: {wrong[0].total}")
        asked = rows["resolutions"].select(F.col("hold").alias("id"), "outcome")
        bad = asked.filter(~F.coalesce(F.col("outcome").isin(*OUTCOMES), F.lit(False))).select("id")
        bad = bad.unionByName(asked.groupBy("id").count().filter("count > 1 or id is null").select("id"))
        if found := bad.limit(1).collect():
            raise Rejected("bad_resolution", f"hold {found[0].id}")

    def submit(self, key: str, postings: DataFrame | None = None, holds: DataFrame | None = None, resolutions: DataFrame | None = None) -> int:
        """Admit rows as one epoch, or reject them all; the epoch's number.

        The given frames are evaluated once. A writer that finds its epoch taken is checked against the new head
        and takes the next one.
        """
        if self.open is not None:
            for name, df in (("postings", postings), ("holds", holds), ("resolutions", resolutions)):
                if df is not None:
                    self.open[name].append(df)
            return -1
        folder = f"{self.root}/_staged/{uuid.uuid4().hex}"
        rows, data = {}, {}
        try:
            for name, df in (("postings", postings), ("holds", holds), ("resolutions", resolutions)):
                rows[name] = self._shaped(name, df, key)
                if df is not None:
                    data[name] = f"{folder}/{name}"
                    laid = rows[name].repartitionByRange(*LAID[name]).sortWithinPartitions(*LAID[name])
                    rows[name] = storage.written(laid, data[name])
            self._balanced(rows)
            bodies = self._bodies(rows)
            while True:
                epoch = self.head() + 1
                self._admitted(key, rows["resolutions"], epoch - 1)
                parent = self.record(epoch - 1)["hash"] if epoch else "0" * 64
                digest = hashlib.sha256("|".join([parent, *bodies]).encode()).hexdigest()
                now = datetime.datetime.now(datetime.UTC).isoformat()
                said = {"epoch": epoch, "idem": key, "parent": parent, "hash": digest, "sealed_at": now, "data": data}
                if storage.claimed(self.spark, self._record(epoch), json.dumps(said)):
                    break
        except BaseException:
            storage.removed(self.spark, folder)
            raise
        self._settled(epoch)
        self._seen = epoch
        storage.removed(self.spark, folder)  # empty by now
        return epoch

    def _shaped(self, name: str, df: DataFrame | None, key: str) -> DataFrame:
        schema = self.spark.createDataFrame([], TABLES[name]).schema
        if df is None:
            return self.spark.createDataFrame([], schema)
        if name == "postings" and "idem" not in df.columns:
            df = df.withColumn("idem", F.lit(key))
        for f in schema.fields:
            if f.name not in df.columns:
                df = df.withColumn(f.name, F.lit(None))
        return df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])

    def _bodies(self, rows: dict[str, DataFrame]) -> list[str]:
        out = []
        for name, df in rows.items():
            fields = [x.split()[0] for x in TABLES[name].split(", ")]
            found = rows_digest(df.select(F.lit(0).alias("all"), row_digest(*fields).alias("digest")), "all").collect()
            out.append(f"{name}:{found[0].digest if found else ''}")
        return out

    def verify_chain(self) -> bool:
        """Whether every epoch's rows and parent give the digest in its record, and no record is missing."""
        head, records = self.head(), self.epochs()
        bodies = records
        for name in TABLES:
            fields = [x.split()[0] for x in TABLES[name].split(", ")]
            found = rows_digest(self.table(name).select("epoch", row_digest(*fields).alias("digest")), "epoch")
            bodies = bodies.join(found.withColumnRenamed("digest", name), "epoch", "left")
        parts = [F.concat(F.lit(f"{name}:"), F.coalesce(name, F.lit(""))) for name in TABLES]
        before = records.select((F.col("epoch") + 1).alias("epoch"), F.col("hash").alias("before"))
        own = F.sha2(F.concat_ws("|", "parent", *parts), 256)
        good = (F.col("hash") == own) & (F.col("parent") == F.coalesce("before", F.lit("0" * 64)))
        n, right = bodies.join(before, "epoch", "left").agg(F.count(F.lit(1)), F.sum(F.coalesce(good, F.lit(False)).cast("long"))).first()
        return n == head + 1 and (right or 0) == n

    @contextmanager
    def txn(self, key: str):
        """Submissions inside are one epoch, sealed at the end; an error drops them all."""
        if self.open is not None:
            raise Refused("0A000", "a transaction is open already")
        self.open = {n: [] for n in TABLES}
        try:
            yield self
            rows, self.open = self.open, None
            merged = {}
            for name, parts in rows.items():
                for df in parts:
                    merged[name] = df if name not in merged else merged[name].unionByName(df, allowMissingColumns=True)
            if merged:
                self.submit(key, **merged)
        finally:
            self.open = None
