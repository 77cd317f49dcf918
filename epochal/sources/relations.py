"""Named relations: where their rows come from, their keys and time columns, and what may be done to them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relation import Rel
from ..plans.refusal import Refused


@dataclass(frozen=True)
class Relation:
    """kind is table, base (append-only, kept for ever) or ledger (a base that conserves)."""

    name: str
    df: DataFrame
    kind: str = "base"
    key: tuple[str, ...] = ()
    epoch: str | None = None
    valid: str | None = None
    retain: str = "forever"
    conserves: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.kind in ("base", "ledger") and self.retain != "forever":
            raise Refused("NL0210", self.name)
        if self.kind == "ledger" and not self.conserves:
            raise Refused("NL0211", self.name)

    def at(self, anchor: int | None) -> DataFrame:
        """The rows recorded up to an epoch."""
        if anchor is None or self.epoch is None:
            return self.df
        return self.df.filter(F.col(self.epoch) <= anchor)


@dataclass
class Catalog:
    spark: SparkSession
    relations: dict[str, Relation] = field(default_factory=dict)

    def add(self, relation: Relation) -> Relation:
        self.relations[relation.name] = relation
        return relation

    def parquet(self, name: str, path: str, **more) -> Relation:
        return self.add(Relation(name, self.spark.read.parquet(path), **more))

    def named(self, name: str) -> Relation:
        if name not in self.relations:
            raise Refused("NL0500", name)
        return self.relations[name]

    def rel(self, name: str) -> Rel:
        r = self.named(name)
        return Rel.source(r.df, name, r.key, r.kind != "table", r.epoch, r.valid)

    def change(self, name: str) -> None:
        """UPDATE and DELETE: refused on what is append-only."""
        if self.named(name).kind != "table":
            raise Refused("NL0230", name)
        raise Refused("0A000", "tables are replaced, not changed in place")


def confidential(df: DataFrame, column: str, level: str, subject: str) -> DataFrame:
    """df with a column marked confidential: it may be projected and nothing else."""
    return df.withMetadata(column, {"confidential": level, "subject": subject})


def changes(spark: SparkSession, path: str, schema: str, stream: bool = False, files: int | None = None) -> DataFrame:
    """Change records as weighted rows: JSON lines with epoch, op (+ or -) and the columns of schema.

    A maintained view takes them as they are, from a batch or a stream of so many files at a time.
    """
    reader = spark.readStream.option("maxFilesPerTrigger", files or 1000) if stream else spark.read
    rows = reader.schema(f"epoch long, op string, {schema}").json(path)
    weight = F.when(F.col("op") == "+", 1).when(F.col("op") == "-", -1).otherwise(F.raise_error(F.lit("a change is + or -")).cast("int"))
    return rows.withColumn("_w", weight.cast("long")).drop("op")
