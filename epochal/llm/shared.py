"""Helpers that the training-data operators share: column choice, shared files, skew-safe lookups."""

from __future__ import annotations

import contextlib
import ctypes
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.storage import owned, removed, shared_dir, written

__all__ = ["BROADCAST_ROWS", "by_text", "looked_up", "mapped", "owned", "pick", "positional", "removed", "shared_dir", "text_digest", "without", "written"]

#: Rows and bytes of a lookup table that may be broadcast whole, with what a row takes beside its values.
BROADCAST_ROWS, BROADCAST_BYTES, ROW_BYTES = 200_000, 8 << 20, 64
#: A key counts as hot from this share of all rows, so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 0.001


def positional(df: DataFrame) -> DataFrame:
    """The same rows with columns c0, c1, ...: names that clash, even in case only, do no harm."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, the first of each exact name."""
    at = []
    for name in names:
        if name not in df.columns:
            raise ValueError(f"column {name!r} is missing; there are {df.columns}")
        at.append(df.columns.index(name))
    return positional(df).select([F.col(f"c{i}").alias(n) for i, n in zip(at, names)])


#: Bytes of an Arrow batch between Spark and Python: what a task holds beside its heap stays a small multiple of this.
BATCH_BYTES = 4 << 20
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def _bytes(setting: str) -> int:
    found = re.fullmatch(r"\s*(-?\d+)\s*([kmgt]?)b?\s*", setting.lower())
    return int(found[1]) << 10 * " kmgt".index(found[2] or " ") if found else -1


def _freed() -> None:
    """Give memory that a task no longer needs back to the system: the worker stays for the next one."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def mapped(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """rows.mapInArrow in batches of some BATCH_BYTES: a batch of 10,000 long texts would not fit beside a heap.

    The size is a setting of the session, which plans read when they run. It is lowered if it is larger, and stays so.
    """
    conf = rows.sparkSession.conf
    if not 0 < _bytes(conf.get(_SETTING)) <= BATCH_BYTES:
        conf.set(_SETTING, str(BATCH_BYTES))

    def freeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _freed()

    return rows.mapInArrow(freeing, schema)


def width_of(df: DataFrame) -> Column:
    """The bytes of a row, about: 8 for each column of fixed width, the length of strings, and what arrays hold."""

    def one(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 8
        if isinstance(kind, T.ArrayType):
            if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)):
                return F.aggregate(F.coalesce(c, F.array().cast(kind)), F.lit(8), lambda a, x: a + one(x, kind.elementType).cast("int"))
            return F.greatest(F.size(c), F.lit(0)) * 8 + 8
        if isinstance(kind, T.StructType):
            return sum((one(c[f.name], f.dataType) for f in kind.fields), F.lit(0))
        return F.lit(8)

    return sum((one(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0)).cast("long")


def looked_up(rows: DataFrame, index: DataFrame, key: str, weight: str, bound: int = BROADCAST_ROWS) -> DataFrame:
    """rows left-joined with index, which is a written table with one row for each key.

    weight is the index column that counts the rows of a key. An index of at
    most ``bound`` rows and BROADCAST_BYTES, both measured, is broadcast. Beyond
    that, only keys with more than HOT_SHARE of all rows are broadcast (1000 keys
    at most, whatever the input, and only within the bytes); the others join by a
    shuffle in which no key is hot.
    """
    n, total, size = index.agg(F.count(F.lit(1)), F.sum(weight), F.sum(width_of(index))).first()
    if n <= bound and (size or 0) + n * ROW_BYTES <= BROADCAST_BYTES:
        return rows.join(F.broadcast(index), key, "left")
    least = total * HOT_SHARE
    hot, cold = index.filter(F.col(weight) > least), index.filter(F.col(weight) <= least)
    if (hot.agg(F.sum(width_of(hot))).first()[0] or 0) > BROADCAST_BYTES:  # a few wide rows: left to the adaptive skew join
        return rows.join(index, key, "left")
    by_hot = rows.join(F.broadcast(hot), key)
    by_cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "left")
    return by_hot.unionByName(by_cold)


def text_digest(doc_id: Column, text: Column) -> Column:
    """Names a row by its doc_id and text; nulls have names of their own, which no value has."""
    own = [F.coalesce(F.concat(F.lit("1"), c.cast("string")), F.lit("0")) for c in (doc_id, text)]
    return F.unhex(F.sha2(F.concat(F.length(own[0]).cast("string"), F.lit("\x00"), *own), 256))


def by_text(docs: DataFrame) -> DataFrame:
    """docs' doc_id, lang and text, with the digest that names the row."""
    return pick(docs, "doc_id", "lang", "text").withColumn("digest", text_digest(F.col("doc_id"), F.col("text")))


def lang_digest(digest: Column, lang: Column) -> Column:
    """Names a row by its text_digest and its language; a null language has a name of its own."""
    return F.unhex(F.sha2(F.concat(digest, F.coalesce(F.concat(F.lit("1"), lang), F.lit("0")).cast("binary")), 256))


def without(docs: DataFrame, dropped: DataFrame, single: DataFrame | None = None, bound: int = BROADCAST_ROWS, by_lang: bool = False) -> DataFrame:
    """docs less the rows whose digest is in the written table ``dropped``, which is broadcast only if small.

    Of each digest in the written table ``single``, one row stays. With
    ``by_lang`` the digests name the language too.
    """
    names = docs.columns
    rows = positional(docs)
    rows = rows.withColumn("digest", text_digest(F.col(f"c{names.index('doc_id')}"), F.col(f"c{names.index('text')}")))
    if by_lang:
        rows = rows.withColumn("digest", lang_digest(F.col("digest"), F.col(f"c{names.index('lang')}")))

    def small(table: DataFrame) -> DataFrame:
        return F.broadcast(table.select("digest")) if table.count() <= min(bound, BROADCAST_BYTES // 64) else table.select("digest").distinct()

    out = rows.join(small(dropped), "digest", "left_anti")
    if single is not None and not single.isEmpty():
        twins = small(single)
        out = out.join(twins, "digest", "left_anti").unionByName(out.join(twins, "digest", "left_semi").dropDuplicates(["digest"]))
    return out.select([F.col(f"c{i}") for i in range(len(names))]).toDF(*names)
