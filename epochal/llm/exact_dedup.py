"""Exact dedup by a log-structured merge index of text digests [DataFrame functions only].

Every scan task is a memtable: it holds the digests of its rows, sorts them and
flushes one run, a Parquet file in digest order with a Bloom filter in its footer.
Compaction merges the level so far and the runs behind it into a new level in
digest order, one entry for each digest: the row that stays, by the smallest rank,
and the number of rows; equal digests of a task are combined before they travel.

A digest that several rows share is a hit. A filter over the digests of a table,
three probes into 8 MB of bits at most, whatever the input, is built by grouped
sums and read by every task as a constant: rows that it turns away are certainly
no hits and go no further. So a batch that is looked up, rows that are resolved
and texts that are verified meet the index by a join only if they pass the filter,
and the join leaves the hits alone. Hits are verified byte by byte: their normalised
texts are made distinct, and a digest must have one of them. Where it has more, the
digest collided and its rows are grouped by the text itself.

Defined results: a null text counts as empty; texts are equal when identical
after the six ASCII white-space characters are deleted, so all blank texts form
one group. Of equal texts the one with the most code points stays, then the one
with the smallest doc_id (null last); of rows that tie in both, exactly one
stays. An empty table gives no rows. Columns that are not needed are not read,
and their names may clash with anything.

Index files lie below the folder of storage.owned, or of the application, and go
with it; clear() deletes them earlier.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import BROADCAST_BYTES, BROADCAST_ROWS, looked_up, pick, positional, removed, shared_dir, written

WHITE_SPACE = " \t\n\x0b\x0c\r"
RUN_OPTIONS = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": "1000000"}


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    for c in WHITE_SPACE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _rank() -> Column:
    """The smallest of these stays: longest text, then smallest doc_id, nulls last, then the row number."""
    return F.struct((-F.col("n_code")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"))


#: Longs in a filter, at most: 8 MB. Bits for each entry below that.
MAX_WORDS, BITS = 1 << 20, 10


class Filter:
    """Which digests may be in a table: no false negatives, and few false positives up to some ten million entries."""

    def __init__(self, digests: DataFrame, n: int, path: str):
        self.words = min(MAX_WORDS, 1 << max(6, (n * BITS // 64).bit_length()))
        bits = digests.select(F.explode(F.array(*self._places(F.col("digest")))).alias("bit"))
        one = F.expr("shiftleft(1L, cast(bit & 63 as int))")
        held = bits.select(F.shiftright("bit", 6).alias("word"), one.alias("value"))
        every = digests.sparkSession.range(self.words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("value"))
        held = held.unionByName(every).groupBy("word").agg(F.bit_or("value").alias("value"))
        whole = F.transform(F.sort_array(F.collect_list(F.struct("word", "value"))), lambda x: x["value"])  # MAX_WORDS
        self.table = written(held.agg(whole.alias("words")), path)

    def _places(self, digest: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(i), digest), F.lit(self.words * 64)) for i in range(3)]

    def may(self, digest: Column) -> Column:
        """False: the digest is not in the table."""
        words = self.table.select("words").scalar()
        out = F.lit(True)
        for place in self._places(digest):
            bit = place.bitwiseAND(F.lit(63)).cast("int")
            out = out & (F.getbit(F.get(words, F.shiftright(place, 6).cast("int")), bit) == 1)
        return out


class DigestIndex:
    """The index of the texts flushed so far.

    digest_bytes: bytes of the SHA-256 that serve as the key. Fewer than 32 make
    collisions likely, which byte verification then has to resolve.
    bound: hits up to this number, and 8 MB, are broadcast; more are joined by a shuffle.
    """

    def __init__(self, spark: SparkSession, digest_bytes: int = 32, bound: int = BROADCAST_ROWS):
        self.spark, self.digest_bytes, self.bound = spark, digest_bytes, min(bound, BROADCAST_BYTES // 96)
        self.root, self.runs, self.level, self.merged = shared_dir(spark), [], None, 0
        self._texts: list[DataFrame] = []

    def _digested(self, docs: DataFrame) -> DataFrame:
        docs = pick(docs, "doc_id", "text").withColumn("norm", normalised(F.col("text")))
        sha = F.unhex(F.sha2("norm", 256))
        return docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_code"), "norm", sha.alias("sha"), F.substring(sha, 1, self.digest_bytes).alias("digest"))

    def flush(self, docs: DataFrame) -> None:
        """Write one sorted run for each scan task; nothing is shuffled."""
        path = f"{self.root}/run-{len(self.runs)}"
        rows = self._digested(docs).select("digest", "sha", "doc_id", "n_code", F.monotonically_increasing_id().alias("row"), F.lit(len(self.runs)).alias("run"))
        self.runs.append(written(rows.sortWithinPartitions("digest"), path, **RUN_OPTIONS))
        self._texts.append(docs)

    def entries(self, runs: slice = slice(None)) -> DataFrame:
        """Flushed rows: digest, sha, doc_id, n_code and a row number of their own."""
        first, *rest = self.runs[runs]
        for run in rest:
            first = first.unionByName(run)
        return first.withColumn("row", F.struct("run", "row")).drop("run")

    def compact(self) -> DataFrame:
        """The level with the runs since merged into it: digest, keep (the rank of the row that stays) and group_size.

        Map-side combining leaves one record of a digest for each task, so a
        group that holds a third of all rows is no larger than any other.
        """
        if self.merged < len(self.runs) or self.level is None:
            parts = self.entries(slice(self.merged, None)).select("digest", _rank().alias("keep"), F.lit(1).cast("long").alias("group_size"))
            if self.level is not None:
                parts = parts.unionByName(self.level)
            merged = parts.groupBy("digest").agg(F.min("keep").alias("keep"), F.sum("group_size").alias("group_size"))
            self.merged = len(self.runs)
            self.level = written(merged.sortWithinPartitions("digest"), f"{self.root}/level-{self.merged}", **RUN_OPTIONS)
            self._hits = None
        return self.level

    def filter(self, name: str, digests: DataFrame, n: int) -> Filter:
        """A filter over some of the level's digests."""
        return Filter(digests.select("digest"), n, f"{self.root}/filter-{name}-{uuid.uuid4().hex}")

    def hits(self) -> tuple[DataFrame, int, Filter]:
        """The level's digests of two or more rows, with the row that stays and the number of rows; how many; their filter."""
        self.compact()
        if self._hits is None:
            rows = self.level.filter("group_size > 1").select("digest", "keep.keep_id", "keep.keep_row", "group_size")
            found = written(rows, f"{self.root}/hits-{self.merged}")
            n = found.count()
            self._hits = found, n, self.filter("hits", found, n)
        return self._hits

    def met(self, rows: DataFrame, table: DataFrame, n: int, may: Filter) -> DataFrame:
        """rows left-joined with a table of n digests. A small table is broadcast; of a larger one, the filter's rows alone meet it."""
        if n <= self.bound:
            return looked_up(rows, table, "digest", "group_size", self.bound)
        rows = rows.withColumn("may", may.may(F.col("digest")))
        hit = looked_up(rows.filter("may").drop("may"), table, "digest", "group_size", self.bound)
        return hit.unionByName(rows.filter("not may").drop("may"), allowMissingColumns=True)

    def known(self, docs: DataFrame) -> DataFrame:
        """doc_id, digest and keep_id of the rows of a batch whose digest the level has; the filter spares all others the join."""
        level = self.compact()
        rows = self._digested(docs).select("doc_id", "digest").filter(self.filter("level", level, level.count()).may(F.col("digest")))
        return looked_up(rows, written(level.select("digest", "keep.keep_id", "group_size")), "digest", "group_size", self.bound).filter("group_size is not null")

    def collided(self) -> DataFrame:
        """The digests under which the bytes differ, found by comparing the texts of all hits, and of hits only."""
        found, n, may = self.hits()
        differ = self._texts_of(found.select("digest"), n, may).distinct().groupBy("digest").count().filter("count > 1")
        return written(differ.select("digest"), f"{self.root}/collided-{self.merged}-{uuid.uuid4().hex}")

    def _texts_of(self, digests: DataFrame, n: int, may: Filter) -> DataFrame:
        """digest and norm of the rows of n digests."""
        wanted = F.broadcast(digests) if n <= self.bound else digests
        out = None
        for docs in self._texts:
            rows = self._digested(docs).select("digest", "norm").filter(may.may(F.col("digest"))).join(wanted, "digest", "left_semi")
            out = rows if out is None else out.unionByName(rows)
        return out

    def resolve(self) -> DataFrame:
        """For every flushed row: doc_id, n_code, keep_id, group_size, kept, sha, and the row's number."""
        bad = self.collided()
        rows = self.met(self.entries(), *self.hits())
        kept = F.col("keep_row").isNull() | (F.col("keep_row") == F.col("row"))
        keep_id = F.when(F.col("keep_row").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
        rows = rows.select("digest", "doc_id", "n_code", "sha", "row", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"))
        if bad.isEmpty():
            return rows
        few = bad.count() <= self.bound
        clean = rows.join(F.broadcast(bad) if few else bad, "digest", "left_anti")
        return clean.unionByName(self._split(bad))

    def _split(self, bad: DataFrame) -> DataFrame:
        """The rows of collided digests, grouped by their full text."""
        rows = None
        for run, docs in enumerate(self._texts):
            one = self._digested(docs).withColumn("row", F.struct(F.lit(run).alias("run"), F.monotonically_increasing_id().alias("row"))).join(bad, "digest", "left_semi")
            rows = one if rows is None else rows.unionByName(one)
        rows = written(rows)
        classes = rows.groupBy("digest", "norm").agg(F.min(_rank()).alias("keep"), F.count(F.lit(1)).alias("group_size"))
        out = rows.join(classes, ["digest", "norm"])
        return out.select("digest", "doc_id", "n_code", "sha", "row", "keep.keep_id", "group_size", (F.col("row") == F.col("keep.keep_row")).alias("kept"))

    def clear(self) -> None:
        """Delete the index files; frames that resolve() returned can't be read afterwards."""
        removed(self.spark, self.root)


def exact_groups(docs: DataFrame, digest_bytes: int = 32, bound: int = BROADCAST_ROWS) -> DataFrame:
    """One row for each document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256."""
    index = DigestIndex(docs.sparkSession, digest_bytes, bound)
    index.flush(docs)
    out = index.resolve()
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """The documents that stay, with all their columns, in the sense of the module's rules.

    The text is joined with the verdicts by its digest: beside a broadcast of
    the groups where they are few, by a shuffle with hot groups apart where
    they are not.
    """
    names = docs.columns
    index = DigestIndex(docs.sparkSession, 32, bound)
    index.flush(docs)
    verdict = index.resolve().filter("kept and group_size > 1").select("digest", F.col("doc_id").alias("stay_id"), F.col("n_code").alias("stay_n"), "group_size", F.lit(True).alias("grouped"))
    verdict = written(verdict, f"{index.root}/verdict")
    n = verdict.count()
    may = index.filter("verdict", verdict, n)
    plain = positional(docs)
    text, doc_id = F.col(f"c{names.index('text')}"), F.col(f"c{names.index('doc_id')}")
    rows = plain.withColumn("digest", F.unhex(F.sha2(normalised(text), 256))).withColumn("n_code", F.length(F.coalesce(text, F.lit(""))).cast("long"))
    rows = index.met(rows, verdict, n, may)
    stays = doc_id.eqNullSafe(F.col("stay_id")) & (F.col("n_code") == F.col("stay_n"))
    listed = index.entries().filter(may.may(F.col("digest"))).join(F.broadcast(verdict) if n <= index.bound else verdict, "digest")
    tied = listed.filter(F.col("doc_id").eqNullSafe(F.col("stay_id")) & (F.col("n_code") == F.col("stay_n"))).groupBy("digest").count().filter("count > 1")
    tied = written(tied.select("digest"), f"{index.root}/tied")
    out = rows.filter(F.col("grouped").isNull() | stays)
    if not tied.isEmpty():  # rows alike in doc_id, length and normalised text: one of each group stays
        marked = F.broadcast(tied) if tied.count() <= index.bound else tied
        out = out.join(marked, "digest", "left_anti").unionByName(out.join(marked, "digest", "left_semi").dropDuplicates(["digest"]))
    return out.select([F.col(f"c{i}") for i in range(len(names))]).toDF(*names)
