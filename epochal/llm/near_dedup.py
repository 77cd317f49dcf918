"""Near-duplicate groups at a similarity of word shingles, by SimHash: blocks, a join on blocks, verified Hamming distance.

A text is its set of shingles. Fingerprints have 1024 bits: three bits of a 64-bit
one reach a similarity of some 0.97 only, and the distance at 0.8 is 155 of 1024
bits on average with a deviation of 11. Two texts link if their distance is at
most what texts of their two sizes have at the similarity, and ``DEVIATIONS``
more: the chance that a bit differs is worked out from the sizes. So a pair just at
the similarity is missed with a chance of 0.006; at 0.75 seven in ten pairs of a
hundred shingles link, at 0.7 one in seven, at 0.65 hardly any.

Blocks. So many bits differ that no block of bits is whole in all close pairs, so
the blocks here are blocks of shingles: they are dealt by hash into classes of 3 to
6, and ``BLOCKS`` classes, each as the sum of its hashes, are the keys; texts with
fewer classes are dealt again and again. At 0.8 two texts agree in a class with a
chance of 0.29 to 0.54, so all of 24 differ with one of 0.0003 at most. The number
of classes is a power of two for the text's size; sizes at similarity s differ by s
at most, so a text is dealt at the powers of sqrt(s) and 1 / sqrt(s) of its size,
and two such texts share one.

Texts of at most ``TINY`` shingles meet exactly: a pair at the similarity differs by
a quarter of what it shares at most, so each text names what is left of it after
taking away one or two shingles, and equal remainders say how far the texts are
apart. Those of 9 and 10 shingles have both kinds of keys, so that any two texts
that may be similar have one kind in common.

Large buckets. A key that more than ``heavy`` texts share is first dealt at random
into chunks, which join what is alike; then what is still apart is keyed again by
the key and ``NEXT`` more classes, level by level. Texts that only share a passage
part at once; texts alike meet with a chance near 1, as they share some nine keys
and each goes on with four more. After ``LEVELS`` of them the rest, if any, is
compared chunk by chunk. A bucket gives links of a spanning forest only.

Defined results: null counts as empty; texts without words are one group; a text
shorter than a shingle is one shingle. One document of each group stays, that of
the smallest doc_id, null last; of rows that tie any one. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, by_text, looked_up, mapped, without, written
from .simhash import HEAVY, _root, components, majority, shingle_hashes

WIDTH, WORDS, BLOCKS = 5, 16, 24
SIMILARITY, DEVIATIONS = 0.8, 2.5
#: Texts of at most so many shingles meet by remainders.
TINY = 10
#: Distinct shingles in a class, at least; twice as many at most.
CLASS_SIZE = 2.8
#: Sizes beyond this have the limits of this one.
SIZES = 256
NEXT, LEVELS = 4, 5
_SALTS = np.array([(i + 1) * 0x9E3779B97F4A7C15 % (1 << 64) for i in range(64)], np.uint64)


def _mixed(h: np.ndarray, salt) -> np.ndarray:
    """Other hashes of 64-bit hashes."""
    h = h ^ np.uint64(salt) if np.isscalar(salt) else h ^ salt
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def differing(n: int, m: int, shared: int) -> float:
    """The chance that a bit of the majorities of n and m random bits differs, of which so many are shared."""

    def pmf(k: int) -> np.ndarray:
        at = np.arange(k + 1)
        logs = [math.lgamma(k + 1) - math.lgamma(i + 1) - math.lgamma(k - i + 1) for i in at]
        return np.exp(np.array(logs) - k * math.log(2))

    def ones(size: int, rest: int) -> np.ndarray:
        """For each number of shared ones, the chance of a majority of ones."""
        least = size // 2 + 1 - np.arange(shared + 1)  # ones needed among the rest
        tail = np.r_[np.cumsum(pmf(rest)[::-1])[::-1], 0.0]
        return tail[np.clip(least, 0, rest + 1)]

    a, b = ones(n, n - shared), ones(m, m - shared)
    return float((pmf(shared) * (a * (1 - b) + b * (1 - a))).sum())


@functools.cache
def limits(similarity: float = SIMILARITY) -> np.ndarray:
    """The bits that may differ between texts of n and n + i shingles, at [n, i]; -1 where the sizes are too far apart."""
    out = np.full((SIZES + 1, math.floor(SIZES / similarity) - SIZES + 2), -1, np.int16)
    for n in range(1, SIZES + 1):
        for m in range(n, math.floor(n / similarity + 1e-9) + 1):
            p = differing(n, m, math.ceil(similarity * (n + m) / (1 + similarity) - 1e-9))
            bits = WORDS * 64
            out[n, m - n] = math.floor(bits * p + DEVIATIONS * math.sqrt(bits * p * (1 - p)))
    return out


def may_differ(table: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """For pairs of sizes, the bits that may differ; -1: no pair of such sizes is similar."""
    low, high = np.minimum(n, m).astype(np.int64), np.maximum(n, m).astype(np.int64)
    big = low > SIZES
    more = np.where(big, np.ceil((high - low) * (SIZES / np.maximum(low, 1)) - 1e-9).astype(np.int64), high - low)
    out = table[np.minimum(low, SIZES), np.minimum(more, table.shape[1] - 1)]
    return np.where(more < table.shape[1], out, -1)


def overlap(similarity: float = SIMILARITY) -> int:
    """Texts of more shingles than this meet by classes: any that may be similar to one of more than TINY."""
    return math.ceil(similarity * (TINY + 1) - 1e-9) - 1


def class_keys(h: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """BLOCKS keys for each power of two at which a set of hashes is dealt, zero for a class without shingles."""
    out, wider = [], 0.999 * math.sqrt(similarity)
    low, high = (max(0, math.floor(math.log2(len(h) * x / CLASS_SIZE))) for x in (wider, 1 / wider))
    value = _mixed(h, 0x14057B7EF767814F)
    for level in range(low, high + 1):
        turns = max(1, -(-BLOCKS >> level))
        of = _mixed(h[None, :], _SALTS[:turns, None]) & np.uint64((1 << level) - 1)
        at = (of + (np.arange(turns, dtype=np.uint64) << np.uint64(level))[:, None]).ravel()
        used = at < BLOCKS
        order = np.argsort(at[used], kind="stable")
        own, add = at[used][order], np.tile(value, turns)[used][order]
        keys = np.zeros(BLOCKS, np.uint64)
        if len(own):
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            keys[own[first].astype(np.int64)] = _mixed(np.add.reduceat(add, first) + own[first], 0x2545F4914F6CDD1D + level) | np.uint64(1)
        out.append(keys)
    return np.concatenate(out)


def remainders(h: np.ndarray, similarity: float = SIMILARITY) -> list[tuple[int, int, int]]:
    """Hash, size, and number of shingles taken away, of all that a small set shares with sets at the similarity."""
    n, value = len(h), _mixed(h, 0x6A09E667F3BCC909).tolist()
    whole, out = sum(value), []
    for k in range(n):
        if n > (n - k) / similarity + 1e-9:
            break
        out += [((whole - sum(value[i] for i in c)) % (1 << 64), n - k, k) for c in combinations(range(n), k)]
    return out


def sketch(text: str | None, width: int = WIDTH, similarity: float = SIMILARITY) -> tuple[int, int, np.ndarray, np.ndarray, int, list]:
    """Two hashes of the set of shingles, its SimHash as words, its class keys, its size, and its remainders."""
    h = np.unique(shingle_hashes(text, width))
    n, none = len(h), np.zeros(0, np.uint64)
    if not n:
        return 0, 0, np.zeros(WORDS, np.uint64), none, 0, []
    with np.errstate(over="ignore"):
        whole, other = (int(_mixed(h, s).sum(dtype=np.uint64)) for s in (0x3C6EF372FE94F82B, 0x510E527FADE682D1))
        keys = class_keys(h, similarity) if n > overlap(similarity) else none
        wide = majority(_mixed(h[:, None], _SALTS[None, :WORDS])) if n > overlap(similarity) else np.zeros(WORDS, np.uint64)
        return whole, other, wide, keys, n, remainders(h, similarity) if n <= TINY else []


FINGERPRINT = [f"f{k}" for k in range(WORDS)]


def sketches(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, digest (naming the row by doc_id and text), whole and other (hashes of the set), f0 to f15, keys, n_shingles, and left (remainders) of every document."""
    rows = by_text(docs).select("doc_id", "digest", "text")
    names = ["doc_id", "digest", "whole", "other", *FINGERPRINT, "keys", "n_shingles", "left"]

    def signed(values: list[int]) -> pa.Array:
        return pa.array(np.array(values, np.uint64).view(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                found = [sketch(x.as_py(), width, similarity) for x in part.column(2)]
                wide = np.array([x[2] for x in found], np.uint64).view(np.int64)
                ends = pa.array(np.cumsum([0, *[len(x[3]) for x in found]]), pa.int32())
                keys = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([x[3] for x in found]).view(np.int64)))
                flat = [r for x in found for r in x[5]]
                left = pa.StructArray.from_arrays([signed([r[0] for r in flat]), *[pa.array([r[i] for r in flat], pa.int32()) for i in (1, 2)]], names=["key", "size", "away"])
                left = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[len(x[5]) for x in found]]), pa.int32()), left)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), signed([x[0] for x in found]), signed([x[1] for x in found]), *[pa.array(wide[:, k]) for k in range(WORDS)], keys, pa.array([x[4] for x in found], pa.int32()), left], names=names)

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, digest binary, whole long, other long, " + ", ".join(f"{f} long" for f in FINGERPRINT) + ", keys array<long>, n_shingles int, left array<struct<key:long,size:int,away:int>>"
    return mapped(rows, run, schema)


def joined(bucket: np.ndarray, root: np.ndarray, size: np.ndarray, fp: np.ndarray, table: np.ndarray) -> tuple[list[int], list[int]]:
    """Row pairs that link what is apart in a bucket into a spanning forest. Equal buckets stand together; rows of one root are joined already."""
    n = len(fp)
    first, place = np.unique(np.stack([bucket, root]), axis=1, return_index=True, return_inverse=True)[1:]
    up = first[place.ravel()].astype(np.int64)
    left: list[int] = []
    right: list[int] = []
    live = np.arange(n)
    for step in range(1, n):
        live = live[live + step < n]
        live = live[bucket[live] == bucket[live + step]]
        if not len(live):
            break
        ask = live[up[live] != up[live + step]]
        most = may_differ(table, size[ask], size[ask + step])
        ask, most = ask[most >= 0], most[most >= 0]
        if not len(ask):
            continue
        near = ask[np.bitwise_count(fp[ask] ^ fp[ask + step]).sum(axis=1) <= most]
        for a in near.tolist():
            ra, rb = _root(up, a), _root(up, a + step)
            if ra != rb:
                up[max(ra, rb)] = min(ra, rb)
                left.append(a)
                right.append(a + step)
        if len(near):
            while not np.array_equal(up, higher := up[up]):
                up = higher
    return left, right


def _linker(similarity: float):
    """Streams rows (key, id, root, n_shingles, fingerprint) sorted by key and gives the links of each key's forest."""
    table = limits(similarity)

    def done(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero(np.r_[True, rows[0][1:] != rows[0][:-1]])
        bucket = np.repeat(np.arange(len(edge)), np.diff(np.r_[edge, rows.shape[1]]))
        fp = np.ascontiguousarray(rows[4:].T).view(np.uint64)
        a, b = joined(bucket, rows[2], rows[3], fp, table)
        if a:
            x, y = rows[1][a], rows[1][b]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((4 + WORDS, 0), np.int64)
        for batch in batches:
            rest = np.concatenate([rest, np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4 + WORDS)])], axis=1)
            if rest.shape[1] and (cut := int(np.argmax(rest[0] == rest[0, -1]))):
                yield from done(rest[:, :cut])
                rest = rest[:, cut:]
        if rest.shape[1]:
            yield from done(rest)

    return run


def _forest(members: DataFrame, wide: DataFrame, similarity: float) -> DataFrame:
    """Links of the members (key, id, root) of buckets that fit a task."""
    rows = members.join(wide.select("id", F.col("n_shingles").cast("long").alias("n"), *FINGERPRINT), "id")
    rows = rows.select("key", "id", "root", "n", *FINGERPRINT).repartition("key").sortWithinPartitions("key", "f0", "id")
    return mapped(rows, _linker(similarity), "a long, b long")


def _small(table: DataFrame, bound: int) -> DataFrame:
    """A written table of narrow rows, broadcast if it has few."""
    return F.broadcast(table) if table.count() <= bound else table


def _chunk(of: Column) -> Column:
    return F.pmod(F.xxhash64("id"), of).cast("int")


def links(wide: DataFrame, similarity: float = SIMILARITY, heavy: int = HEAVY, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Links (a < b) between the ids of ``wide`` (id, n_shingles, fingerprint, keys) that join all that is alike."""
    key = wide.select("id", F.posexplode("keys").alias("at", "key")).filter("key <> 0")
    keyed, found, label = written(key.select("key", "id", "at")), None, None
    for level in range(LEVELS + 1):
        shared = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
        members = written(looked_up(keyed, shared, "key", "n", 0).filter("n is not null"))  # by a shuffle at any size: there are some keys for every text
        if label is not None:
            members = members.join(label, "id", "left").withColumn("root", F.coalesce("root", "id"))
        else:
            members = members.withColumn("root", F.col("id"))
        light = members.filter(F.col("n") <= heavy).select("key", "id", "root")
        large = members.filter(F.col("n") > heavy)
        chunked = large.select(F.xxhash64("key", _chunk(F.ceil(F.col("n") / heavy))).alias("key"), "id", "root")
        new = written(_forest(light.unionByName(chunked), wide, similarity).distinct())
        found = new if found is None else found.unionByName(new)
        if large.isEmpty():
            return written(found.distinct())
        label = written(components(found, bound).select(F.col("vertex").alias("id"), "root"))
        large = large.drop("root").join(label, "id", "left").withColumn("root", F.coalesce("root", "id"))
        large = written(large)
        apart = written(large.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key"))
        if apart.isEmpty():
            return written(found.distinct())
        large = written(large.join(_small(apart, bound), "key", "left_semi").select("key", "id", "at", "root", "n"))
        if level < LEVELS:
            start = F.col("at") - F.pmod(F.col("at"), F.lit(BLOCKS))
            turn = F.explode(F.sequence(F.lit(1 + NEXT * level), F.lit(NEXT * (level + 1)))).alias("turn")
            more = large.join(wide.select("id", "keys"), "id").select("key", "id", "at", "keys", turn, start.alias("start"))
            other = F.element_at("keys", (F.col("start") + F.pmod(F.col("at") + F.col("turn"), F.lit(BLOCKS)) + 1).cast("int"))
            keyed = written(more.withColumn("other", other).filter("other <> 0").select(F.xxhash64("key", "turn", "other").alias("key"), "id", "at"))
    # What is left after all levels: every chunk beside every other.
    chunks = F.ceil(F.col("n") / heavy).cast("int")
    pairs = large.withColumn("chunk", _chunk(chunks)).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    pairs = pairs.select(F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("key"), "id", "root")
    return written(found.unionByName(_forest(pairs, wide, similarity)).distinct())


def tiny_links(left: DataFrame, similarity: float = SIMILARITY, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Links between the ids of small sets by their remainders (id, key, size, away).

    Sets that leave the same remainder are similar if what was taken away, together, is little enough. So whoever is
    similar to another one is similar to the one that lost the least, and a link to that one joins all.
    """
    named = left.withColumn("name", F.xxhash64("key", "size"))
    hubs = named.groupBy("name").agg(F.min(F.struct("away", "id")).alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    hubs = written(hubs.select("name", F.col("hub.id").alias("hub"), F.col("hub.away").alias("lost"), "n"))
    rows = looked_up(named, hubs, "name", "n", bound).filter("n is not null and hub <> id")
    rows = rows.filter(F.col("size") >= similarity * (F.col("size") + F.col("away") + F.col("lost")) - 1e-9)
    return written(rows.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct())


def near_groups(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, heavy: int = HEAVY, bound: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, digest, row and kept of every document: one row of each group stays, that of the smallest doc_id.

    A group is what links connect. Texts of equal sets of shingles are one vertex. Null doc_ids come last; among rows of
    one doc_id any one stays.
    """
    rows = written(sketches(docs, width, similarity).withColumn("row", F.monotonically_increasing_id()))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    nodes = written(rows.groupBy("whole", "other", "n_shingles").agg(F.min("row").alias("id"), first))
    twins = written(rows.select(F.col("row").alias("id")).join(nodes.select("id"), "id", "left_anti"))
    own = rows.withColumn("id", F.col("row")).join(_small(twins, bound), "id", "left_anti")
    wide = own.filter(F.col("n_shingles") > overlap(similarity)).select("id", "n_shingles", "keys", *FINGERPRINT)
    left = own.filter(F.col("n_shingles") <= TINY).select("id", F.explode("left").alias("r")).select("id", "r.key", "r.size", "r.away")
    edges = links(wide, similarity, heavy, bound).unionByName(tiny_links(left, similarity, bound))
    stars = components(edges, bound)
    whole = written(stars.select(F.col("vertex").alias("id"), "root").unionByName(stars.select(F.col("root").alias("id"), "root").distinct()))
    lows = written(nodes.select("id", "first").join(whole, "id").groupBy("root").agg(F.min("first").alias("stays")))
    low_row = lows.select(F.col("stays.row").alias("row"))
    lost = nodes.select("id", F.col("first.row").alias("row")).join(whole.select("id"), "id").join(low_row, "row", "left_anti")
    kept = written(nodes.select(F.col("first.row").alias("row")).join(lost.select("row"), "row", "left_anti").withColumn("kept", F.lit(True)))
    return rows.select("doc_id", "digest", "row").join(kept, "row", "left").select("doc_id", "digest", "row", F.coalesce("kept", F.lit(False)).alias("kept"))


def near_dedup(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, heavy: int = HEAVY, bound: int = BROADCAST_ROWS) -> DataFrame:
    """The documents that stay, with all their columns: one of each group of near duplicates."""
    verdict = written(near_groups(docs, width, similarity, heavy, bound))
    named = written(verdict.groupBy("digest").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).filter("not kept or n > 1"))
    return without(docs, named.filter("not kept"), named.filter("kept"), bound)
