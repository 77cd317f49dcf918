"""SimHash near-duplicates by pigeonhole blocks.

A document's fingerprint has 64 bits, the majority of the bits of its shingles'
hashes. Documents of one fingerprint are one vertex. The 64 bits are split into
six blocks; of two fingerprints that differ in three bits or fewer, at least
three blocks agree, so for each of the 20 choices of three blocks the vertices
are brought together by those blocks' 31 to 33 bits and the Hamming distance of
those that meet is verified.

Large buckets. A bucket key with more than ``heavy`` fingerprints is not
processed in one task: its members are split again by three of six blocks of
the bits that the key leaves open. A pair within three bits still agrees in one
of those 20 choices, and a second key fixes 46 bits or more, so it holds 2^18
fingerprints at most, whatever the input. The key counts that find such buckets
are exact; the hottest keys are set apart before the shuffle.

A bucket never yields all its pairs: it gives the links that join parts which
were not joined before, at most one fewer than its members. That keeps every
component whole. Components come from alternating star contractions on those
links, each round written to the shared folder.

Defined results: null counts as empty; a text without words has fingerprint
zero and links like any other; texts shorter than a shingle are one shingle.
Null doc_ids are grouped like others but never name a component unless a
component has no other. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, looked_up, mapped, pick, written

#: Width of the six blocks, from the lowest bit up.
BLOCKS = (11, 11, 11, 11, 10, 10)
SEED = 42
#: Fingerprints in a bucket from which it is split again.
HEAVY = 2048
#: Fingerprints that one second-level bucket can hold at all.
BOUND = 1 << 18


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of the word shingles of one text, repeats included: lower-cased ASCII, words between ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[:-1]]]
    digest, ends = xxhash.xxh64_intdigest, ends[width - 1 :] or [len(joined)]
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends)), np.uint64, len(ends))


def majority(hashes: np.ndarray) -> np.ndarray:
    """The words of the bits that are set in over half the rows of an (n, k) array of 64-bit words."""
    ones, n = np.zeros(hashes.shape[1] * 64, np.int64), len(hashes)
    for at in range(0, n, 255):  # as many as a byte can count
        part = np.ascontiguousarray(hashes[at : at + 255]).astype("<u8", copy=False)
        ones += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > n, bitorder="little").view("<u8")


def fingerprint(text: str | None, width: int = 3) -> int:
    """The SimHash of one text."""
    hashes = shingle_hashes(text, width)
    return int(majority(hashes.reshape(-1, 1))[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            fp = np.fromiter((fingerprint(texts[i].as_py(), width) for i in range(len(texts))), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    rows = pick(docs, "doc_id", "text")
    return mapped(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def _bits(value: Column, spans: list[tuple[int, int]]) -> Column:
    """The bits of value at (place, width) spans, packed side by side."""
    out, at = F.lit(0).cast("long"), 0
    for place, width in spans:
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(value, place).bitwiseAND(F.lit((1 << width) - 1)), at))
        at += width
    return out


def _spans(choice: tuple[int, ...]) -> list[tuple[int, int]]:
    starts = [sum(BLOCKS[:i]) for i in range(len(BLOCKS))]
    return [(starts[i], BLOCKS[i]) for i in choice]


def _cut(spans: list[tuple[int, int]], parts: int = 6) -> list[list[int]]:
    """The bits of spans dealt into so many blocks, one by one."""
    bits = [p + i for p, w in spans for i in range(w)]
    return [bits[i::parts] for i in range(parts)]


CHOICES = list(combinations(range(6), 3))


def _keys(fp: Column) -> Column:
    """One key for each choice of three blocks; the choice stands above the bits."""
    return F.array([_bits(fp, _spans(c)).bitwiseOR(F.lit(i << 40)) for i, c in enumerate(CHOICES)])


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, fp) members of large buckets, the second-level keys: three of six blocks of the open bits beside the first key."""
    names, span = ["key", "sub", "fp"], np.uint64((1 << 40) - 1)
    for batch in batches:
        key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        first = key >> 40
        for i, c in enumerate(CHOICES):
            own = np.flatnonzero(first == i)
            if not len(own):
                continue
            held, bits = key[own].view(np.uint64) & span, fp[own]
            parts = [_packed(bits.view(np.uint64), block) for block in _cut(_spans(tuple(x for x in range(6) if x not in c)))]
            for j, d in enumerate(CHOICES):
                sub = parts[d[0]] | parts[d[1]] << np.uint64(8) | parts[d[2]] << np.uint64(16)
                whole = held | np.uint64((i * 20 + j) << 40)
                yield pa.RecordBatch.from_arrays([pa.array(whole.view(np.int64)), pa.array(sub.view(np.int64)), pa.array(bits)], names=names)


def _packed(fp: np.ndarray, places: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.uint64)
    for at, place in enumerate(places):
        out |= (fp >> np.uint64(place) & np.uint64(1)) << np.uint64(at)
    return out


def _joined(bucket: np.ndarray, fp: np.ndarray, tiers: tuple[int, ...]) -> tuple[list[int], list[int]]:
    """Row pairs of a spanning forest of the links within the last tier's bits, bucket by bucket, nearer ones first.

    bucket has a number for each row, equal rows together; fp has a row of 64-bit words for each row.
    tiers are growing distances: links within one are taken before those within the next.
    """
    n = len(fp)
    root = np.arange(n)
    left: list[int] = []
    right: list[int] = []
    for most in tiers:
        live = np.arange(n)
        for step in range(1, n):
            live = live[live + step < n]
            live = live[bucket[live] == bucket[live + step]]
            if not len(live):
                break
            far = live + step
            ask = root[live] != root[far]
            if not ask.any():
                continue
            some, other = live[ask], far[ask]
            near = np.bitwise_count(fp[some] ^ fp[other]).sum(axis=1) <= most
            for a, b in zip(some[near].tolist(), other[near].tolist()):
                ra, rb = _root(root, a), _root(root, b)
                if ra != rb:
                    root[max(ra, rb)] = min(ra, rb)
                    left.append(a)
                    right.append(b)
            if near.any():
                while not np.array_equal(root, up := root[root]):
                    root = up
    return left, right


def _joined_dense(fp: np.ndarray, most: int) -> tuple[list[int], list[int]]:
    """Row pairs of a spanning forest of one bucket of distinct fingerprints that differ in few places: partners are looked up, not compared.

    Each choice of up to ``most`` of the places in which the bucket differs at all pairs every fingerprint with one other
    at most. For 18 places and three bits that are 987 searches, whatever the size.
    """
    order = np.argsort(fp, kind="stable")
    fp = fp[order]
    varying = int(np.bitwise_or.reduce(fp ^ fp[0]))
    places = [i for i in range(64) if varying >> i & 1]
    root = np.arange(len(fp))
    left: list[int] = []
    right: list[int] = []
    for k in range(1, most + 1):
        for choice in combinations(places, k):
            other = fp ^ np.uint64(sum(1 << i for i in choice))
            low = np.flatnonzero(fp < other)
            at = np.minimum(np.searchsorted(fp, other[low]), len(fp) - 1)
            there = fp[at] == other[low]
            low, at = low[there], at[there]
            apart = root[low] != root[at]
            for a, b in zip(low[apart].tolist(), at[apart].tolist()):
                ra, rb = _root(root, a), _root(root, b)
                if ra != rb:
                    root[max(ra, rb)] = min(ra, rb)
                    left.append(int(order[a]))
                    right.append(int(order[b]))
            if apart.any():
                while not np.array_equal(root, up := root[root]):
                    root = up
        if not root.any():
            break
    return left, right


def _root(root: np.ndarray, a: int) -> int:
    while root[a] != a:
        root[a] = root[root[a]]
        a = root[a]
    return a


def _linker(most: int, heavy: int):
    """Streams sorted (key, sub, fp) rows: links of small buckets as (a, b, 0); members of larger ones as (key, fp, 1)."""

    def done(rows: np.ndarray) -> Iterator[tuple]:
        key, sub, fp = rows
        edge = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])])
        size = np.diff(np.r_[edge, len(key)])
        own, bucket = np.repeat(size, size), np.repeat(np.arange(len(size)), size)
        for start, n in zip(edge[(size > HEAVY) & (size <= heavy)].tolist(), size[(size > HEAVY) & (size <= heavy)].tolist()):
            ids = fp[start : start + n]
            a, b = _joined_dense(ids.view(np.uint64), most)
            yield ids[a], ids[b], np.zeros(len(a), np.int8)
        for again, chosen in ((0, (own > 1) & (own <= min(heavy, HEAVY))), (1, own > heavy)):
            if not chosen.any():
                continue
            if again:
                yield key[chosen], fp[chosen], np.ones(chosen.sum(), np.int8)
            else:
                ids = fp[chosen]
                a, b = _joined(bucket[chosen], ids.view(np.uint64).reshape(-1, 1), (most,))
                yield ids[a], ids[b], np.zeros(len(a), np.int8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((3, 0), np.int64)
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            rest = np.concatenate([rest, rows], axis=1)
            if not rest.shape[1]:
                continue
            open_ = (rest[0] == rest[0, -1]) & (rest[1] == rest[1, -1])  # the last bucket may go on
            cut = int(np.argmax(open_))
            if open_[cut:].sum() > heavy + 1 and heavy < BOUND:  # known to be large: its rows need not wait
                yield from _batches(done(rest[:, :cut]) if cut else ())
                yield from _batches([(rest[0, cut:-heavy - 1], rest[2, cut:-heavy - 1], np.ones(rest.shape[1] - cut - heavy - 1, np.int8))])
                rest = rest[:, -heavy - 1 :]
            elif cut:
                yield from _batches(done(rest[:, :cut]))
                rest = rest[:, cut:]
        if rest.shape[1]:
            yield from _batches(done(rest))

    return run


def _batches(found) -> Iterator[pa.RecordBatch]:
    for a, b, again in found:
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(again)], names=["a", "b", "again"])


def _linked(buckets: DataFrame, most: int, heavy: int) -> DataFrame:
    by = ("key", "sub", "fp")
    return mapped(buckets.select(*by).repartition("key", "sub").sortWithinPartitions(*by), _linker(most, heavy), "a long, b long, again tinyint")


def links(nodes: DataFrame, most: int = 3, heavy: int = HEAVY) -> DataFrame:
    """Links (a < b) between the distinct fingerprints of ``nodes`` (column fp) that keep every component whole."""
    if not 0 <= most <= 3:
        raise ValueError("six blocks of which three agree cover up to three differing bits")
    rows = nodes.select("fp", F.explode(_keys(F.col("fp"))).alias("key"))
    total = nodes.count() * len(CHOICES)
    least = max(heavy, total // 20_000)  # so there are 20,000 such keys at most
    hot = written(rows.groupBy("key").count().filter(F.col("count") > least).select("key"))
    zero = F.lit(0).cast("long").alias("sub")
    first = written(_linked(rows.join(F.broadcast(hot), "key", "left_anti").select("key", zero, "fp"), most, heavy))
    large = first.filter("again = 1").select(F.col("a").alias("key"), F.col("b").alias("fp")).unionByName(rows.join(F.broadcast(hot), "key", "left_semi").select("key", "fp"))
    finer = mapped(large.select("key", "fp"), _finer, "key long, sub long, fp long")
    second = _linked(finer, most, BOUND)
    found = first.filter("again = 0").select("a", "b").unionByName(second.select("a", "b"))
    return written(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def components(edges: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """vertex and root, the smallest vertex of its component, for every vertex of ``edges`` (a, b).

    Large-star and small-star rounds in turn, until nothing changes. A vertex of
    many edges is one row of the table of minima, and its edges meet that row by
    a lookup that sets hot vertices apart.
    """
    edges, before = written(edges.select("a", "b")), None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")))
        large = looked_up(both.filter("v > u"), least, "u", "n", bound).select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b").distinct()
        large = written(large)
        lower = written(large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"), F.count(F.lit(1)).alias("n")))
        kept = looked_up(large.select(F.col("b").alias("u"), F.col("a").alias("v")), lower, "u", "n", bound)
        small = kept.filter("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(lower.select(F.col("m").alias("a"), F.col("u").alias("b")))
        edges = written(small.filter("a <> b").distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("b").alias("vertex"), F.col("a").alias("root"))
        before = state


def grouped(docs: DataFrame, width: int = 3, most: int = 3, heavy: int = HEAVY, bound: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, fp (signed long) and component_id, the smallest doc_id of the component, of every document."""
    rows = written(fingerprints(docs, width))
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")))
    found = links(nodes, most, heavy)
    if found.isEmpty():
        named = nodes.select("fp", F.col("low").alias("component_id"), "n")
    else:
        stars = components(found, bound)
        whole = written(stars.unionByName(stars.select(F.col("root").alias("vertex"), "root").distinct()).join(nodes, F.col("vertex") == F.col("fp")).select("fp", "root", "low", "n"))
        lows = written(whole.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("members")))
        linked = looked_up(whole, lows, "root", "members", bound).select("fp", "component_id", "n")
        alone = nodes.join(whole.select("fp"), "fp", "left_anti").select("fp", F.col("low").alias("component_id"), "n")
        named = linked.unionByName(alone)
    return looked_up(rows, written(named), "fp", "n", bound).select("doc_id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    """A signed long as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
