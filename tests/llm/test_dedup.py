"""Exact dedup, SimHash groups and near-dedup against brute force, with nulls, ties, repeated rows and clashing names."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from epochal.llm import exact_dedup, near_dedup, simhash
from epochal.llm.shared import looked_up, pick, removed, written

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(3)
WORDS = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(3000)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)


def prose(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) for _ in range(n))


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def brute_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append((-len(t or ""), i is None, i or 0, i))
    out = Counter()
    for i, t in rows:
        g = groups[norm(t)]
        best = min(g)
        out[i, best[3], len(g), hashlib.sha256(norm(t).encode()).hexdigest()] += 1
    return out


CASES = [(1, "a b c"), (2, "abc"), (3, " a\tb\nc "), (4, None), (5, ""), (6, " \x0b\x0c\r\n"), (7, "x"), (7, "x"), (None, "x"), (8, "é "), (9, "é"), (10, "y" * 300_000), (11, "y " * 300_000), (None, "lone")]


@pytest.mark.parametrize(("digest_bytes", "bound"), [(32, 10_000), (32, 0), (1, 10_000), (1, 0), (0, 10_000)])
def test_exact_groups(spark, digest_bytes, bound):
    more = [(100 + i, f"text {i % 37}" + " " * (i % 3)) for i in range(300)]
    rows = CASES + more
    got = exact_dedup.exact_groups(docs(spark, rows).repartition(3), digest_bytes, bound).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute_groups(rows)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({norm(t) for _, t in rows})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_index_over_several_flushes(spark):
    index = exact_dedup.DigestIndex(spark)
    index.flush(docs(spark, [(5, "a"), (6, "b")]))
    index.flush(docs(spark, [(1, "a"), (2, "c c")]))
    index.flush(docs(spark, [(9, "cc")]))
    index.compact()
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in index.resolve().collect()) == [(1, 1, True), (2, 2, True), (5, 1, False), (6, 6, True), (9, 2, False)]
    index.clear()


def test_runs_and_levels_are_sorted_and_have_filters(spark):
    import pyarrow.parquet as pq

    index = exact_dedup.DigestIndex(spark)
    index.flush(docs(spark, [(i, f"t{i}") for i in range(100)]).coalesce(1))
    index.compact()
    for table in (index.runs[0], index.level.coalesce(1)):
        digests = [r.digest for r in table.collect()]
        assert table is not index.runs[0] or digests == sorted(digests)
    file = index.runs[0].inputFiles()[0].removeprefix("file://")
    plain = pq.ParquetFile(file).metadata
    assert sum(plain.row_group(0).column(i).total_compressed_size for i in range(plain.num_columns)) + 1_000_000 < len(open(file, "rb").read())  # the Bloom filter's bytes
    index.clear()


def test_a_level_is_an_input_of_the_next_compaction(spark):
    """Earlier runs are not read again: they are gone."""
    index = exact_dedup.DigestIndex(spark)
    index.flush(docs(spark, [(i, f"t{i % 50}") for i in range(100)]))
    assert index.compact().count() == 50
    removed(spark, f"{index.root}/run-0")
    index.flush(docs(spark, [(1000 + i, f"t{i}") for i in range(60)]))
    level = {r.digest: (r.keep.keep_id, r.group_size) for r in index.compact().collect()}
    assert Counter(level.values()) == Counter({**{(i, 3): 1 for i in range(50)}, **{(1050 + i, 1): 1 for i in range(10)}})
    index.clear()


@pytest.mark.parametrize("bound", [10_000, 0])
def test_only_hits_are_verified_and_joined(spark, bound):
    """Of 4000 texts with 40 in groups, a handful beyond these passes the filter; no others reach the aggregation of texts."""
    rows = [(i, f"text number {i}") for i in range(4000)] + [(9000 + i, f"text number {i}") for i in range(20)]
    index = exact_dedup.DigestIndex(spark, bound=bound)
    index.flush(docs(spark, rows))
    found, n, may = index.hits()
    passed = exact_dedup.pick(docs(spark, rows), "doc_id", "text").select(F.unhex(F.sha2(exact_dedup.normalised(F.col("text")), 256)).alias("digest")).filter(may.may(F.col("digest"))).count()
    assert n == 20 and 40 <= passed < 120
    texts = index._texts_of(found.select("digest"), n, may)
    assert texts.count() == 40
    known = index.known(docs(spark, [(1, "text number 7"), (2, "new"), (3, "other"), (4, None)]))
    assert [(r.doc_id, r.keep_id) for r in known.collect()] == [(1, 7)]
    assert sum(r.group_size == 2 for r in index.resolve().collect()) == 40
    index.clear()


def test_filters_never_turn_a_member_away(spark):
    for n, words in ((0, 64), (5, 64), (20_000, 4096)):
        digests = spark.range(n).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
        f = exact_dedup.Filter(digests, n, exact_dedup.shared_dir(spark))
        assert f.words >= words and digests.filter(f.may(F.col("digest"))).count() == n
        others = spark.range(n, n + 20_000).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
        assert others.filter(f.may(F.col("digest"))).count() < 1200


@pytest.mark.parametrize("bound", [10_000, 0])
def test_exact_dedup_keeps_one_of_each(spark, bound):
    got = exact_dedup.exact_dedup(docs(spark, CASES), bound)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    rows = got.collect()
    assert Counter(norm(r.text) for r in rows) == Counter({norm(t) for _, t in CASES})
    assert {r.doc_id for r in rows if norm(r.text) == "abc"} == {3}


def test_empty_tables(spark):
    none = docs(spark, [])
    assert exact_dedup.exact_groups(none).count() == 0 and exact_dedup.exact_dedup(none).count() == 0
    assert simhash.grouped(none).count() == 0 and near_dedup.near_dedup(none).count() == 0


def test_clashing_names(spark):
    extra = docs(spark, [(1, "a b"), (2, "ab"), (3, "c")]).withColumns({n: F.lit("z") for n in ("digest", "kept", "keep_id", "row", "c0", "fp", "key", "norm", "group_size", "whole", "f0")})
    twin = extra.select("*", F.lit("q").alias("TEXT"), F.lit(1).alias("Doc_Id"))
    assert sorted((r.doc_id, r.keep_id) for r in exact_dedup.exact_groups(twin).collect()) == [(1, 1), (2, 1), (3, 3)]
    for out in (exact_dedup.exact_dedup(twin), near_dedup.near_dedup(exact_dedup.exact_dedup(extra))):
        assert out.columns[: len(extra.columns)] == extra.columns and out.count() == 2
    assert simhash.grouped(twin).count() == 3
    with pytest.raises(ValueError, match="missing"):
        pick(extra, "nope")


# --- SimHash ---


def brute_fingerprint(t, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))


def brute_components(pairs):
    """doc_id to smallest doc_id reachable over fingerprints within three bits."""
    root = list(range(len(pairs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            if (pairs[i][1] ^ pairs[j][1]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(pairs):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return Counter((d, low.get(find(i))) for i, (d, _) in enumerate(pairs))


@pytest.mark.parametrize("text", ["", None, " \t\r\n", "One", "one TWO", "a b c d", "É é Été ÀB  x y", "x " * 5000, "w\x1cz q r\x85s"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_fingerprint_is_sparks_hash(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % 2**64 == brute_fingerprint("a b c")


@pytest.mark.parametrize(("heavy", "bound"), [(2048, 100_000), (2, 100_000), (4, 0)])
def test_groups(spark, heavy, bound):
    r = random.Random(heavy)
    base = [prose(r, 200) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(60):
        words = base[i % 5].split()
        for _ in range(r.randint(0, 2)):
            words[r.randrange(len(words))] = r.choice(WORDS)
        rows.append((100 + i, " ".join(words)))
    rows += [(1000, None), (999, ""), (None, "  "), (1001, base[0].upper()), (None, base[1])]
    got = simhash.grouped(docs(spark, rows).repartition(3), heavy=heavy, bound=bound).collect()
    want = [(d, brute_fingerprint(t)) for d, t in rows]
    assert Counter((x.doc_id, x.fp % 2**64) for x in got) == Counter(want)
    assert Counter((x.doc_id, x.component_id) for x in got) == brute_components(want)


@pytest.mark.parametrize(("heavy", "most"), [(2048, 3), (3, 3), (16, 2), (3, 0)])
def test_links_of_planted_fingerprints(spark, heavy, most):
    """Dense clusters of fingerprints: chains and balls within few bits, which fill the same blocks."""
    r = np.random.default_rng(heavy + most)
    fps = set()
    for _ in range(6):
        centre = int(r.integers(0, 2**63)) * 2 + 1
        for _ in range(60):
            x = centre
            for b in r.integers(0, 64, r.integers(0, 7)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    nodes = written(spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp long"))
    edges = simhash.links(nodes, most, heavy)
    for e in edges.collect():
        assert ((e.a % 2**64) ^ (e.b % 2**64)).bit_count() <= most and e.a < e.b
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= most:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    want = defaultdict(set)
    for x in fps:
        want[find(x)].add(x)
    got = defaultdict(set)
    if not edges.isEmpty():
        for row in simhash.components(edges, bound=5).collect():
            got[row.root].update({row.vertex % 2**64, row.root % 2**64})
    assert {frozenset(s) for s in got.values()} == {frozenset(s) for s in want.values() if len(s) > 1}


@pytest.mark.parametrize(("n", "places", "most"), [(3000, 16, 3), (400, 18, 3), (50, 18, 3), (5000, 13, 1), (30, 14, 2)])
def test_dense_buckets(n, places, most):
    """Fingerprints that differ in few places: the forest joins what comparing all with all joins."""
    r = np.random.default_rng(n)
    at = r.choice(64, places, replace=False)
    low = r.choice(1 << places, n, replace=False)
    fp = np.array([sum(1 << int(b) for i, b in enumerate(at) if x >> i & 1) for x in low.tolist()], np.uint64) ^ np.uint64(r.integers(0, 2**63))
    found = simhash._joined_dense(fp, most)
    want = simhash._joined(np.zeros(n, np.int64), fp.reshape(-1, 1), (most,))

    def classes(pairs):
        root = list(range(n))
        for a, b in zip(*pairs):
            ra, rb = simhash._root(root, a), simhash._root(root, b)
            root[max(ra, rb)] = min(ra, rb)
        return [simhash._root(root, i) for i in range(n)]

    assert classes(found) == classes(want) and len(found[0]) == len(want[0])
    assert all((int(fp[a]) ^ int(fp[b])).bit_count() <= most for a, b in zip(*found))


def test_a_full_bucket_is_quick():
    left, _ = simhash._joined_dense(np.arange(1 << 18, dtype=np.uint64), 3)
    assert len(left) == (1 << 18) - 1


def test_components_of_a_long_chain(spark):
    n = 200
    order = random.Random(1).sample(range(n), n)
    edges = spark.createDataFrame([(min(a, b), max(a, b)) for a, b in zip(order, order[1:])], "a long, b long")
    got = {r.vertex: r.root for r in simhash.components(edges).collect()}
    assert got == {v: 0 for v in range(1, n)}


def test_large_buckets_keep_every_link(spark):
    """The linker gives few links, never all pairs."""
    fps = sorted({(1 << i) | (1 << j) for i in range(40) for j in range(40)})
    nodes = written(spark.createDataFrame([(x,) for x in fps], "fp long"))
    edges = simhash.links(nodes, 3, heavy=64)
    assert edges.count() <= 20 * 2 * len(fps)
    assert simhash.components(edges).select("root").distinct().count() == 1


# --- near-dedup at a similarity ---


def shingles(t, width=5):
    w = t.lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}


def near_pairs(text, least):
    """(similarity, a, b) of all pairs that share a shingle, from the least similarity on."""
    sets, at = {i: shingles(t) for i, t in text.items()}, defaultdict(list)
    for i, s in sets.items():
        for x in s:
            at[x].append(i)
    shared = Counter((a, b) for v in at.values() for k, b in enumerate(sorted(v)) for a in sorted(v)[:k])
    found = ((n / (len(sets[a]) + len(sets[b]) - n), a, b) for (a, b), n in shared.items())
    return [x for x in found if x[0] >= least]


def check_kept(text, kept, missed=0.0):
    """One of each group at the similarity stays; nothing goes that no partner of 0.65 is there for. The share of pairs at 0.8 left whole."""
    pairs = near_pairs(text, 0.65)
    root = {i: i for i in text}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for _, a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    alone = set(text) - {i for _, a, b in pairs for i in (a, b)}
    assert alone <= kept and {find(i) for i in kept} == {find(i) for i in text}
    close = [(a, b) for s, a, b in pairs if s >= 0.8]
    both = [p for p in close if kept.issuperset(p)]
    assert len(both) <= missed * len(close), (len(both), len(close))
    return len(close)


@pytest.mark.parametrize(("heavy", "bound"), [(2048, 100_000), (8, 100_000), (8, 0)])
def test_near_copies_go_and_others_stay(spark, heavy, bound):
    r = random.Random(9)
    shared = prose(r, 60)
    base = [prose(r, r.randint(60, 400)) for _ in range(40)] + [prose(r, 150) + " " + shared for _ in range(30)]
    rows = list(enumerate(base))
    for i in range(40):
        for k in range(3):
            words = base[i].split()
            for _ in range(max(1, len(words) * (k + 1) // 90)):
                words[r.randrange(len(words))] = r.choice(WORDS)
            rows.append((1000 + 40 * k + i, " ".join(words)))
    kept = {x.doc_id for x in near_dedup.near_dedup(docs(spark, rows), heavy=heavy, bound=bound).collect()}
    assert check_kept(dict(rows), kept, 0.02) > 60
    assert {i for i in range(40, 70)} <= kept  # they share a passage only


@pytest.mark.parametrize("heavy", [2048, 8])
def test_large_groups_near_the_limit(spark, heavy):
    """Copies that lie at 0.75 to 0.85 of each other, edited independently."""
    r = random.Random(17)
    rows = []
    for g, edits in enumerate(((4,), (4,), (3, 4, 4, 4), (4, 5), (3, 5), (5,))):
        base = prose(r, 304).split()
        for k in range(60):
            words = list(base)
            for at in r.sample(range(len(words)), edits[k % len(edits)]):
                words[at] = r.choice(WORDS)
            rows.append((1000 * g + k, " ".join(words)))
    kept = {x.doc_id for x in near_dedup.near_dedup(docs(spark, rows), heavy=heavy).collect()}
    assert check_kept(dict(rows), kept, 0.01) > 1000 and len(kept) < 12


def test_large_buckets_of_texts_that_share_a_passage_only(spark):
    """All share the passage's classes; none is alike. Few links, and no text goes."""
    r = random.Random(5)
    passage = prose(r, 60)
    rows = [(i, prose(r, 60) + " " + passage) for i in range(300)]
    kept = {x.doc_id for x in near_dedup.near_dedup(docs(spark, rows), heavy=4).collect()}
    assert kept == set(range(300))


def test_sizes_that_differ_as_far_as_the_similarity_allows(spark):
    """A text that is the beginning of another, of 0.8 or more of its shingles; at most one in fifty is missed."""
    r = random.Random(23)
    sizes = [(n, n + 1) for n in (4, 5, 6, 7, 8, 9, 10, 11)] + [(8, 10), (9, 10), (9, 11), (10, 12), (12, 15), (20, 25), (40, 50), (80, 100), (160, 200), (161, 200), (200, 250), (201, 251), (320, 399), (322, 400), (640, 800), (1281, 1600), (3000, 3750)]
    rows = []
    for i, (a, b) in enumerate(sizes * 6):
        words = [f"{r.randrange(10**9)}" for _ in range(b + 4)]
        rows += [(2 * i, " ".join(words[: a + 4])), (2 * i + 1, " ".join(words))]
    kept = {x.doc_id for x in near_dedup.near_dedup(docs(spark, rows)).collect()}
    assert {i for i in kept if i % 2 == 0} == {2 * i for i in range(len(sizes) * 6)}
    assert len(kept) <= len(sizes) * 6 * 1.02
    exact = {2 * i + 1 for i, (_, b) in enumerate(sizes * 6) if b <= near_dedup.TINY}
    assert not exact & kept  # small ones meet exactly


def test_small_texts_against_brute_force(spark):
    r = random.Random(31)
    words = [f"w{i}" for i in range(9)]
    rows = [(i, " ".join(r.choice(words) if r.random() < 0.1 else words[k % 9] for k in range(r.randint(1, 14)))) for i in range(300)]
    got = near_dedup.near_dedup(docs(spark, rows), bound=0).collect()
    text = dict(rows)
    tiny = {i: t for i, t in text.items() if len(shingles(t)) <= near_dedup.TINY}
    root = {i: i for i in tiny}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = {i: shingles(t) for i, t in tiny.items()}
    for a in tiny:
        for b in tiny:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert len(text) == len(tiny) and {x.doc_id for x in got} == {find(i) for i in tiny}


def test_chances_of_a_bit(spark):
    r = np.random.default_rng(4)
    for n, m, shared in ((9, 9, 8), (20, 22, 17), (100, 120, 95), (300, 310, 260)):
        h = r.integers(0, 2**63, (n + m - shared, 256), dtype=np.uint64) * np.uint64(2) + r.integers(0, 2, (n + m - shared, 256), dtype=np.uint64)
        d = np.bitwise_count(simhash.majority(h[:n]) ^ simhash.majority(h[n - shared :])).sum()
        p = near_dedup.differing(n, m, shared)
        assert abs(d - 256 * 64 * p) < 4 * (256 * 64 * p * (1 - p)) ** 0.5
    table = near_dedup.limits()
    assert near_dedup.may_differ(table, np.array([100, 8, 1000, 10**6, 40]), np.array([126, 11, 1200, 10**6, 50])).tolist()[:2] == [-1, -1]
    assert (near_dedup.may_differ(table, np.arange(9, 3000), np.arange(9, 3000)) > 100).all()
    with pytest.raises(AssertionError):
        check_kept({1: "a b c d e f g", 2: "a b c d e f g"}, {1, 2})


def test_majority_counts_every_row():
    r = np.random.default_rng(8)
    for n in (1, 2, 255, 256, 1000):
        h = r.integers(0, 2**63, (n, 3), dtype=np.uint64)
        bits = ((h[:, :, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).sum(axis=0)
        want = (bits * 2 > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)
        assert (simhash.majority(h) == want.sum(axis=1, dtype=np.uint64)).all()


def test_near_dedup_of_odd_rows(spark):
    rows = [(4, None), (3, ""), (2, "one two"), (1, "one two"), (1, "one two"), (None, "one  TWO"), (5, "z " * 100_000), (6, "z " * 100_001)]
    got = near_dedup.near_dedup(docs(spark, rows), bound=0).collect()
    assert sorted((r.doc_id, (r.text or "")[:3]) for r in got) == [(1, "one"), (3, ""), (5, "z z")]


@pytest.mark.parametrize("bound", [10, 0])
def test_lookup_of_hot_keys(spark, bound):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    index = written(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top")).filter("k % 2 = 0"))
    got = {r.id: r.top for r in looked_up(rows, index, "k", "n", bound).collect()}
    assert got == {i: 2997 if i % 3 == 0 else i if i % 2 == 0 else None for i in range(3000)}
