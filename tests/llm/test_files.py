"""Shards, mixing, archives and the pipeline."""

from __future__ import annotations

import hashlib
import io
import math
import random
import struct
import zipfile
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from epochal.llm import mixing, sharding, warc
from epochal.llm.shared import shared_dir, written

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], DOCS)


# --- shards ---


def brute_shards(rows, n):
    data = sorted(((i is not None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), i) for i, t in rows))
    total, done, out, slots = sum(x[2] for x in data), 0, [], Counter()
    for _, _, size, crc, i in data:
        shard = min(n - 1, (2 * done + size) * n // (2 * total))
        out.append((i, size, crc, shard, slots[shard]))
        slots[shard] += 1
        done += size
    return Counter(out)


@pytest.mark.parametrize("n", [1, 3, 8])
def test_shards(spark, n):
    r = random.Random(n)
    rows = [(r.choice([None, *range(400)]), r.choice([None, "", "é" * r.randint(0, 50), "x" * r.randint(0, 500)])) for _ in range(500)]
    rows += [(7, "same")] * 30 + [(401, "y" * 20_000)]
    table = docs(spark, [(i, t, "s") for i, t in rows]).repartition(5).withColumns({c: F.lit("z") for c in ("part", "size", "shard", "slot", "bytes")})
    got = sharding.byte_shards(table.select("*", F.lit("q").alias("TEXT")), n).collect()
    assert Counter((x.doc_id, x["size"], x.text_crc32, x.shard, x.slot) for x in got) == brute_shards(rows, n)


def test_shards_are_balanced_and_written(spark, tmp_path):
    rows = [(i, "w" * (i * 37 % 101), "s") for i in range(2000)]
    out = sharding.byte_shards(docs(spark, rows), 8).collect()
    size = Counter()
    for x in out:
        size[x.shard] += x["size"]
    assert max(size.values()) - min(size.values()) <= 2 * 102
    sharding.write_shards(docs(spark, [*rows, (None, None, None)]), f"{tmp_path}/s", 8)
    back = spark.read.parquet(f"{tmp_path}/s")
    assert back.count() == 2001 and back.select("shard").distinct().count() == 8
    assert sharding.byte_shards(docs(spark, [])).count() == 0
    with pytest.raises(ValueError, match="n_shards"):
        sharding.byte_shards(docs(spark, []), 0)


# --- mixing ---


def corpus(sizes):
    r = random.Random(5)
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((i, " ".join(["w"] * r.randint(1, 60)) + f" {i}", source))
            i += 1
    return rows


SIZES = {"big": 900, "mid": 200, "small": 60, None: 30}


def shares(rows):
    t = Counter()
    for _, text, s in rows:
        t[s] += len(text.split()) + 1
    return {s: n / sum(t.values()) for s, n in t.items()}, t


@pytest.mark.parametrize("repeats", [1.0, 2.0, 5.0, 1000.0])
def test_repetition_limit(spark, repeats):
    rows = corpus(SIZES)
    table = docs(spark, rows)
    p, tokens = shares(rows)
    plan = mixing.planned(table, mixing.Target(max_repeats=repeats, block_tokens=500))
    ratio = max(p.values()) / min(p.values())
    want = 0.0 if ratio <= repeats else 1 - math.log(repeats) / math.log(ratio)
    assert plan.exponent == pytest.approx(want, abs=1e-6)
    z = sum(x**plan.exponent for x in p.values())
    got = mixing.mixed(table, mixing.Target(max_repeats=repeats, block_tokens=500)).collect()
    used, copies = Counter(), Counter()
    for x in got:
        used[x.source] += x.tokens
        copies[x.doc_id] += 1
        assert x.weight == pytest.approx(p[x.source] ** plan.exponent / z, abs=1e-6)
    assert set(copies) == {i for i, _, _ in rows}  # no document is left out
    for s, n in tokens.items():
        goal = n * (max(p.values()) / p[s]) ** (1 - plan.exponent)
        assert goal - 62 <= used[s] <= goal + 1
        own = {copies[i] for i, _, q in rows if q == s}
        assert max(own) - min(own) <= 1 and max(own) <= math.ceil(repeats + 1e-9)
    real = Counter(x.doc_id for x in mixing.realised(table, mixing.Target(max_repeats=repeats, block_tokens=500)).collect())
    assert real == copies


def test_entropy_and_budget(spark):
    rows = corpus(SIZES)
    p, tokens = shares(rows)
    top, own = math.log(len(p)), -sum(x * math.log(x) for x in p.values())
    target = (top + own) / 2
    plan = mixing.planned(docs(spark, rows), mixing.Target(entropy=target))
    z = sum(x**plan.exponent for x in p.values())
    w = [x**plan.exponent / z for x in p.values()]
    assert -sum(x * math.log(x) for x in w) == pytest.approx(target, abs=1e-5)
    assert mixing.planned(docs(spark, rows), mixing.Target(entropy=top + 1)).exponent == 0
    half = sum(tokens.values()) // 2
    got = mixing.mixed(docs(spark, rows), mixing.Target(max_repeats=3, budget_tokens=half, block_tokens=300)).collect()
    assert half - 62 * len(p) <= sum(x.tokens for x in got) <= half + len(p)


def test_targets_that_no_weights_meet_are_refused(spark):
    rows = corpus(SIZES)
    p, tokens = shares(rows)
    own = -sum(x * math.log(x) for x in p.values())
    low = mixing.planned(docs(spark, rows), mixing.Target(entropy=own / 3))  # sharper than the corpus itself
    z = sum(x**low.exponent for x in p.values())
    w = [x**low.exponent / z for x in p.values()]
    assert low.exponent > 1 and -sum(x * math.log(x) for x in w) == pytest.approx(own / 3, abs=1e-4)
    twins = corpus({"a": 300, "b": 300})
    equal = min(shares(twins)[0].values()) == max(shares(twins)[0].values())
    for target, data in ((mixing.Target(entropy=-0.1), rows), (mixing.Target(max_repeats=1.5, budget_tokens=33 * sum(tokens.values())), rows), *([(mixing.Target(entropy=0.1), twins)] * equal)):
        with pytest.raises(mixing.Unreachable):
            mixing.planned(docs(spark, data), target)
    just = mixing.planned(docs(spark, rows), mixing.Target(max_repeats=2, budget_tokens=2 * sum(tokens.values())))
    assert just.exponent == pytest.approx(1.0)


def test_the_stream_is_interleaved_and_repeatable(spark):
    rows, target = corpus(SIZES), mixing.Target(max_repeats=3, block_tokens=300)
    first = mixing.mixed(docs(spark, rows), target).collect()
    again = mixing.mixed(docs(spark, rows).repartition(7), target).collect()
    assert Counter(map(tuple, first)) == Counter(map(tuple, again))
    halves = defaultdict(lambda: [0, 0])
    for x in first:
        halves[x.source][x["at"] > 0.5] += x.tokens
    for a, b in halves.values():
        assert 0.25 < a / (a + b) < 0.75
    passes = defaultdict(list)
    for x in sorted(first, key=lambda x: x["at"]):
        if x.source == "small":
            passes[x["pass"]].append(x.doc_id)
    assert passes[0] != passes[1] and sorted(passes[0]) == sorted(passes[1])  # another permutation


def test_odd_corpora(spark):
    assert mixing.mixed(docs(spark, [])).count() == 0 and mixing.realised(docs(spark, [])).count() == 0
    odd = docs(spark, [(None, None, None), (1, "", "a"), (1, "", "a"), (2, "x " * 100_000, "a")]).withColumns({c: F.lit("z") for c in ("name", "h", "passes", "weight")})
    assert {x.doc_id for x in mixing.mixed(odd).collect()} == {None, 1, 2}
    real = mixing.realised(odd.select("*", F.lit("q").alias("SOURCE")))
    assert real.columns == [*odd.columns, "SOURCE"] and real.filter("h = 'z'").count() == real.count() >= 4


# --- archives ---


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def brute_records(rows):
    last = {}
    for i, _, h in rows:
        h = h or ""
        if len(h.encode()) >= 1000 and i is not None:
            last[h] = max(last.get(h, i), i)
    out = Counter()
    for i, _, h in rows:
        raw, top = (h or "").encode(), last.get(h or "")
        again = top is not None and i != top
        out[i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", top if again else None] += 1
    return out


BIG, SAME = "é" * 600, "<p>" + "x" * 2000
PAGES = [(1, "http://a/1", SAME), (2, "http://a/2", SAME), (9, None, SAME), (3, "http://a\r\nX: y", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (None, "u", SAME), (None, "u", BIG), (7, "u", "\r\n\r\nWARC/1.1 " * 200), (7, "u", "\r\n\r\nWARC/1.1 " * 200), (8, "u", "y" * 999), (10, "u", "y" * 999), (11, "é ü", BIG)]


@pytest.mark.parametrize(("zip64", "bound", "archive_bytes"), [(False, 10_000, 1 << 26), (True, 10_000, 1 << 26), (False, 0, 1)])
def test_archives(spark, zip64, bound, archive_bytes):
    table = pages(spark, PAGES).repartition(3).withColumns({c: F.lit("z") for c in ("key", "digest", "keeper", "payload")})
    got = warc.archived(table.select("*", F.lit("q").alias("HTML")), archive_bytes=archive_bytes, zip64=zip64, bound=bound).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == brute_records(PAGES)
    for r in got:
        assert (r.payload is None) == (r.record_type == "revisit")
    assert Counter(bytes(r.payload) for r in got if r.payload is not None)[b""] == 2


def test_empty_pages(spark):
    assert warc.archived(pages(spark, [])).count() == 0


def archive(records, **more) -> bytes:
    out = io.BytesIO()
    w = warc.ArchiveWriter(out, **more)
    for r in records:
        w.add(r)
    w.close()
    return out.getvalue()


def record(i, payload: bytes):
    return warc.Record(i, f"http://x/{i}", "response", len(payload), hashlib.sha1(payload).hexdigest(), None, payload)


@pytest.mark.parametrize("zip64", [False, True])
def test_reader_against_zipfile(zip64):
    data = archive([record(i, bytes([i]) * (50 * i)) for i in range(40)], zip64=zip64, member_bytes=700)
    reader = warc.ArchiveReader(warc.Bytes(data))
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert set(z.namelist()) == set(reader.members) and len(reader.members) > 4
        for name in z.namelist():
            assert reader.read(name) == z.read(name)
            assert reader.read(name, 3, 5) == z.read(name)[3:8]
    assert [(r.page_id, r.payload) for r in reader.records()] == [(i, bytes([i]) * (50 * i)) for i in range(40)]


def test_zip64_end_record():
    """An archive whose end record is full, so that the ZIP64 one must be read."""
    data = archive([record(1, b"hello")])
    at = data.rfind(b"PK\x05\x06")
    entries, size, place = struct.unpack("<10xHII", data[at : at + 20])
    end64 = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, entries, entries, size, place)
    locator = b"PK\x06\x07" + struct.pack("<IQI", 0, at, 1)
    full = b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 5) + b"PK\x05\x06"[:4] + b"x"
    reader = warc.ArchiveReader(warc.Bytes(data[:at] + end64 + locator + full))
    assert [r.payload for r in reader.records()] == [b"hello"]
    with pytest.raises(ValueError, match="ZIP64"):
        warc.ArchiveReader(warc.Bytes(data[:at] + full))


def test_broken_archives():
    data = archive([record(1, b"hello" * 100)])
    for bad in (b"", data[:-30], b"no zip" * 100):
        with pytest.raises((ValueError, struct.error)):
            list(warc.ArchiveReader(warc.Bytes(bad)).records())
    wrong = archive([record(1, b"hello")._replace(digest="0" * 40)])
    with pytest.raises(ValueError, match="digest"):
        list(warc.ArchiveReader(warc.Bytes(wrong)).records())
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("indexes/index.jsonl", "x" * 1000)
    with pytest.raises(ValueError, match="compressed"):
        list(warc.ArchiveReader(warc.Bytes(packed.getvalue())).records())


# --- the pipeline ---


def test_pipeline(spark):
    r = random.Random(8)
    words = ["the", "of", "and", *["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(800)]]
    clean = [" ".join(r.choice(words) for _ in range(200)) + "." for _ in range(40)]
    near = clean[3].split()
    near[100] = "changed"
    rows = [(i, t, "big" if i % 4 else "small") for i, t in enumerate(clean)]
    rows += [(100, clean[0], "big"), (101, clean[1].replace(" ", "  "), "big"), (102, " ".join(near), "big"), (103, "too short", "big"), (104, None, None), (105, "a b c " * 100, "big")]
    table = docs(spark, rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "simhash_near_dedup", "temperature_mix", "byte_bpe"] and corpus_pipeline.ORACLE_SQL is None
    kept = []
    df = table
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = written(stage(spark, df, ""))
        assert df.columns == table.columns
        kept.append({x.doc_id for x in df.collect()})
    assert kept[0] == {*range(40), 100, 101, 102}
    assert kept[1] == {*range(40), 102} - {1} | {101}  # of equal texts the longest stays
    assert kept[2] == kept[1] - {102} == kept[3]
    out = corpus_pipeline.STAGES[-1][1](spark, df, "")
    assert out.count() == df.count() and out.filter("not round_trip or n_tokens = 0").count() == 0
    folder = shared_dir(spark)
    table.write.parquet(f"{folder}/documents.parquet")
    whole = corpus_pipeline.run(spark, folder)
    assert {x.doc_id for x in whole.select("doc_id").collect()} == kept[3] and whole.columns == out.columns


def test_hadoop_schemes_are_mapped(monkeypatch):
    asked = []

    class Stores:
        class FileSystem:
            @staticmethod
            def from_uri(uri):
                asked.append(uri)
                return None, uri

    monkeypatch.setattr(warc, "fs", Stores)
    for uri in ("s3a://bucket/x", "hdfs://name:9000/x", "file:///x", "/x"):
        warc.opened(uri)
    assert asked == ["s3://bucket/x", "hdfs://name:9000/x", "file:///x", "/x"]
    with pytest.raises(ValueError, match="ftp"):
        warc.opened("ftp://host/x")


def test_page_ids_may_be_strings(spark):
    rows = [("a1", "u", "x" * 2000), ("b2", "u", "x" * 2000), (None, "u", "y"), ("7", None, None)]
    got = warc.archived(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()
    assert {(r.page_id, r.record_type, r.refers_to) for r in got} == {("a1", "revisit", "b2"), ("b2", "response", None), (None, "response", None), ("7", "response", None)}
