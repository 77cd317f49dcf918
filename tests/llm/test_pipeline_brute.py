"""Each stage of the pipeline against a brute-force version of it, on whole tables of the driver."""

from __future__ import annotations

import os
import re
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_dedup import check_kept, norm
from test_text import brute_judged

import corpus_pipeline
from epochal.llm import bpe, quality
from epochal.llm.shared import written

SF = "/root/testdata/sf0.001"
STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def table(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = docs.limit(5).unionByName(docs.limit(3).withColumn("text", F.lit(None).cast("string")))  # repeated rows, nulls
    return written(docs.unionByName(more))


def rows_of(df):
    return [(r.doc_id, r.text, r.lang, r.source) for r in df.collect()]


def test_every_stage(spark, table):
    """Rows of each stage, from what the stage before really kept."""
    before = rows_of(table)
    after = written(STAGE["quality_rules"](spark, table, SF))
    verdicts = brute_judged([(lang, t) for _, t, lang, _ in before], quality.Limits())
    want = Counter(x for x, (kept, _) in zip(before, verdicts) if kept)
    assert Counter(rows_of(after)) == want and 0 < sum(want.values()) < len(before)

    before, docs = rows_of(after), after
    after = written(STAGE["exact_dedup"](spark, docs, SF))
    first: dict[str, tuple] = {}
    for row in before:
        key = norm(row[1])
        rank = (-len(row[1] or ""), row[0])
        if key not in first or rank < first[key][0]:
            first[key] = (rank, row)
    assert Counter(rows_of(after)) == Counter(row for _, row in first.values())

    before, docs = rows_of(after), after
    after = written(STAGE["simhash_near_dedup"](spark, docs, SF))
    kept = {i for i, *_ in rows_of(after)}
    check_kept({i: t or "" for i, t, *_ in before}, kept)
    assert set(rows_of(after)) <= set(before)

    before, docs = rows_of(after), after
    after = written(STAGE["temperature_mix"](spark, docs, SF))
    times = Counter(rows_of(after))
    assert set(times) == set(before) and max(times.values()) <= 2
    share = lambda rows: Counter({s: sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) + 1 for _, t, _, x in rows if x == s) for s in {x for *_, x in rows}})
    own, mixed = share(before), share(rows_of(after))
    assert all(mixed[s] <= 2 * own[s] for s in own) and min(own, key=own.get) == max(own, key=lambda s: mixed[s] / own[s])

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    names = {v: k for k, v in bpe._coder(open(ranks, "rb").read(), public_tokenizers.PATTERN).bytes_of.items()}
    coder = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=names, special_tokens={})
    text = {i: t or "" for i, t, *_ in before}
    out = STAGE["byte_bpe"](spark, after, SF).collect()
    assert len(out) == sum(times.values())
    assert all([x % 2**32 for x in r.ids] == coder.encode_ordinary(text[r.doc_id]) and r.round_trip and r.n_tokens == len(r.ids) for r in out)
