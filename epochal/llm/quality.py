"""Quality rules by distribution divergence.

Each document gives two histograms: its characters by class, and its common
words, the entries of short function-word lists of several languages, with one
slot for all other words. The reference of a language is the mean of these
histograms over all documents of that language which pass the base rules. A
document is rejected when the Jensen-Shannon distance of its classes from the
reference (base 2, so 0 to 1) exceeds a limit, or when the distances of classes
and words together do. A text of few words differs from any reference by chance:
below ``min_words`` words, the part of the squared word distance that is more
than such a sample of the reference has on average is taken off, by ``noise_share``,
so that the limit grows as the text gets shorter. Length guards come first: below
``least_words`` words a word histogram says nothing, below ``min_chars`` characters a class histogram
says nothing, and a language of fewer than ``min_docs`` reference documents has
no reference; in each case that distance is null and rejects nothing.

The texts are read once. Statistics cover every document: one map pass writes
the features of each, the references are sums over those, and the distances are
DataFrame expressions beside them.

Defined results: a null text has no words; a null language is a language of its
own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import by_text, lang_digest, looked_up, mapped, pick, without, written

#: Common words of four languages, the slots of the word histogram.
COMMON_WORDS = (
    "the of and to in a is that it for was on with as be at by this from or an are not have had they which you were but "
    "le la les de des du un une et est en que qui dans pour par sur au pas plus ne se ce il elle avec "
    "der die das und ist ein eine den von zu mit sich auf für dem nicht als auch es im "
    "el los las y una por con para del se su al lo como más pero sus no"
).split()
WORD_SLOT = {w.encode(): i for i, w in enumerate(dict.fromkeys(COMMON_WORDS))}
N_WORDS = len(WORD_SLOT) + 1

#: Character classes by byte: 0 white space, 1 lower case, 2 upper case, 3 digits, 4 sentence marks, 5 the symbols
#: of n_symbols, 6 other printable ASCII, 7 control characters, 8 the first byte of other characters; 9 is ignored.
CLASS = np.full(256, 7, np.uint8)
CLASS[0x21:0x7F] = 6
CLASS[[0x20, *range(0x09, 0x0E)]] = 0
CLASS[ord("a") : ord("z") + 1] = 1
CLASS[ord("A") : ord("Z") + 1] = 2
CLASS[ord("0") : ord("9") + 1] = 3
CLASS[list(b".,;:!?'\"()-")] = 4
CLASS[list(b"#*$%&|<>")] = 5
CLASS[0x80:0xC0] = 9
CLASS[0xC0:] = 8
N_CLASSES = 9


@dataclass(frozen=True)
class Limits:
    """Production parameters; the distances are Jensen-Shannon distances to base 2."""

    base_words: int = 50
    max_repeat_percent: int = 50
    min_words: int = 150
    least_words: int = 30
    noise_share: float = 0.25
    min_chars: int = 200
    min_docs: int = 20
    max_char_distance: float = 0.32
    max_sum: float = 0.43


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window of three words which the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    k = len(number)
    pairs = ids[:-1] * k + ids[1:]
    if k > 2_000_000:  # the third factor would not fit
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * k + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    cover = np.zeros(n, bool)
    cover[:-2] |= twice
    cover[1:-1] |= twice
    cover[2:] |= twice
    return int(cover.sum())


def features(text: str | None) -> tuple[int, int, int, int, int, np.ndarray, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the two histograms of one text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    classes = np.zeros(10, np.int64)
    for at in range(0, len(raw), 1 << 24):  # bounded memory for texts of any length
        classes += np.bincount(CLASS[np.frombuffer(raw, np.uint8, min(1 << 24, len(raw) - at), at)], minlength=10)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()] if b"\n" in raw else []
    common = np.zeros(N_WORDS, np.int64)
    slot = WORD_SLOT.get
    found = [s for w in raw.lower().translate(None, b".,;:!?\"()").split() if (s := slot(w)) is not None]
    if found:
        common += np.bincount(found, minlength=N_WORDS)
    common[-1] = max(0, len(words) - len(found))
    return len(words), int(classes[:9].sum() - classes[0]), int(classes[5]), len(lines) - len(set(lines)), repeated_words(words), classes[:N_CLASSES], common


#: A share of one in the sums of shares: whole numbers, so that sums don't depend on the order of tasks.
UNIT = 1_000_000_000
#: Languages whose sums a task holds before it passes them on.
HELD = 1000


def _scaled(histogram: np.ndarray) -> np.ndarray:
    total = histogram.sum()
    return histogram * UNIT // total if total else histogram


def measured(docs: DataFrame, limits: Limits = Limits(), extra: tuple[str, ...] = ()) -> DataFrame:
    """The features of every document (kind 0), and sums of the shares of the documents of a language in a task (kind 1).

    ``extra`` columns of docs go along. Of kind 1, n_words counts the documents.
    """
    rows = pick(docs, "doc_id", "lang", "text", *extra)
    kept = ["doc_id", "lang", *extra]
    numbers = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    names = [*kept, "kind", *numbers, "base_failed", "classes", "common", "classes_n", "common_n"]

    def table(columns: list[pa.Array], kind: int, some: list[tuple]) -> pa.RecordBatch:
        *counts, failed, classes, common = zip(*some)
        columns = [*columns, pa.array([kind] * len(some), pa.int8()), *[pa.array(x, pa.int64()) for x in counts], pa.array(failed, pa.bool_())]
        columns += [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(x[0]), pa.int32()), pa.array(np.concatenate(x))) for x in (classes, common)]
        columns += [pa.array([int(y.sum()) for y in x], pa.int64()) for x in (classes, common)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str | None, list] = {}
        kinds: list[pa.DataType] = []

        def passed_on() -> Iterator[pa.RecordBatch]:
            if sums:
                none = [pa.nulls(len(sums), t) for t in kinds]
                none[1] = pa.array(list(sums), kinds[1])
                yield table(none, 1, [(n, 0, 0, 0, 0, False, *v) for n, *v in sums.values()])
                sums.clear()

        for batch in batches:
            own = [batch.column(i) for i in (0, 1, *range(3, batch.num_columns))]
            kinds = [x.type for x in own]
            texts = batch.column(2)
            for at in range(0, len(batch), 2000):
                some = []
                for i in range(at, min(at + 2000, len(batch))):
                    *counts, classes, common = features(texts[i].as_py())
                    failed = counts[0] < limits.base_words or counts[4] * 100 > counts[0] * limits.max_repeat_percent
                    some.append((*counts, failed, classes, common))
                    if not failed:
                        sum_ = sums.setdefault(own[1][i].as_py(), [0, 0, 0])
                        sum_[0], sum_[1], sum_[2] = sum_[0] + 1, sum_[1] + _scaled(classes), sum_[2] + _scaled(common)
                yield table([x.slice(at, len(some)) for x in own], 0, some)
                if len(sums) > HELD:
                    yield from passed_on()
        yield from passed_on()

    schema = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in kept) + ", kind tinyint, " + ", ".join(f"{n} long" for n in numbers) + ", base_failed boolean, classes array<long>, common array<long>, classes_n long, common_n long"
    return mapped(rows, run, schema).withColumn("tongue", F.coalesce(F.concat(F.lit("1"), F.col("lang").cast("string")), F.lit("0")))  # a null language is one of its own


def _shares(histogram: str) -> Column:
    total = F.col(f"{histogram}_n").cast("double")
    return F.transform(histogram, lambda x: x / F.when(total > 0, total))


def references(rows: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row for each language: the mean histograms of the documents that pass the base rules, and its documents."""
    out = rows.filter("kind = 0").groupBy("tongue").agg(F.count(F.lit(1)).alias("docs"))
    good = rows.filter("kind = 1").groupBy("tongue").agg(F.sum("n_words").alias("reference_docs"))
    out = out.join(good.filter(F.col("reference_docs") >= limits.min_docs), "tongue")
    for name in ("classes", "common"):
        slots = rows.filter("kind = 1").select("tongue", F.posexplode(name).alias("at", "n")).groupBy("tongue", "at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
        lists = slots.groupBy("tongue").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("slots"))  # as many as the histogram has
        total = F.aggregate("slots", F.lit(0.0), lambda a, x: a + x["n"].cast("double"))
        lists = lists.withColumn("total", total)
        out = out.join(lists.select("tongue", F.transform("slots", lambda x: x["n"].cast("double") / F.when(F.col("total") > 0, F.col("total"))).alias(f"{name}_ref")), "tongue")
    return out


def sampling_noise(n: Column) -> Column:
    """The mean squared distance of n words drawn from a reference: fitted to draws of 20 to 1000 words from those of ``sf0.1``."""
    return 6.0 / (n + 23.0)


def js_distance(p: Column, q: Column) -> Column:
    """The Jensen-Shannon distance, base 2, of two arrays of shares."""

    def term(x: Column, y: Column) -> Column:
        half = F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)
        return half + F.when(y > 0, y * F.log2(2 * y / (x + y))).otherwise(0.0)

    total = F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def judged(docs: DataFrame, limits: Limits = Limits(), extra: tuple[str, ...] = ()) -> DataFrame:
    """The features of every document with char_distance, word_distance, base_failed and kept."""
    rows = written(measured(docs, limits, extra))
    refs = written(references(rows, limits))
    rows = looked_up(rows.filter("kind = 0"), refs, "tongue", "docs")
    long = F.col("word_chars") >= limits.min_chars
    rows = rows.withColumn("char_distance", F.when(long & F.col("classes_ref").isNotNull(), js_distance(_shares("classes"), F.col("classes_ref"))))
    enough = F.col("n_words") >= limits.least_words
    rows = rows.withColumn("word_distance", F.when(enough & F.col("common_ref").isNotNull(), js_distance(_shares("common"), F.col("common_ref"))))
    chance = limits.noise_share * (sampling_noise(F.col("n_words")) - sampling_noise(F.lit(limits.min_words)))
    beyond_chance = F.sqrt(F.greatest(F.pow("word_distance", F.lit(2.0)) - F.greatest(chance, F.lit(0.0)), F.lit(0.0)))
    far = (F.col("char_distance") > limits.max_char_distance) | (F.col("char_distance") + beyond_chance > limits.max_sum)
    return rows.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).drop("classes", "common", "classes_n", "common_n", "classes_ref", "common_ref", "tongue", "docs", "reference_docs", "kind")


def quality_filtered(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The documents that pass, with all their columns; rows alike in doc_id, language and text share one verdict."""
    judge = judged(by_text(docs), limits, ("digest",)).withColumn("digest", lang_digest(F.col("digest"), F.col("lang")))
    return without(docs, written(judge.filter(~F.col("kept")).select("doc_id", "digest")), by_lang=True)
