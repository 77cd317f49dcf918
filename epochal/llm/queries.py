"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, html_text, licenses, mixing, quality, secrets, sharding, simhash, warc


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.byte_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"), mixing.Target(max_repeats=4.0))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.grouped(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, most=3)
    return out.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archived(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_byte_shards": op2_byte_shards,
    "op3_html_text": op3_html_text,
    "op4_temperature_mix": op4_temperature_mix,
    "op5_license_scan": op5_license_scan,
    "op6_simhash": op6_simhash,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_secret_scan": op8_secret_scan,
    "op9_warc": op9_warc,
    "op10_quality_rules": op10_quality_rules,
}

def _distance(p: str, q: str) -> str:
    """SQL of the Jensen-Shannon distance, base 2, of two lists of shares."""
    term = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / ({0} + {1})) ELSE 0.0 END"
    both = f"list_sum(list_transform(list_zip({p}, {q}), lambda z: {term.format('z[1]', 'z[2]')} + {term.format('z[2]', 'z[1]')}))"
    return f"sqrt(greatest({both} / 2, 0.0))"


def _quality_sql(limits: quality.Limits = quality.Limits()) -> str:
    """The quality rules over documents in SQL: features by expressions, references by sums of whole shares."""
    quoted = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)
    common = list(dict.fromkeys(quality.COMMON_WORDS))
    kinds = (r"\x20\x09-\x0D", "a-z", "A-Z", "0-9", r""".,;:!?''"()\-""", "#*$%&|<>", r"""+/=@\[\\\]^_`{}~""", r"\x00-\x08\x0E-\x1F\x7F")
    counts = ", ".join(f"length(regexp_replace(t, '[^{k}]', '', 'g'))" for k in kinds) + r", length(regexp_replace(t, '[\x00-\x7F]', '', 'g'))"
    shares = ", ".join(f"list_sum(list_transform({h}, lambda x: x)) AS {h}_n" for h in ("classes", "common"))
    return rf"""
        WITH d AS (
            SELECT row_number() OVER () AS rid, doc_id, coalesce('1' || lang, '0') AS tongue, coalesce(text, '') AS t FROM documents),
        w AS (
            SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
                   list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
                   [{counts}] AS classes,
                   list_filter(regexp_extract_all(regexp_replace(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?"()]', '', 'g'), '[^\x20\x09-\x0D]+'),
                       lambda x: x IN ({quoted(common)})) AS known
            FROM d),
        places AS (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 3),
        windows AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i], words[i + 1], words[i + 2]) AS n FROM places),
        repeats AS (SELECT rid, count(DISTINCT spot) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS spot FROM windows WHERE n > 1) GROUP BY rid),
        f AS (
            SELECT w.rid, doc_id, tongue, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars, classes[6] AS n_symbols,
                   len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words, classes,
                   list_transform([{quoted(common)}], lambda c: len(list_filter(known, lambda x: x = c))) || [greatest(0, len(words) - len(known))] AS common
            FROM w LEFT JOIN repeats ON w.rid = repeats.rid),
        b AS (
            SELECT *, {shares}, n_words < {limits.base_words} OR 100 * n_repeat_words > {limits.max_repeat_percent} * n_words AS base_failed FROM f),
        slots AS (
            SELECT tongue, what, spot, sum(CAST(h[spot] AS HUGEINT) * {quality.UNIT} // n) AS s
            FROM (SELECT tongue, 'classes' AS what, classes AS h, classes_n AS n, unnest(range(1, len(classes) + 1)) AS spot FROM b WHERE NOT base_failed
                  UNION ALL SELECT tongue, 'common', common, common_n, unnest(range(1, len(common) + 1)) FROM b WHERE NOT base_failed)
            GROUP BY ALL),
        refs AS (
            SELECT tongue, what, list_transform(list(s ORDER BY spot), lambda x: CAST(x AS DOUBLE) / CAST(sum(s) AS DOUBLE)) AS ref FROM slots GROUP BY tongue, what),
        known_tongues AS (SELECT tongue FROM b WHERE NOT base_failed GROUP BY tongue HAVING count(*) >= {limits.min_docs}),
        far AS (
            SELECT b.*,
                   CASE WHEN word_chars >= {limits.min_chars} AND k.tongue IS NOT NULL THEN {_distance("list_transform(classes, lambda x: CAST(x AS DOUBLE) / classes_n)", "c.ref")} END AS cd,
                   CASE WHEN n_words >= {limits.least_words} AND k.tongue IS NOT NULL THEN {_distance("list_transform(common, lambda x: CAST(x AS DOUBLE) / common_n)", "o.ref")} END AS wd
            FROM b LEFT JOIN known_tongues k ON b.tongue = k.tongue
            LEFT JOIN refs c ON b.tongue = c.tongue AND c.what = 'classes' LEFT JOIN refs o ON b.tongue = o.tongue AND o.what = 'common')
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
               CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
               NOT base_failed AND NOT coalesce(cd > {limits.max_char_distance} OR cd + sqrt(greatest(wd * wd - greatest({limits.noise_share} * (6.0 / (n_words + 23.0) - 6.0 / ({limits.min_words} + 23.0)), 0.0), 0.0)) > {limits.max_sum}, false) AS kept
        FROM far"""


ORACLES: dict[str, str] = {
    "op9_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
        r AS (
            SELECT page_id, n, html, max(page_id) OVER (PARTITION BY html) AS last FROM p)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
               CASE WHEN n >= 1000 AND last IS NOT NULL AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM last THEN last END AS refers_to
        FROM r""",
    "op1_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents),
        r AS (
            SELECT doc_id, norm,
                   first_value(doc_id) OVER w AS keep_id,
                   count(*) OVER (PARTITION BY norm) AS group_size,
                   row_number() OVER w AS place
            FROM t WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id ASC NULLS LAST))
        SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, place = 1 AS kept, sha256(norm) AS text_sha256
        FROM r""",
    "op2_byte_shards": """
        WITH codes AS (
            SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS code),
        sized AS (
            SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size,
                   list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes
            FROM documents),
        summed AS (
            SELECT doc_id, size, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, code[xor(c & 255, b) + 1]), 4294967295), 4294967295) AS text_crc32
            FROM sized, codes),
        placed AS (
            SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER () AS total
            FROM summed),
        dealt AS (
            SELECT *, least(7, CAST((2 * before + size) * 8 // (2 * total) AS INTEGER)) AS shard FROM placed)
        SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
               CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
        FROM dealt""",
    "op10_quality_rules": _quality_sql(),
}
