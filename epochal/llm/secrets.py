"""Secret scans: three base patterns, and strings that a primed compressor finds new.

Candidates are strings of 16 or more characters of keys and hashes that hold a
letter and a digit and stand in a sensitive context, a word such as password, token
or bearer at most 64 characters before or after; and the body of a private key,
from its BEGIN to its END line. Each is measured by Zstandard with a dictionary of
code identifiers: the compressed size of its surroundings with it less the size
without it, in bytes for each of its characters. Its share of what random
characters of its alphabet take, hexadecimal, of one case, or mixed, is its novelty;
a candidate of ``least`` or more cannot be made up from the surrounding code or
known identifiers and is reported as ``novel``, unless it lies in a span of the
base patterns.

Base spans are the whole matches, leftmost and without overlaps for each kind.
Matches that are too short use up their characters and are dropped.

Defined results: null counts as empty; spans are in code points, the end
exclusive; a text without findings has counts of zero, the hash of the empty
string, and empty spans. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .shared import mapped, pick

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
PRIVATE_KEY = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----\s+([A-Za-z0-9+/=\s]{16,}?)\s*-----END [A-Z0-9 ]*PRIVATE KEY-----")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+")
KINDS = ("assign", "access", "hex", "novel")
#: Words that gate the assignments, and words that make a context sensitive.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
SENSITIVE = (*ASSIGN_WORDS, "api-key", "credential", "private", "bearer", "authorization", "access_key", "signature", "pwd")
NEAR, AROUND = 64, 256
LEAST = 0.92
#: Identifiers and literals of common code, which prime the compressor.
IDENTIFIERS = (
    "public static final private protected import export default function return class struct const let var def self None null "
    "true false async await lambda yield package namespace include require module interface extends implements override "
    "username password passwd secret token api_key apikey access_key secret_key client_id client_secret authorization bearer "
    "credential credentials signature private_key public_key certificate session cookie header request response content-type "
    "application/json text/html https://www. http://localhost:8080 localhost 127.0.0.1 0.0.0.0 example.com github.com "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 00000000 11111111 ffffffff deadbeef xxxxxxxxxxxxxxxx "
    "config settings environment database connection string timeout retry version description name value type index length "
    "getElementById addEventListener querySelector createElement toString hashCode equals println printf malloc sizeof "
    "REPLACE_ME YOUR_API_KEY_HERE your-password-here changeme placeholder example_token_value test_secret_key sample "
)


@functools.cache
def _compressor() -> zstandard.ZstdCompressor:
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False, write_dict_id=False)


def _random_bytes(own: str) -> float:
    """Bytes that a random character of the string's alphabet takes."""
    if not own.strip("0123456789abcdef") or not own.strip("0123456789ABCDEF"):
        return 4 / 8
    cases = any(c.islower() for c in own) + any(c.isupper() for c in own)
    return math.log2(36 if cases < 2 else 64) / 8


def novelty(text: str, start: int, end: int) -> float:
    """Compressed bytes that text[start:end] adds to its surroundings, as a share of what random characters take."""
    before, after = text[max(0, start - AROUND) : start].encode("utf-8", "replace"), text[end : end + AROUND].encode("utf-8", "replace")
    own = text[start:end]
    size = _compressor().compress
    return (len(size(before + after + own.encode())) - len(size(before + after))) / len(own) / _random_bytes(own)


def scan(text: str | None, least: float = LEAST) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every finding, by start, then kind."""
    text = text or ""
    low = text.lower() if text.isascii() else text.translate(_LOWER)
    found = []
    if any(w in low for w in ASSIGN_WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    if any(w in low for w in SENSITIVE):
        keys = [m.span(1) for m in PRIVATE_KEY.finditer(text) if novelty(text, *m.span(1)) >= least]
        held = sorted([(a, b) for _, a, b in found] + keys)
        starts, reach = [a for a, _ in held], list(itertools.accumulate((b for _, b in held), max))
        found += [("novel", a, b) for a, b in keys]
        for a, b in _candidates(text, low):
            at = bisect.bisect_right(starts, a)
            if not (at and reach[at - 1] >= b) and novelty(text, a, b) >= least:
                found.append(("novel", a, b))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def _candidates(text: str, low: str) -> Iterator[tuple[int, int]]:
    """Long strings of key characters, with a letter and a digit, near a sensitive word."""
    done = 0
    for word in _SENSITIVE.finditer(low):
        low_end, high_end = max(done, word.start() - NEAR), word.end() + NEAR
        for m in _START.finditer(text, _begun(text, low_end, done), high_end + 16):
            if m.start() < done:
                continue
            whole = CANDIDATE.match(text, m.start())
            if whole.end() < word.start() - NEAR:
                continue
            done = whole.end()
            if any(c.isdigit() for c in whole[0]) and any(c.isalpha() for c in whole[0]):
                yield whole.span()


def _begun(text: str, at: int, least: int) -> int:
    """Where the string of key characters begins that stands at a place; not before ``least``."""
    while at > least and text[at - 1] in _KEY_CHARACTERS:
        at -= 1
    return at


_KEY_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
_START = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16}")
_SENSITIVE = re.compile("|".join(map(re.escape, sorted(SENSITIVE, key=len, reverse=True))))


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b, *_ in spans)


def scanned(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, the counts of the base kinds, base_sha256, spans, and n_novel of every document."""
    rows = pick(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1):
                spans = scan(text.as_py(), least)
                count = [sum(s[0] == k for s in spans) for k in KINDS]
                base = joined([s for s in spans if s[0] != "novel"])
                out.append((*count[:3], hashlib.sha256(base.encode()).hexdigest(), joined(spans), count[3]))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, t) for x, t in zip(zip(*out), kinds)]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"])

    return mapped(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long")
