"""Byte-level BPE over Arrow batches with the tokenizers library.

A rank file lists byte strings by rank. Bytes are shown as characters: printable
ones as themselves, the others as characters from U+0100 on, so that a token is
a string. Every way to split a token into two tokens of the file becomes a merge
whose priority is the token's rank; a piece of text that is itself a token is
taken whole. That gives the ids that merging by lowest rank gives. The text is
cut by the pattern first, and every match is encoded on its own; there are no
special tokens.

Decoding goes back through the byte table: ids to byte strings, joined. A
character whose bytes are split among tokens comes out whole in ``decode_bytes``;
``decode_text`` shows incomplete ones as U+FFFD, and ``TextStream`` holds them
back until their last byte has come.

The pattern always cuts between a character that is not white space and a blank,
whatever follows. So texts are taken in stretches that begin with such a blank:
for ids alone, each distinct stretch goes to the library once and is remembered,
within a bound; with offsets, a text goes whole, and a long one in pieces.

Defined results: null counts as empty and has no tokens. Texts of any length are
encoded whole. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import codecs
import functools
import hashlib
import os
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from .shared import mapped, pick

#: Tasks are the parallelism here; the library's own threads would contend with those of other tasks.
os.environ["TOKENIZERS_PARALLELISM"] = "false"
#: Characters that go to the library at once: an encoding takes some 100 bytes of memory a token.
STRETCH = 1 << 16
#: Distinct stretches between blanks whose ids a worker remembers, some 40 MB.
PIECES = 100_000
_CUT = re.compile(r"(?<=\S) ")
_WIDE = re.compile(r"\s ")


@functools.cache
def byte_characters() -> tuple[str, ...]:
    """The character that stands for each byte."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    hidden = [b for b in range(256) if b not in set(shown)]
    return tuple(chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256))


class ByteBpe:
    """An encoder and decoder of one rank file's bytes and one pattern."""

    def __init__(self, ranks: bytes, pattern: str):
        rank = {base64.b64decode(token): int(number) for token, number in (line.split() for line in ranks.splitlines() if line.strip())}
        shown = byte_characters()
        vocab = {"".join(shown[b] for b in token): number for token, number in rank.items()}
        name = {number: token for token, number in vocab.items()}
        merges = []
        for token, _ in sorted(rank.items(), key=lambda x: x[1]):
            splits = [(rank[token[:i]], rank[token[i:]]) for i in range(1, len(token)) if token[:i] in rank and token[i:] in rank]
            merges += [(name[a], name[b]) for a, b in sorted(splits)]
        self.tokenizer = Tokenizer(models.BPE(vocab=vocab, merges=merges, ignore_merges=True, cache_capacity=0))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.bytes_of = {number: token for token, number in rank.items()}
        self.sizes = np.zeros(max(self.bytes_of) + 1, np.int64)
        for number, token in self.bytes_of.items():
            self.sizes[number] = len(token)
        self.known: dict[str, bytes] = {}

    def _learn(self, new: set[str]) -> None:
        """The ids of each piece, after a blank, as little-endian words."""
        open_ = [p for p in new if not p or p[-1].isspace()]  # the pattern may join these with what follows
        for piece, found in zip(open_, self.tokenizer.encode_batch_fast([f" {p}" for p in open_], add_special_tokens=False)):
            self.known[piece] = np.array(found.ids, "<u4").tobytes()
        closed, at = list(new.difference(open_)), 0
        while at < len(closed):
            end, size = at, 0
            while end < len(closed) and (end == at or size + len(closed[end]) <= STRETCH):
                size += len(closed[end]) + 1
                end += 1
            some = closed[at:end]
            (found,) = self.tokenizer.encode_batch_fast(["".join(f" {p}" for p in some)], add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            bounds = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(p.encode("utf-8", "surrogatepass")) + 1 for p in some])) + 1
            raw = ids.tobytes()
            for piece, start, stop in zip(some, [0, *bounds[:-1].tolist()], bounds.tolist()):
                self.known[piece] = raw[4 * start : 4 * stop]
            at = end

    def encode_ids(self, texts: list[str]) -> list[np.ndarray]:
        """ids of every text. Stretches from a blank to the next are encoded once and remembered."""
        cut = [text.split(" ") if not _WIDE.search(text) else _CUT.split(text) for text in texts]
        new = set().union(*(c[1:] for c in cut)).difference(self.known)
        self._learn(new)
        heads = self.tokenizer.encode_batch_fast([c[0] for c in cut], add_special_tokens=False)
        of = self.known.__getitem__
        out = [np.frombuffer(np.array(h.ids, "<u4").tobytes() + b"".join(map(of, c[1:])), "<u4") for h, c in zip(heads, cut)]
        full = len(self.known) > PIECES  # then the pieces of before stay, and new ones go again
        for piece in new:
            if full or len(piece) > 100:
                del self.known[piece]
        return out

    def encode(self, texts: list[str], offsets: bool = False) -> list[tuple[list[int], list[tuple[int, int]]]]:
        """ids of every text and, if asked for, each token's characters in it."""
        parts = [(i, at, s) for i, t in enumerate(texts) for at, s in stretches(t)]
        out: list[tuple[list[int], list[tuple[int, int]]]] = [([], []) for _ in texts]
        run = self.tokenizer.encode_batch if offsets else self.tokenizer.encode_batch_fast
        at = 0
        while at < len(parts):
            end, size = at, 0
            while end < len(parts) and (end == at or size + len(parts[end][2]) <= STRETCH):
                size += len(parts[end][2])
                end += 1
            for (i, start, _), e in zip(parts[at:end], run([s for _, _, s in parts[at:end]], add_special_tokens=False)):
                out[i][0].extend(e.ids)
                if offsets:
                    out[i][1].extend((start + a, start + b) for a, b in e.offsets)
            at = end
        return out

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))

    def decode_text(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


class TextStream:
    """Text of ids that come one by one; bytes of an incomplete character wait."""

    def __init__(self, coder: ByteBpe):
        self.coder, self.open = coder, codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids) -> str:
        return self.open.decode(self.coder.decode_bytes(ids))

    def end(self) -> str:
        return self.open.decode(b"", final=True)


def stretches(text: str) -> Iterator[tuple[int, str]]:
    """(place, part) of a text, cut only where the pattern cuts whatever follows."""
    at = 0
    while len(text) - at > STRETCH:
        found = _CUT.search(text, at + STRETCH)
        if not found:
            break
        yield at, text[at : found.start()]
        at = found.start()
    if at < len(text):
        yield at, text[at:]


@functools.lru_cache(maxsize=4)
def _coder(ranks: bytes, pattern: str) -> ByteBpe:
    return ByteBpe(ranks, pattern)


def _texts(batches: Iterator[pa.RecordBatch], column: int, most: int = 4 * STRETCH) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Batches cut so that each holds some size characters or one text."""
    for batch in batches:
        texts, at, size = batch.column(column), 0, 0
        some: list[str] = []
        for i in range(len(batch)):
            text = texts[i].as_py() or ""
            if some and size + len(text) > most:
                yield batch.slice(at, len(some)), some
                at, size, some = i, 0, []
            some.append(text)
            size += len(text)
        if some:
            yield batch.slice(at, len(some)), some


def encoded(docs: DataFrame, ranks_path: str, pattern: str, offsets: bool = False, check: bool = False, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_tokens and ids of every document.

    With ``offsets``, each token's start and end characters in the text; with
    ``check``, whether the ids decode to the bytes of the text.
    """
    ranks, rows = Path(ranks_path).read_bytes(), pick(docs, *keep, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks, pattern)
        for batch, texts in _texts(batches, len(keep)):
            found = coder.encode(texts, True) if offsets else [(ids, ()) for ids in coder.encode_ids(texts)]
            ids = [np.asarray(x, np.uint32) for x, _ in found]
            ends = np.cumsum([0, *map(len, ids)])
            columns = [*batch.columns[: len(keep)], pa.array(np.diff(ends), pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids).view(np.int32)))]
            if offsets:
                columns += [pa.array([[o[k] for o in spans] for _, spans in found], pa.list_(pa.int64())) for k in (0, 1)]
            if check:
                columns.append(pa.array([coder.decode_bytes(x) == text.encode("utf-8", "surrogatepass") for x, text in zip(ids, texts)]))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [*keep, "n_tokens", "ids", *["starts", "ends"] * offsets, *["round_trip"] * check]
    schema = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in keep) + ", n_tokens long, ids array<int>" + ", starts array<long>, ends array<long>" * offsets + ", round_trip boolean" * check
    return mapped(rows, run, schema)


def decoded(rows: DataFrame, ranks_path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, the bytes of ids and their text, with U+FFFD for what is not UTF-8."""
    ranks, rows = Path(ranks_path).read_bytes(), pick(rows, *keep, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks, pattern)
        for batch in batches:
            raw = [coder.decode_bytes(ids or ()) for ids in batch.column(len(keep)).to_pylist()]
            columns = [*batch.columns[: len(keep)], pa.array(raw, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in raw])]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "bytes", "text"])

    schema = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in keep) + ", bytes binary, text string"
    return mapped(rows, run, schema)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids as little-endian words and of the bytes they decode to.

    Encoding and decoding run in one pass, so that the ids of the corpus never leave their task.
    """
    ranks, rows = Path(ranks_path).read_bytes(), pick(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks, pattern)
        for batch, texts in _texts(batches, 1):
            ids = coder.encode_ids(texts)
            columns = [batch.column(0), pa.array([len(x) for x in ids], pa.int64())]
            columns.append(pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids]))
            columns.append(pa.array([hashlib.sha256(coder.decode_bytes(x)).hexdigest() for x in ids]))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return mapped(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_counts(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and n_tokens of every document."""
    return encoded(docs, ranks_path, pattern).select("doc_id", F.col("n_tokens"))
