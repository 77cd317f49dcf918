"""License scans by ordered signature rules.

A text becomes its words, lower-cased and joined by single blanks. Rules are
hand-written regular expressions over that (license_rules.py): SPDX identifiers,
sentences of the licenses, addresses, notices, names and codes, each with a label
and a role that gives its priority. Every rule has keywords, strings of which each
of its matches holds at least one; they are read off the parsed expression, so
the prefilter can't miss a match. One Aho-Corasick pass finds the rules to try.
Detections are taken by priority, then length, then place; one whose interval lies
within an accepted one, or overlaps one of higher priority, is suppressed. The
three base phrases are rules too, with the highest priority, and never suppressed.

Defined results: null counts as empty; words are runs of ASCII letters, digits
and all characters beyond ASCII; places count words from 0; a text without
detections has empty labels and score 0, first_word and last_word are null
without a base phrase. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .license_rules import SIGNATURES
from .shared import mapped, pick

#: The base phrases and their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Strings of a choice that are written out to find keywords.
MOST_STRINGS = 64
#: What a role counts for.
PRIORITIES = {"base": 100, "id": 96, "text": 92, "url": 88, "grant": 84, "name": 70, "title": 60, "mention": 45}


class Rule(NamedTuple):
    label: str
    role: str
    priority: int
    keywords: tuple[str, ...]
    pattern: re.Pattern


class Detection(NamedTuple):
    start: int
    end: int
    rule: Rule


def _bounded(expression: str) -> re.Pattern:
    return re.compile(rf"(?<![^ ])(?:{expression})(?![^ ])".encode())


def _finite(op, arg) -> set[str] | None:
    """All strings of a part of an expression, if it is a literal, a class, or a choice of literals."""
    name = str(op)
    if name == "LITERAL":
        return {chr(arg)}
    if name == "IN" and all(str(kind) == "LITERAL" for kind, _ in arg):
        return {chr(x) for _, x in arg}
    ways = [arg[3]] if name == "SUBPATTERN" else arg[1] if name == "BRANCH" else []
    out: set[str] = set()
    for way in ways:
        own = {""}
        for part in way:
            found = _finite(*part)
            if found is None or len(own) * len(found) > MOST_STRINGS:
                return None
            own = {a + b for a in own for b in found}
        out |= own
    return out or None


def _runs(parsed) -> list[frozenset[str]]:
    """For a parsed expression, sets of strings of which every match holds at least one."""
    out, run = [], {""}
    for op, arg in parsed:
        found = _finite(op, arg)
        if found is not None and len(run) * len(found) <= MOST_STRINGS:
            run = {a + b for a in run for b in found}
            continue
        out, run = out + [frozenset(run)] * (run != {""}), {""}
        if str(op) == "SUBPATTERN":
            out += _runs(arg[3])
        elif str(op) == "MAX_REPEAT" and arg[0] > 0:
            out += _runs(arg[2])
        elif str(op) == "BRANCH" and all(ways := [_runs(x) for x in arg[1]]):
            out.append(frozenset().union(*(_best(w) for w in ways)))
        elif found is not None:
            run = found
    return [s for s in out + [frozenset(run)] if "" not in s]


def _best(sets: list[frozenset[str]]) -> set[str]:
    """The most telling set: the one whose shortest string is longest; strings that hold another of the set say no more than that."""
    return max(({x for x in s if not any(y != x and y in x for y in s)} for s in sets), key=lambda s: (min(map(len, s)), -len(s)), default=frozenset({""}))


def keywords(expression: str) -> tuple[str, ...]:
    """Strings of which every match of an expression holds at least one: they follow from the expression itself."""
    found = _best(_runs(re._parser.parse(expression)))
    if min(map(len, found)) < 3:
        raise ValueError(f"no telling string in {expression!r}")
    return tuple(sorted(found))


@functools.cache
def rules() -> tuple[Rule, ...]:
    """All rules in order: the base phrases, then the signatures."""
    lines = [("base", label, phrase) for phrase, label in BASE]
    lines += [(role, label, expression) for label, role, expression in (line.split(" ", 2) for line in SIGNATURES.split("\n") if line)]
    return tuple(Rule(label, role, PRIORITIES[role], keywords(expression), _bounded(expression)) for role, label, expression in lines)


@functools.cache
def _prefilter() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for i, rule in enumerate(rules()):
        for word in rule.keywords:
            automaton.add_word(word, (*automaton.get(word, ()), i))
    automaton.make_automaton()
    return automaton


_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


def detected(joined: bytes, prefilter: bool = True) -> list[Detection]:
    """The detections that stay, by place; ``joined`` is the words with a blank between them. Without the prefilter every rule is tried."""
    hit: set[int] = set() if prefilter else set(range(len(rules())))
    if prefilter:
        for _, ids in _prefilter().iter(joined.decode("utf-8", "replace")):
            hit.update(ids)
    raw = [Detection(*m.span(), rules()[i]) for i in sorted(hit) for m in rules()[i].pattern.finditer(joined)]
    kept: list[Detection] = []
    for priority in sorted({d.rule.priority for d in raw}, reverse=True):
        starts, ends = _merged(kept)
        own = [d for d in raw if d.rule.priority == priority and not _meets(d, starts, ends)]
        reach = -1
        for d in sorted(own, key=lambda d: (d.start, -d.end)):
            if d.end > reach or d.rule.role == "base":
                kept.append(d)
            reach = max(reach, d.end)
    return sorted(kept, key=lambda d: (d.start, d.end))


def _merged(kept: list[Detection]) -> tuple[list[int], list[int]]:
    """The stretches that detections cover, as starts and ends."""
    starts: list[int] = []
    ends: list[int] = []
    for d in sorted(kept, key=lambda d: d.start):
        if ends and d.start < ends[-1]:
            ends[-1] = max(ends[-1], d.end)
        else:
            starts.append(d.start)
            ends.append(d.end)
    return starts, ends


def _meets(d: Detection, starts: list[int], ends: list[int]) -> bool:
    """Whether a detection overlaps one of the stretches."""
    at = bisect.bisect_right(ends, d.start)
    return at < len(starts) and starts[at] < d.end


def scan(text: str | None) -> tuple[int, list[tuple[int, int, Rule]]]:
    """The number of words, and (first word, words, rule) of every detection that stays."""
    words = words_of(text)
    joined = b" ".join(words)
    out, at, seen = [], 0, 0
    for d in detected(joined):
        seen += joined.count(b" ", at, d.start)
        at = d.start
        out.append((seen, joined.count(b" ", d.start, d.end) + 1, d.rule))
    return len(words), out


def scanned(docs: DataFrame) -> DataFrame:
    """n_words, n_base, first_word, last_word, base_labels, labels, score and detections of every document."""
    rows = pick(docs, "doc_id", "text")
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string())

    def row(text: str | None) -> tuple:
        n, found = scan(text)
        base = [at for at, _, rule in found if rule.role == "base"]
        names_ = [",".join(sorted({r.label for _, _, r in found if all_ or r.role == "base"})) for all_ in (False, True)]
        score = max((r.priority for _, _, r in found), default=0) / 100
        return n, len(base), min(base, default=None), max(base, default=None), *names_, score, ",".join(f"{r.role}/{r.label}:{a}:{a + k}" for a, k, r in found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [row(text.as_py()) for text in batch.column(1)]
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, t) for x, t in zip(zip(*out), kinds)]], names=names)

    return mapped(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections string")
