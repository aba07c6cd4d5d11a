"""Licence scans by ordered signatures.

Words are runs of ASCII letters (A-Z lower-cased), digits and other than ASCII characters. A text
meets an automaton of keywords first; only texts that hold one, or a base phrase, are brought into the
form in which the signatures are written, words joined by single spaces, and only rules whose gate is
in it are tried. Matches are intervals of words with a level. One that lies within another of the same
or a higher level is suppressed: of equal intervals the earlier rule stays, and a name within its notice or
its version says nothing of its own. The three base phrases are found in the bytes as they stand and
are never suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import text_bytes
from tidewright.llm.license_rules import WORTH, Rule, compiled, parsed, stem

#: Phrases and labels of the base.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: What a base phrase alone is worth.
BASE_WORTH = 0.5

#: A-Z lower-cased, other bytes as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
IN_WORD = np.array([b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 for b in range(256)])
WORD_CLASS = r"0-9a-z\x80-\xff"


def phrase_pattern(phrase: str) -> re.Pattern[bytes]:
    """The phrase's words, parted by anything that isn't in a word. What stands before is looked at
    by the caller, so that the search can start from the first word's letters."""
    between = f"[^{WORD_CLASS}]+".join(phrase.split())
    return re.compile(f"{between}(?![{WORD_CLASS}])".encode("latin-1"))


PATTERNS = [(phrase_pattern(p), label, len(p.split())) for p, label in BASE]


def word_starts(data: bytes) -> np.ndarray:
    """Byte offsets of the words of a lower-cased text."""
    inside = IN_WORD[np.frombuffer(data, np.uint8)]
    return np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))


def base_places(data: bytes) -> list[tuple[int, str]]:
    """(byte offset, label) of each base phrase of a lower-cased text."""
    found = []
    for pattern, label, _ in PATTERNS:
        for m in pattern.finditer(data):
            at = m.start()
            if not at or not IN_WORD[data[at - 1]]:
                found.append((at, label))
    return found


class Scanner:
    """The signatures, compiled once a task."""

    def __init__(self, rules: Sequence[Rule] | None = None) -> None:
        self.rules = list(parsed() if rules is None else rules)
        self.patterns = [compiled(r) for r in self.rules]
        self.keywords = ahocorasick.Automaton()
        for word in {s for s in map(stem, self.rules) if s}:
            self.keywords.add_word(word, word)
        self.keywords.make_automaton()

    def maybe(self, data: bytes) -> bool:
        """Whether a lower-cased text holds any keyword."""
        return next(self.keywords.iter(data.decode("latin-1")), None) is not None

    def matches(self, words: Sequence[str]) -> list[tuple[int, int, int]]:
        """(first word, end, rule) of every rule's matches in order of rules."""
        text = " ".join(words)
        starts = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])
        found = []
        for k, (rule, pattern) in enumerate(zip(self.rules, self.patterns, strict=True)):
            if rule.gate in text:
                for m in pattern.finditer(text):
                    a = int(np.searchsorted(starts, m.start(), "left"))
                    b = int(np.searchsorted(starts, m.end() - 1, "right"))
                    found.append((a, b, k))
        return found

    def kept(self, found: Sequence[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """``found`` without what lies in another match of the same or a higher level. Levels go from
        the highest down; within one, longer ones first where they start together."""
        starts: list[int] = []
        reach: list[int] = []  # the furthest end up to each start
        out = []
        by_level: dict[int, list[tuple[int, int, int]]] = {}
        for m in found:
            by_level.setdefault(self.rules[m[2]].level, []).append(m)
        for level in sorted(by_level, reverse=True):
            fresh, furthest = [], -1
            for a, b, k in sorted(by_level[level], key=lambda m: (m[0], -m[1], m[2])):
                i = bisect_right(starts, a)
                if b <= furthest or (i and reach[i - 1] >= b):
                    continue
                furthest = b
                fresh.append((a, b, k))
            out += fresh
            merged = sorted([*zip(starts, reach, strict=True), *((a, b) for a, b, _ in fresh)])
            starts, ends = [a for a, _ in merged], [b for _, b in merged]
            reach = list(np.maximum.accumulate(ends)) if ends else []
        return out

    def scan(self, text: bytes) -> tuple[int, int, int | None, int | None, str, str, float, list[tuple[str, int, int, int]]]:
        """n_words, n_base, first_word, last_word, base_labels, labels, score, and what was kept as
        (label, first word, end, level)."""
        data = text.translate(LOWER)
        starts = word_starts(data)
        base = base_places(data)
        found: list[tuple[int, int, int]] = []
        if base or self.maybe(data):
            found = self.kept(self.matches(bytes_words(data)))
        labels = {label for _, label in base}
        kept = [(self.rules[k].label, a, b, self.rules[k].level) for a, b, k in found]
        places = np.searchsorted(starts, [at for at, _ in base]) if base else []
        score = max([BASE_WORTH * bool(base), *(WORTH[level] for *_, level in kept)])
        return (
            len(starts), len(base), int(min(places)) if base else None, int(max(places)) if base else None,
            ",".join(sorted(labels)), ",".join(sorted(labels | {k[0] for k in kept})), float(score), sorted(kept, key=lambda k: (k[1], k[2], k[0])),
        )


#: Bytes of words as they are, all others as spaces.
GAPS = bytes(b if IN_WORD[b] else 32 for b in range(256))


def bytes_words(data: bytes) -> list[str]:
    """The words of a lower-cased text, a character for each byte."""
    return [w.decode("latin-1") for w in data.translate(GAPS).split()]


REPORT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
SPANS = "array<struct<label: string, first_word: int, end_word: int, level: int>>"


def scan(docs: DataFrame, rules: Sequence[Rule] | None = None, spans: bool = True) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row of
    ``docs`` (doc_id, text); with ``spans`` also where each label that isn't of the base stands.

    A null text is an empty one: no words, no labels (empty strings), score 0. Rows that repeat a
    doc_id are rows each; a null id stays. Whole texts are scanned, however long. An empty table
    gives an empty one; other columns aren't read, whatever their names.
    """
    given = list(parsed() if rules is None else rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(given)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                rows = [scanner.scan(t) for t in text_bytes(b.column(1))]
                columns = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()))]
                names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
                if spans:
                    kind = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int32()), ("end_word", pa.int32()), ("level", pa.int32())]))
                    columns.append(pa.array([[dict(zip(("label", "first_word", "end_word", "level"), s, strict=True)) for s in r[7]] for r in rows], kind))
                    names.append("spans")
                yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=names)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, REPORT + (f", spans {SPANS}" if spans else ""))
