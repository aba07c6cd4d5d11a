"""Quality rules: fixed base rules, then a hashed n-gram logistic regression.

Base counts are exact. The verdict comes from a logistic regression over hashed words, pairs of
words and n-grams of characters (code points), trained on a bounded sample of labelled rows, with
its probability calibrated on rows that the weights have not seen, and compared with a fixed
threshold. Texts are read in pieces that end before a word, so that a long one needs no more
memory than a short one but for its words' numbers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import SPACES, mix64, small_batches, span_hashes, words_of
from tidewright.llm.quality_compression import logistic, sigmoid, training_rows

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
SYMBOLS = "#*$%&|<>"
THRESHOLD = 0.3
BITS = 18
CHAR_N = (2, 4)
#: Labelled rows read for each class, at most; a documented bound of the fit.
SAMPLE_ROWS = 1500
#: Characters of a text, or of several short ones, that are looked at together.
PIECE = 1 << 18
_SPACE = re.compile(r"[\x20\x09-\x0D]")


def cuts(text: str, size: int = PIECE) -> list[tuple[int, int]]:
    """[a, b) pieces of about ``size`` characters; each but the first begins after white space."""
    out, a = [], 0
    while len(text) - a > size:
        gap = _SPACE.search(text, a + size)
        if not gap or gap.end() == len(text):
            break
        out.append((a, gap.end()))
        a = gap.end()
    return [*out, (a, len(text))]


def base_counts(text: str, size: int = PIECE) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text.

    Words are numbered in order of first sight; a window of three is a pair of numbers, the
    second that of its first two words. Windows are compared by these numbers, not by hashes.
    """
    number: dict[bytes, int] = {}
    parts = []
    for a, b in cuts(text, size):
        words = text[a:b].encode().split()  # bytes.split() breaks at ASCII white space only
        for w in dict.fromkeys(words):
            number.setdefault(w, len(number))
        parts.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
    ids = np.concatenate(parts)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = Counter(x for x in text.split("\n") if x.strip(SPACES))
    dup = sum(lines.values()) - len(lines)
    repeated = 0
    if len(ids) > 3:
        pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
        _, window, count = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
        twice = count[window] > 1
        inside = np.zeros(len(ids), bool)
        for k in range(3):
            inside[k : k + len(twice)] |= twice
        repeated = int(inside.sum())
    return len(ids), chars, symbols, dup, repeated


def runs(texts: list[str], size: int = PIECE) -> Iterator[tuple[int, list[tuple[str, int]]]]:
    """(first document, its and the following ones' (string, end)): short texts together, pieces of
    a long one alone. Features begin before ``end``; what follows it only completes them."""
    held: list[tuple[str, int]] = []
    total = 0
    for i, t in enumerate(texts):
        if held and total + len(t) > size:
            yield i - len(held), held
            held, total = [], 0
        if len(t) <= size:
            held.append((t, len(t)))
            total += len(t)
            continue
        for a, b in cuts(t, size):
            ahead = _SPACE.search(t, _after_space(t, b))
            reach = max(b + max(CHAR_N), ahead.start() if ahead else len(t)) if b < len(t) else b
            yield i, [(t[a:reach], b - a)]
    if held:
        yield len(texts) - len(held), held


def _after_space(text: str, at: int) -> int:
    while at < len(text) and text[at] in SPACES:
        at += 1
    return at


def hashed_features(texts: list[str], bits: int = BITS, size: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, slot) of every feature occurrence: words, pairs of words, and n-grams of
    characters. A document may come in several parts, one after another."""
    shift = np.uint64(64 - bits)
    for first, run in runs(texts, size):
        data = np.frombuffer("\n".join(t for t, _ in run).encode(), np.uint8)
        points = np.frombuffer("\n".join(t for t, _ in run).encode("utf-32-le"), np.uint32).astype(np.uint64)
        lengths = np.array([len(t) for t, _ in run])
        begins = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
        owner = np.repeat(np.arange(len(run)), lengths + 1)[: len(points)]
        ends = (begins + lengths)[owner]
        counted = np.zeros(len(points), bool)  # characters where a feature may begin
        for a, (_, end) in zip(begins, run, strict=True):
            counted[a : a + end] = True
        starts = np.flatnonzero((data & 0xC0) != 0x80)  # bytes where characters begin
        s, e = words_of(data)
        at = np.searchsorted(starts, s)
        h = span_hashes(data, s, e)
        doc, slot = [owner[at][counted[at]]], [h[counted[at]] >> shift]
        if len(h) > 1:
            pair = mix64(h[:-1] * np.uint64(3) + h[1:])
            ok = (owner[at[:-1]] == owner[at[1:]]) & counted[at[:-1]]
            doc.append(owner[at[:-1]][ok])
            slot.append(pair[ok] >> shift)
        codes = mix64(points + np.uint64(0x9E3779B97F4A7C15))
        for n in CHAR_N:
            if len(points) >= n:
                gram = np.zeros(len(points) - n + 1, np.uint64)
                for k in range(n):
                    gram = gram * np.uint64(0x100000001B3) + codes[k : len(points) - n + 1 + k]
                ok = counted[: len(gram)] & (np.arange(n, len(points) + 1) <= ends[: len(gram)])
                doc.append(owner[: len(gram)][ok])
                slot.append((gram[ok] * np.uint64(0x9E3779B97F4A7C15)) >> shift)
        yield np.concatenate(doc) + first, np.concatenate(slot).astype(np.int64)


@dataclass(frozen=True)
class NgramModel:
    weights: np.ndarray
    calibration: tuple[float, float]


def margins(weights: np.ndarray, texts: list[str], size: int = PIECE) -> np.ndarray:
    """Mean weight of a text's features, 0 without any."""
    total, n = np.zeros(len(texts)), np.zeros(len(texts))
    for doc, slot in hashed_features(texts, size=size):
        total += np.bincount(doc, weights[slot], minlength=len(texts))
        n += np.bincount(doc, minlength=len(texts))
    return total / np.maximum(n, 1)


def fit_ngram(rows: list[tuple[int, str, int]], passes: int = 60, rate: float = 40.0) -> NgramModel:
    """rows: (doc_id, text, label). Two thirds train the weights by gradient steps on the mean
    feature vectors, classes weighted equally; the last third calibrates."""
    rows = sorted(rows)
    labels = np.array([r[2] for r in rows], float)
    if len(set(labels)) < 2:
        share = (labels.sum() + 1) / (len(labels) + 2)
        return NgramModel(np.zeros(1 << BITS), (0.0, float(np.log(share / (1 - share)))))
    place = np.zeros(len(rows), int)
    for y in (0, 1):
        place[labels == y] = np.arange(int((labels == y).sum()))
    texts = [r[1] or "" for r in rows]
    docs, slots, values = [], [], []
    n = np.zeros(len(rows))
    for doc, slot in hashed_features(texts):
        key, count = np.unique(doc * (1 << BITS) + slot, return_counts=True)
        docs.append((key >> BITS).astype(np.int32))
        slots.append((key & ((1 << BITS) - 1)).astype(np.int32))
        values.append(count.astype(np.float64))
        n += np.bincount(doc, minlength=len(rows))
    flat = []
    for parts in (docs, slots, values):
        flat.append(np.concatenate(parts) if parts else np.zeros(0, int))
        parts.clear()  # never all of it twice
    d, s, v = flat
    v = v / np.maximum(n, 1)[d]
    seen = (place % 3 != 2) | (len(rows) < 12)
    own = np.where(seen, np.where(labels == 1, 1 / max(1, (labels[seen] == 1).sum()), 1 / max(1, (labels[seen] == 0).sum())), 0)
    w, bias = np.zeros(1 << BITS), 0.0
    scale = np.sqrt(np.bincount(s, v * v * own[d], minlength=1 << BITS)) + 1e-4  # steps in the scale of each feature
    for _ in range(passes):
        z = np.bincount(d, w[s] * v, minlength=len(rows)) + bias
        g = (sigmoid(z) - labels) * own
        w -= rate / 10 * (np.bincount(s, g[d] * v, minlength=1 << BITS) / scale + 1e-3 * w * scale)
        bias -= g.sum()
    z = np.bincount(d, w[s] * v, minlength=len(rows))
    test = ~seen if (~seen).any() and len(set(labels[~seen])) == 2 else seen
    middle = float(z[test].mean())
    spread = float(z[test].std()) or 1.0
    c = logistic(np.column_stack([(z[test] - middle) / spread, np.ones(int(test.sum()))]), labels[test], 1e-3)
    return NgramModel(w, (float(c[0] / spread), float(c[1] - c[0] * middle / spread)))


def train_ngram(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_ROWS, held: tuple[int, int] = (5, 0)) -> NgramModel:
    return fit_ngram(training_rows(docs, labels, "quality", held, per_class))


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, model: NgramModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the five counts, base_failed, kept and the calibrated score of every row of
    ``docs`` (doc_id, text).

    Null and empty texts have zero counts, so they fail the base rules. Long texts are read whole,
    in pieces. Repeated rows are judged each, null ids as any other; an empty table gives an empty
    one. Other columns are not read, whatever their names.
    """
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = given.value
        for batch in (s for x in batches for s in small_batches(x)):
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            counts = np.array([base_counts(t) for t in texts], np.int64).reshape(len(texts), 5)
            failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEATED_PERCENT * counts[:, 0])
            score = sigmoid(m.calibration[0] * margins(m.weights, texts) + m.calibration[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c) for c in counts.T), pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)],
                names=["doc_id", *FIELDS, "base_failed", "kept", "score"],
            )

    ddl = "doc_id long, " + ", ".join(f"{x} long" for x in FIELDS) + ", base_failed boolean, kept boolean, score double"
    return docs.select("doc_id", "text").mapInArrow(run, ddl)
