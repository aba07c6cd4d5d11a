"""Language identification by prediction by partial matching (PPM).

For each language a variable-order byte context tree is counted over a bounded sample of
labelled texts and then frozen. The code length of a byte is the usual PPM one: in the
longest context that the tree has, count / (total + distinct) if the byte followed it, else
the escape distinct / (total + distinct) and the next shorter context; below order 0 all
256 bytes are equal. A text's language is the one whose tree codes it shortest.

As the statistics are frozen, the code length of a byte depends on the last ORDER + 1 bytes only. The
trees are kept sparse, as sorted tables of what followed a context in any language, with a code length
a language, and of the contexts with their escapes: nothing that the sample holds is dropped, and the
model grows with the sample alone. A batch looks up each different run of ORDER + 1 bytes once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import SAMPLE_TEXT, bounded_sample, by_bytes, id_remainder, sample_text, text_bytes

ORDER = 3
#: Labelled documents read for each language, at most; a documented bound of the fit.
SAMPLE_DOCS = 300
#: Code points of the whole sample, at most: with many languages each text gives fewer of them, in
#: parts from all over it (SAMPLE_TEXT at most, SAMPLE_LEAST at least).
SAMPLE_CHARS, SAMPLE_LEAST = 1 << 27, 256
#: Bytes of a text that are coded together.
PIECE = 1 << 18
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"
#: Code length of a byte in no context at all.
PLAIN = 8.0


@dataclass(frozen=True)
class PpmModel:
    """Level k: ``grams[k]`` are the runs of k + 1 bytes in the sample as ascending numbers and
    ``bits[k]`` the code lengths (run, language) of their last byte after the others; ``contexts[k]``
    the runs of k bytes that something followed and ``escapes[k]`` what leaving them costs."""

    languages: tuple[str, ...]
    grams: tuple[np.ndarray, ...]
    bits: tuple[np.ndarray, ...]
    contexts: tuple[np.ndarray, ...]
    escapes: tuple[np.ndarray, ...]

    @property
    def order(self) -> int:
        return len(self.grams) - 1


def runs(data: np.ndarray, k: int) -> np.ndarray:
    """The runs of k bytes that start at each place, the first byte highest."""
    n = len(data) - k + 1
    out = np.zeros(max(0, n), np.uint64)
    for i in range(k if n > 0 else 0):
        out = out << np.uint64(8) | data[i : i + n].astype(np.uint64)
    return out


def found_in(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where keys stand in a sorted table, whether they do)."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def gram_costs(model: PpmModel, grams: np.ndarray, k: int) -> np.ndarray:
    """(run, language): the code lengths of the last bytes of runs of k + 1 bytes."""
    out = np.zeros((len(grams), len(model.languages)))
    open_, keys = np.arange(len(grams)), grams
    for level in range(k, -1, -1):
        if not len(open_):
            return out
        at, hit = found_in(model.grams[level], keys)
        out[open_[hit]] += model.bits[level][at[hit]]
        open_, keys = open_[~hit], keys[~hit]
        at, known = found_in(model.contexts[level], keys >> np.uint64(8))
        out[open_[known]] += model.escapes[level][at[known]]
        keys = keys & np.uint64((1 << 8 * level) - 1)
    out[open_] += PLAIN
    return out


def fit_ppm(rows: list[tuple[int, str, str]], order: int = ORDER) -> PpmModel:
    """rows: (doc_id, text, lang). Frozen trees of all languages."""
    languages = tuple(sorted({r[2] for r in rows}))
    texts = {x: np.frombuffer(b"\n".join((t or "").encode() for _, t, g in sorted(rows, key=lambda r: r[0]) if g == x), np.uint8) for x in languages}
    model = PpmModel(languages, (), (), (), ())
    for k in range(order + 1):
        seen = [np.unique(runs(texts[x], k + 1), return_counts=True) for x in languages]
        grams = np.unique(np.concatenate([g for g, _ in seen])) if seen else np.zeros(0, np.uint64)
        contexts, of = np.unique(grams >> np.uint64(8), return_inverse=True)
        # what a language has not seen is coded by leaving the context, if it has seen that
        shorter = gram_costs(model, grams & np.uint64((1 << 8 * k) - 1), k - 1) if k else np.full((len(grams), len(languages)), PLAIN)
        bits, escapes = np.zeros((len(grams), len(languages)), np.float32), np.zeros((len(contexts), len(languages)), np.float32)
        for j, (own, n) in enumerate(seen):
            count = np.zeros(len(grams))
            count[np.searchsorted(grams, own)] = n
            total, distinct = np.bincount(of, count, len(contexts)), np.bincount(of, count > 0, len(contexts))
            whole = np.maximum(total + distinct, 1)
            escapes[:, j] = np.where(total > 0, -np.log2(np.where(total > 0, distinct, 1) / whole), 0)
            with np.errstate(divide="ignore"):
                bits[:, j] = np.where(count > 0, -np.log2(count / whole[of]), escapes[of, j] + shorter[:, j])
        model = PpmModel(languages, (*model.grams, grams), (*model.bits, bits), (*model.contexts, contexts), (*model.escapes, escapes))
    return model


def code_lengths(model: PpmModel, texts: list[bytes], piece: int = PIECE) -> np.ndarray:
    """Bits of each text under each language, (texts, languages). A long text is coded in pieces,
    each with the few bytes before it as its context."""
    out = np.zeros((len(texts), len(model.languages)))
    order = model.order
    parts = [(i, max(0, a - order), a, min(len(t), a + piece)) for i, t in enumerate(texts) for a in range(0, len(t), piece)]
    data_of = [texts[i][a:e] for i, a, _, e in parts]
    for first, last in by_bytes(data_of, piece):
        sizes = np.array([len(t) for t in data_of[first:last]])
        data = np.frombuffer(b"".join(data_of[first:last]), np.uint8)
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        place = np.arange(len(data)) - np.repeat(starts, sizes)  # bytes since the piece's start
        lengths = np.zeros((len(data), len(model.languages)))
        for k in range(order + 1):  # bytes with k bytes before them, or more at the last
            at = np.flatnonzero(place == k if k < order else place >= k)
            if len(at):
                grams, where = np.unique(runs(data, k + 1)[at - k], return_inverse=True)
                lengths[at] = gram_costs(model, grams, k)[where]
        cum = np.vstack((np.zeros(lengths.shape[1]), np.cumsum(lengths, 0)))
        for p, (i, a, begin, _) in enumerate(parts[first:last]):
            out[i] += cum[starts[p] + sizes[p]] - cum[starts[p] + begin - a]
    return out


def languages_of(model: PpmModel, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
    """The best language and its posterior probability under equal priors; ``und`` and 0 for a
    text without letters. Equal code lengths: the first language by code point."""
    if not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    bits = code_lengths(model, texts)
    best = bits.argmin(1)
    odds = np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000))
    score = odds.max(1) / odds.sum(1)
    known = np.array([LETTER.search(t.decode("utf-8", "replace")) is not None for t in texts], bool)
    return [model.languages[i] if ok else UNKNOWN for i, ok in zip(best, known, strict=True)], np.where(known, score, 0.0)


def train_ppm(docs: DataFrame, per_language: int = SAMPLE_DOCS, held: tuple[int, int] = (4, 2)) -> PpmModel:
    """Reads text and non-null lang of documents outside the held-out remainder only; of repeated
    ids, the smallest text counts."""
    modulus, out = held
    rows = docs.select("doc_id", "text", "lang").where((id_remainder(F.col("doc_id"), modulus) != out) & F.col("text").isNotNull())
    ids = bounded_sample(rows.select("doc_id", "lang").where(F.col("doc_id").isNotNull()), "lang", "doc_id", per_language)
    chosen = rows.join(F.broadcast(ids), ["doc_id", "lang"])  # per_language rows a language
    chosen = chosen.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    languages = ids.select("lang").distinct().count()
    most = max(SAMPLE_LEAST, min(SAMPLE_TEXT, SAMPLE_CHARS // max(1, languages * per_language)))
    return fit_ppm([tuple(r) for r in chosen.select("doc_id", sample_text(F.col("text"), most).alias("text"), "lang").collect()])


def identify(docs: DataFrame, model: PpmModel, held: tuple[int, int] = (4, 2)) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text).

    Null, empty and letterless texts are ``und`` with score 0, and all are where no language was
    learned. Equal code lengths: the first language by code point. Long texts are coded whole, in
    pieces. Repeated rows are scored each; null ids are held out by the crc32 of an empty text; an
    empty table gives an empty one. Other columns are not read, whatever their names."""
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = languages_of(given.value, text_bytes(batch.column(2)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    modulus, out = held
    rows = docs.select("doc_id", (id_remainder(F.col("doc_id"), modulus) == out).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
