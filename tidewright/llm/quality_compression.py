"""Quality classifier by compression: which dictionary, good or bad, explains a text better.

Two zstandard dictionaries are trained on a bounded sample of labelled texts. Every text is
compressed with both, in independent blocks so that the dictionary and not the text's own
history decides; the normalised difference of the two sizes is turned into a probability by a
logistic curve fitted on the other half of the sample. The curve shrinks a text of few compressed
bytes towards the base rate, as its difference says little. Nothing else enters a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import bounded_sample, id_remainder, sample_text, text_bytes

#: Labelled rows read for each class, at most: a documented bound of the fit. A text of over
#: SAMPLE_TEXT code points (llm/common.py) gives as many of them, in parts from all over it.
SAMPLE_ROWS = 1500
#: Bytes that are compressed together, and bytes of a dictionary and of the samples it is trained on.
BLOCK = 512
DICTIONARY_BYTES = 110 << 10
PIECE, PIECES_BYTES = 2048, 8 << 20
LEVEL = 3
#: Compressed bytes (both sizes together) at which a text's difference counts half.
HALF = 100


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    curve: tuple[float, float, float]  # log odds = curve[0] + weight * (curve[1] + curve[2] * difference)

    def scorer(self) -> Scorer:
        return Scorer(self)


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    given = zstandard.ZstdCompressionDict(dictionary) if dictionary else None  # raw content where it has no dictionary's head
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=given, write_content_size=False, write_checksum=False, write_dict_id=False)


class Scorer:
    """The two compressors of one task."""

    def __init__(self, model: CompressionModel):
        self.good, self.bad, self.curve = compressor(model.good), compressor(model.bad), model.curve

    def sizes(self, text: bytes) -> tuple[int, int]:
        """Compressed with the good and with the bad dictionary; an empty text has none."""
        g = b = 0
        for i in range(0, len(text), BLOCK):
            part = text[i : i + BLOCK]
            g += len(self.good.compress(part))
            b += len(self.bad.compress(part))
        return g, b

    def features(self, texts: list[bytes]) -> np.ndarray:
        """1, the weight n / (n + HALF) of n compressed bytes, and (bad - good) / n times it."""
        g, b = np.array([self.sizes(t) for t in texts], float).reshape(-1, 2).T
        n = g + b
        return np.column_stack((np.ones(len(n)), n / (n + HALF), (b - g) / (n + HALF)))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return sigmoid(self.features(texts) @ np.array(self.curve))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps for a small ridge-penalised logistic regression."""
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def pieces(texts: list[bytes], size: int = PIECES_BYTES) -> list[bytes]:
    """Pieces of PIECE bytes, one of each text in turn, up to ``size`` bytes: a long text has no
    larger part than a short one until the short one ends."""
    out, at, total = [], 0, 0
    texts = [t for t in texts if t]
    while texts and total < size:
        for t in texts:
            out.append(t[at : at + PIECE])
            total += len(out[-1])
            if total >= size:
                break
        at += PIECE
        texts = [t for t in texts if len(t) > at]
    return out


def dictionary(texts: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary trained on pieces of the texts; of too few or too short ones, their raw bytes."""
    parts = pieces(texts)
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[:size]


def fit_compression(rows: list[tuple[int, str, int]]) -> CompressionModel:
    """rows: (doc_id, text, label). Dictionaries from the even rows of each class, calibration
    on the odd ones. With one class only, the score is that class's share."""
    rows = sorted(rows, key=lambda r: (r[2], r[0]))
    sides: dict[int, list[bytes]] = {0: [], 1: []}
    rest: list[tuple[bytes, int]] = []
    seen = {0: 0, 1: 0}
    for _, text, y in rows:
        data = (text or "").encode()
        (sides[y].append(data) if seen[y] % 2 == 0 else rest.append((data, y)))
        seen[y] += 1
    if not seen[0] or not seen[1]:
        share = (seen[1] + 1) / (seen[0] + seen[1] + 2)
        return CompressionModel(b"", b"", (float(np.log(share / (1 - share))), 0.0, 0.0))
    raw = CompressionModel(dictionary(sides[1]), dictionary(sides[0]), (0.0, 0.0, 0.0))
    rest = rest or [(t, y) for y in (0, 1) for t in sides[y]]
    scale = np.array([1.0, 1.0, 20.0])  # a difference is some hundredths
    w = logistic(raw.scorer().features([t for t, _ in rest]) * scale, np.array([y for _, y in rest], float), 1e-3) * scale
    return CompressionModel(raw.good, raw.bad, tuple(map(float, w)))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, held: tuple[int, int], per_class: int) -> list:
    """(doc_id, text, label) of at most ``per_class`` labelled documents a class whose crc32
    remainder is not the held-out one; of a long text, parts. Of repeated ids, the smallest label
    and the smallest text count."""
    modulus, out = held
    marked = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (id_remainder(F.col("doc_id"), modulus) != out))
        .groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    )
    chosen = bounded_sample(marked, "y", "doc_id", per_class)
    # at most 2 * per_class rows are broadcast
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    return [tuple(r) for r in joined.select("doc_id", sample_text(F.col("text")).alias("text"), "y").collect()]


def train_compression(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_ROWS, held: tuple[int, int] = (5, 0)) -> CompressionModel:
    return fit_compression(training_rows(docs, labels, "quality", held, per_class))


def score_compression(docs: DataFrame, model: CompressionModel, threshold: float = 0.3, held: tuple[int, int] = (5, 0)) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text).

    Null and empty texts have no bytes: their score is the curve's base rate. Long texts are
    compressed whole, block by block. Repeated rows are scored each; null ids are held out by the
    crc32 of an empty text; an empty table gives an empty one. Other columns are not read, whatever
    their names. Ties don't arise: a score depends on its own text only.
    """
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = given.value.scorer()
        for batch in batches:
            s = scorer.scores(text_bytes(batch.column(2)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    modulus, out = held
    rows = docs.select("doc_id", (id_remainder(F.col("doc_id"), modulus) == out).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: CompressionModel, threshold: float = 0.3) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; columns unchanged, whatever their
    names. Null and empty texts are judged as empty ones, repeated rows each."""
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = given.value.scorer()
        for batch in batches:
            s = scorer.scores(text_bytes(batch.column(batch.schema.names.index("text"))))
            yield batch.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema)
