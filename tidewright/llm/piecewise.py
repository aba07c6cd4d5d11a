"""Document fingerprints by context-triggered piecewise hashing.

A hash of the last WINDOW bytes rolls over the text; where it hits a value set by the block
size, a chunk ends. Each chunk's own hash gives one of 64 characters, so an edit changes
the characters of the chunks it touches and no others. A fingerprint is
``block size:signature:signature at twice the block size``. Two fingerprints are compared by
edit distance where their block sizes are equal or one is twice the other.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import mix64, small_batches, span_hashes, written

WINDOW = 7
LEAST_BLOCK = 3
#: A signature of about this many characters is aimed at; periodic texts go beyond it.
LENGTH = 64
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_letters = np.frombuffer(ALPHABET.encode(), np.uint8)
_codes = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64)


def rolling(data: np.ndarray) -> np.ndarray:
    """A hash of the WINDOW bytes that end at each position (fewer at the start)."""
    codes = _codes[data]
    out = np.zeros(len(data), np.uint64)
    for k in range(min(WINDOW, len(data))):
        out[k:] += (codes[: len(data) - k]) << np.uint64(5 * k)
    return mix64(out) >> np.uint64(32)


def signature(data: np.ndarray, roll: np.ndarray, block: int) -> str:
    """One character a chunk; what follows the last boundary is a chunk as well. Boundaries at
    twice a block size are boundaries at the block size. No chunk is left out: a periodic text,
    whose boundaries may follow one another much faster, has a longer signature."""
    ends = np.flatnonzero(roll % np.uint64(block) == block - 1) + 1
    if not len(ends) or ends[-1] != len(data):
        ends = np.append(ends, len(data))
    starts = np.concatenate(([0], ends[:-1]))
    return _letters[(span_hashes(data, starts, ends) >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(text: bytes) -> str:
    """The fingerprint of a whole text; an empty one has empty signatures. The block size follows
    from the length alone, so that an edit that keeps the length keeps it."""
    if not text:
        return f"{LEAST_BLOCK}::"
    data = np.frombuffer(text, np.uint8)
    block = LEAST_BLOCK
    while block * LENGTH < len(data):
        block *= 2
    roll = rolling(data)
    return f"{block}:{signature(data, roll, block)}:{signature(data, roll, 2 * block)}"


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, a column of differences at a time in the bits of an integer. What
    both begin or end with costs nothing and is cut off first."""
    same = len(os.path.commonprefix((a, b)))
    a, b = a[same:], b[same:]
    same = len(os.path.commonprefix((a[::-1], b[::-1])))
    a, b = a[: len(a) - same], b[: len(b) - same]
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    full, last = (1 << len(b)) - 1, 1 << (len(b) - 1)
    at: dict[str, int] = {}
    for i, c in enumerate(b):
        at[c] = at.get(c, 0) | 1 << i
    up, down, distance = full, 0, len(b)
    for c in a:
        x = at.get(c, 0)
        diagonal = (((x & up) + up) ^ up) | x | down
        rise, fall = down | (full & ~(diagonal | up)), up & diagonal
        distance += bool(rise & last) - bool(fall & last)
        rise = (rise << 1 | 1) & full
        up, down = (fall << 1 & full) | (full & ~(diagonal | rise)), rise & diagonal
    return distance


def alike(a: str, b: str) -> float:
    """1 - edit distance / longer length; 0 without a common run of a third of the shorter
    signature (7 characters at most), which unrelated texts rarely have."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0
    run = max(1, min(WINDOW, len(short) // 3))
    parts = {long[i : i + run] for i in range(len(long) - run + 1)}
    if not any(short[i : i + run] in parts for i in range(len(short) - run + 1)):
        return 0.0
    return 1 - edit_distance(a, b) / len(long)


def likeness(a: str, b: str) -> float:
    """Of two fingerprints, 0 to 1; 1 for equal ones, 0 at incompatible block sizes."""
    if a == b:
        return 1.0
    (x, a1, a2), (y, b1, b2) = ((int(p[0]), p[1], p[2]) for p in (a.split(":"), b.split(":")))
    if x == y:
        return max(alike(a1, b1), alike(a2, b2))
    if x == 2 * y:
        return alike(a1, b2)
    return alike(a2, b1) if y == 2 * x else 0.0


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as many first characters of ``following``."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


FIELDS = ("doc_id", "n_chars", "fingerprint", "edited_sha256", "edited_fingerprint", "near_edited", "near_next")


def row(doc_id: int | None, text: str, own: str, following: str, following_print: str) -> tuple:
    other = edited(text, following)
    print_ = fingerprint(other.encode())
    return (doc_id, len(text), own, hashlib.sha256(other.encode()).hexdigest(), print_, likeness(own, print_), likeness(own, following_print))


ROW_DDL = "doc_id long, n_chars long, fingerprint string, edited_sha256 string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Fingerprints of every row of ``docs`` and of its edited text, with their likeness and
    that to the next document (descending doc_id; after the last the first).

    One range shuffle puts the rows in order; each partition walks its own. Its first and
    last text are passed on, and the few rows at the joints are finished from those.
    Null texts are empty. Equal doc_ids follow one another by a hash of the text, then by text;
    null doc_ids come last. Ranges go by these and the row's place in the input, so that rows
    which repeat a doc_id, or even a text, don't crowd one task. Long texts are hashed whole. A
    single row is its own next; an empty table gives an empty one. Other columns are not read,
    whatever their names.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("hash", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    order = [F.col("doc_id").desc_nulls_last(), F.col("hash").asc()]
    ordered = docs.repartitionByRange(n, *order, F.col("place").asc()).sortWithinPartitions(*order, "text", "place").select(F.spark_partition_id().alias("part"), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # the row before: its next is not known yet
        for batch in (s for x in batches for s in small_batches(x, 256)):
            done, heads = [], []
            for part, i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = fingerprint(text.encode())
                if last is None:
                    heads.append((part, text))
                else:
                    done.append(row(*last[1:], text, own))
                last = (part, i, text, own)
            yield packed(done, heads, [])
        if last is not None:
            yield packed([], [], [last[:3]])

    def packed(done: list[tuple], heads: list[tuple], tails: list[tuple]) -> pa.RecordBatch:
        """Finished rows, and unfinished ends: kind 1 a partition's first text, kind 2 its last row."""
        columns = [[0] * len(done) + [1] * len(heads) + [2] * len(tails)]
        columns += [[None] * len(done) + [h[0] for h in heads] + [t[0] for t in tails]]
        columns += [[None] * len(done) + [h[1] for h in heads] + [t[2] for t in tails]]
        ids = [[d[0] for d in done] + [None] * len(heads) + [t[1] for t in tails]]
        rest = [[d[k] for d in done] + [None] * (len(heads) + len(tails)) for k in range(1, 7)]
        types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns + ids + rest, types, strict=True)], names=["kind", "part", "payload", *FIELDS])

    walked = written(ordered.mapInArrow(run, f"kind int, part int, payload string, {ROW_DDL}"), "walked")
    # two rows a partition from here on
    heads = walked.where("kind = 1").select("part", F.col("payload").alias("head"))
    wrap = F.first("part").over(Window.orderBy("part"))
    after = F.lead("part").over(Window.orderBy("part"))
    following = heads.select("part").select(F.col("part").alias("p"), F.coalesce(after, wrap).alias("follows"))
    ends = walked.where("kind = 2").select("part", "doc_id", "payload").join(following, F.col("part") == F.col("p"))
    ends = ends.drop("part", "p").join(heads, F.col("follows") == F.col("part")).select("doc_id", F.col("payload").alias("text"), "head")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [row(i, t, fingerprint(t.encode()), h, fingerprint(h.encode())) for i, t, h in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=list(FIELDS))

    return walked.where("kind = 0").select(*FIELDS).unionByName(ends.mapInArrow(finish, ROW_DDL))
