"""Exact ranked retrieval over dual-sorted postings in wavelet trees, shard by shard.

A shard is some thousand documents, numbered in order of doc_id. Its postings stand term by term, the
highest impact first, as one sequence of document numbers. A wavelet matrix over that sequence splits
it by the numbers' bits, from the highest: each level moves zeros before ones and keeps the order, so
that a term's postings within any aligned range of documents are a run of some level, still by falling
impact. The first of each run bounds what the range can score, and at a single document the bound is
the score. A query starts with the whole range, opens the ranges of the highest bounds first, a few at
a time, and drops those that the k-th best found rules out; equal bounds are kept while they may hold
a smaller doc_id. What is left when nothing is open are the shard's k best, exactly.

Texts are read once for each block of items: the postings of the terms that the block asks for are
written, with each document's number of terms; sums of these give the collection's figures. Shards
are built and searched where their rows lie. A task hands on k rows an item, and two rounds of ranking
by item bring them together.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import text_bytes, written

#: ASCII letters (A-Z lower-cased), digits and every byte of other characters make terms; the rest is a gap.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
TOP = 10
#: Documents and postings of one shard, at most (a document is never cut).
SHARD_DOCS, SHARD_POSTINGS = 1 << 13, 1 << 20
#: Ranges that a query opens at a time.
OPENED = 48
#: Bytes of items whose terms are asked for in one pass over the documents; an item counts ITEM_BYTES more.
BLOCK_BYTES, ITEM_BYTES = 8 << 20, 64
#: First groups of ranking, for each item.
SALTS = 256


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def weight(n: int, df: int) -> int:
    """Of a term that ``df`` of ``n`` documents hold."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, length: np.ndarray, n: int, total: int) -> np.ndarray:
    """What a posting is worth under a weight of 1; 64-bit integers."""
    m = 25 + (75 * length * n) // total
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


@dataclass
class Shard:
    """``docs``: document numbers of the shard, ascending. ``start``: where each term's postings
    begin. ``zeros[k][i]``: zeros of level k before place i. ``worth[k]``: impacts as level k has them."""

    docs: np.ndarray
    start: np.ndarray
    zeros: np.ndarray
    worth: np.ndarray

    @property
    def levels(self) -> int:
        return len(self.zeros)


def build(order: np.ndarray, doc: np.ndarray, term: np.ndarray, worth: np.ndarray, terms: int) -> Shard:
    """Of postings (doc, term, worth), doc numbered from 0 in the order of ``order``, the doc_ids."""
    at = np.lexsort((doc, -worth, term))
    doc, term, worth = doc[at].astype(np.int32), term[at], worth[at].astype(np.int32)
    levels = max(0, int(len(order) - 1).bit_length())
    zeros, ranked = np.zeros((levels, len(doc) + 1), np.int32), np.empty((levels + 1, len(doc)), np.int32)
    ranked[0] = worth
    for k in range(levels):
        one = (doc >> (levels - 1 - k) & 1).astype(bool)
        np.cumsum(~one, out=zeros[k, 1:])
        move = np.concatenate((np.flatnonzero(~one), np.flatnonzero(one)))
        doc, ranked[k + 1] = doc[move], ranked[k][move]
    return Shard(order, np.searchsorted(term, np.arange(terms + 1)).astype(np.int32), zeros, ranked)


def best_of(shard: Shard, terms: np.ndarray, weights: np.ndarray, k: int, known: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The k highest (score, -doc) of the shard and of ``known``, highest first. ``weights`` hold the
    repeats of a term; doc is a doc_id, and known ones come from other shards."""
    found = sorted(known, reverse=True)[:k]
    low, high = shard.start[terms].astype(np.int64), shard.start[terms + 1].astype(np.int64)
    has = (high > low) & (weights > 0)
    low, high, weights = low[has], high[has], weights[has]
    if not len(low):
        return found
    levels = shard.levels

    def bounds(level: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        full = b > a
        return (np.where(full, shard.worth[level[:, None], np.where(full, a, 0)], 0) * weights).sum(1)

    level, first = np.zeros(1, np.int64), np.zeros(1, np.int64)
    a, b = low[None], high[None]
    bound = bounds(level, a, b)
    while len(bound):
        if len(bound) > OPENED:
            # the highest bounds first; of equal ones the deepest, then the smallest numbers
            pick = np.lexsort((first, -level, -bound))
            chosen, left = pick[:OPENED], pick[OPENED:]
        else:
            chosen, left = np.arange(len(bound)), np.zeros(0, np.int64)
        done = level[chosen] == levels
        for i in chosen[done]:
            found.append((int(bound[i]), -int(shard.docs[first[i]])))
        if done.any():
            found = sorted(found, reverse=True)[:k]
        up = chosen[~done]
        parts = [(level[left], first[left], a[left], b[left], bound[left])]
        if len(up):
            at, x, y = level[up], a[up], b[up]
            za, zb = shard.zeros[at[:, None], x], shard.zeros[at[:, None], y]
            step, ones = 1 << (levels - 1 - at), shard.zeros[at, -1][:, None]
            for ca, cb, cf in ((za, zb, first[up]), (ones + x - za, ones + y - zb, first[up] + step)):
                ca, cb = ca.astype(np.int64), cb.astype(np.int64)
                parts.append((at + 1, cf, ca, cb, bounds(at + 1, ca, cb)))
        level, first, a, b, bound = (np.concatenate(p) for p in zip(*parts, strict=True))
        keep = bound > 0
        if len(found) == k:
            least, doc = found[-1][0], -found[-1][1]
            keep &= (bound > least) | ((bound == least) & (shard.docs[np.minimum(first, len(shard.docs) - 1)] < doc))
        level, first, a, b, bound = level[keep], first[keep], a[keep], b[keep], bound[keep]
    return found


def postings(docs: DataFrame, vocabulary: Sequence[bytes]) -> DataFrame:
    """(doc_id, n, terms, tf) of every row: its number of terms, and those of the vocabulary (by
    number) with their counts. A null text has none; a null doc_id ranks before all others."""
    number = {t: i for i, t in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                length, ends, terms, tf = [], [0], [], []
                for text in text_bytes(b.column(1)):
                    words = terms_of(text)
                    length.append(len(words))
                    for w, c in Counter(words).items():
                        if w in number:
                            terms.append(number[w])
                            tf.append(c)
                    ends.append(len(terms))
                ends = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(v, pa.int32())) for v in (terms, tf)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(length, pa.int64()), *lists], names=["doc_id", "n", "terms", "tf"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>")


def document_frequencies(rows: DataFrame, terms: int) -> np.ndarray:
    """Of each term number, the rows that hold it: a count a task, then sums; one number a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(terms, np.int64)
        for b in batches:
            n += np.bincount(b.column(0).flatten().to_numpy(zero_copy_only=False), minlength=terms)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["term", "n"])

    got = rows.select("terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(terms, np.int64)
    out[got.column("term").to_numpy()] = got.column("n").to_numpy()
    return out


#: Stands for a null doc_id.
NO_ID = -(1 << 63)


def shards_of(batches: Iterator[pa.RecordBatch], terms: int, n: int, total: int) -> Iterator[Shard]:
    """Shards of a task's rows, in the order in which they come."""
    held: list[tuple[np.ndarray, ...]] = []
    docs = count = 0

    def made() -> Shard:
        ids, length, sizes, term, tf = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return build(ids[order], np.repeat(place, sizes), term, impacts(tf, np.repeat(length, sizes), n, total), terms)

    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            b = whole.slice(at, 256)
            ids = np.array([NO_ID if i is None else i for i in b.column(0).to_pylist()], np.int64)
            length, sizes = b.column(1).to_numpy(), b.column(2).value_lengths().to_numpy()
            term, tf = (b.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
            some = sizes > 0
            if not some.any():
                continue
            held.append((ids[some], length[some], sizes[some], term, tf))
            docs, count = docs + int(some.sum()), count + len(term)
            if docs >= SHARD_DOCS or count >= SHARD_POSTINGS:
                yield made()
                held, docs, count = [], 0, 0
    if held:
        yield made()


def shard_tops(rows: DataFrame, asked: Sequence[tuple[np.ndarray, np.ndarray]], terms: int, n: int, total: int, k: int) -> DataFrame:
    """(item, doc_id, score): each task's k best of each item. ``asked`` has term numbers and weights
    for each item; what a task's earlier shards found rules out ranges of the later ones."""
    given = rows.sparkSession.sparkContext.broadcast(asked)  # BLOCK_BYTES of items make its terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in given.value]
        for shard in shards_of(batches, terms, n, total):
            for i, (term, w) in enumerate(given.value):
                best[i] = best_of(shard, term, w, k, best[i])
        item = np.repeat(np.arange(len(best)), [len(x) for x in best])
        doc, score = [-d for x in best for _, d in x], [s for x in best for s, _ in x]
        ids = pa.array([None if d == NO_ID else d for d in doc], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), ids, pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return rows.mapInArrow(run, "item int, doc_id long, score long")


def ranked(tops: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first()))
    return tops.withColumn("rank", place).where(F.col("rank") <= k)


def search_block(docs: DataFrame, items: list[tuple[int | None, bytes]], k: int) -> DataFrame:
    """(item_id, rank, doc_id, score) for items that are at hand."""
    spark = docs.sparkSession
    words = [Counter(terms_of(t)) for _, t in items]
    vocabulary = sorted(set().union(*words))
    number = {t: i for i, t in enumerate(vocabulary)}
    rows = written(postings(docs, vocabulary), "postings")
    n, total = rows.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = document_frequencies(rows, len(vocabulary))
    asked = []
    for w in words:
        terms = sorted(number[t] for t in w)
        weights = [w[vocabulary[t]] * weight(n, int(df[t])) for t in terms]
        asked.append((np.array(terms, np.int64), np.array(weights, np.int64)))
    tops = shard_tops(rows, asked, len(vocabulary), n, max(1, total), k).withColumn("salt", F.spark_partition_id() % SALTS)
    best = ranked(ranked(tops, ["item", "salt"], k).drop("rank"), ["item"], k)
    names = spark.createDataFrame([(i, key) for i, (key, _) in enumerate(items)], "item int, item_id long")
    return best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # an id an item of the block


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents (doc_id, text) of every item
    (item_id, text), scores above 0, equal scores by doc_id.

    Null and empty texts have no terms: such documents are never found, such items find nothing.
    Rows that repeat a doc_id are documents each; rows that repeat an item_id are items each, with
    ranks of their own. A null doc_id ranks before others of its score. Empty tables give no rows.
    Other columns aren't read, whatever their names. Items are taken in blocks of about BLOCK_BYTES
    of text, each one pass over the documents.
    """
    slim = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = slim.agg(F.coalesce(F.sum(F.octet_length("text") + ITEM_BYTES), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    out = None
    for block in range(blocks):
        mine = slim if blocks == 1 else slim.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = [(r["item_id"], r["text"].encode()) for r in mine.orderBy("item_id", "text").collect()]  # a block of the stated items
        part = search_block(docs, rows, k)
        out = part if out is None else out.unionByName(part)
    return out


GAPS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ORACLE = f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{GAPS}')) AS w FROM documents
), q AS MATERIALIZED (
  SELECT i, item_id, w, count(*) AS times FROM (
    SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{GAPS}')) AS w FROM benchmark) GROUP BY ALL
), n AS MATERIALIZED (SELECT r, any_value(doc_id) AS doc_id, count(*)::BIGINT AS n FROM d GROUP BY r),
c AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nl FROM n),
p AS MATERIALIZED (SELECT r, w, count(*)::BIGINT AS tf FROM d WHERE w IN (SELECT w FROM q) GROUP BY ALL),
f AS (SELECT w, count(*)::BIGINT AS df FROM p GROUP BY w),
g AS (SELECT w, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight FROM f, c),
s AS (
  SELECT i, item_id, n.doc_id, p.r, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n.n * nd) // nl))))::BIGINT AS score
  FROM q JOIN p ON q.w = p.w JOIN g ON g.w = q.w JOIN n ON n.r = p.r, c GROUP BY ALL
), o AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST, r) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM o WHERE rank <= {TOP}
"""
