"""Nearest neighbours and the median distance through balls around pivots.

Some hundred rows of the table are pivots. A row belongs to the ball of its nearest pivot, and there to
a ring of distances from it. The triangle inequality then says, from a point's distances to the pivots
alone, which rings can hold anything nearer than what it has found already, and, from two rings'
pivots and radii, that all distances between them lie on one side of a value. What can't be settled so is
compared, and no pair is left out: where distances are alike, as among random points of many
dimensions, nothing can be settled and the work nears all pairs.

Rows are packed into chunks of neighbouring rings, and a task meets one chunk with a few others, read
as they are dealt: rows are not copied for each of those that they meet, so that disk follows the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.vectors import EPS, as_lists, rows_of
from tidewright.shared import forget, remove, write_once, written

#: Points that are compared with as many others at a time, and rows of a ring at about.
BLOCK = 512
#: Pivots, and rings of one ball, at most. A larger ring is dealt into parts, which are all met.
MAX_PIVOTS, RINGS = 1024, 64


def exact_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(rows of a, rows of b): squared distances summed over the coordinates in order, so that a pair's
    is the same wherever it is computed."""
    d = np.zeros((len(a), len(b)))
    for u, v in zip(a.T, b.T, strict=True):
        e = u[:, None] - v[None]
        e *= e
        d += e
    return d


def product_squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """The same by one matrix product, and how far any of them may be off."""
    aa, bb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    d = a @ (-2.0 * b.T)
    d += aa[:, None]
    d += bb
    return d, 8 * (a.shape[1] + 4) * EPS * (float(aa.max(initial=0.0)) + float(bb.max(initial=0.0))) + 1e-300


@dataclass(frozen=True)
class Balls:
    """``cuts``: RINGS - 1 ascending distances of each pivot, infinite beyond its last ring; ``reach``:
    least and greatest distance of each ring's rows, ``sizes`` their numbers (pivot, ring)."""

    pivots: np.ndarray
    cuts: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sizes: np.ndarray

    @cached_property
    def slack(self) -> float:
        """What rounding may take from a distance to a pivot, at most, for rows in the balls."""
        top = float(np.sqrt((self.pivots**2).sum(1)).max(initial=0.0)) + float(self.high[np.isfinite(self.high)].max(initial=0.0))
        return float(np.sqrt(16 * (self.pivots.shape[1] + 4) * EPS)) * top

    def distances(self, x: np.ndarray) -> np.ndarray:
        d, _ = product_squares(x, self.pivots)
        return np.sqrt(np.maximum(d, 0))

    def ring(self, ball: np.ndarray, r: np.ndarray) -> np.ndarray:
        return (self.cuts[ball] < r[:, None]).sum(1)

    def rings_within(self, x: np.ndarray, own: np.ndarray, reach: np.ndarray) -> list[np.ndarray]:
        """For each row, in the ball ``own``: the numbers (ball * RINGS + ring) of the rings that may hold
        a row at most ``reach`` away."""
        d, slack = self.distances(x), self.slack
        low, high = d - slack - reach[:, None], d + slack + reach[:, None]
        # a row of another ball is nearer to that ball's pivot
        aside = (d - slack - (d[np.arange(len(d)), own] + slack)[:, None]) / 2 <= reach[:, None] + slack
        aside[np.arange(len(d)), own] = True
        i, b = np.nonzero(aside & (low <= self.high.max(1) + slack) & (high >= self.low.min(1) - slack))
        meets = (self.sizes[b] > 0) & (self.low[b] - slack <= high[i, b][:, None]) & (self.high[b] + slack >= low[i, b][:, None])
        pair, ring = np.nonzero(meets)
        numbers = b[pair] * RINGS + ring
        return np.split(numbers, np.cumsum(np.bincount(i[pair], minlength=len(x)))[:-1])

    def may_hold(self, x: np.ndarray, own: np.ndarray, reach: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """(rows, numbers): which of these rings may hold a row at most ``reach`` away, as ``rings_within``."""
        some, at = np.unique(numbers // RINGS, return_inverse=True)
        ball, ring, slack = numbers // RINGS, numbers % RINGS, self.slack
        d = np.sqrt(np.maximum(product_squares(x, self.pivots[some])[0], 0))
        to_own = np.sqrt(((x - self.pivots[own]) ** 2).sum(1))
        aside = (d - slack - (to_own + slack)[:, None]) / 2 <= reach[:, None] + slack
        aside |= own[:, None] == some[None]
        low, high = d - slack - reach[:, None], d + slack + reach[:, None]
        return aside[:, at] & (self.low[ball, ring] - slack <= high[:, at]) & (self.high[ball, ring] + slack >= low[:, at])


#: Rows of the sample of pivots for each of them, and numbers of the sample, at most (a row a pivot at least).
SAMPLED, SAMPLE_CELLS = 8, 1 << 22


def pivots_of(sample: np.ndarray, count: int) -> np.ndarray:
    """At most ``count`` different rows: the first half as they come, so that dense places have many,
    then the row that is farthest from all of them, so that no group far off has none."""
    sample = np.unique(sample, axis=0)
    sample = sample[np.random.default_rng(5).permutation(len(sample))]
    chosen = list(range(min(len(sample), -(-count // 2))))
    if not chosen:
        return sample
    away = product_squares(sample, sample[chosen])[0].min(1)
    while len(chosen) < min(count, len(sample)):
        far = int(away.argmax())
        if away[far] <= 0:
            break
        chosen.append(far)
        away = np.minimum(away, ((sample - sample[far]) ** 2).sum(1))
    return sample[sorted(set(chosen))]


def balls_of(points: DataFrame, n: int, rows: int = BLOCK) -> tuple[DataFrame, Balls, str]:
    """(key, x, ball, ring) of rows (key, x), written, the balls, and the folder. Pivots, one for about ``rows``
    rows, are rows of a sample; the driver gets the sample and RINGS numbers of each pivot."""
    spark = points.sparkSession
    count = max(1, min(MAX_PIVOTS, -(-n // rows)))
    first = points.select(F.size("x")).first()
    dim = max(1, first[0] if first else 1)
    some = points.orderBy(F.xxhash64("key", F.lit(11)), "key").limit(max(count, min(SAMPLED * count, SAMPLE_CELLS // dim)))
    pivots = pivots_of(np.array([r["x"] for r in some.collect()], float).reshape(-1, dim), count)
    given = spark.sparkContext.broadcast(pivots)

    kind = points.schema["x"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, BLOCK):
                b = whole.slice(a, BLOCK)
                d, _ = product_squares(rows_of(b.column(1)), given.value)
                ball = d.argmin(1)
                r = np.sqrt(np.maximum(d[np.arange(len(d)), ball], 0))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ball.astype(np.int32)), pa.array(r)], names=["key", "x", "ball", "r"])

    assigned = points.mapInArrow(assign, f"key long, x {kind}, ball int, r double")
    shares = F.array(*[F.lit(k / RINGS) for k in range(1, RINGS)])
    found = assigned.groupBy("ball").agg(F.count("*").alias("n"), F.percentile_approx("r", shares, F.lit(10_000)).alias("cuts")).collect()  # a row a pivot
    cuts = np.full((len(pivots), RINGS - 1), np.inf)
    for f in found:
        rings = min(RINGS, -(-f["n"] // rows))
        own = np.unique([f["cuts"][RINGS * k // rings - 1] for k in range(1, rings)])
        cuts[f["ball"], : len(own)] = own
    known = spark.sparkContext.broadcast(cuts)

    def ringed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, BLOCK):
                b = whole.slice(a, BLOCK)
                ball, r = b.column(2).to_numpy(), b.column(3).to_numpy()
                ring = (known.value[ball] < r[:, None]).sum(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ring)], names=["key", "x", "ball", "r", "ring"])

    rings, path = write_once(assigned.mapInArrow(ringed, f"key long, x {kind}, ball int, r double, ring int"), "rings")
    limits = rings.groupBy("ball", "ring").agg(F.count("*").alias("n"), F.min("r").alias("low"), F.max("r").alias("high")).collect()  # RINGS rows a pivot
    low, high, sizes = np.full((len(pivots), RINGS), np.inf), np.full((len(pivots), RINGS), -np.inf), np.zeros((len(pivots), RINGS), np.int64)
    for f in limits:
        at = f["ball"], f["ring"]
        low[at], high[at], sizes[at] = f["low"], f["high"], f["n"]
    return rings, Balls(pivots, cuts, low, high, sizes), path


#: Rows of a chunk, at least; chunks, at most while they are under HELD bytes; chunks that a task meets one with.
CHUNK, CHUNKS, HELD, TURN = 4096, 128, 1 << 25, 16


@dataclass(frozen=True)
class Deal:
    """Which of ``count`` chunks hold a group's rows: ``parts`` of them from ``first`` on, by the key."""

    first: np.ndarray
    parts: np.ndarray
    count: int

    def chunk(self, group: np.ndarray, key: np.ndarray) -> np.ndarray:
        h = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (self.first[group] + (h >> np.uint64(33)).astype(np.int64) % self.parts[group]).astype(np.int32)


def dealt(sizes: np.ndarray, length: int) -> Deal:
    """Groups of ``sizes`` rows in their order, about ``length`` rows a chunk; a larger group has chunks of its own."""
    first, parts, chunk, filled = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, 0
    for g in np.flatnonzero(sizes):
        n = int(sizes[g])
        if filled and filled + n > length:
            chunk, filled = chunk + 1, 0
        first[g], parts[g] = chunk, -(-n // length)
        filled += n
        if n > length:
            chunk, filled = chunk + int(parts[g]), 0
    return Deal(first, parts, chunk + (filled > 0))


def chunk_rows(n: int, dim: int, least: int) -> int:
    return max(1, min(max(least, -(-n // CHUNKS)), max(least, HELD // (8 * dim))))


def packed(rows: DataFrame, deal: Deal) -> tuple[DataFrame, str]:
    """(c, keys, groups, x) of rows (g, key, x): a chunk's rows by group and key, written, and the folder."""
    width = "<f4" if rows.schema["x"].dataType.elementType.simpleString() == "float" else "<f8"
    kind = rows.schema["x"].dataType.simpleString()
    given = rows.sparkSession.sparkContext.broadcast(deal)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = given.value.chunk(b.column(0).to_numpy(), b.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(c), *b.columns], names=["c", "g", "key", "x"])

    def pack(group: pa.Table) -> pa.Table:
        g, key = group.column("g").to_numpy(), group.column("key").to_numpy()
        order = np.lexsort((key, g))
        data = [key[order].astype("<i8"), g[order].astype("<i4"), rows_of(group.column("x"))[order].astype(width)]
        return pa.table({"c": pa.array([group.column("c")[0].as_py()], pa.int32()), **{name: pa.array([np.ascontiguousarray(d).tobytes()], pa.binary()) for name, d in zip(("keys", "groups", "x"), data, strict=True)}})

    placed = rows.select(F.col("g").cast("int"), "key", "x").mapInArrow(place, f"c int, g int, key long, x {kind}")
    # a number that is given isn't coalesced: chunks are small to read and long to compare
    return write_once(placed.repartition(max(1, min(2000, deal.count)), "c").groupBy("c").applyInArrow(pack, "c int, keys binary, groups binary, x binary"), "chunks")


@dataclass
class Chunk:
    """Rows of one chunk by group; ``starts``: where each of ``own`` groups starts, and the end."""

    keys: np.ndarray
    groups: np.ndarray
    x: np.ndarray

    def __post_init__(self):
        self.own, starts = np.unique(self.groups, return_index=True)
        self.starts = np.append(starts, len(self.groups))


def unpacked(dim: int, keys: pa.BinaryScalar, groups: pa.BinaryScalar, x: pa.BinaryScalar) -> Chunk:
    key, data = np.frombuffer(keys.as_buffer(), "<i8"), x.as_buffer()
    return Chunk(key, np.frombuffer(groups.as_buffer(), "<i4"), np.frombuffer(data, f"<f{data.size // (len(key) * dim)}").reshape(len(key), dim))


def met(left: DataFrame, right: DataFrame, count: int, rows: int, dim: int) -> DataFrame:
    """Chunks (c, ..) of the left, each with those of the right (d, ..) where ``wanted`` [d] says so. One chunk
    of the left to a task, with a turn of the right: neither is copied to disk for it."""
    turn = max(1, min(TURN, HELD // max(1, 8 * rows * dim)))
    turns = -(-count // turn)
    left = left.repartitionById(count, F.col("c"))
    right = right.repartitionById(turns, F.pmod("d", F.lit(turns)))  # neighbouring chunks, which ask alike, go to different turns
    return left.join(right.hint("shuffle_replicate_nl"), F.expr("wanted[d]"))


def asked(balls: Balls, a: Chunk, b: Chunk, best: np.ndarray, nn: np.ndarray) -> None:
    """Moves ``best`` distances and ``nn`` of a's rows to what b has nearer, or as near with a lower key."""
    for i in range(0, len(a.keys), BLOCK):
        own = a.x[i : i + BLOCK].astype(float)
        # what rounds off in a distance must not hide an equal one
        need = balls.may_hold(own, a.groups[i : i + BLOCK] // RINGS, best[i : i + BLOCK] * (1 + 1e-9), b.own)
        for g in np.flatnonzero(need.any(0)):
            rows = np.flatnonzero(need[:, g])
            for j in range(b.starts[g], b.starts[g + 1], BLOCK):
                at = slice(j, min(j + BLOCK, b.starts[g + 1]))
                improve(own[rows], a.keys[i + rows], b.x[at].astype(float), b.keys[at], best, nn, i + rows)


def improve(x: np.ndarray, keys: np.ndarray, z: np.ndarray, others: np.ndarray, best: np.ndarray, nn: np.ndarray, at: np.ndarray) -> None:
    """One tile of ``asked``: rows x, which lie at ``at`` of best and nn, and rows z by key. A matrix product
    says which pairs may be nearest, exact sums which are."""
    d, off = product_squares(x, z)
    if np.isin(keys, others).any():
        d[keys[:, None] == others[None]] = np.inf
    top = best[at] ** 2 * (1 + 8 * EPS)
    least = d.min(1)
    hit = np.flatnonzero((least - off <= top) & (least < np.inf))
    if not len(hit):
        return
    u, v = np.nonzero(d[hit] <= (np.minimum(least[hit] + off, top[hit]) + off)[:, None])
    if 4 * len(u) > len(hit) * len(z):  # many are alike
        s = np.where(d[hit] < np.inf, np.sqrt(exact_squares(x[hit], z)), np.inf)
        v, u = s.argmin(1), np.arange(len(hit))
        found = s[u, v]
    else:
        s = np.zeros(len(u))
        for f, h in zip(x[hit[u]].T, z[v].T, strict=True):
            s += (f - h) * (f - h)
        s = np.sqrt(s)
        order = np.lexsort((others[v], s, u))
        order = order[np.append(True, u[order][1:] != u[order][:-1])]
        u, v, found = u[order], v[order], s[order]
    to, key = at[hit[u]], others[v]
    better = (found < best[to]) | ((found == best[to]) & (key < nn[to]))
    best[to[better]], nn[to[better]] = found[better], key[better]


def nearest_neighbours(points: DataFrame, key: str = "t", value: str = "s") -> DataFrame:
    """(key, nn, distance): the nearest other row, the lowest key of equals.

    Each point finds its nearest in its block and its chunk first; then chunks meet those that may hold
    anything as near to one of their points, and there points meet the rings that may."""
    slim = points.select(F.col(key).cast("long").alias("key"), floats(points, value).alias("x"))
    first = slim.select(F.size("x")).first()
    n = slim.count() if first else 0
    if not n:
        return points.select(F.col(key).cast("long").alias(key), F.lit(0).cast("long").alias("nn"), F.lit(0.0).alias("distance")).limit(0)
    spark, dim = points.sparkSession, max(1, first[0])
    rings, balls, rings_at = balls_of(slim, n)
    length = chunk_rows(n, dim, CHUNK)
    deal = dealt(balls.sizes.ravel(), length)
    chunks, path = packed(rings.select((F.col("ball") * RINGS + F.col("ring")).alias("g"), "key", "x"), deal)
    given, chunk_of = spark.sparkContext.broadcast(balls), spark.sparkContext.broadcast(deal)

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each point's nearest in its own chunk, and the chunks that may hold anything as near."""
        for batch in batches:
            for c, *data in zip(*batch.columns, strict=True):
                a = unpacked(dim, *data)
                best, nn = np.full(len(a.keys), np.inf), np.zeros(len(a.keys), np.int64)
                for i in range(0, len(best), BLOCK):
                    x, at = a.x[i : i + BLOCK].astype(float), np.arange(i, min(i + BLOCK, len(best)))
                    order = np.argsort(a.keys[at], kind="stable")
                    improve(x, a.keys[at], x[order], a.keys[at][order], best, nn, at)
                asked(given.value, a, a, best, nn)
                wanted = np.zeros(chunk_of.value.count, bool)
                numbers = np.flatnonzero(given.value.sizes.ravel())
                for i in range(0, len(best), BLOCK):
                    need = given.value.may_hold(a.x[i : i + BLOCK].astype(float), a.groups[i : i + BLOCK] // RINGS, best[i : i + BLOCK] * (1 + 1e-9), numbers)
                    for g in numbers[need.any(0)]:
                        wanted[chunk_of.value.first[g] : chunk_of.value.first[g] + chunk_of.value.parts[g]] = True
                wanted[c.as_py()] = False
                yield pa.RecordBatch.from_arrays([pa.array([c.as_py()], pa.int32()), *[pa.array([d.as_py()], pa.binary()) for d in data], pa.array([best.tobytes()], pa.binary()), pa.array([nn.tobytes()], pa.binary()), pa.array([wanted.tolist()])], names=["c", "keys", "groups", "x", "best", "nn", "wanted"])

    begun = written(chunks.mapInArrow(inside, "c int, keys binary, groups binary, x binary, best binary, nn binary, wanted array<boolean>"), "neighbours")
    remove(spark, path)
    remove(spark, rings_at)
    forget(spark)
    right = begun.select(F.col("c").alias("d"), F.col("keys").alias("keys_d"), F.col("groups").alias("groups_d"), F.col("x").alias("x_d"))
    pairs = met(begun, right, deal.count, length, dim).select("c", "keys", "groups", "x", "best", "nn", "keys_d", "groups_d", "x_d")

    def rows(a: Chunk, best: np.ndarray, nn: np.ndarray, some: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.keys[some]), pa.array(nn[some]), pa.array(best[some])], names=["key", "nn", "distance"])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, a = None, None
        for batch in batches:
            for c, keys, groups, x, own, own_nn, *data in zip(*batch.columns, strict=True):
                if c.as_py() != now:
                    if a is not None:
                        yield rows(a, best, nn, changed(best, nn, start))
                    now, a = c.as_py(), unpacked(dim, keys, groups, x)
                    start = np.frombuffer(own.as_py(), "<f8"), np.frombuffer(own_nn.as_py(), "<i8")
                    best, nn = start[0].copy(), start[1].copy()
                asked(given.value, a, unpacked(dim, *data), best, nn)
        if a is not None:
            yield rows(a, best, nn, changed(best, nn, start))

    def changed(best: np.ndarray, nn: np.ndarray, start: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return (best != start[0]) | (nn != start[1])

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, b, j in zip(*batch.columns, strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(v.as_py(), t)) for v, t in ((k, "<i8"), (j, "<i8"), (b, "<f8"))], names=["key", "nn", "distance"])

    ddl = "key long, nn long, distance double"
    every = begun.select("keys", "best", "nn").mapInArrow(alone, ddl).unionByName(pairs.mapInArrow(across, ddl)).where("distance < double('inf')")
    best = every.groupBy("key").agg(F.min(F.struct("distance", "nn")).alias("b"))
    return best.select(F.col("key").alias(key), "b.nn", "b.distance")


def floats(points: DataFrame, value: str) -> Column:
    """Floats as they are, which halves what is dealt; other numbers as doubles."""
    return F.col(value) if dict(points.dtypes)[value] == "array<float>" else F.col(value).cast("array<double>")


def _nearest(own: pa.StructArray, other: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    a, b = rows_of(own.field("x")), rows_of(other.field("x"))
    i, j = own.field("key").to_numpy(), other.field("key").to_numpy()
    order = np.argsort(j, kind="stable")
    j, b = j[order], b[order]
    best, distance = np.zeros(len(a), np.int64), np.full(len(a), np.inf)
    for k in range(0, len(a), BLOCK):
        d = exact_squares(a[k : k + BLOCK], b)
        d[i[k : k + BLOCK, None] == j[None]] = np.inf
        best[k : k + BLOCK] = d.argmin(1)
        distance[k : k + BLOCK] = np.sqrt(d.min(1))
    return i, j[best], distance, a


def asked_rings(points: DataFrame, key: str, value: str) -> tuple[DataFrame | None, tuple]:
    """What single points ask, at most, for counts on small tables: each point with its nearest in its own
    block, and the points that ask other blocks, in turns of about BLOCK of them, with the blocks."""
    slim = points.select(F.col(key).cast("long").alias("key"), F.col(value).cast("array<double>").alias("x"))
    n = slim.count()
    if not n:
        return None, ()
    rings, balls, _ = balls_of(slim, n)
    given = points.sparkSession.sparkContext.broadcast(balls)
    slabs = int((balls.sizes > 0).sum())
    tasks = max(1, min(2000, slabs // 4))  # a number that is given isn't coalesced: blocks are small to read and long to compare
    sized = rings.select("key", "x", (F.col("ball") * RINGS + F.col("ring")).alias("slab"))
    parts = sized.groupBy("slab").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("parts"))
    dealt = sized.join(parts, "slab").select("key", "x", "slab", F.pmod(F.hash("key"), F.col("parts")).alias("part"))
    blocks = dealt.repartition(tasks, "slab", "part").groupBy("slab", "part").agg(F.collect_list(F.struct("key", "x")).alias("other"))

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each point's nearest in its own block, and the rings that anything as near may be in."""
        for batch in batches:
            for slab, part, other in zip(*batch.columns, strict=True):
                i, j, d, x = _nearest(other.values, other.values)
                # what rounds off in a distance must not hide an equal one
                own = np.full(len(i), slab.as_py() // RINGS)
                for a in range(0, len(i), BLOCK):
                    at = slice(a, a + BLOCK)
                    near = given.value.rings_within(x[at], own[at], d[at] * (1 + 1e-9))
                    ends = np.cumsum([0] + [len(v) for v in near]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(near).astype(np.int32)))
                    same = [pa.repeat(c, len(near)) for c in (slab, part)]
                    yield pa.RecordBatch.from_arrays([pa.array(i[at]), as_lists(x[at]), *same, pa.array(j[at]), pa.array(d[at]), lists], names=["key", "x", "slab", "part", "nn", "distance", "near"])

    found = written(blocks.mapInArrow(inside, "key long, x array<double>, slab int, part int, nn long, distance double, near array<int>"), "neighbours")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    asked = found.select("key", "x", F.col("slab").alias("own"), F.col("part").alias("own_part"), F.explode("near").alias("slab"))
    asked = asked.join(parts, "slab").withColumn("part", every).where((F.col("slab") != F.col("own")) | (F.col("part") != F.col("own_part")))
    # a block that many points reach is asked by about BLOCK of them at a time
    load = asked.groupBy("slab", "part").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("turns"))
    turn = F.pmod(F.hash("key"), F.col("turns")).alias("turn")
    return found, (asked.join(load, ["slab", "part"]).select("slab", "part", turn, "key", "x"), blocks, tasks)


# --- the median of all distances ----------------------------------------------------------

#: Points whose distances guess where the median lies, and the share of pairs around it that the guess takes.
GUESS, AROUND = 1500, 0.012
#: Bins of a pass, and values that the driver sorts at the end.
BINS, SORTED = 1 << 14, 1 << 20
#: Rows of a ring in the search of the median, at about, and how many rings there are, at most twice
#: that; rows of a chunk, at least.
GROUP, GROUPS, CELL = 128, 1024, 4096


def tiles(meet: list[tuple[np.ndarray, np.ndarray, bool]]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Pieces of at most BLOCK by BLOCK of rows that meet others; of the same rows, the upper half."""
    for left, right, same in meet:
        for i in range(0, len(left), BLOCK):
            for j in range(i if same else 0, len(right), BLOCK):
                yield left[i : i + BLOCK], right[j : j + BLOCK], same


@dataclass
class Counted:
    """What a search of the median compared, out of how many pairs."""

    distances: int = 0
    pairs: int = 0


def median_distance(points: DataFrame, tally: Counted | None = None) -> float | None:
    """Median of the distances of all pairs of rows (key, x) with different keys; None without a pair.

    A guess from GUESS points brackets the middle. Two rings whose pivots and radii put all their
    distances on one side of the bracket are counted and not compared; the others count what lies below
    and bin what lies within, from a matrix product where that is clear and from exact sums where it
    isn't. The bin that holds the middle is the next bracket, until its values can be sorted. A middle
    outside of the bracket widens it. Rows that repeat a key leave nothing to be counted unseen."""
    tally = tally or Counted()
    spark = points.sparkSession
    points = points.where("key IS NOT NULL AND x IS NOT NULL").select(F.col("key").cast("long").alias("key"), "x")
    n = points.count()
    if n < 2:
        return None
    repeated = points.groupBy("key").count().where("count > 1").limit(1).count() > 0
    rings, balls, rings_at = balls_of(points, n, max(GROUP, -(-n // GROUPS)))
    guess = np.array([r["x"] for r in points.orderBy(F.xxhash64("key", F.lit(23)), "key").limit(GUESS).collect()], float)
    own = exact_squares(guess, guess)[np.triu_indices(len(guess), 1)]
    low, high = (float(np.quantile(own, 0.5 + s * AROUND)) for s in (-1, 1))

    groups = np.argwhere(balls.sizes > 0)
    number = {int(b) * RINGS + int(r): k for k, (b, r) in enumerate(groups)}
    centre, sizes = balls.pivots[groups[:, 0]], balls.sizes[groups[:, 0], groups[:, 1]]
    radius = balls.high[groups[:, 0], groups[:, 1]] + balls.slack
    apart = np.sqrt(np.maximum(product_squares(centre, centre)[0], 0))
    slack = 4 * balls.slack
    least, most = np.maximum(apart - radius[:, None] - radius[None] - slack, 0) ** 2, (apart + radius[:, None] + radius[None] + slack) ** 2
    pairs = np.triu(np.where(np.eye(len(groups), dtype=bool), sizes * (sizes - 1) // 2, np.multiply.outer(sizes, sizes)))
    upper = np.triu(np.ones_like(pairs, bool))
    dim = guess.shape[1]
    length = chunk_rows(n, dim, CELL)
    deal = dealt(sizes, length)
    holds = np.zeros((deal.count, len(groups)), np.float32)  # which chunks have rows of a group
    for g in range(len(groups)):
        holds[deal.first[g] : deal.first[g] + deal.parts[g], g] = 1
    place = spark.createDataFrame([(s, k) for s, k in number.items()], "slab int, g int")
    rows = rings.select("key", "x", (F.col("ball") * RINGS + F.col("ring")).alias("slab")).join(F.broadcast(place), "slab").select("g", "key", "x")  # RINGS rows a pivot
    chunks, chunks_at = packed(rows, deal)
    remove(spark, rings_at)
    forget(spark)

    def counted(low: float, high: float, gather: bool) -> tuple[int, int, int, dict[int, int], list[tuple[float, int]]]:
        """Pairs below the bracket, those at its low end, all pairs, those within by bin, and, if asked
        for, their squares with counts."""
        settled = np.zeros_like(upper) if repeated else (most < low) | (least > high)
        below = int(pairs[upper & settled & (most < low)].sum())
        unseen = int(pairs[upper & settled].sum())
        open_ = upper & ~settled
        both = open_ | open_.T
        cell = np.triu(holds @ both.astype(np.float32) @ holds.T > 0)
        known = spark.createDataFrame([(c, row.tolist()) for c, row in enumerate(cell)], "c int, wanted array<boolean>")
        todo = spark.sparkContext.broadcast(both)  # (2 GROUPS)^2 at most
        width = (high - low) / BINS if np.isfinite(high) else 0.0

        def bin_of(d: np.ndarray) -> np.ndarray:
            return np.minimum(((d - low) / width).astype(np.int64), BINS - 1) if width > 0 else np.zeros(len(d), np.int64)

        def meets(p: int, a: Chunk, q: int, b: Chunk) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
            """Rows of a and of b whose groups are open; each pair of rows once."""
            for k, start, end in zip(a.own, a.starts, a.starts[1:], strict=False):
                left = np.arange(start, end)
                others = [np.arange(b.starts[m], b.starts[m + 1]) for m, g in enumerate(b.own) if todo.value[k, g] and (p != q or g > k)]
                if others:
                    yield left, np.concatenate(others), False
                if p == q and todo.value[k, k]:
                    yield left, left, True

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            under = seen = lowest = 0
            bins, values = np.zeros(BINS, np.int64), []
            for p, keys, groups, x, q, *data in (pair for batch in batches for pair in zip(*batch.columns, strict=True)):
                a, b = unpacked(dim, keys, groups, x), unpacked(dim, *data)
                for r, c, same in tiles(meets(p.as_py(), a, q.as_py(), b)):
                    left, right = a.x[r].astype(float), b.x[c].astype(float)
                    d, off = product_squares(left, right)
                    differ = a.keys[r][:, None] < b.keys[c][None] if same else a.keys[r][:, None] != b.keys[c][None]
                    seen += int(differ.sum())
                    sure = differ & (d < low - off)
                    under += int(sure.sum())
                    u, v = np.nonzero(differ & ~sure & (d <= high + off))
                    for e in range(0, len(u), 1 << 14):
                        s = np.zeros(len(u[e : e + (1 << 14)]))
                        for f, h in zip(left[u[e : e + (1 << 14)]].T, right[v[e : e + (1 << 14)]].T, strict=True):
                            s += (f - h) * (f - h)
                        under += int((s < low).sum())
                        s = s[(s >= low) & (s <= high)]
                        lowest += int((s == low).sum())
                        bins += np.bincount(bin_of(s), minlength=BINS)
                        if gather:
                            values.append(s)
            if not seen:
                return
            at = np.flatnonzero(bins)
            each, times = np.unique(np.concatenate(values), return_counts=True) if values else (np.zeros(0), np.zeros(0, np.int64))
            kind = np.concatenate(([-1, -2, -4], at, np.full(len(each), -3))).astype(np.int32)
            n = np.concatenate(([under, seen, lowest], bins[at], times)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(n), pa.array(np.concatenate((np.zeros(3 + len(at)), each)))], names=["bin", "n", "d"])

        right = chunks.select(F.col("c").alias("d"), F.col("keys").alias("keys_d"), F.col("groups").alias("groups_d"), F.col("x").alias("x_d"))
        pairs_of = met(chunks.join(F.broadcast(known), "c"), right, deal.count, length, dim)  # a row a chunk
        got = pairs_of.select("c", "keys", "groups", "x", "d", "keys_d", "groups_d", "x_d").mapInArrow(count, "bin int, n long, d double")
        table = got.groupBy("bin", "d").agg(F.sum("n").alias("n")).collect() if cell.any() else []  # BINS rows, or SORTED values
        by = {(r["bin"], r["d"]): r["n"] for r in table}
        seen = by.get((-2, 0.0), 0)
        tally.distances += seen
        tally.pairs = unseen + seen
        return below + by.get((-1, 0.0), 0), by.get((-4, 0.0), 0), unseen + seen, {k: v for (k, _), v in by.items() if k >= 0}, sorted((d, v) for (k, d), v in by.items() if k == -3)

    def one_pass(low: float, high: float, gather: bool) -> tuple:
        out = counted(low, high, gather)
        forget(spark)  # a pass deals the chunks out twice
        return out

    try:
        return _narrowed(one_pass, low, high, float(most.max()))
    finally:
        remove(spark, chunks_at)


def _narrowed(counted, low: float, high: float, top: float) -> float | None:
    """The median of what ``counted`` counts, from a bracket that is guessed."""
    gather = False
    while True:
        below, lowest, total, bins, values = counted(low, high, gather)
        if not total:
            return None
        middle = [(total - 1) // 2, total // 2]
        held = sum(bins.values())
        if middle[0] < below or middle[1] >= below + held:  # the guess was wrong
            low, high, gather = (0.0 if middle[0] < below else low), (np.inf if middle[1] >= below + held else high), False
            if high == np.inf:
                high = top
            continue
        if middle[1] < below + lowest or low == high:
            return float(np.sqrt(low))
        if gather:
            ends = below + np.cumsum([v for _, v in values])
            a, b = np.sqrt([values[int(np.searchsorted(ends, m, side="right"))][0] for m in middle])
            return float(a + (b - a) / 2)
        order = sorted(bins)
        ends = below + np.cumsum([bins[k] for k in order])
        first, last = (order[int(np.searchsorted(ends, m, side="right"))] for m in middle)
        inside = sum(bins[k] for k in order if first <= k <= last)
        width = (high - low) / BINS
        # a hair wider than the bins: what is binned so lies within
        new_low, new_high = max(low, low + first * width - 4 * EPS * high), min(high, low + (last + 1) * width + 4 * EPS * high)
        # few values, or so narrow that only ties can be many
        gather = 2 * inside <= SORTED or new_high - new_low <= 4096 * EPS * new_high
        low, high = new_low, new_high
