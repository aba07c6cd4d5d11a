"""Near-duplicates by SetSketch registers, bands, joint likelihood and exact verification.

Each document's set of word shingles is summed up in REGISTERS registers: the smallest of
the elements' exponential hash values on an exponential scale, K = floor(1 - log_b(min)),
truncated to 16 bits. Registers merge by maximum and collide with about the probability of
the Jaccard similarity, so bands of ROWS registers find candidates. A candidate's
similarity is first estimated from the counts of smaller, equal and larger registers by
maximum likelihood; what is clearly below the threshold goes, the rest is decided on the
full sets.

Work is kept off quadratic paths: equal sets are one class from the start; each bucket
links its members to one member of its own (another one in each band); only members that are
then still in different components are compared with one another. Members of large buckets
do so where they share one of their rarest shingles, if that makes fewer comparisons.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import by_bytes, mix64, plain_names, small_batches, span_hashes, text_bytes, words_of, written

BANDS, ROWS = 30, 4
REGISTERS = BANDS * ROWS
SCALE_BASE = 1.001
RATE = 20.0
TOP = (1 << 16) - 1
#: An estimate below the threshold by more than this (over five standard errors of 120 registers) rules a pair out.
MARGIN = 0.22
#: Hashes of a set that its block holds: smaller sets are whole there. MARGIN's like for such a sample.
SAMPLE = 256
SAMPLE_MARGIN = 0.13
#: Members of a bucket that are compared with as many others at a time, and blocks that one cell
#: of a large bucket has.
BLOCK, TURN = 64, 8
#: Counters of shingles by hash, for their order by rarity: 8 bytes each go to every executor.
SLOTS = 1 << 20
_seeds = np.random.default_rng(7).integers(0, 1 << 63, (2, REGISTERS), dtype=np.uint64)
SALT, FACTOR = _seeds[0], _seeds[1] * np.uint64(2) + np.uint64(1)
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's ``size``-word shingles, A-Z lowered; a
    text of fewer words is one shingle, a text without words has none."""
    out: list[np.ndarray] = []
    for a, b in by_bytes(texts):
        lengths = np.array([len(t) for t in texts[a:b]])
        data = _lower[np.frombuffer(b"\n".join(texts[a:b]), np.uint8)]
        starts, ends = words_of(data)
        h = span_hashes(data, starts, ends)
        bound = np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths + 1))))
        for i, j in zip(bound[:-1], bound[1:], strict=True):
            w = h[i:j]
            n = len(w) - size + 1
            if not len(w):
                out.append(w)
                continue
            k = size if n > 0 else len(w)
            s = w[: len(w) - k + 1].copy()
            for d in range(1, k):
                s = mix64(s * np.uint64(0x9E3779B97F4A7C15) + w[d : len(w) - k + 1 + d])
            out.append(np.unique(mix64(s + np.uint64(k))))
    return out


def set_digest(items: bytes) -> bytes:
    return hashlib.blake2b(items, digest_size=16).digest()


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers of non-empty sets, (sets, REGISTERS) of 16 bits."""
    ends = np.cumsum([len(s) for s in sets])
    flat = np.concatenate(sets)
    low = np.empty((len(sets), REGISTERS), np.uint64)
    starts = np.concatenate(([0], ends[:-1]))
    for i in range(REGISTERS):
        low[:, i] = np.minimum.reduceat((flat ^ SALT[i]) * FACTOR[i], starts)
    u = ((low >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
    value = -np.log1p(-u) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(SCALE_BASE)), 0, TOP).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each row."""
    r = regs.astype(np.uint64).reshape(len(regs), BANDS, ROWS)
    key = mix64(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :].repeat(len(regs), 0)
    for k in range(ROWS):
        key = mix64(key * np.uint64(3) + r[:, :, k])
    return key.view(np.int64)


def joint_estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs of sketches (rows of a and b) of sets of known sizes, by
    maximum likelihood of the numbers of registers that are larger, equal and smaller."""
    more, less = (a > b).sum(1).astype(float), (a < b).sum(1).astype(float)
    same = a.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)
    ratio = (SCALE_BASE - 1) / SCALE_BASE

    def likelihood(j: np.ndarray) -> np.ndarray:
        p = [-np.log1p(-np.clip(x, 1e-12, 1) * ratio) / np.log(SCALE_BASE) for x in (u - v * j, v - u * j)]
        return more * np.log(p[0]) + less * np.log(p[1]) + same * np.log(np.maximum(1 - p[0] - p[1], 1e-12))

    low, high = np.zeros(len(a)), np.minimum(u / v, v / u)
    g = (np.sqrt(5) - 1) / 2
    for _ in range(30):  # golden section; the likelihood has one maximum
        x, y = high - g * (high - low), low + g * (high - low)
        left = likelihood(x) > likelihood(y)
        low, high = np.where(left, low, x), np.where(left, y, high)
    return (low + high) / 2


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n (set size), digest of the set, regs, keys for every row; an empty set has null
    regs and keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for x in batches for s in small_batches(x)):
            sets = shingle_sets(text_bytes(batch.column(1)), size)
            digest = [set_digest(s.tobytes()) for s in sets]
            filled = [i for i, s in enumerate(sets) if len(s)]
            regs: list[bytes | None] = [None] * len(sets)
            keys: list[np.ndarray | None] = [None] * len(sets)
            for i in range(0, len(filled), 64):
                part = filled[i : i + 64]
                r = registers([sets[j] for j in part])
                for j, x, k in zip(part, r, band_keys(r), strict=True):
                    regs[j], keys[j] = x.tobytes(), k
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(regs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n", "digest", "regs", "keys"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, digest binary, regs binary, keys array<long>")


def likely(pairs: DataFrame, sketch: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (a, b), those whose joint estimate doesn't rule them out."""
    one = lambda x: sketch.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
            na, nb = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("na", "nb"))
            yield batch.select(["a", "b"]).filter(pa.array(joint_estimate(x, y, na, nb) >= threshold - MARGIN))

    both = pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "na", "nb", "ra", "rb")
    return both.mapInArrow(run, "a long, b long")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, the whole set as bytes of sorted 64-bit hashes, and its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for x in batches for s in small_batches(x)):
            sets = [s.tobytes() for s in shingle_sets(text_bytes(batch.column(1)), size)]
            digest = [set_digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary()), pa.array(digest, pa.binary())], names=["doc_id", "items", "digest"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, items binary, digest binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those with 100 * intersection >= percent * union on the full sets."""
    one = lambda x: sets.select(F.col("doc_id").alias(x), F.col("items").alias(f"s{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for x in batches for s in small_batches(x)):
            keep = []
            for p, q in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                both = np.concatenate((x, y))
                both.sort(kind="stable")  # two sorted runs
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def block_links(p: pa.StructArray, z: pa.StructArray, percent: int, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all pairs across two blocks of members (doc_id, n, comp, low), those of different
    components that reach ``percent`` where both sets are whole in ``low``, or may do so where
    not: of a larger set, ``low`` has the SAMPLE smallest hashes, and two such samples estimate
    the similarity up to the smaller one's end. One certain link of a row to a component does.
    A pair that may link counts in its first common band only (band -1: always), if its joint
    estimate allows."""
    sets = [[np.frombuffer(v.as_buffer(), np.uint64) for v in x.field("low")] for x in (p, z)]
    ids, n, comp = ([x.field(f).to_numpy(zero_copy_only=False) for x in (p, z)] for f in ("doc_id", "n", "comp"))
    both = np.intersect1d(np.concatenate(sets[0]), np.concatenate(sets[1]))
    if not len(both):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    held = []
    for side in sets:
        flat, owner = np.concatenate(side), np.repeat(np.arange(len(side)), [len(s) for s in side])
        at = np.minimum(np.searchsorted(both, flat), len(both) - 1)
        here = both[at] == flat
        m = np.zeros((len(side), len(both)), np.float32)
        m[owner[here], at[here]] = 1
        held.append(m)
    common = np.rint(held[0] @ held[1].T)
    whole = [np.array([len(s) for s in side]) == k for side, k in zip(sets, n, strict=True)]
    ends = [np.where(w, np.uint64(2**64 - 1), np.array([s[-1] for s in side], np.uint64)) for side, w in zip(sets, whole, strict=True)]
    u = np.array([np.searchsorted(s, ends[1], "right") for s in sets[0]]) + np.array([np.searchsorted(s, ends[0], "right") for s in sets[1]]).T - common
    certain = whole[0][:, None] & whole[1][None]
    may = (comp[0][:, None] != comp[1][None]) & (100 * common >= np.where(certain, percent, percent - 100 * SAMPLE_MARGIN) * u)
    may &= 100 * np.minimum(n[0][:, None], n[1][None]) >= percent * np.maximum(n[0][:, None], n[1][None])
    i, j = np.nonzero(may)
    regs = [np.frombuffer(b"".join(x.field("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS) for x in (p, z)]
    x, y = regs[0][i], regs[1][j]
    if band >= 0:
        first = (x == y).reshape(-1, BANDS, ROWS).all(2).argmax(1) == band
        i, j, x, y = i[first], j[first], x[first], y[first]
    sure = certain[i, j]
    if not sure.all():
        fine = sure | (joint_estimate(x, y, n[0][i].astype(float), n[1][j].astype(float)) >= percent / 100 - MARGIN)
        i, j, sure = i[fine], j[fine], sure[fine]
    _, first = np.unique(np.stack((i[sure], comp[1][j[sure]])), axis=1, return_index=True)
    chosen = np.concatenate((np.flatnonzero(~sure), np.flatnonzero(sure)[first]))
    x, y = ids[0][i[chosen]], ids[1][j[chosen]]
    return np.minimum(x, y), np.maximum(x, y)


def cells(rest: Column, met: Column, n_rest: Column, n_met: Column, turn: int) -> Column:
    """The cells (turn, i, j, rest, met) of a group that one of its members goes to. The group's ``rest``
    is dealt over about n_rest / (BLOCK TURN / 2) rows, its ``met`` over about n_met / (BLOCK TURN) columns:
    a member of the rest goes to its whole row, one of the met to its whole column, to the cell where
    these cross once. No ``rest``, no cells."""
    h = F.xxhash64("doc_id", "key")
    rows, columns = F.ceil(n_rest / (BLOCK * TURN // 2)), F.ceil(n_met / (BLOCK * TURN))
    i, j = F.pmod(h, F.greatest(rows, F.lit(1))), F.pmod(h, F.greatest(columns, F.lit(1)))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(1)) - 1)
    cell = lambda i, j, rest, met: F.struct(F.lit(turn).alias("turn"), i.alias("i"), j.alias("j"), rest.alias("rest"), met.alias("met"))
    along = F.transform(upto(columns), lambda k: cell(i, k, F.lit(True), met & (k == j)))
    down = F.transform(F.filter(upto(rows), lambda k: ~(rest & (k == i))), lambda k: cell(k, j, F.lit(False), F.lit(True)))
    none = F.slice(along, 1, 0)
    return F.concat(F.when(rest, along).otherwise(none), F.when(met & (n_rest > 0), down).otherwise(none))


def across_blocks(placed: DataFrame, mixed: DataFrame, payload: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that ``block_links`` finds in the ``mixed_groups`` of ``placed``: the rest that is first
    with all members, and the rest that is not with those that are. ``payload`` has low and regs of each
    doc_id. A cell of a group meets by one aggregate, about BLOCK TURN members by half as many; it is
    compared in blocks. There is no join of members with members: one that deals the two sides of a large
    group anew makes as many tasks as the product of their pieces."""
    outside, first = F.col("comp") != F.col("main"), F.col("first")
    where = F.concat(cells(outside & first, F.lit(True), F.col("ahead"), F.col("total"), 0), cells(outside & ~first, first, F.col("rest") - F.col("ahead"), F.col("f"), 1))
    dealt = placed.join(mixed, "key").select("band", "key", "doc_id", "n", "comp", where.alias("cells")).where(F.size("cells") > 0)
    dealt = dealt.join(payload, "doc_id").select("band", "key", "doc_id", "n", "comp", "low", "regs", F.explode("cells").alias("at"))
    x = F.struct("doc_id", "n", "comp", "low", "regs", "at.rest", "at.met")
    groups = dealt.groupBy("band", "key", "at.turn", "at.i", "at.j").agg(F.collect_list(x).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for band, x in zip(*batch.columns, strict=True):
                p, z = x.values.filter(x.values.field("rest")), x.values.filter(x.values.field("met"))
                for i in range(0, len(p), BLOCK):
                    found += [block_links(p[i : i + BLOCK], z[j : j + BLOCK], percent, band.as_py()) for j in range(0, len(z), BLOCK)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found]), pa.int64()) for k in (0, 1)], names=["a", "b"])

    return groups.select("band", "x").mapInArrow(run, "a long, b long")


def mixed_groups(placed: DataFrame) -> DataFrame:
    """(key, total, f, main, rest, ahead, work) of each group of ``placed`` (key, comp, first, ..) with several
    components and a ``first`` member: its members, the first ones, its largest component, the members outside
    it, the first ones of these, and how many comparisons bring this rest together with all, one of two
    being first."""
    shares = placed.groupBy("key", "comp").agg(F.count("*").alias("k"), F.sum(F.col("first").cast("long")).alias("f"))
    mixed = shares.groupBy("key").agg(F.sum("k").alias("total"), F.sum("f").alias("f"), F.max(F.struct("k", "comp", "f")).alias("m"))
    rest = F.col("total") - F.col("m.k")
    ahead = F.col("f") - F.col("m.f")
    work = ahead.cast("double") * F.col("total") + (rest - ahead).cast("double") * F.col("f")
    return mixed.where((rest > 0) & (F.col("f") > 0)).select("key", "total", "f", F.col("m.comp").alias("main"), rest.alias("rest"), ahead.alias("ahead"), work.alias("work"))


def comparisons(mixed: DataFrame) -> float:
    return mixed.agg(F.sum("work")).first()[0] or 0.0


def rare_shingles(crowd: DataFrame, percent: int) -> DataFrame:
    """(band -1, key, doc_id, n, comp, first): the rarest hashes of each set (doc_id, comp, items), so
    many that two sets of the wanted similarity share one of them, which is ``first`` in the smaller.

    Sets of similarity s have s of the larger one in common, and 2 s / (1 + s) of the smaller one. The
    rarest hash in common comes, in either set, before all others in common: among the first
    n - s n + 1 of the larger set, and the first n - 2 s n / (1 + s) + 1 of the smaller. Rarity is the
    count of the hash's slot, ties by the hash: an order that all sets share, which is all it needs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for v in batch.column(0):
                np.add.at(seen, np.frombuffer(v.as_buffer(), np.uint64) % np.uint64(SLOTS), 1)
        slots = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(seen[slots], pa.int64())], names=["slot", "c"])

    counts = crowd.select("items").mapInArrow(count, "slot long, c long").groupBy("slot").agg(F.sum("c")).toArrow()
    seen = np.zeros(SLOTS, np.int64)
    seen[counts.column(0).to_numpy()] = counts.column(1).to_numpy()
    sent = crowd.sparkSession.sparkContext.broadcast(seen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for x in batches for s in small_batches(x)):
            chosen = []
            for v in batch.column(2):
                x = np.frombuffer(v.as_buffer(), np.uint64)
                order = np.lexsort((x, sent.value[x % np.uint64(SLOTS)]))
                chosen.append(x[order[: len(x) + percent * len(x) // -100 + 1]].view(np.int64))
            size = np.array([len(c) for c in chosen], np.int64)
            of = np.repeat(np.arange(batch.num_rows), size)
            n = np.array([len(v.as_buffer()) // 8 for v in batch.column(2)], np.int64)
            place = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
            first = place < (n + 2 * percent * n // -(100 + percent) + 1)[of]
            keys = np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
            at = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys), -1), pa.int32()), pa.array(keys, pa.int64()), batch.column(0).take(at), pa.array(n[of], pa.int64()), batch.column(1).take(at), pa.array(first)],
                names=["band", "key", "doc_id", "n", "comp", "first"],
            )

    return crowd.select("doc_id", "comp", "items").mapInArrow(run, "band int, key long, doc_id long, n long, comp long, first boolean")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): connected components of edges (a, b) with the smallest id as root; nodes
    without an edge, and roots, are not listed.

    Alternating large and small stars: every node hands its larger neighbours to its smallest
    one, then its smaller ones. Each round is written out. Degrees are never gathered in one
    place: a node's minimum is an aggregate and its edges meet it in a join.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    before = None
    while True:
        e = written(e, "stars")
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state["n"] == 0 or before == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        met = e.join(low, "u")
        e = low.select("u", F.col("m").alias("v")).unionByName(met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()


def near_duplicates(docs: DataFrame, size: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Null, empty and wordless texts have an empty set, are linked with nothing and kept.
    Rows that repeat a doc_id are one node; if their texts differ, that of the smallest set digest
    stands for it. Rows with a null doc_id have a null component and are kept. Very long texts are
    whole sets. An empty table gives an empty one. Other columns are not read, whatever their names.
    """
    docs = docs.select("doc_id", "text")
    sketch = written(sketches(docs, size), "sketches")
    filled = sketch.where(F.col("n").cast("boolean") & F.col("doc_id").isNotNull())
    classes = written(filled.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    reps = filled.join(classes, (filled.doc_id == classes.rep) & (filled.digest == classes.digest), "left_semi")
    first = F.min(F.struct("digest", "n", "regs", "keys"))
    reps = written(reps.groupBy("doc_id").agg(first.alias("x")).select("doc_id", "x.*"), "representatives")

    # a set of n items is at best n / (n + 1) like another one; smaller sets link with equal ones only
    linkable = 100 * F.col("n") >= percent * (F.col("n") + 1)
    banded = reps.where(linkable).select("doc_id", "n", F.posexplode("keys").alias("band", "key"))
    centre = F.struct(F.xxhash64("doc_id", "key").alias("h"), F.col("doc_id").alias("c"), F.col("n").alias("cn"))
    buckets = banded.groupBy("key").agg(F.count("*").alias("size"), F.min(centre).alias("centre")).where("size > 1")
    # written, so that the join deals both sides itself and may split a large bucket
    buckets = written(buckets.select("key", "centre.c", "centre.cn"), "centres")
    members = written(banded.join(buckets, "key"), "buckets")

    fits = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)  # noqa: E731  else too few in common
    stars = members.where((F.col("doc_id") != F.col("c")) & fits(F.col("n"), F.col("cn")))
    stars = stars.select(F.least("doc_id", "c").alias("a"), F.greatest("doc_id", "c").alias("b")).distinct()
    tried = written(likely(stars, reps, percent / 100), "likely")
    needed = members.select("doc_id").distinct()
    wanted = docs.join(needed, "doc_id", "left_semi")
    twice = filled.join(needed, "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1")
    twice = written(twice.select("doc_id"), "repeated")
    repeated = not twice.isEmpty()
    if repeated:  # rows that repeat an id: each of its texts once
        wanted = wanted.join(twice, "doc_id", "left_anti").unionByName(wanted.join(twice, "doc_id", "left_semi").distinct())
    sets = written(full_sets(wanted, size), "sets").where(F.length("items") > 0)
    if repeated:  # else each id has one set, its representative's
        sets = sets.join(reps.select("doc_id", "digest"), ["doc_id", "digest"], "left_semi")
    sets = sets.select("doc_id", "items")
    found = written(verified(tried, sets, percent), "links")
    roots = components(found)

    # members of a bucket that are still apart: those outside its largest component against all others
    placed = members.select("band", "key", "doc_id", "n").join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    placed = written(placed.select("band", "key", "doc_id", "n", F.coalesce("root", "doc_id").alias("comp"), F.lit(True).alias("first")), "placed")
    mixed = written(mixed_groups(placed), "mixed")
    payload = sets.select("doc_id", F.substring("items", 1, 8 * SAMPLE).alias("low")).join(reps.select("doc_id", "regs"), "doc_id")

    large = F.col("total") > BLOCK * TURN
    crowd = placed.join(mixed.where(large), "key", "left_semi").groupBy("doc_id").agg(F.min("comp").alias("comp"))
    met = None
    if not mixed.where(large).isEmpty():
        rare = written(rare_shingles(crowd.join(sets, "doc_id"), percent), "rare")
        fewer = written(mixed_groups(rare), "mixed")
        if comparisons(fewer) < comparisons(mixed.where(large)):
            met = across_blocks(placed, mixed.where(~large), payload, percent).unionByName(across_blocks(rare, fewer, payload, percent))
    met = across_blocks(placed, mixed, payload, percent) if met is None else met
    second = written(met.distinct(), "second").join(stars, ["a", "b"], "left_anti")
    more = written(verified(second, sets, percent), "links")
    if not more.isEmpty():
        roots = components(more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))

    rows = sketch.select("doc_id", "n", "digest").join(classes, "digest", "left")
    rows = rows.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("n") > 0, F.coalesce("root", "rep", "doc_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest doc_id; rows that repeat
    it stay together, rows without a doc_id or without words stay. Columns unchanged, whatever
    their names."""
    d, at = plain_names(docs)
    nodes = near_duplicates(d.select(F.col(at["doc_id"]).alias("doc_id"), F.col(at["text"]).alias("text")), size, percent)
    gone = nodes.where(~F.col("kept")).select("doc_id").distinct()
    return d.join(gone, F.col(at["doc_id"]) == F.col("doc_id"), "left_anti").toDF(*docs.columns)
