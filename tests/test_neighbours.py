import gc
import os
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import neighbours
from tidewright.operators.neighbours import Counted, asked_rings, median_distance, nearest_neighbours


def table(spark, x, keys=None):
    keys = range(len(x)) if keys is None else keys
    return spark.createDataFrame([(int(k), [float(c) for c in v]) for k, v in zip(keys, x, strict=True)], "t long, s array<double>").repartition(5)


def plain(x, keys):
    """Nearest other key, the lowest of equals, by exact sums."""
    d = np.sqrt(neighbours.exact_squares(x, x))
    out = {}
    for i, k in enumerate(keys):
        rows = [(d[i, j], keys[j]) for j in range(len(keys)) if keys[j] != k]
        out[int(k)] = min(rows)
    return out


def clusters(seed, n, dim, centres, spread=0.05):
    r = np.random.default_rng(seed)
    c = r.normal(size=(centres, dim)) * 4
    return c[r.integers(0, centres, n)] + spread * r.normal(size=(n, dim))


@pytest.mark.parametrize("dim,kind", [(1, "even"), (2, "even"), (3, "crowd"), (8, "clusters"), (64, "clusters"), (20, "even")])
def test_nearest_against_all_pairs(spark, monkeypatch, dim, kind):
    monkeypatch.setattr(neighbours, "MAX_PIVOTS", 12)  # rings and parts come into play
    r = np.random.default_rng(dim)
    x = {"even": lambda: r.uniform(-1, 1, (1500, dim)), "clusters": lambda: clusters(dim, 1500, dim, 9), "crowd": lambda: np.vstack((r.normal(size=(700, dim)), np.repeat(r.normal(size=(2, dim)), 400, 0)))}[kind]()
    keys = r.permutation(len(x))
    want = plain(x, keys)
    got = {q.t: (q.distance, q.nn) for q in nearest_neighbours(table(spark, x, keys)).collect()}
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and got[k][0] == want[k][0] for k in want)


def test_ties_take_the_lowest_key(spark):
    x = np.array([[i % 40, i // 40] for i in range(1600)], float)  # a lattice: four equal neighbours
    keys = np.random.default_rng(3).permutation(1600)
    got = {q.t: (q.distance, q.nn) for q in nearest_neighbours(table(spark, x, keys)).collect()}
    assert got == plain(x, keys)


def test_clusters_compare_a_small_share_of_all_pairs(spark):
    """Own rings apart, 20 clusters of 64 dimensions: each point asks under a tenth of the others."""
    x = clusters(5, 6000, 64, 20)
    found, (asked, blocks, _) = asked_rings(table(spark, x), "t", "s")
    sizes = {(b.slab, b.part): len(b.other) for b in blocks.collect()}
    compared = sum(r["count"] * sizes[(r.slab, r.part)] for r in asked.groupBy("slab", "part").count().collect())
    assert found.count() == 6000 and compared < 0.1 * 6000 * 6000


def on_disk(spark):
    """Bytes of shuffles and of tables in the shared folder, when Spark has dropped what nothing refers to."""
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
    return held(spark)


def held(spark):
    tops = [spark.conf.get(c).removeprefix("file:") for c in ("spark.local.dir", "spark.checkpoint.dir")]
    files = [f"{d}/{f}" for top in tops for d, _, names in os.walk(top) for f in names]
    return sum(os.path.getsize(f) for f in files if os.path.exists(f))


def test_disk_follows_the_rows(spark):
    """Random points of 64 dimensions meet all others, and are not copied for it."""
    points = table(spark, np.random.default_rng(4).uniform(-1, 1, (8000, 64))).persist()
    assert points.count() == 8000
    before = on_disk(spark)
    counted = nearest_neighbours(points).agg(F.count("nn"))
    assert counted.collect()[0][0] == 8000
    assert on_disk(spark) - before < 8 * 8000 * 64 * 8  # while the result is held, and with it what it was made of
    points.unpersist()
    del counted


def test_the_medians_disk_follows_the_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL", 256)
    x = np.random.default_rng(4).uniform(-1, 1, (6000, 64))
    points = table(spark, x).toDF("key", "x").persist()
    assert points.count() == 6000
    before, peak, over = on_disk(spark), [0], threading.Event()

    def watch():
        while not over.wait(0.1):
            peak[0] = max(peak[0], held(spark))

    tops = threading.Thread(target=watch)
    tops.start()
    median_distance(points)
    over.set()
    tops.join()
    assert peak[0] - before < 16 * 6000 * 64 * 8  # all passes, of which each deals the rows out twice
    points.unpersist()


@pytest.mark.parametrize("kind", ["float", "double"])
def test_many_chunks_and_turns(spark, monkeypatch, kind):
    """Rings larger than a chunk, keys that repeat, and several turns of the right side."""
    monkeypatch.setattr(neighbours, "CHUNK", 64)
    monkeypatch.setattr(neighbours, "CHUNKS", 64)
    monkeypatch.setattr(neighbours, "TURN", 3)
    monkeypatch.setattr(neighbours, "MAX_PIVOTS", 3)
    r = np.random.default_rng(17)
    x = np.vstack((r.normal(size=(300, 6)), np.repeat(r.normal(size=(2, 6)), 150, 0))).astype(np.float32).astype(float)
    keys = r.permutation(np.append(np.arange(590), [3, 3, 5, 7, 7, 7, 11, 13, 17, 19]))
    points = table(spark, x, keys).withColumn("s", F.col("s").cast(f"array<{kind}>"))
    d, want = np.sqrt(neighbours.exact_squares(x, x)), {}
    for i, k in enumerate(keys):
        want[int(k)] = min([want.get(int(k), (np.inf, 0)), *[(d[i, j], int(keys[j])) for j in range(len(keys)) if keys[j] != k]])
    assert {q.t: (q.distance, q.nn) for q in nearest_neighbours(points).collect()} == want
    assert median_distance(points.toDF("key", "x")) == plain_median(x, keys)


def test_few_and_no_points(spark):
    assert nearest_neighbours(table(spark, np.zeros((1, 2)))).count() == 0
    assert nearest_neighbours(table(spark, np.zeros((1, 2))).limit(0)).count() == 0
    assert [tuple(r) for r in nearest_neighbours(table(spark, np.zeros((2, 2)))).orderBy("t").collect()] == [(0, 1, 0.0), (1, 0, 0.0)]


# --- the median ---------------------------------------------------------------------------


def plain_median(x, keys):
    d = np.sqrt(neighbours.exact_squares(x, x))
    i, j = np.triu_indices(len(x), 1)
    some = np.asarray(keys)[i] != np.asarray(keys)[j]
    v = np.sort(d[i[some], j[some]])
    return None if not len(v) else v[(len(v) - 1) // 2] + (v[len(v) // 2] - v[(len(v) - 1) // 2]) / 2


def median(spark, x, keys=None, tally=None):
    return median_distance(table(spark, x, keys).toDF("key", "x"), tally)


@pytest.mark.parametrize("kind", ["even", "clusters", "two", "lattice", "equal", "zeros", "repeated keys", "far"])
def test_median_against_all_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(neighbours, "GUESS", 40)
    monkeypatch.setattr(neighbours, "GROUP", 16)
    monkeypatch.setattr(neighbours, "CELL", 100)
    monkeypatch.setattr(neighbours, "SORTED", 500)
    r = np.random.default_rng(len(kind))
    x = {
        "even": lambda: r.uniform(-1, 1, (901, 3)), "clusters": lambda: clusters(2, 900, 16, 12), "two": lambda: np.array([[0.0], [3.0]]), "lattice": lambda: np.array([[i % 30, i // 30] for i in range(900)], float),
        "equal": lambda: np.eye(300), "zeros": lambda: np.vstack((np.zeros((800, 2)), r.normal(size=(100, 2)))), "repeated keys": lambda: r.normal(size=(600, 2)),
        "far": lambda: np.concatenate((r.normal(size=(500, 2)), 1e6 + r.normal(size=(60, 2)))),
    }[kind]()
    keys = r.integers(0, 200, len(x)) if kind == "repeated keys" else np.arange(len(x))
    assert median(spark, x, keys) == plain_median(x, keys)


def test_rings_on_one_side_are_not_compared(spark):
    """Of clusters as embeddings of topics are, under half of the pairs are compared, all passes together."""
    r = np.random.default_rng(8)
    centre = r.normal(size=(20, 64)) * r.uniform(0.2, 1.5, (20, 1))
    x = centre[r.integers(0, len(centre), 5000)] + 0.02 * r.normal(size=(5000, 64))
    tally = Counted()
    assert median(spark, x, tally=tally) == plain_median(x, np.arange(len(x)))
    assert tally.pairs == 5000 * 4999 // 2 and tally.distances < tally.pairs / 2


def test_a_wrong_guess_is_widened(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "GUESS", 3)
    monkeypatch.setattr(neighbours, "AROUND", 1e-9)
    x = clusters(11, 700, 5, 6, 1.0)
    assert median(spark, x) == plain_median(x, np.arange(len(x)))
    assert median(spark, x[:1]) is None and median(spark, np.zeros((3, 2)), [5, 5, 5]) is None
