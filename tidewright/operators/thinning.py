"""Greedy de-duplication by radius: of points in the order of their keys, those stay that no earlier
one that stays is nearer to than the radius.

That set is found in rounds. A point without an undecided earlier neighbour stays; neighbours of what
stays go; the rest is left to the next round. Points that share a small cell (its diagonal is the
radius) are neighbours all, so that only the first of each cell can stay in a round; it is compared
with the undecided points of the cells around, over up to three coordinates.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.vectors import squared_distance
from tidewright.shared import written

#: Coordinates by which neighbouring cells are met; each makes three cells of one.
CELL_COORDINATES = 3


def thinned(points: DataFrame, radius: float, key: str = "start", value: str = "x") -> DataFrame:
    """The rows (key, value array, others) of ``points`` that stay, distances as square roots of sums
    over the coordinates in order.

    Rows that repeat a key go by their coordinates, and of equal rows one stays. Null keys or values
    go; a coordinate that isn't finite is near nothing, and its row stays. Rounds are as many as the
    longest chain of points that wait for one another; each is written."""
    if radius <= 0:
        return points.where(F.col(key).isNotNull() & F.col(value).isNotNull())
    rows = points.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(F.struct(F.col(key).alias("k"), F.col(value).cast("array<double>").alias("x")).alias("p")).distinct()
    first = rows.select(F.size("p.x")).first()
    if first is None:
        return points.limit(0)
    dim = first[0]
    fine = radius / dim**0.5 * (1 - 1e-9)
    floor = lambda c, side: F.floor(F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)) / F.lit(float(side)))
    small = F.transform("p.x", lambda c: floor(c, fine))
    wide = [floor(F.get("p.x", F.lit(i)), radius).alias(f"c{i}") for i in range(min(dim, CELL_COORDINATES))]
    cells = [f"c{i}" for i in range(len(wide))]
    undecided = written(rows.select("p", small.alias("small"), *wide), "undecided")
    around = F.array(*[F.struct(*[(F.col(c) + d).alias(c) for c, d in zip(cells, step, strict=True)]) for step in product((-1, 0, 1), repeat=len(cells))])

    def near(a: str, b: str) -> Column:
        return F.sqrt(squared_distance(F.col(f"{a}.x"), F.col(f"{b}.x"))) < radius

    def spread(df: DataFrame) -> DataFrame:
        return df.select(F.col("p").alias("q"), F.explode(around).alias("_c")).select("q", "_c.*")

    kept = []
    while undecided.limit(1).count():
        firsts = undecided.groupBy("small").agg(F.min("p").alias("p"))
        firsts = firsts.select("p", *[floor(F.get("p.x", F.lit(i)), radius).alias(c) for i, c in enumerate(cells)])
        waits = spread(firsts).join(undecided.select("p", *cells), cells).where((F.col("p") < F.col("q")) & near("p", "q")).select("q").distinct()
        stay = written(firsts.join(waits, F.col("p") == F.col("q"), "left_anti"), "stay")
        kept.append(stay.select("p"))
        beside = spread(stay)
        met = [F.col(f"u.{c}") == F.col(f"s.{c}") for c in cells]
        cond = near("u.p", "s.q")
        for m in met:
            cond = cond & m
        gone = undecided.alias("u").join(beside.alias("s"), cond, "left_anti")
        # what stays isn't near to itself if a coordinate isn't finite
        undecided = written(gone.join(stay.select(F.col("p").alias("_p")), F.col("p") == F.col("_p"), "left_anti"), "undecided")
    out = kept[0]
    for k in kept[1:]:
        out = out.unionByName(k)
    chosen = written(out.select(F.col("p.k").alias("_k"), F.col("p.x").alias("_x")), "thinned")
    whole = points.join(chosen, (F.col(key) == F.col("_k")) & (F.col(value).cast("array<double>") == F.col("_x"))).drop("_k", "_x")
    return whole.dropDuplicates([key, value])
