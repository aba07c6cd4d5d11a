"""Level lines of a field on a grid: marching squares, then polylines by rounds of joins.

Grid points are rows (i, j, x, y, value); i counts along y, j along x, from any number. A point crosses
between two neighbours of which one is below the level and the other isn't. Each crossing has one
number, which both cells beside its edge know, and its place is computed the same way in both.
Segments run with the higher side on their left, so that a crossing ends one segment and begins the next.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.lifts import Dictionary
from tidewright.operators.embedding import ranked
from tidewright.operators.spectral import field, grid
from tidewright.shared import written

#: Grid points along an axis, at most: an edge's number holds both indices.
MAX_INDEX = 1 << 30


def edge_number(i: Column, j: Column, upright: int) -> Column:
    """Of the edge from (i, j) to (i, j + 1), or upright to (i + 1, j)."""
    return (i.cast("long") * F.lit(2 * MAX_INDEX) + j.cast("long") * 2 + upright).cast("long")


def segments(points: DataFrame, level: float = 0.0, by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """(keys, i, j, a, xa, ya, b, xb, yb): the directed segments of cells (i, j), a cell named by its
    corner of least indices. A value equal to the level counts as above it; where both diagonals of a
    cell differ, the mean of its corners says which are joined. Cells with a missing, null or NaN
    corner have none."""
    p = points.select(*by, "i", "j", F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col(value).cast("double").alias("v")).alias("p"))
    p = p.where(F.col("p.v").isNotNull() & ~F.isnan("p.v"))
    # corners in turn: (0, 0), (0, 1), (1, 1), (1, 0)
    turns = ((0, 0), (0, 1), (1, 1), (1, 0))
    of = F.array(*[F.struct((F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.lit(k).alias("k")) for k, (di, dj) in enumerate(turns)])
    cells = p.select(*by, F.explode(of).alias("c"), "p").select(*by, "c.i", "c.j", "c.k", "p").groupBy(*by, "i", "j")
    cells = cells.agg(*[F.max(F.when(F.col("k") == k, F.col("p"))).alias(f"c{k}") for k in range(4)])
    cells = cells.where(" AND ".join(f"c{k} IS NOT NULL" for k in range(4)))
    high = [F.col(f"c{k}.v") >= level for k in range(4)]
    one_sided = (high[0] == high[1]) & (high[1] == high[2]) & (high[2] == high[3])
    saddle = (high[0] == high[2]) & (high[1] == high[3]) & (high[0] != high[1])
    middle = (F.col("c0.v") + F.col("c1.v") + F.col("c2.v") + F.col("c3.v")) / 4 >= level
    i, j = F.col("i"), F.col("j")
    # the edge after corner k, from its end of lower index to the other
    edges = (("c0", "c1", i, j, 0), ("c1", "c2", i, j + 1, 1), ("c3", "c2", i + 1, j, 0), ("c0", "c3", i, j, 1))

    def crossing(k: int) -> Column:
        s, e, ei, ej, upright = edges[k]
        share = F.try_divide(F.lit(float(level)) - F.col(f"{s}.v"), F.col(f"{e}.v") - F.col(f"{s}.v"))
        at = [(F.col(f"{s}.{c}") + share * (F.col(f"{e}.{c}") - F.col(f"{s}.{c}"))).alias(c) for c in "xy"]
        return F.struct(edge_number(ei, ej, upright).alias("id"), *at)

    cells = cells.where(~one_sided).withColumns({f"e{k}": crossing(k) for k in range(4)})
    found = []
    for k in range(4):  # from where the turn leaves the higher side, to where it comes back
        for step in (1, 2, 3):
            back = (k + step) % 4
            fits = high[k] & ~high[(k + 1) % 4] & ~high[back] & high[(back + 1) % 4]
            joined = ~saddle if step == 2 else ~saddle | (middle if step == 1 else ~middle)
            found.append(F.when(fits & joined, F.struct(F.col(f"e{k}").alias("a"), F.col(f"e{back}").alias("b"))))
    out = cells.select(*by, "i", "j", F.explode(F.array_compact(F.array(*found))).alias("s"))
    return out.select(*by, "i", "j", F.col("s.a.id").alias("a"), F.col("s.a.x").alias("xa"), F.col("s.a.y").alias("ya"), F.col("s.b.id").alias("b"), F.col("s.b.x").alias("xb"), F.col("s.b.y").alias("yb"))


def _rounds(links: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """(keys, p, next, steps, low, ended) after enough rounds of doubling: of each point the end of its
    line, or a later point where the line is closed, the steps to it, the least point up to it."""
    same = [*by, "p"]
    out = links.select(*same, "next", F.when(F.col("next") == F.col("p"), 0).otherwise(1).cast("long").alias("steps"), F.col("p").alias("low"), (F.col("next") == F.col("p")).alias("ended"))
    rounds = max(1, n.bit_length())
    for k in range(rounds):
        ahead = out.select(*by, F.col("p").alias("next"), F.col("next").alias("_next"), F.col("steps").alias("_steps"), F.col("low").alias("_low"), F.col("ended").alias("_ended"))
        met = out.join(ahead, [*by, "next"])
        out = met.select(*same, F.col("_next").alias("next"), (F.col("steps") + F.col("_steps")).alias("steps"), F.least("low", "_low").alias("low"), F.col("_ended").alias("ended"))
        if k % 2 or k == rounds - 1:
            out = written(out, "lines")
    return out


def polylines(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Directed segments (keys, a, xa, ya, b, xb, yb) -> (keys, line, closed, place, x, y): the points
    of each line in order, lines numbered from 1 in each key by their least crossing. A closed line
    begins there and names it once; open lines begin where nothing leads to them.

    Pointers double from round to round, so that a line of n points takes log2(n) joins; every second
    round is written. No line is held by one task."""
    by = list(by)
    parts = written(parts, "segments")
    first = parts.select(*by, F.col("a").alias("p"), F.col("b").alias("next"), F.col("xa").alias("x"), F.col("ya").alias("y"))
    ends = parts.select(*by, F.col("b").alias("p"), F.col("b").alias("next"), F.col("xb").alias("x"), F.col("yb").alias("y"))
    points = written(first.unionByName(ends.join(first.select(*by, "p"), [*by, "p"], "left_anti")), "points")
    n = points.count()
    open_or_not = _rounds(points, by, n)
    closed = open_or_not.where(~F.col("ended")).select(*by, "p", F.col("low").alias("head"))
    # a closed line ends at the point before its least one
    cut = points.join(closed, [*by, "p"]).select(*by, "p", F.when(F.col("next") == F.col("head"), F.col("p")).otherwise(F.col("next")).alias("next"))
    placed = open_or_not.where("ended").withColumn("closed", F.lit(False))
    placed = placed.unionByName(_rounds(written(cut, "cut"), by, n).withColumn("closed", F.lit(True)))
    lines = placed.groupBy(*by, "next", "closed").agg(F.min("p").alias("least"), F.max("steps").alias("_last"))
    numbered = ranked(lines, by, "least").select(*by, "next", "closed", F.col("t").cast("int").alias("line"), "_last")
    out = placed.join(numbered, [*by, "next", "closed"]).join(points.select(*by, "p", "x", "y"), [*by, "p"])
    return out.select(*by, "line", "closed", (F.col("_last") - F.col("steps") + 1).cast("int").alias("place"), "x", "y")


def field_grid(spark: SparkSession, vectors, d: Dictionary, xs: Sequence[float], ys: Sequence[float], n_modes: int | None = None) -> DataFrame:
    """(mode, i, j, x, y, value): the real parts of the modes of a learned operator on a plane grid."""
    step = lambda name, axis: spark.createDataFrame([(k + 1, float(v)) for k, v in enumerate(axis)], f"{'j' if name == 'x' else 'i'} int, {name} double")
    if max(len(xs), len(ys)) > MAX_INDEX:
        raise ValueError(f"an axis of over {MAX_INDEX} points")
    points = grid(spark, [xs, ys]).withColumnsRenamed({"g1": "x", "g2": "y"})
    points = points.join(F.broadcast(step("x", xs)), "x").join(F.broadcast(step("y", ys)), "y")  # the caller's axes
    out = field(points.withColumn("_at", F.array("x", "y")), vectors, d, "_at", n_modes)
    return out.select("mode", "i", "j", "x", "y", F.col("re").alias("value"))


def zero_contours(spark: SparkSession, vectors, d: Dictionary, xs: Sequence[float], ys: Sequence[float], n_modes: int | None = None, level: float = 0.0) -> DataFrame:
    """(mode, line, closed, place, x, y): where the real part of each mode is ``level``."""
    return polylines(segments(field_grid(spark, vectors, d, xs, ys, n_modes), level, ["mode"]), ["mode"])
