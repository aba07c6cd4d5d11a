"""The registered queries over the driver's tables, each with its SQL where SQL can say it.

Doubles are rounded on both sides and 0.0 is added, so that -0.0 and 0.0 agree.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import dynamics
from tidewright.functions.lifts import Fourier, Hermite, Radial, lift
from tidewright.functions.vectors import gaussian, spectrum_table
from tidewright.operators import diagnostics, embedding, fit, predict, spectral, stats
from tidewright.operators import hankel_gram as hankel_grams
from tidewright.plans import config as plans
from tidewright.sources import simulate, training

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def entries(df: DataFrame, array: str, n: int, digits: int = 6, name: str = "v") -> list[Column]:
    return [rounded(F.get(array, F.lit(i)), digits).alias(f"{name}{i + 1}") for i in range(n)]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_type, t, value, user_id, user_value): one series for each event type."""
    e = read(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value", F.col("user_id").cast("double").alias("user_id"))
    return embedding.numbered(e, ["event_type"], "ts", "event_id")


def one_series(spark, sf_dir):
    """(t, value): all events as one series in order of time, scaled by a number that leaves no
    decimal ties to round."""
    e = read(spark, sf_dir, "events").select("event_id", "ts", (F.col("value") / 97.0).alias("value"))
    return embedding.numbered(e, [], "ts", "event_id").select("t", "value")


SERIES = """s AS (SELECT event_type, value, user_id::DOUBLE AS user_id,
  row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS t FROM events)"""

ONE_SERIES = "e AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS t, value / 97.0::DOUBLE AS v FROM events)"

BY = ["event_type"]


# --- embedding ----------------------------------------------------------------------------


@query(f"""WITH {SERIES}, l AS (SELECT event_type, t - 4 AS t, value AS v1, lag(value, 2) OVER w AS v2, lag(value, 4) OVER w AS v3 FROM s
  WINDOW w AS (PARTITION BY event_type ORDER BY t))
SELECT event_type, t, round(v1, 6) + 0.0::DOUBLE AS v1, round(v2, 6) + 0.0::DOUBLE AS v2, round(v3, 6) + 0.0::DOUBLE AS v3 FROM l WHERE t > 0""")
def hankel_embed(spark, sf_dir):
    s = embedding.delay_embed(events(spark, sf_dir), 3, 2, BY)
    return s.select("event_type", "t", *entries(s, "s", 3))


GRAM_DELAYS = 1000


@query(f"""WITH {ONE_SERIES}, c AS (SELECT i, j FROM (SELECT unnest([1, 250, 500, 750, 1000]) AS i), (SELECT unnest([1, 250, 500, 750, 1000]) AS j)),
n AS (SELECT max(t) - {GRAM_DELAYS - 1} AS n FROM e)
SELECT i::INT AS i, j::INT AS j, round(sum(a.v * b.v), 4) + 0.0::DOUBLE AS value FROM c, n, e a, e b
WHERE a.t BETWEEN 1 + {GRAM_DELAYS} - i AND n + {GRAM_DELAYS} - i AND b.t = a.t + i - j GROUP BY i, j""")
def hankel_gram(spark, sf_dir):
    """Entries of the Gram matrix of a thousand delays of all events."""
    g, _ = hankel_grams.hankel_gram(one_series(spark, sf_dir), GRAM_DELAYS, 1)
    at = [0, 249, 499, 749, 999]
    rows = [(i + 1, j + 1, float(g[i, j])) for i in at for j in at]
    return spark.createDataFrame(rows, "i int, j int, value double").withColumn("value", rounded("value", 4))


@query(f"""WITH {SERIES}, l AS (SELECT event_type, t - 1 AS t, value AS v1, lag(value) OVER w AS v2, user_id AS v3, lag(user_id) OVER w AS v4 FROM s
  WINDOW w AS (PARTITION BY event_type ORDER BY t))
SELECT event_type, t, round(v1, 6) + 0.0::DOUBLE AS v1, round(v2, 6) + 0.0::DOUBLE AS v2, v3, v4 FROM l WHERE t > 0""")
def hankel_multichannel(spark, sf_dir):
    e = events(spark, sf_dir).select("event_type", "t", F.array("value", "user_id").alias("x"))
    s = embedding.delay_embed(e, 2, 1, BY, "x")
    return s.select("event_type", "t", *entries(s, "s", 4))


@query(f"""WITH {SERIES}, l AS (SELECT event_type, t, value AS x, lead(value) OVER (PARTITION BY event_type ORDER BY t) AS y FROM s)
SELECT event_type, t, round(x, 6) + 0.0::DOUBLE AS x, round(y, 6) + 0.0::DOUBLE AS y FROM l WHERE y IS NOT NULL""")
def snapshot_pairs(spark, sf_dir):
    p = embedding.snapshot_pairs(events(spark, sf_dir), BY, "value")
    return p.select("event_type", "t", rounded("x").alias("x"), rounded("y").alias("y"))


@query(f"""WITH {SERIES}, l AS (SELECT event_type, t, value AS a, lag(value) OVER w AS b, lead(value) OVER w AS c, lead(value, 2) OVER w AS d FROM s
  WINDOW w AS (PARTITION BY event_type ORDER BY t))
SELECT event_type, t - 1 AS t, round(a, 6) + 0.0::DOUBLE AS x1, round(b, 6) + 0.0::DOUBLE AS x2, round(c, 6) + 0.0::DOUBLE AS y1, round(a, 6) + 0.0::DOUBLE AS y2
FROM l WHERE b IS NOT NULL AND c IS NOT NULL""")
def delay_embed_pairs(spark, sf_dir):
    pairs = embedding.snapshot_pairs(events(spark, sf_dir), BY, "value")
    out = embedding.delay_pairs(pairs, 2, 1, BY)
    return out.select("event_type", "t", *entries(out, "x", 2, name="x"), *entries(out, "y", 2, name="y"))


@query(f"""WITH {SERIES}, l AS (SELECT event_type, t, value AS v1, lead(value, 3) OVER w AS v2, lead(t, 3) OVER w AS ok FROM s
  WINDOW w AS (PARTITION BY event_type ORDER BY t))
SELECT event_type, t, round(v1, 6) + 0.0::DOUBLE AS v1, round(v2, 6) + 0.0::DOUBLE AS v2 FROM l WHERE ok IS NOT NULL""")
def forward_embed(spark, sf_dir):
    s = embedding.forward_embed(events(spark, sf_dir), 2, 3, BY)
    return s.select("event_type", "t", *entries(s, "s", 2))


@query(f"""WITH {SERIES}, l AS (SELECT event_type, t, lag(value, 2) OVER w AS a, lag(value) OVER w AS b, lead(value) OVER w AS c, lead(value, 2) OVER w AS d FROM s
  WINDOW w AS (PARTITION BY event_type ORDER BY t))
SELECT event_type, t, round((-d + 8.0::DOUBLE * c - 8.0::DOUBLE * b + a) / 1.2::DOUBLE, 5) + 0.0::DOUBLE AS derivative
FROM l WHERE a IS NOT NULL AND d IS NOT NULL""")
def central_difference(spark, sf_dir):
    out = embedding.central_difference(events(spark, sf_dir), 0.1, BY)
    return out.select("event_type", "t", rounded("derivative", 5).alias("derivative"))


# --- statistics ---------------------------------------------------------------------------


@query("""WITH m AS (SELECT avg(l_quantity) AS mq, stddev_samp(l_quantity) AS sq, avg(l_extendedprice) AS mp, stddev_samp(l_extendedprice) AS sp,
  avg(l_discount) AS md, stddev_samp(l_discount) AS sd FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_quantity - mq) / sq, 6) + 0.0::DOUBLE AS l_quantity, round((l_extendedprice - mp) / sp, 6) + 0.0::DOUBLE AS l_extendedprice,
  round((l_discount - md) / sd, 6) + 0.0::DOUBLE AS l_discount FROM lineitem, m""")
def standardize(spark, sf_dir):
    columns = ["l_quantity", "l_extendedprice", "l_discount"]
    out = stats.standardized(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *columns), columns)
    return out.select("l_orderkey", "l_linenumber", *[rounded(c).alias(c) for c in columns])


@query(f"""WITH {SERIES}, m AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM s GROUP BY event_type)
SELECT s.event_type, t, round(((value - lo) / (hi - lo) + 0.35::DOUBLE) / 1.35::DOUBLE, 6) + 0.0::DOUBLE AS value FROM s JOIN m ON s.event_type = m.event_type""")
def normalize_vector(spark, sf_dir):
    out = stats.normalize_vector(events(spark, sf_dir), "value", BY)
    return out.select("event_type", "t", rounded("value").alias("value"))


MI = f"""{SERIES}, m AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM s GROUP BY event_type),
k AS (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8])::INT AS lag),
p AS (SELECT a.event_type, k.lag, least(50, floor((a.value - lo) / ((hi - lo) / 50)) + 1)::INT AS x, least(50, floor((b.value - lo) / ((hi - lo) / 50)) + 1)::INT AS y
  FROM s a CROSS JOIN k JOIN s b ON a.event_type = b.event_type AND b.t = a.t + k.lag JOIN m ON a.event_type = m.event_type),
c AS (SELECT event_type, lag, x, y, count(*)::DOUBLE AS n FROM p GROUP BY ALL),
q AS (SELECT *, sum(n) OVER (PARTITION BY event_type, lag) AS t, sum(n) OVER (PARTITION BY event_type, lag, x) AS nx, sum(n) OVER (PARTITION BY event_type, lag, y) AS ny FROM c),
mi AS (SELECT event_type, lag, sum(n / t * ln((n / t) / ((nx / t) * (ny / t)))) AS mi FROM q GROUP BY event_type, lag)"""


def information(spark, sf_dir):
    return stats.mutual_information(events(spark, sf_dir), range(1, 9), BY)


@query(f"WITH {MI} SELECT event_type, lag, round(mi, 6) + 0.0::DOUBLE AS mi FROM mi")
def mutual_information_curve(spark, sf_dir):
    return information(spark, sf_dir).select("event_type", F.col("lag").cast("int").alias("lag"), rounded("mi").alias("mi"))


@query(f"""WITH {MI}, r AS (SELECT event_type, lag, round(mi, 9) AS mi FROM mi),
w AS (SELECT *, lag(mi) OVER (PARTITION BY event_type ORDER BY lag) AS a, lead(mi) OVER (PARTITION BY event_type ORDER BY lag) AS b FROM r)
SELECT event_type, coalesce(min(CASE WHEN mi < a AND mi <= b THEN lag END), arg_min(lag, (mi, lag)))::INT AS i FROM w GROUP BY event_type""")
def first_minimum(spark, sf_dir):
    curve = information(spark, sf_dir).withColumn("mi", F.round("mi", 9))
    return stats.find_first_minimum(curve, BY, "lag", "mi").select("event_type", F.col("i").cast("int").alias("i"))


@query("""WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings)
SELECT round(median(list_distance(a.x, b.x)), 5) + 0.0::DOUBLE AS sigma FROM p a JOIN p b ON a.vec_id < b.vec_id""")
def median_sigma(spark, sf_dir):
    # all pairs, as the SQL; the operator's default would sample
    points = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("t"), F.col("embedding").alias("x"))
    return spark.createDataFrame([(stats.median_sigma(points, n_sample=None),)], "sigma double").select(rounded("sigma", 5).alias("sigma"))


@query("""WITH p AS (SELECT c_nationkey AS nation, c_custkey AS i, c_custkey::DOUBLE % 97 AS x, c_acctbal AS y FROM customer),
f AS (SELECT nation, i, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM p
  WINDOW w AS (PARTITION BY nation ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT nation, round(sum(x * ny - nx * y) / 2, 3) + 0.0::DOUBLE AS area FROM f GROUP BY nation""")
def signed_area(spark, sf_dir):
    p = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("i"), (F.col("c_custkey").cast("double") % 97).alias("x"), F.col("c_acctbal").alias("y"))
    return stats.signed_area(p, ["nation"]).select("nation", rounded("area", 3).alias("area"))


SIGMAS = [10.0, 5.0, 2.0, 1.0, 0.1, 0.01]


@query("""WITH s AS (SELECT unnest([10.0, 5.0, 2.0, 1.0, 0.1, 0.01])::DOUBLE AS sigma, unnest([1, 2, 3, 4, 5, 6])::INT AS k),
c AS (SELECT k, sum(sigma * sigma) OVER (ORDER BY k) / sum(sigma * sigma) OVER () AS share FROM s),
e AS (SELECT unnest([0.5, 0.9, 0.95, 0.999])::DOUBLE AS energy)
SELECT energy, min(k)::INT AS rank FROM e, c WHERE share >= energy GROUP BY energy""")
def rank_energy(spark, sf_dir):
    s = spark.createDataFrame([(k + 1, v) for k, v in enumerate(SIGMAS)], "k int, sigma double")
    parts = [stats.rank_by_energy(s, energy=e).select(F.lit(e).alias("energy"), "rank") for e in (0.5, 0.9, 0.95, 0.999)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""WITH s AS (SELECT unnest(range(1, 4))::INT AS dim), v AS (
  SELECT 0 AS dim, l_quantity AS v FROM lineitem UNION ALL SELECT 1, l_extendedprice FROM lineitem UNION ALL SELECT 2, l_discount FROM lineitem)
SELECT dim::INT AS dim, round(min(v) - 0.1::DOUBLE * (max(v) - min(v)), 4) + 0.0::DOUBLE AS low, round(max(v) + 0.1::DOUBLE * (max(v) - min(v)), 4) + 0.0::DOUBLE AS high FROM v GROUP BY dim""")
def data_limits(spark, sf_dir):
    x = read(spark, sf_dir, "lineitem").select(F.array("l_quantity", "l_extendedprice", "l_discount").alias("x"))
    return stats.padded_limits(x).select("dim", rounded("low", 4).alias("low"), rounded("high", 4).alias("high"))


@query(f"""WITH {ONE_SERIES},
p AS (SELECT t, v AS a, lead(v) OVER (ORDER BY t) AS b, lead(v, 2) OVER (ORDER BY t) AS c FROM e),
q AS (SELECT * FROM p WHERE c IS NOT NULL),
n AS (SELECT x.t, arg_min(struct_pack(c := y.c, d := sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2)), (sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2), y.t)) AS m, any_value(x.c) AS c
  FROM q x JOIN q y ON x.t <> y.t GROUP BY x.t)
SELECT round(avg(CASE WHEN abs(c - m.c) / m.d > 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS fraction FROM n WHERE m.d >= 1e-12::DOUBLE""")
def fnn_fraction(spark, sf_dir):
    return spark.createDataFrame([(diagnostics.false_nearest_neighbours(one_series(spark, sf_dir), 2, 1),)], "fraction double").select(F.round("fraction", 6).alias("fraction"))


# --- dictionaries -------------------------------------------------------------------------


def discounts(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array("l_discount", "l_tax").alias("x"))


@query("""SELECT l_orderkey, l_linenumber, 1.0::DOUBLE AS v1, round(l_tax, 6) AS v2, round(l_discount, 6) AS v3, round(l_tax * l_tax - 1, 6) + 0.0::DOUBLE AS v4,
  round(l_discount * l_tax, 6) + 0.0::DOUBLE AS v5, round(l_discount * l_discount - 1, 6) + 0.0::DOUBLE AS v6 FROM lineitem""")
def hermite_lift(spark, sf_dir):
    out = lift(discounts(spark, sf_dir), Hermite(2, 2))
    return out.select("l_orderkey", "l_linenumber", *entries(out, "psi", 6))


CENTERS = ((0.02, 0.01), (0.05, 0.04), (0.09, 0.07))


def radial_sql(kernel: str) -> str:
    terms = []
    for k, (a, b) in enumerate(CENTERS):
        d2 = f"((l_discount - {a}::DOUBLE) * (l_discount - {a}::DOUBLE) + (l_tax - {b}::DOUBLE) * (l_tax - {b}::DOUBLE))"
        r = f"(sqrt({d2}) + 1e-12::DOUBLE)"
        f = f"exp(-{d2} / 0.005::DOUBLE)" if kernel == "gaussian" else f"{r} * {r} * ln({r})"
        terms.append(f"round({f}, 6) + 0.0::DOUBLE AS v{k + 4}")
    return f"SELECT l_orderkey, l_linenumber, 1.0::DOUBLE AS v1, round(l_discount, 6) + 0.0::DOUBLE AS v2, round(l_tax, 6) + 0.0::DOUBLE AS v3, {', '.join(terms)} FROM lineitem"


@query(radial_sql("thinplate"))
def rbf_lift_thinplate(spark, sf_dir):
    out = lift(discounts(spark, sf_dir), Radial(CENTERS))
    return out.select("l_orderkey", "l_linenumber", *entries(out, "psi", 6))


@query(radial_sql("gaussian"))
def rbf_lift_gaussian(spark, sf_dir):
    out = lift(discounts(spark, sf_dir), Radial(CENTERS, "gaussian", 0.05))
    return out.select("l_orderkey", "l_linenumber", *entries(out, "psi", 6))


FOURIER = Fourier(((1.5, -2.0), (0.5, 3.0)), (0.25, 1.0))


@query("""SELECT l_orderkey, l_linenumber, round(cos(0.25::DOUBLE + 1.5::DOUBLE * l_discount + -2.0::DOUBLE * l_tax), 6) + 0.0::DOUBLE AS v1,
  round(cos(1.0::DOUBLE + 0.5::DOUBLE * l_discount + 3.0::DOUBLE * l_tax), 6) + 0.0::DOUBLE AS v2 FROM lineitem""")
def rff_lift(spark, sf_dir):
    out = lift(discounts(spark, sf_dir), FOURIER)
    return out.select("l_orderkey", "l_linenumber", *entries(out, "psi", 2))


# --- fits ---------------------------------------------------------------------------------


def lifted_events(spark, sf_dir, m=2):
    """psi = [1, s1, .., sm] of scaled delay vectors and its successor, by event type."""
    e = events(spark, sf_dir).withColumn("value", F.col("value") / 100.0)
    s = embedding.delay_embed(e, m, 1, BY)
    p = embedding.snapshot_pairs(s, BY, "s")
    one = F.array(F.lit(1.0))
    return p.select("event_type", "t", "x", F.concat(one, "x").alias("psi_x"), F.concat(one, "y").alias("psi_y"))


LIFTED = f"""{SERIES}, e AS (SELECT event_type, t, value / 100.0::DOUBLE AS v FROM s),
w AS (SELECT event_type, t, 1.0::DOUBLE AS a1, v AS a2, lag(v) OVER w AS a3, 1.0::DOUBLE AS b1, lead(v) OVER w AS b2, v AS b3, lead(t) OVER w AS nt FROM e
  WINDOW w AS (PARTITION BY event_type ORDER BY t)),
p AS (SELECT * FROM w WHERE a3 IS NOT NULL AND nt IS NOT NULL)"""


def sums_sql(n: int, alpha: str) -> str:
    g = [f"sum(a{i} * a{j}){f' + {alpha}' if i == j else ''} AS g{i}{j}" for i in range(1, n + 1) for j in range(1, n + 1)]
    a = [f"sum(a{i} * b{j}) AS h{i}{j}" for i in range(1, n + 1) for j in range(1, n + 1)]
    return f"m AS (SELECT event_type, {', '.join(g + a)} FROM p GROUP BY event_type)"


@query(f"""WITH {LIFTED}, c AS ({' UNION ALL '.join(f"SELECT event_type, '{b}' AS block, {i} AS i, {j} AS j, sum(a{i} * {c}{j}) AS v FROM p GROUP BY event_type" for b, c in (('G', 'a'), ('A', 'b')) for i in (1, 2, 3) for j in (1, 2, 3))})
SELECT event_type, block, i::INT AS i, j::INT AS j, round(v, 3) + 0.0::DOUBLE AS value FROM c""")
def gram_blocks(spark, sf_dir):
    p = lifted_events(spark, sf_dir)
    both = fit.gram(p.select("event_type", "psi_x", F.concat("psi_x", "psi_y").alias("xy")), BY, "psi_x", "xy", (3, 6))
    both = both.withColumn("block", F.when(F.col("j") <= 3, "G").otherwise("A")).withColumn("j", F.when(F.col("j") <= 3, F.col("j")).otherwise(F.col("j") - 3))
    return both.select("event_type", "block", "i", "j", rounded("value", 3).alias("value"))


@query(f"""WITH {LIFTED}, {sums_sql(2, '0.001::DOUBLE')}, d AS (SELECT *, g11 * g22 - g12 * g21 AS det FROM m)
{' UNION ALL '.join(f"SELECT event_type, {i}::INT AS i, {j}::INT AS j, round({e}, 5) + 0.0::DOUBLE AS value FROM d" for i, j, e in ((1, 1, '(g22 * h11 - g12 * h21) / det'), (1, 2, '(g22 * h12 - g12 * h22) / det'), (2, 1, '(g11 * h21 - g21 * h11) / det'), (2, 2, '(g11 * h22 - g21 * h12) / det')))}""")
def edmd_ridge_2x2(spark, sf_dir):
    p = lifted_events(spark, sf_dir).select("event_type", F.slice("psi_x", 1, 2).alias("psi_x"), F.slice("psi_y", 1, 2).alias("psi_y"))
    return fit.grouped_ridge(p, BY, 2, 1e-3).select("event_type", "i", "j", rounded("value", 5).alias("value"))


def cramer(c: str) -> str:
    """SQL of the three unknowns of a 3x3 system with the matrix g and right side ``c``, over det."""
    m = [["g11", "g12", "g13"], ["g21", "g22", "g23"], ["g31", "g32", "g33"]]
    out = []
    for k in range(3):
        r = [[(f"h{i + 1}{c}" if j == k else m[i][j]) for j in range(3)] for i in range(3)]
        out.append(det3(r))
    return out


def det3(r: list[list[str]]) -> str:
    return f"({r[0][0]} * ({r[1][1]} * {r[2][2]} - {r[1][2]} * {r[2][1]}) - {r[0][1]} * ({r[1][0]} * {r[2][2]} - {r[1][2]} * {r[2][0]}) + {r[0][2]} * ({r[1][0]} * {r[2][1]} - {r[1][1]} * {r[2][0]}))"


DET = det3([[f"g{i}{j}" for j in (1, 2, 3)] for i in (1, 2, 3)])


@query(f"""WITH {LIFTED}, {sums_sql(3, '0.001::DOUBLE')}
{' UNION ALL '.join(f"SELECT event_type, {i + 1}::INT AS i, {j}::INT AS j, round({e} / {DET}, 5) + 0.0::DOUBLE AS value FROM m" for j in (1, 2, 3) for i, e in enumerate(cramer(str(j))))}""")
def edmd_ridge_3x3(spark, sf_dir):
    return fit.grouped_ridge(lifted_events(spark, sf_dir), BY, 3, 1e-3).select("event_type", "i", "j", rounded("value", 5).alias("value"))


@query(f"""WITH {LIFTED}, m AS (SELECT {', '.join(f"sum(a{i} * a{j}){' + 1e-6::DOUBLE' if i == j else ''} AS g{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3))},
  {', '.join(f"sum(a{i} * a{j + 1}) AS h{i}{j}" for i in (1, 2, 3) for j in (1, 2))} FROM p)
{' UNION ALL '.join(f"SELECT {j}::INT AS i, {i + 1}::INT AS j, round({e} / {DET}, 4) + 0.0::DOUBLE AS value FROM m" for j in (1, 2) for i, e in enumerate(cramer(str(j))))}""")
def projection_operator(spark, sf_dir):
    p = lifted_events(spark, sf_dir)
    b = fit.fit_projection(p, "x", "psi_x", 1e-6)
    from tidewright.functions.vectors import matrix_table

    return matrix_table(spark, b).select("i", "j", rounded("value", 4).alias("value"))


@query("""WITH d AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label, i, avg(v) AS v FROM d GROUP BY label, i), c AS (SELECT label, list(v ORDER BY i) AS c FROM m GROUP BY label)
SELECT vec_id AS i, c.label AS j, round(exp(-(list_distance(embedding::DOUBLE[], c) ** 2) / 2.0::DOUBLE), 6) + 0.0::DOUBLE AS k FROM embeddings, c""")
def kernel_gram(spark, sf_dir):
    """Kernel vectors of all embeddings; the landmarks are the labels' mean vectors."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    means = e.select("label", F.posexplode("x").alias("d", "v")).groupBy("label", "d").agg(F.avg("v").alias("v"))
    means = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("d", "v"))).alias("m"))
    means = sorted(means.select("label", "m.v").limit(fit.MAX_LANDMARKS + 1).collect())
    if len(means) > fit.MAX_LANDMARKS:
        raise ValueError("too many labels to be landmarks")
    out = fit.kernel_rows(e.select("vec_id", "x"), np.array([m[1] for m in means]), 1.0).select("vec_id", F.posexplode("k").alias("p", "k"))
    label = F.get(F.array(*[F.lit(m[0]) for m in means]), F.col("p"))
    return out.select(F.col("vec_id").alias("i"), label.alias("j"), rounded("k").alias("k"))


# --- spectra ------------------------------------------------------------------------------

MODES = [1.0, complex(np.cos(0.5), np.sin(0.5)), complex(np.cos(0.5), -np.sin(0.5)), complex(np.cos(1.0), np.sin(1.0)), complex(np.cos(1.0), -np.sin(1.0)), 0.5]
MODES_SQL = """s AS (SELECT unnest([1, 2, 3, 4, 5, 6])::INT AS k, unnest([1.0::DOUBLE, cos(0.5::DOUBLE), cos(0.5::DOUBLE), cos(1.0::DOUBLE), cos(1.0::DOUBLE), 0.5::DOUBLE]) AS re,
  unnest([0.0::DOUBLE, sin(0.5::DOUBLE), -sin(0.5::DOUBLE), sin(1.0::DOUBLE), -sin(1.0::DOUBLE), 0.0::DOUBLE]) AS im)"""


@query(f"""WITH {MODES_SQL} SELECT k, round(re, 6) + 0.0::DOUBLE AS re, round(im, 6) + 0.0::DOUBLE AS im FROM s
WHERE abs(sqrt(re * re + im * im) - 1) <= 0.05 AND abs(im) > 1e-6 AND NOT sqrt((re - 1) * (re - 1) + im * im) < 1e-8""")
def mode_filter(spark, sf_dir):
    return spectral.limit_cycle_modes(spectrum_table(spark, MODES)).select("k", rounded("re").alias("re"), rounded("im").alias("im"))


@query(f"""WITH {MODES_SQL}, b AS (SELECT sqrt(re ** 2 + im ** 2) AS r, atan2(im, re) AS a FROM s WHERE k = 2),
t AS (SELECT h::INT AS harmonic, g::INT AS sign, r ** h * cos(h * a) AS x, g * r ** h * sin(h * a) AS y FROM b, unnest([2, 3, 4, 5]) u(h), unnest([1, -1]) v(g)),
d AS (SELECT harmonic, sign, k, sqrt((re - x) ** 2 + (im - y) ** 2) AS d FROM s, t),
n AS (SELECT harmonic, sign, arg_min(k, (d, k)) AS k, min(d) AS distance FROM d GROUP BY harmonic, sign)
SELECT harmonic, sign, k, round(distance, 6) + 0.0::DOUBLE AS distance FROM n WHERE distance < 0.05::DOUBLE * 1.5::DOUBLE ** (harmonic - 1)""")
def harmonic_match(spark, sf_dir):
    out = spectral.harmonic_matches(spectrum_table(spark, MODES), 2)
    return out.select("harmonic", "sign", "k", rounded("distance").alias("distance"))


@query("""WITH x AS (SELECT unnest([-1.0, -0.5, 0.0, 0.5, 1.0])::DOUBLE AS g1), y AS (SELECT unnest([-1.0, 0.0, 1.0])::DOUBLE AS g2),
m AS (SELECT 1 AS mode, 0.5::DOUBLE AS a, 0.25::DOUBLE AS b, 1.0::DOUBLE AS c, 0.0::DOUBLE AS ai, 0.5::DOUBLE AS bi, -0.5::DOUBLE AS ci
  UNION ALL SELECT 2, 1.0, -1.0, 0.5, 0.0, 0.0, 0.0)
SELECT g1, g2, mode::INT AS mode, round(a + b * g2 + c * g1, 6) + 0.0::DOUBLE AS re, round(-ai - bi * g2 - ci * g1, 6) + 0.0::DOUBLE AS im FROM x, y, m""")
def eigenfunction_grid(spark, sf_dir):
    xi = np.array([[0.5, 1.0], [0.25 + 0.5j, -1.0], [1.0 - 0.5j, 0.5]])
    out = spectral.eigenfunction_grid(spark, xi, Hermite(2, 1), [[-1, -0.5, 0, 0.5, 1], [-1, 0, 1]])
    return out.select("g1", "g2", "mode", rounded("re").alias("re"), rounded("im").alias("im"))


@query("""WITH e(re1, im1, re2, im2) AS (VALUES (1.0, 0.0, -1.0, 0.0), (-1.0, 0.0, -2.0, 0.0), (-1.0, 0.0, -1.0, 0.0), (1.0, 0.0, 2.0, 0.0), (0.0, 0.0, 1.0, 0.0),
  (-1.0, 1.0, -1.0, -1.0), (1.0, 1.0, 1.0, -1.0), (0.0, 1.0, 0.0, -1.0))
SELECT re1::DOUBLE AS re1, im1::DOUBLE AS im1, re2::DOUBLE AS re2, im2::DOUBLE AS im2, CASE WHEN im1 = 0 AND im2 = 0 THEN
  CASE WHEN re1 * re2 < 0 THEN 'saddle' WHEN re1 < 0 AND re2 < 0 THEN CASE WHEN re1 = re2 THEN 'stable node (star/degenerate)' ELSE 'stable node' END
  WHEN re1 > 0 AND re2 > 0 THEN 'unstable node' ELSE 'non-hyperbolic' END
  WHEN re1 < 0 THEN 'stable spiral/focus' WHEN re1 > 0 THEN 'unstable spiral/focus' ELSE 'center' END AS kind FROM e""")
def fixed_point_kinds(spark, sf_dir):
    rows = [(1, 0, -1, 0), (-1, 0, -2, 0), (-1, 0, -1, 0), (1, 0, 2, 0), (0, 0, 1, 0), (-1, 1, -1, -1), (1, 1, 1, -1), (0, 1, 0, -1)]
    e = spark.createDataFrame([tuple(map(float, r)) for r in rows], "re1 double, im1 double, re2 double, im2 double")
    return e.withColumn("kind", diagnostics.classify_fixed_point(*map(F.col, e.columns)))


# --- prediction ---------------------------------------------------------------------------


def rollout(spark, sf_dir):
    """Fixed 2x2 operator rolled out from every delay vector that has 20 more after it."""
    s = embedding.delay_embed(one_series(spark, sf_dir), 2, 1, [])
    return predict.predict_delay_space(s, np.array([[0.9, 0.2], [-0.1, 0.8]]), None, 20)


ROLL = f"""WITH RECURSIVE {ONE_SERIES}, d AS (SELECT t - 1 AS t, v AS s1, lag(v) OVER (ORDER BY t) AS s2 FROM e),
r AS (SELECT t AS start_idx, 0 AS step, s1, s2 FROM d WHERE t BETWEEN 1 AND (SELECT max(t) FROM d) - 20
  UNION ALL SELECT start_idx, step + 1, 0.9::DOUBLE * s1 + 0.2::DOUBLE * s2, -0.1::DOUBLE * s1 + 0.8::DOUBLE * s2 FROM r WHERE step < 20),
o AS (SELECT r.start_idx, r.step, d.s1 AS x_true, r.s1 AS x_pred FROM r JOIN d ON d.t = r.start_idx + r.step)"""


@query(f"{ROLL} SELECT start_idx, step::INT AS step, 1::INT AS dim, round(x_true, 6) + 0.0::DOUBLE AS x_true, round(x_pred, 6) + 0.0::DOUBLE AS x_pred FROM o")
def linear_rollout(spark, sf_dir):
    return rollout(spark, sf_dir).select("start_idx", "step", "dim", rounded("x_true").alias("x_true"), rounded("x_pred").alias("x_pred"))


@query(f"{ROLL} SELECT step::INT AS step, round(avg(abs(x_pred - x_true)), 6) + 0.0::DOUBLE AS error FROM o GROUP BY step")
def prediction_error(spark, sf_dir):
    return stats.prediction_error(rollout(spark, sf_dir)).select("step", rounded("error").alias("error"))


# --- simulation ---------------------------------------------------------------------------

STARTS = {2: [(0.1, 0.0), (0.5, -0.2), (-1.0, 0.3)], 3: [(1.0, 1.0, 1.0), (0.5, -0.2, 0.1)]}


def simulated(system: str, regime: str, dt: float, m: int) -> Query:
    def run(spark, sf_dir):
        p = dynamics.parameters(system, regime)
        starts = spark.createDataFrame([(i + 1, list(x)) for i, x in enumerate(STARTS[p.dim])], "traj_id long, x0 array<double>")
        out = simulate.rk4(starts, p, dt, m)
        return out.select("traj_id", "t", *entries(out, "x", p.dim, name="x"))

    return run


def simulated_sql(dim: int, rhs: list[str], dt: float, m: int) -> str:
    """Runge-Kutta as a recursive query; ``rhs`` over {0}, {1}, {2}."""
    v = [f"x{i}" for i in range(dim)]
    at = lambda e: [f"({r.format(*e)})" for r in rhs]
    h = f"{dt}::DOUBLE"
    stage = lambda k, w: [f"(x{i} + {w} * {k}{i})" for i in range(dim)]
    cols = lambda k, e: ", ".join(f"{x} AS {k}{i}" for i, x in enumerate(at(e)))
    step = (
        f"SELECT traj_id, t + 1, {', '.join(f'x{i} + {h} / 6 * (a{i} + 2 * b{i} + 2 * c{i} + d{i})' for i in range(dim))} FROM ("
        f"SELECT *, {cols('d', stage('c', h))} FROM (SELECT *, {cols('c', stage('b', h + ' / 2'))} FROM (SELECT *, {cols('b', stage('a', h + ' / 2'))} FROM ("
        f"SELECT *, {cols('a', v)} FROM r WHERE t <= {m}))))"
    )
    starts = ", ".join(f"({i + 1}, {', '.join(f'{c}::DOUBLE' for c in x)})" for i, x in enumerate(STARTS[dim]))
    return (
        f"WITH RECURSIVE i(traj_id, {', '.join(v)}) AS (VALUES {starts}), r(traj_id, t, {', '.join(v)}) AS (SELECT traj_id::BIGINT, 1::BIGINT, {', '.join(v)} FROM i UNION ALL {step}) "
        f"SELECT traj_id, t, {', '.join(f'round(x{i}, 6) + 0.0::DOUBLE AS x{i + 1}' for i in range(dim))} FROM r"
    )


RK4 = {
    "rk4_fhn": ("fhn", "stable-limit-cycle", 0.01, 200, ["{0} - {0} * {0} * {0} / 3.0::DOUBLE - {1} + 0.5::DOUBLE", "0.08::DOUBLE * ({0} + 0.7::DOUBLE - 0.0::DOUBLE * {1})"]),
    "rk4_duffing": ("duffing", "three-equilibrium-attractors", 0.01, 200, ["{1}", "-0.2::DOUBLE * {1} + 1.0::DOUBLE * {0} - 1.0::DOUBLE * {0} * {0} * {0}"]),
    "rk4_lorenz": ("lorenz", "chaotic", 0.005, 100, ["10.0::DOUBLE * ({1} - {0})", "{0} * (28.0::DOUBLE - {2}) - {1}", "{0} * {1} - (8.0::DOUBLE / 3.0::DOUBLE) * {2}"]),
    "rk4_vanderpol": ("vanderpol", "stable-limit-cycle", 0.01, 100, ["{1}", "{2}", "0.3::DOUBLE * (1.0::DOUBLE - {0} * {0}) * {2} - {0} - {1}"]),
    "rk4_rossler": ("rossler", "chaotic", 0.01, 100, ["-{1} - {2}", "{0} + 0.2::DOUBLE * {1}", "0.2::DOUBLE + {2} * ({0} - 5.7::DOUBLE)"]),
}
for _name, (_system, _regime, _dt, _m, _rhs) in RK4.items():
    QUERIES[_name] = simulated(_system, _regime, _dt, _m)
    ORACLES[_name] = simulated_sql(len(_rhs), _rhs, _dt, _m)


@query("""WITH l AS (SELECT sqrt(8.0::DOUBLE / 3.0::DOUBLE * 27.0::DOUBLE) AS r, sqrt(5.7::DOUBLE ** 2 - 4 * 0.2::DOUBLE * 0.2::DOUBLE) AS d, sqrt(2.5::DOUBLE ** 2 - 4 * 0.2::DOUBLE * 0.2::DOUBLE) AS e), p AS (
SELECT 'fhn' AS system, 'stable-limit-cycle' AS regime, 1 AS k, [-0.7::DOUBLE, -0.7::DOUBLE + 0.343::DOUBLE / 3 + 0.5::DOUBLE] AS x
UNION ALL SELECT 'duffing', r, k, x FROM (SELECT unnest(['stable-node', 'three-equilibrium-attractors', 'three-equilibrium-centers']) AS r), (VALUES (1, [0.0::DOUBLE, 0.0::DOUBLE]), (2, [1.0::DOUBLE, 0.0::DOUBLE]), (3, [-1.0::DOUBLE, 0.0::DOUBLE])) v(k, x)
UNION ALL SELECT 'lorenz', 'chaotic', k, x FROM (SELECT unnest([1, 2, 3]) AS k, unnest([[0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE], [r, r, 27.0::DOUBLE], [-r, -r, 27.0::DOUBLE]]) AS x FROM l)
UNION ALL SELECT 'vanderpol', unnest(['stable-focus', 'stable-limit-cycle', 'chaotic']), 1, [0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE]
UNION ALL SELECT 'rossler', 'chaotic', k, [-0.2::DOUBLE * y, y, -y] FROM (SELECT unnest([1, 2]) AS k, unnest([(-5.7::DOUBLE + d) / 0.4::DOUBLE, (-5.7::DOUBLE - d) / 0.4::DOUBLE]) AS y FROM l)
UNION ALL SELECT 'rossler', 'stable-limit-cycle', k, [-0.2::DOUBLE * y, y, -y] FROM (SELECT unnest([1, 2]) AS k, unnest([(-2.5::DOUBLE + e) / 0.4::DOUBLE, (-2.5::DOUBLE - e) / 0.4::DOUBLE]) AS y FROM l))
SELECT system, regime, k::INT AS k, (u.i - 1)::INT AS dim, round(x[u.i], 6) + 0.0::DOUBLE AS value FROM p, unnest(range(1, 4)) u(i) WHERE u.i <= len(x)""")
def fixed_points(spark, sf_dir):
    t = dynamics.fixed_points_table(spark).where("system <> 'epileptor3d' AND NOT (system = 'fhn' AND regime <> 'stable-limit-cycle')")
    out = t.select("system", "regime", "k", F.posexplode("x").alias("dim", "value"))
    return out.withColumn("value", rounded("value"))


@query()
def regimes(spark, sf_dir):
    return dynamics.regimes_table(spark)


@query()
def fixed_points_all(spark, sf_dir):
    return dynamics.fixed_points_table(spark)


# --- whole analyses (no SQL) --------------------------------------------------------------


def analysed(kind: str, **options) -> Query:
    def run(spark, sf_dir):
        c = plans.Config(**{"m_embed": 6, "tau_delay": 1, "r": 3, "dict_type": kind, "seed": 1} | options)
        a = plans.hankel_analysis(one_series(spark, sf_dir), c)
        out = a.spectrum_table(spark, len(a.k))
        a.release(spark)  # the spectrum is at hand
        return out

    return run


QUERIES |= {
    "analysis_none": analysed("none", dict_params={}),
    "analysis_hermite": analysed("hermite", dict_params={"max_deg": 2}),
    "analysis_rbf": analysed("rbf", dict_params={"n_rbf": 8}),
    "analysis_rff": analysed("rff", dict_params={"D": 20, "include_states": True}),
    "analysis_kernel": analysed("kernel", dict_params={"sigma": 2.0, "n_landmarks": 500}),
    "analysis_havok": analysed("havok", dict_params={}),
}


@query()
def hankel_prediction(spark, sf_dir):
    c = plans.Config(m_embed=6, tau_delay=1, r=3, dict_type="hermite", dict_params={"max_deg": 2}, seed=1)
    return plans.hankel_analysis(one_series(spark, sf_dir), c).predict(None, 5)


@query()
def state_analysis(spark, sf_dir):
    pairs = training.edmd_training_data(spark, "duffing", "stable-node", 20, 4)
    c = plans.Config(dict_type="hermite", dict_params={"max_deg": 3}, seed=1)
    return plans.state_analysis(pairs, c).spectrum_table(spark)


@query()
def zero_level_set(spark, sf_dir):
    pairs = training.edmd_training_data(spark, "fhn", "stable-node", 40, 4)
    a = plans.state_analysis(pairs, plans.Config(dict_type="rbf", dict_params={"n_rbf": 10}, seed=1))
    points = pairs.select((F.col("traj_id") * 1000 + F.col("t")).alias("t"), "x")
    return diagnostics.zero_level_points(points, a.dictionary, a.spectrum[1], [2], 40, 60)


@query("""WITH p AS (SELECT vec_id AS t, embedding::DOUBLE[] AS x FROM embeddings), d AS (SELECT a.t, b.t AS nn, list_distance(a.x, b.x) AS d FROM p a JOIN p b ON a.t <> b.t)
SELECT t, arg_min(nn, (d, nn)) AS nn, round(min(d), 6) + 0.0::DOUBLE AS distance FROM d GROUP BY t""")
def nearest_embeddings(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("t"), F.col("embedding").alias("s"))
    return diagnostics.nearest_neighbours(e).select("t", "nn", rounded("distance").alias("distance"))


@query("""WITH e AS (SELECT ts, event_id, event_type, value FROM events) SELECT event_type, count(*) - 1 AS pairs FROM e GROUP BY event_type""")
def pair_counts(spark, sf_dir):
    return embedding.snapshot_pairs(events(spark, sf_dir), BY, "value").groupBy("event_type").agg(F.count("*").alias("pairs"))


from tidewright import model_queries, table_queries  # noqa: E402, F401  more of them, registered on import
