"""Registered queries of modes, ranks, fields and small geometry over the given tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidewright.functions.lifts import Hermite
from tidewright.functions.vectors import spectrum_table
from tidewright.model_queries import shown
from tidewright.operators import diagnostics, embedding, fit, kernel_cg, krylov, spectral, spectral_keys, stats
from tidewright.queries import BY, LIFTED, lifted_events, one_series, query, read, rounded, sums_sql

# Numbers like 1e0 are DOUBLE in the SQL.

KEYS = ["nation", "segment"]
#: Every customer is a mode of its nation and segment: near the unit circle, at an angle of its own.
MODES = """m AS MATERIALIZED (SELECT nation, segment, k::INT AS k, CASE WHEN real THEN r ELSE r * cos(a) END AS re, CASE WHEN real THEN 0e0 ELSE r * sin(a) END AS im FROM (
  SELECT c_nationkey AS nation, c_mktsegment AS segment, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS k,
  1e0 + (c_custkey % 11 - 5) / 1e2 AS r, ((c_custkey * 37) % 629) / 1e2 AS a, c_custkey % 7 = 0 AS real FROM customer))"""


def modes(spark, sf_dir):
    from pyspark.sql import Window

    c = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.col("c_custkey").cast("long").alias("id"))
    k = F.row_number().over(Window.partitionBy(*KEYS).orderBy("id"))
    r, a = 1.0 + (F.col("id") % 11 - 5) / 100.0, ((F.col("id") * 37) % 629) / 100.0
    real = F.col("id") % 7 == 0
    return c.select(*KEYS, k.alias("k"), F.when(real, r).otherwise(r * F.cos(a)).alias("re"), F.when(real, 0.0).otherwise(r * F.sin(a)).alias("im"))


@query(f"""WITH {MODES} SELECT nation, segment, k, {shown(6, re='re', im='im')} FROM m
WHERE abs(sqrt(re * re + im * im) - 1) <= 0.02 AND abs(im) > 1e-6 AND NOT sqrt((re - 1) * (re - 1) + im * im) < 1e-8""")
def limit_cycle_customers(spark, sf_dir):
    """Modes of all keys near the unit circle and off the real axis."""
    out = spectral.limit_cycle_modes(modes(spark, sf_dir), 0.02)
    return out.select(*KEYS, "k", rounded("re").alias("re"), rounded("im").alias("im"))


@query(f"""WITH {MODES}, o AS (SELECT *, row_number() OVER (PARTITION BY nation, segment ORDER BY round(sqrt(re * re + im * im), 9) DESC, k) AS place FROM m)
SELECT nation, segment, k, place::INT AS place FROM o WHERE place <= 3""")
def leading_by_key(spark, sf_dir):
    return spectral_keys.leading(modes(spark, sf_dir), KEYS, 3).select(*KEYS, "k", F.col("place").cast("int").alias("place"))


def family_sql(name: str, growth: str) -> str:
    """Members of every mode's family, whichever mode is asked for."""
    return f"""{name} AS MATERIALIZED (SELECT DISTINCT nation, segment, base, k FROM (
  SELECT nation, segment, base, CASE WHEN h = 1 THEN min(k) FILTER (d < 0.05e0) WHEN min(d) < 0.05e0 * pow({growth}, h - 1) THEN arg_min(k, (d, k)) END AS k FROM (
    SELECT b.nation, b.segment, b.k AS base, h, s, m.k, sqrt((m.re - pow(b.r, h) * cos(h * b.a)) ** 2 + (m.im - s * pow(b.r, h) * sin(h * b.a)) ** 2) AS d
    FROM (SELECT *, sqrt(re * re + im * im) AS r, atan2(im, re) AS a FROM m) b, (SELECT unnest([1, 2, 3, 4, 5]) AS h), (SELECT unnest([1, -1]) AS s), m
    WHERE m.nation = b.nation AND m.segment = b.segment AND NOT (h = 1 AND s = 1)) GROUP BY nation, segment, base, h, s
  UNION ALL SELECT nation, segment, k, k FROM m) WHERE k IS NOT NULL)"""


PHASE = f"""{MODES}, {family_sql('f1', '1e0')},
ph AS (SELECT nation, segment, arg_min(k, (im, k)) AS base FROM m WHERE sqrt((re - 1) ** 2 + im * im) > 1e-3 AND abs(sqrt(re * re + im * im) - 1) < 1e-3 AND im > 1e-4 GROUP BY ALL),
am AS (SELECT m.nation, m.segment, arg_max(m.k, (abs(im) < 1e-4, re, -m.k)) AS amp FROM m JOIN ph ON m.nation = ph.nation AND m.segment = ph.segment
  WHERE sqrt((re - 1) ** 2 + im * im) > 1e-3 AND NOT EXISTS (SELECT 1 FROM f1 WHERE f1.nation = m.nation AND f1.segment = m.segment AND f1.base = ph.base AND f1.k = m.k) GROUP BY ALL),
pa AS MATERIALIZED (SELECT ph.nation, ph.segment, ph.base, amp FROM ph JOIN am ON ph.nation = am.nation AND ph.segment = am.segment JOIN m ON m.nation = am.nation AND m.segment = am.segment AND m.k = amp WHERE m.re <> 0 OR m.im <> 0)"""


@query(f"""WITH {PHASE} SELECT pa.nation, pa.segment, pa.base AS phase_k, amp AS amplitude_k, {shown(6, phase_re='ln(sqrt(p.re * p.re + p.im * p.im)) / 0.1e0', phase_im='atan2(p.im, p.re) / 0.1e0', amplitude_re='ln(sqrt(a.re * a.re + a.im * a.im)) / 0.1e0', amplitude_im='atan2(a.im, a.re) / 0.1e0')}
FROM pa JOIN m p ON p.nation = pa.nation AND p.segment = pa.segment AND p.k = pa.base JOIN m a ON a.nation = pa.nation AND a.segment = pa.segment AND a.k = pa.amp""")
def phase_amplitude_by_key(spark, sf_dir):
    out, _ = spectral_keys.phase_and_amplitude(modes(spark, sf_dir), KEYS, 0.1)
    return out.select(*KEYS, "phase_k", "amplitude_k", *[rounded(c).alias(c) for c in ("phase_re", "phase_im", "amplitude_re", "amplitude_im")])


@query(f"""WITH RECURSIVE {PHASE}, {family_sql('f2', '1.5e0')},
al AS MATERIALIZED (SELECT nation, segment, k, im FROM m WHERE abs(sqrt(re * re + im * im) - 1) <= 0.05e0 AND im > 1e-6 AND sqrt((re - 1) ** 2 + im * im) > 1e-8),
ls AS MATERIALIZED (SELECT nation, segment, list((im, k) ORDER BY im, k) AS c FROM al GROUP BY ALL),
g1 AS (SELECT nation, segment, base, list(k) AS ks FROM f1 GROUP BY ALL), g2 AS MATERIALIZED (SELECT nation, segment, base, list(k) AS ks FROM f2 GROUP BY ALL),
z AS (SELECT i.nation, i.segment, coalesce(g1.ks, []) AS taken, CASE WHEN g1.ks IS NULL THEN 0 ELSE 1 END AS branch, g1.ks AS ks FROM (SELECT DISTINCT nation, segment FROM m) i
    LEFT JOIN pa ON pa.nation = i.nation AND pa.segment = i.segment LEFT JOIN g1 ON g1.nation = pa.nation AND g1.segment = pa.segment AND g1.base = pa.base
  UNION ALL SELECT q.nation, q.segment, list_concat(q.taken, g2.ks), q.branch + 1, g2.ks FROM (
    SELECT z.*, list_filter(ls.c, lambda e: NOT list_contains(z.taken, e[2]))[1][2] AS base FROM z JOIN ls ON ls.nation = z.nation AND ls.segment = z.segment) q
    JOIN g2 ON g2.nation = q.nation AND g2.segment = q.segment AND g2.base = q.base)
SELECT nation, segment, branch::INT AS branch, unnest(ks)::INT AS k FROM z WHERE ks IS NOT NULL""")
def families_by_key(spark, sf_dir):
    """All harmonic families of every nation and segment, in rounds over all keys."""
    return spectral_keys.harmonic_families(modes(spark, sf_dir), KEYS, 0.1)


@query(f"""WITH {LIFTED}, {sums_sql(2, '0.001::DOUBLE')}, dt AS (SELECT *, g11 * g22 - g12 * g21 AS det FROM m),
op AS (SELECT event_type, (g22 * h11 - g12 * h21) / det AS a, (g22 * h12 - g12 * h22) / det AS b, (g11 * h21 - g21 * h11) / det AS c, (g11 * h22 - g21 * h12) / det AS d FROM dt),
ev AS (SELECT event_type, (a + d) / 2 AS h, ((a - d) / 2) ** 2 + b * c AS q FROM op),
sp AS (SELECT event_type, h + sign * CASE WHEN q > 0 THEN sqrt(q) ELSE 0 END AS re, CASE WHEN q > 0 THEN 0e0 ELSE sign * sqrt(-q) END AS im FROM ev, (SELECT unnest([1, -1]) AS sign))
SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY round(sqrt(re * re + im * im), 9) DESC, re DESC, im DESC)::INT AS k, {shown(5, re='re', im='im')} FROM sp""")
def spectra_by_key(spark, sf_dir):
    """Eigenvalues of every event type's operator."""
    p = lifted_events(spark, sf_dir).select("event_type", F.slice("psi_x", 1, 2).alias("psi_x"), F.slice("psi_y", 1, 2).alias("psi_y"))
    out = spectral_keys.spectra(fit.grouped_ridge(p, BY, 2, 1e-3), BY)
    return out.select("event_type", "k", rounded("re", 5).alias("re"), rounded("im", 5).alias("im"))


@query(f"""SELECT l_orderkey, l_linenumber, mode::INT AS mode, {shown(6, re='a + b * l_tax + c * l_discount', im='-ai - bi * l_tax - ci * l_discount')} FROM lineitem, (
  SELECT 1 AS mode, 0.5e0 AS a, 0.25e0 AS b, 1e0 AS c, 0e0 AS ai, 0.5e0 AS bi, -0.5e0 AS ci UNION ALL SELECT 2, 1, -1, 0.5, 0, 0, 0)""")
def eigenfunction_lineitems(spark, sf_dir):
    """Two modes' fields at every line item's discount and tax."""
    xi = np.array([[0.5, 1.0], [0.25 + 0.5j, -1.0], [1.0 - 0.5j, 0.5]])
    points = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array("l_discount", "l_tax").alias("x"))
    out = spectral.field(points, xi, Hermite(2, 1))
    return out.select("l_orderkey", "l_linenumber", "mode", rounded("re").alias("re"), rounded("im").alias("im"))


@query("""WITH s AS (SELECT c_nationkey AS nation, abs(c_acctbal) AS sigma, row_number() OVER (PARTITION BY c_nationkey ORDER BY abs(c_acctbal) DESC, c_custkey) AS k FROM customer),
c AS (SELECT nation, k, sum(sigma * sigma) OVER (PARTITION BY nation ORDER BY k) / sum(sigma * sigma) OVER (PARTITION BY nation) AS share FROM s)
SELECT nation, coalesce(min(CASE WHEN share >= 0.9e0 THEN k END), max(k))::INT AS rank FROM c GROUP BY nation""")
def rank_by_nation(spark, sf_dir):
    """How many of a nation's largest balances hold nine tenths of the squares."""
    from pyspark.sql import Window

    c = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.abs("c_acctbal").alias("sigma"), "c_custkey")
    k = F.row_number().over(Window.partitionBy("nation").orderBy(F.col("sigma").desc(), "c_custkey"))
    return stats.rank_by_energy(c.withColumn("k", k), ["nation"], energy=0.9).select("nation", F.col("rank").cast("int").alias("rank"))


@query("""WITH e AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 0e0 ELSE (c_custkey % 5 - 2) / 2e0 END AS re1, (c_custkey % 4)::DOUBLE - 1.5e0 + (c_custkey % 2) / 2e0 AS b, (c_custkey % 6 = 1) AS turns FROM customer),
f AS (SELECT c_custkey, re1, CASE WHEN turns THEN 1e0 ELSE 0e0 END AS im1, CASE WHEN turns THEN re1 ELSE b END AS re2, CASE WHEN turns THEN -1e0 ELSE 0e0 END AS im2 FROM e)
SELECT c_custkey, CASE WHEN im1 = 0 AND im2 = 0 THEN CASE WHEN re1 * re2 < 0 THEN 'saddle'
  WHEN re1 < 0 AND re2 < 0 THEN CASE WHEN re1 = re2 THEN 'stable node (star/degenerate)' ELSE 'stable node' END WHEN re1 > 0 AND re2 > 0 THEN 'unstable node' ELSE 'non-hyperbolic' END
  WHEN re1 < 0 THEN 'stable spiral/focus' WHEN re1 > 0 THEN 'unstable spiral/focus' ELSE 'center' END AS kind FROM f""")
def kinds_of_customers(spark, sf_dir):
    """The kind of fixed point that each customer's two eigenvalues make."""
    k = F.col("c_custkey")
    re1 = F.when(k % 3 == 0, 0.0).otherwise((k % 5 - 2) / 2.0)
    turns = k % 6 == 1
    other = (k % 4).cast("double") - 1.5 + (k % 2) / 2.0
    c = read(spark, sf_dir, "customer").select("c_custkey", re1.alias("re1"), F.when(turns, 1.0).otherwise(0.0).alias("im1"), F.when(turns, re1).otherwise(other).alias("re2"), F.when(turns, -1.0).otherwise(0.0).alias("im2"))
    return c.select("c_custkey", diagnostics.classify_fixed_point(*map(F.col, ("re1", "im1", "re2", "im2"))).alias("kind"))


@query(f"""SELECT l_orderkey, l_linenumber, i::INT AS i, j::INT AS j, {shown(5, value='CASE WHEN i = 1 AND j = 1 THEN 2 * x WHEN i = 1 THEN 1 WHEN j = 1 THEN y ELSE x END')}
FROM (SELECT l_orderkey, l_linenumber, l_quantity / 1e1 AS x, l_discount AS y FROM lineitem), (SELECT unnest([1, 2]) AS i), (SELECT unnest([1, 2]) AS j)""")
def jacobians_of_lineitems(spark, sf_dir):
    """Central differences of (x^2 + y, x y) at every line item."""
    p = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array(F.col("l_quantity") / 10.0, F.col("l_discount")).alias("x"))
    out = diagnostics.jacobians(p, lambda x: np.stack((x[:, 0] ** 2 + x[:, 1], x[:, 0] * x[:, 1]), 1), ["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", "i", "j", rounded("value", 5).alias("value"))


@query()
def kernel_all_pairs(spark, sf_dir):
    """One step ahead of every pair of events, by a kernel fit whose basis is all of them."""
    pairs = embedding.snapshot_pairs(embedding.delay_embed(one_series(spark, sf_dir), 2, 1, []), [], "s")
    found = kernel_cg.solve_kernel(pairs, 1.0, 0.1, landmarks=200, tol=1e-8)
    out = found.evaluate(pairs.select("t", "x"))
    return out.select("t", F.get("y", F.lit(0)).alias("y1"), F.get("y", F.lit(1)).alias("y2"))


#: Cells of a ring, more than a spectrum is dense for; an event turns by 16 cells a unit, and a few.
RING = 4096


@query(f"""WITH p AS (SELECT s, count(*) / (sum(count(*)) OVER ())::DOUBLE AS v FROM (SELECT ((16 * floor(value)::BIGINT + event_id % 3) % {RING} + {RING}) % {RING} AS s FROM events WHERE value IS NOT NULL AND event_id IS NOT NULL) GROUP BY s),
l AS (SELECT sum(v * cos(2 * pi() * ((w * s) % {RING}) / {RING})) AS re, sum(v * sin(2 * pi() * ((w * s) % {RING}) / {RING})) AS im FROM p, range({RING}) AS r(w) GROUP BY w),
o AS (SELECT *, row_number() OVER (ORDER BY round(sqrt(re * re + im * im), 9) DESC, round(re / sqrt(re * re + im * im), 9) DESC, im DESC) AS k FROM l)
SELECT k::INT AS k, {shown(6, re='re', im='im')} FROM o WHERE k <= 7""")
def ring_spectrum(spark, sf_dir):
    """Leading eigenvalues of the transfer operator on 4,096 cells of a ring that every event turns."""
    e = read(spark, sf_dir, "events").select((16 * F.floor("value") + F.col("event_id") % 3).alias("step"))
    operator = krylov.row_blocks(krylov.step_operator(e, RING), RING)
    found = operator.leading(7, krylov=60)
    operator.release()
    return spectrum_table(spark, found.values).select("k", rounded("re").alias("re"), rounded("im").alias("im"))
