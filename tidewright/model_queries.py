"""More registered queries: fits, predictions, simulations, spectra and figures against SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions import dynamics
from tidewright.functions.lifts import Hermite, Radial, cluster_centers, gradients, lift, padded
from tidewright.functions.vectors import matrix_table, spectrum_table
from tidewright.operators import contour, diagnostics, embedding, fit, predict, sampling, spectral, stats, thinning
from tidewright.plans import config as plans
from tidewright.plans import figures
from tidewright.queries import ONE_SERIES, SERIES, cramer, det3, entries, events, one_series, query, read, rounded
from tidewright.sources import simulate, training

# Numbers like 1e0 are DOUBLE in the SQL.


def shown(digits: int, **columns: str) -> str:
    """SQL of rounded columns under their names."""
    return ", ".join(f"round({e}, {digits}) + 0e0 AS {c}" for c, e in columns.items())


def cells(df: DataFrame, digits: int) -> DataFrame:
    return df.withColumn("value", rounded("value", digits))


# --- whole analyses of one series ---------------------------------------------------------

PAIRS = f"""{ONE_SERIES}, p AS (SELECT * FROM (SELECT t - 1 AS t, v AS x1, lag(v) OVER (ORDER BY t) AS x2, lead(v) OVER (ORDER BY t) AS y1, v AS y2 FROM e)
  WHERE x2 IS NOT NULL AND y1 IS NOT NULL)"""
NONE = f"""{PAIRS}, m AS (SELECT sum(x1 * x1) AS g11, sum(x1 * x2) AS g12, sum(x2 * x2) AS g22, sum(y1 * x1) AS a11, sum(y1 * x2) AS a12, sum(y2 * x1) AS a21, sum(y2 * x2) AS a22 FROM p),
k AS (SELECT (a11 * g22 - a12 * g12) / (g11 * g22 - g12 * g12) AS k11, (a12 * g11 - a11 * g12) / (g11 * g22 - g12 * g12) AS k12,
  (a21 * g22 - a22 * g12) / (g11 * g22 - g12 * g12) AS k21, (a22 * g11 - a21 * g12) / (g11 * g22 - g12 * g12) AS k22 FROM m)"""


def analysis(spark, sf_dir, kind, **options):
    settings = {"m_embed": 2, "tau_delay": 1, "r": 2, "dict_params": {}, "seed": 1} | options
    return plans.hankel_analysis(one_series(spark, sf_dir), plans.Config(dict_type=kind, **settings))


def shown_operator(spark, a: plans.Analysis) -> DataFrame:
    """The operator's table; what the fit has written is no longer needed."""
    a.release(spark)
    return a.operator_table(spark)


@query(f"""WITH {NONE} SELECT i::INT AS i, j::INT AS j, round(value, 5) + 0e0 AS value FROM (
  SELECT 1 AS i, 1 AS j, k11 AS value FROM k UNION ALL SELECT 1, 2, k12 FROM k UNION ALL SELECT 2, 1, k21 FROM k UNION ALL SELECT 2, 2, k22 FROM k)""")
def operator_none(spark, sf_dir):
    return cells(shown_operator(spark, analysis(spark, sf_dir, "none")), 5)


@query(f"""WITH {NONE}, d AS (SELECT (k11 + k22) / 2 AS h, ((k11 - k22) / 2) ** 2 + k12 * k21 AS q FROM k),
s AS (SELECT unnest([1, -1]) AS sign, h, q FROM d), c AS (SELECT h + CASE WHEN q > 0 THEN sign * sqrt(q) ELSE 0 END AS re, CASE WHEN q > 0 THEN 0 ELSE sign * sqrt(-q) END AS im FROM s)
SELECT row_number() OVER (ORDER BY round(sqrt(re * re + im * im), 9) DESC, re DESC, im DESC)::INT AS k, {shown(5, re='re', im='im')} FROM c""")
def spectrum_none(spark, sf_dir):
    a = analysis(spark, sf_dir, "none")
    out = a.spectrum_table(spark)
    a.release(spark)
    return out.select("k", rounded("re", 5).alias("re"), rounded("im", 5).alias("im"))


#: psi = [1, x2, x1]: of one degree, later variables come first.
LIFT = f"""{PAIRS}, l AS (SELECT t, 1e0 AS a1, x2 AS a2, x1 AS a3, 1e0 AS b1, y2 AS b2, y1 AS b3 FROM p)"""


def ridge_sql(table: str, n: int, alpha: str, right: str = "b", m: int | None = None) -> str:
    g = [f"sum(a{i} * a{j}){f' + {alpha}' if i == j else ''} AS g{i}{j}" for i in range(1, n + 1) for j in range(1, n + 1)]
    h = [f"sum(a{i} * {right}{j}) AS h{i}{j}" for i in range(1, n + 1) for j in range(1, (m or n) + 1)]
    return f"m AS (SELECT {', '.join(g + h)} FROM {table})"


DET = det3([[f"g{i}{j}" for j in (1, 2, 3)] for i in (1, 2, 3)])
HERMITE = f"""{LIFT}, {ridge_sql('l', 3, '1e-2')},
k AS (SELECT {', '.join(f"{e} / {DET} AS k{i + 1}{j}" for j in (1, 2, 3) for i, e in enumerate(cramer(str(j))))} FROM m)"""


def hermite_analysis(spark, sf_dir):
    return analysis(spark, sf_dir, "hermite", use_svd=False, r=None, dict_params={"max_deg": 1}, edmd_alpha=1e-2)


@query(f"WITH {HERMITE} " + " UNION ALL ".join(f"SELECT {i}::INT AS i, {j}::INT AS j, round(k{i}{j}, 5) + 0e0 AS value FROM k" for i in (1, 2, 3) for j in (1, 2, 3)))
def operator_hermite(spark, sf_dir):
    return cells(shown_operator(spark, hermite_analysis(spark, sf_dir)), 5)


STATES = "d AS (SELECT t - 1 AS t, v AS s1, lag(v) OVER (ORDER BY t) AS s2 FROM e)"


def rolled(steps: int) -> str:
    """r(start_idx, step, c, b, a): psi moved by K' from every start with ``steps`` rows after it."""
    move = [" + ".join(f"k{i}{j} * {x}" for i, x in ((1, "c"), (2, "b"), (3, "a"))) for j in (1, 2, 3)]
    return f"""{STATES}, r AS (SELECT t AS start_idx, 0 AS step, 1e0 AS c, s2 AS b, s1 AS a FROM d WHERE t BETWEEN 1 AND (SELECT max(t) FROM d) - {steps}
  UNION ALL SELECT start_idx, step + 1, {', '.join(move)} FROM r, k WHERE step < {steps})"""


@query(f"""WITH RECURSIVE {HERMITE}, {rolled(3)}
SELECT start_idx, step::INT AS step, 1::INT AS dim, {shown(5, x_true='s1', x_pred='a')} FROM r JOIN d ON d.t = start_idx + step""")
def prediction_hermite(spark, sf_dir):
    out = hermite_analysis(spark, sf_dir).predict(None, 3)
    return out.select("start_idx", "step", "dim", rounded("x_true", 5).alias("x_true"), rounded("x_pred", 5).alias("x_pred"))


# no terminating decimals: they would end in ties of rounding, which two engines break in two ways
K3 = np.array([[1.0, 1 / 97, 2 / 97], [0.0, 0.3 / 1.01, 0.6 / 1.01], [0.0, 0.5 / 1.01, 0.2 / 1.01]])
K3_SQL = "k AS (SELECT " + ", ".join(f"{float(K3[i, j])!r}::DOUBLE AS k{i + 1}{j + 1}" for i in range(3) for j in range(3)) + ")"


@query(f"""WITH RECURSIVE {ONE_SERIES}, {K3_SQL}, {rolled(4)}
SELECT start_idx, step::INT AS step, dim::INT AS dim, {shown(6, x_true='CASE dim WHEN 1 THEN s1 ELSE s2 END', x_pred='CASE dim WHEN 1 THEN a ELSE b END')}
FROM r JOIN d ON d.t = start_idx + step, (SELECT unnest([1, 2]) AS dim)""")
def states_from_psi(spark, sf_dir):
    s = embedding.delay_embed(one_series(spark, sf_dir), 2, 1, []).withColumnRenamed("s", "x")
    d = Hermite(2, 1)
    out = predict.predict_states_from_psi(lift(s, d), K3, d.projection(), None, 4)
    return out.select("start_idx", "step", "dim", rounded("x_true").alias("x_true"), rounded("x_pred").alias("x_pred"))


# --- forced and kernel fits ---------------------------------------------------------------


@query(f"""WITH {ONE_SERIES}, {STATES}, s AS (SELECT * FROM d WHERE t > 0), g AS (SELECT sum(s1 * s1) AS a, sum(s1 * s2) AS b, sum(s2 * s2) AS c FROM s),
w AS (SELECT *, (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b) AS l1, (a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b * b) AS l2 FROM g),
n AS (SELECT b / sqrt(b * b + (l1 - a) ** 2) AS p1, (l1 - a) / sqrt(b * b + (l1 - a) ** 2) AS p2, b / sqrt(b * b + (l2 - a) ** 2) AS q1, (l2 - a) / sqrt(b * b + (l2 - a) ** 2) AS q2 FROM w),
u AS (SELECT p1 * sign(CASE WHEN abs(p1) >= abs(p2) THEN p1 ELSE p2 END) AS p1, p2 * sign(CASE WHEN abs(p1) >= abs(p2) THEN p1 ELSE p2 END) AS p2,
  q1 * sign(CASE WHEN abs(q1) >= abs(q2) THEN q1 ELSE q2 END) AS q1, q2 * sign(CASE WHEN abs(q1) >= abs(q2) THEN q1 ELSE q2 END) AS q2 FROM n),
v AS (SELECT t, p1 * s1 + p2 * s2 AS v1, q1 * s1 + q2 * s2 AS v2 FROM s, u),
r AS (SELECT v1, v2, (-lead(v1, 2) OVER w + 8e0 * lead(v1) OVER w - 8e0 * lag(v1) OVER w + lag(v1, 2) OVER w) / 1.2e0 AS rate FROM v WINDOW w AS (ORDER BY t)),
m AS (SELECT sum(v1 * v1) AS g11, sum(v1 * v2) AS g12, sum(v2 * v2) AS g22, sum(rate * v1) AS h1, sum(rate * v2) AS h2 FROM r WHERE rate IS NOT NULL),
c AS (SELECT (h1 * g22 - h2 * g12) / (g11 * g22 - g12 * g12) AS a, (h2 * g11 - h1 * g12) / (g11 * g22 - g12 * g12) AS b FROM m)
SELECT i::INT AS i, j::INT AS j, round(value, 5) + 0e0 AS value FROM (SELECT 1 AS i, 1 AS j, exp(a * 0.1e0) AS value FROM c
  UNION ALL SELECT 1, 2, b * (exp(a * 0.1e0) - 1) / a FROM c UNION ALL SELECT 2, 1, 0e0 UNION ALL SELECT 2, 2, 1e0)""")
def operator_havok(spark, sf_dir):
    return cells(shown_operator(spark, analysis(spark, sf_dir, "havok", dt=0.1)), 5)


LANDMARKS = np.array([[0.2, 0.6], [0.9, 0.4]])


def kernel_sql(x: str, y: str, k: int) -> str:
    a, b = LANDMARKS[k]
    return f"exp(-(({x} - {a}::DOUBLE) ** 2 + ({y} - {b}::DOUBLE) ** 2) / (2 * 0.5e0 ** 2))"


KERNEL = f"""{PAIRS}, l AS (SELECT {', '.join(f"{kernel_sql('x1', 'x2', k)} AS a{k + 1}, {kernel_sql('y1', 'y2', k)} AS b{k + 1}" for k in (0, 1))}, x1 AS c1, x2 AS c2 FROM p),
m AS (SELECT {', '.join(f"sum(a{i} * a{j}) + {'1e-3' if i == j else '0e0'} AS g{i}{j}" for i in (1, 2) for j in (1, 2))}, {', '.join(f"sum(a{i} * {c}{j}) AS {c}{i}{j}" for c in 'bc' for i in (1, 2) for j in (1, 2))} FROM l)"""


@query(f"""WITH {KERNEL}, d AS (SELECT *, g11 * g22 - g12 * g21 AS det FROM m) """ + " UNION ALL ".join(
    f"SELECT '{block}' AS block, {a}::INT AS i, {b}::INT AS j, round(({'g22' if i == 1 else 'g11'} * {c}{i}{j} - {'g12' if i == 1 else 'g21'} * {c}{3 - i}{j}) / det, 4) + 0e0 AS value FROM d"
    for block, c in (("K", "b"), ("B", "c")) for i in (1, 2) for j in (1, 2) for a, b in [(i, j) if block == "K" else (j, i)]
))
def operator_kernel(spark, sf_dir):
    """Kernel features of two landmarks, fitted on all pairs: K and the way back, B."""
    pairs = embedding.snapshot_pairs(embedding.delay_embed(one_series(spark, sf_dir), 2, 1, []), [], "s")
    f = fit.fit_landmarks(pairs, 0.5, 2, 1e-3, landmarks=LANDMARKS)
    parts = [matrix_table(spark, m).withColumn("block", F.lit(b)) for b, m in (("K", f.k), ("B", f.b))]
    return cells(parts[0].unionByName(parts[1]), 4).select("block", "i", "j", "value")


def from_all(steps: int) -> str:
    """i(start_idx, s1, s2): every delay vector that has ``steps`` more after it."""
    return f"{ONE_SERIES}, {STATES}, i AS (SELECT t AS start_idx, s1, s2 FROM d WHERE t BETWEEN 1 AND (SELECT max(t) FROM d) - {steps})"


def observed(spark, sf_dir):
    return embedding.delay_embed(one_series(spark, sf_dir), 2, 1, [])


def observable(out: DataFrame) -> DataFrame:
    return out.select("start_idx", "step", "dim", rounded("x_true").alias("x_true"), rounded("x_pred").alias("x_pred"))


@query(f"""WITH RECURSIVE {from_all(20)}, {K3_SQL}, r AS (SELECT start_idx, 0 AS step, s1 AS a, s2 AS b FROM i
  UNION ALL SELECT start_idx, step + 1, k13 + k23 * b + k33 * a, k12 + k22 * b + k32 * a FROM r, k WHERE step < 20)
SELECT start_idx, step::INT AS step, 1::INT AS dim, {shown(6, x_true='s1', x_pred='a')} FROM r JOIN d ON d.t = start_idx + step""")
def delay_prediction(spark, sf_dir):
    """Every step lifts the delay vector again."""
    d = Hermite(2, 1)
    return observable(predict.predict_delay_edmd(observed(spark, sf_dir), K3, d.projection(), np.eye(2), d, None, 20))


KK, KB = np.array([[0.7, 0.2], [0.1, 0.9]]), np.array([[0.3, 0.8], [0.5, 0.4]])


@query(f"""WITH RECURSIVE {from_all(12)}, r AS (SELECT start_idx, 0 AS step, s1 AS a, s2 AS b FROM i UNION ALL SELECT start_idx, step + 1,
  0.3e0 * (0.7e0 * f + 0.1e0 * g) + 0.8e0 * (0.2e0 * f + 0.9e0 * g), 0.5e0 * (0.7e0 * f + 0.1e0 * g) + 0.4e0 * (0.2e0 * f + 0.9e0 * g)
  FROM (SELECT *, {kernel_sql('a', 'b', 0)} AS f, {kernel_sql('a', 'b', 1)} AS g FROM r) WHERE step < 12)
SELECT start_idx, step::INT AS step, 1::INT AS dim, {shown(6, x_true='s1', x_pred='a')} FROM r JOIN d ON d.t = start_idx + step""")
def kernel_prediction(spark, sf_dir):
    f = fit.KernelFit(KK, KB, LANDMARKS, np.eye(2), np.eye(2), 0.5)
    return observable(predict.predict_kernel(observed(spark, sf_dir), f, np.eye(2), None, 12))


@query(f"""WITH RECURSIVE {from_all(15)}, f AS (SELECT t, s2 AS f0, lead(s2) OVER (ORDER BY t) AS f1 FROM d WHERE t > 0),
r AS (SELECT start_idx, 0 AS step, s1 AS v FROM i UNION ALL SELECT start_idx, step + 1, v + 0.1e0 / 6 * (k1 + 2 * k2 + 2 * k3 + k4) FROM (
  SELECT *, -0.4e0 * (v + 0.1e0 * k3) + 0.3e0 * f1 AS k4 FROM (SELECT *, -0.4e0 * (v + 0.05e0 * k2) + 0.3e0 * (f0 + f1) / 2 AS k3 FROM (
  SELECT *, -0.4e0 * (v + 0.05e0 * k1) + 0.3e0 * (f0 + f1) / 2 AS k2 FROM (SELECT r.*, f0, f1, -0.4e0 * v + 0.3e0 * f0 AS k1 FROM r JOIN f ON f.t = start_idx + step WHERE step < 15)))))
SELECT start_idx, step::INT AS step, 1::INT AS dim, {shown(6, x_true='s1', x_pred='v')} FROM r JOIN d ON d.t = start_idx + step""")
def forced_prediction(spark, sf_dir):
    """v' = -0.4 v + 0.3 f along the true forcing, here the older of two delays."""
    return observable(predict.predict_forced(observed(spark, sf_dir), np.array([[-0.4]]), np.array([0.3]), np.eye(2), None, 15, 0.1))


# --- simulation ---------------------------------------------------------------------------


def rk4_sql(rhs: list[str], h: str, start: str, steps: int, extra: str = "") -> str:
    """r(traj_id, t, x0, ..) by Runge-Kutta from ``start`` (traj_id, x0, ..); ``rhs`` over {0}, {1}, .."""
    dim = len(rhs)
    at = lambda e: [f"({r.format(*e)})" for r in rhs]
    stage = lambda k, w: [f"(x{i} + {w} * {k}{i})" for i in range(dim)]
    cols = lambda k, e: ", ".join(f"{x} AS {k}{i}" for i, x in enumerate(at(e)))
    v = [f"x{i}" for i in range(dim)]
    step = (
        f"SELECT traj_id, t + 1, {', '.join(f'x{i} + {h} / 6 * (a{i} + 2 * b{i} + 2 * c{i} + d{i})' for i in range(dim))} FROM ("
        f"SELECT *, {cols('d', stage('c', h))} FROM (SELECT *, {cols('c', stage('b', h + ' / 2'))} FROM (SELECT *, {cols('b', stage('a', h + ' / 2'))} FROM ("
        f"SELECT *, {cols('a', v)} FROM r WHERE t <= {steps}))))"
    )
    return f"r(traj_id, t, {', '.join(v)}) AS (SELECT traj_id::BIGINT, 1::BIGINT, {', '.join(v)} FROM ({start}) UNION ALL {step})"


def box_sql(n: int, center: list[str], scale: float, seed: int) -> str:
    u = lambda i: f"((('0x' || substr(md5(id || ':{seed}:{i}'), 1, 12))::BIGINT::DOUBLE + 0.5e0) / 281474976710656e0)"
    return f"SELECT id AS traj_id, {', '.join(f'{c} + {scale}::DOUBLE * (2 * {u(i)} - 1) AS x{i}' for i, c in enumerate(center))} FROM (SELECT unnest(range(1, {n + 1})) AS id)"


FHN_NODE = ["{0} - {0} * {0} * {0} / 3e0 - {1} - 0.4e0", "0.08e0 * ({0} + 0.7e0 - 0.8e0 * {1})"]
DUFFING_NODE = ["{1}", "-0.3e0 * {1} - {0} + {0} * {0} * {0}"]
ROSSLER = ["-{1} - {2}", "{0} + 0.2e0 * {1}", "0.2e0 + {2} * ({0} - 5.7e0)"]


@query(f"WITH RECURSIVE {rk4_sql(FHN_NODE, '0.01e0', box_sql(12, ['0.5e0', '-0.25e0'], 0.5, 3), 60)} SELECT traj_id, t, {shown(6, x1='x0', x2='x1')} FROM r")
def ensemble(spark, sf_dir):
    out = simulate.generate_trajectories(spark, dynamics.parameters("fhn", "stable-node"), 12, 0.01, 60, center=[0.5, -0.25], scale=0.5, seed=3)
    return out.select("traj_id", "t", *entries(out, "x", 2, name="x"))


@query(f"""WITH RECURSIVE s AS ({box_sql(6, ['0e0', '0e0'], 2.0, 1)}), {rk4_sql(DUFFING_NODE, '0.02e0', 'SELECT * FROM s', 40)}
SELECT 'path' AS kind, traj_id, t, {shown(6, x1='x0', x2='x1')} FROM r WHERE (t - 1) % 4 = 0 UNION ALL SELECT 'start', traj_id, 1, {shown(6, x1='x0', x2='x1')} FROM s""")
def held_out_ensemble(spark, sf_dir):
    """Every fourth step of a test ensemble, numbered by step, and its starts."""
    paths, starts = simulate.generate_test_trajectories(spark, dynamics.parameters("duffing", "stable-node"), 6, 0.02, 10, every=4, window=2.0)
    a = paths.select(F.lit("path").alias("kind"), "traj_id", ((F.col("t") - 1) * 4 + 1).alias("t"), *entries(paths, "x", 2, name="x"))
    return a.unionByName(starts.select(F.lit("start").alias("kind"), "traj_id", F.lit(1).cast("long").alias("t"), *entries(starts, "x0", 2, name="x")))


@query(f"""WITH RECURSIVE {rk4_sql(DUFFING_NODE, '0.05e0', box_sql(30, ['0e0', '0e0'], 1.0, 0), 20)}
SELECT * FROM (SELECT traj_id, t, {shown(6, x1='x0', x2='x1')}, round(lead(x0) OVER w, 6) + 0e0 AS y1, round(lead(x1) OVER w, 6) + 0e0 AS y2 FROM r WINDOW w AS (PARTITION BY traj_id ORDER BY t)) WHERE y1 IS NOT NULL""")
def training_pairs(spark, sf_dir):
    out = training.edmd_training_data(spark, "duffing", "stable-node", 20, 30, 1.0, 0.05)
    return out.select("traj_id", "t", *entries(out, "x", 2, name="x"), *entries(out, "y", 2, name="y"))


@query(f"""WITH RECURSIVE {rk4_sql(ROSSLER, '0.01e0', 'SELECT 1 AS traj_id, 1e0 AS x0, 0.5e0 AS x1, 0.2e0 AS x2', 300)}
SELECT 1::BIGINT AS series_id, t - 12 AS t, {shown(6, v1='x1', v2='y2', v3='y3')} FROM (SELECT t, x1, lag(x1, 6) OVER (ORDER BY t) AS y2, lag(x1, 12) OVER (ORDER BY t) AS y3 FROM r) WHERE y3 IS NOT NULL""")
def training_delays(spark, sf_dir):
    _, s = training.hankel_training_data(spark, "rossler", "chaotic", 3, 6, 300, 0.01, x0=[1.0, 0.5, 0.2], observed_state=2)
    return s.select("series_id", "t", *entries(s, "s", 3))


@query(f"""WITH RECURSIVE {rk4_sql(['{0} - {0} * {0} * {0} / 3e0 - {1} + 0.5e0', '0.08e0 * ({0} + 0.7e0)'], '0.05e0', 'SELECT 1 AS traj_id, 0.1e0 AS x0, 0e0 AS x1', 1000)}
SELECT traj_id, t, {shown(6, x1='x0', x2='x1')} FROM r WHERE t >= 400""")
def limit_cycle(spark, sf_dir):
    out = simulate.detect_limit_cycle(spark, dynamics.parameters("fhn", "stable-limit-cycle"), 0.05, 400, 600, x0=[0.1, 0.0])
    return out.select("traj_id", "t", *entries(out, "x", 2, name="x"))


def mixed_sql(z: str) -> str:
    """The two rounds of the counter's hash, in whole numbers modulo 2^64."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = f"((xor({z}, {z} >> {shift})::UHUGEINT * {factor}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"
    return f"(xor({z}, {z} >> 31) >> 11)::DOUBLE / 9007199254740992e0"


def uniform_sql(c: int) -> str:
    key = f"(traj_id::UHUGEINT * {0x9E3779B97F4A7C15}::UHUGEINT + (t - 1)::UHUGEINT * {0xD1B54A32D192ED03}::UHUGEINT + 3::UHUGEINT + {(c + 1) * 0x8CB92BA72F3D8DD7}::UHUGEINT)"
    return f"({key} % 18446744073709551616::UHUGEINT)::UBIGINT"


@query(f"""WITH RECURSIVE r AS (SELECT id::BIGINT AS traj_id, 1::BIGINT AS t, id / 10e0 AS x0, -id / 20e0 AS x1 FROM (SELECT unnest(range(1, 9)) AS id)
UNION ALL SELECT traj_id, t + 1, x0 + (x0 - x0 * x0 * x0 / 3e0 - x1 - 0.4e0) * 0.01e0 + 0.05e0 * abs(x0) * sqrt(0.01e0) * sqrt(-2 * ln(1 - u0)) * cos(2 * pi() * u2),
  x1 + 0.08e0 * (x0 + 0.7e0 - 0.8e0 * x1) * 0.01e0 + 0.025e0 * abs(x0) * sqrt(0.01e0) * sqrt(-2 * ln(1 - u1)) * cos(2 * pi() * u3) FROM (
  SELECT *, {', '.join(f"{mixed_sql(f'z{c}')} AS u{c}" for c in range(4))} FROM (SELECT *, {', '.join(f'{uniform_sql(c)} AS z{c}' for c in range(4))} FROM r WHERE t <= 80)))
SELECT traj_id, t, {shown(6, x1='x0', x2='x1')} FROM r""")
def euler_maruyama(spark, sf_dir):
    """State-dependent noise in both coordinates, from counted random numbers."""
    p = dynamics.parameters("fhn", "stable-node", "state_dependent", 0.05, (1.0, 0.5))
    starts = spark.range(1, 9).select(F.col("id").alias("traj_id"), F.array(F.col("id") / 10.0, -F.col("id") / 20.0).alias("x0"))
    out = simulate.euler_maruyama(starts, p, 0.01, 80, seed=3)
    return out.select("traj_id", "t", *entries(out, "x", 2, name="x"))


# --- the Epileptor, regimes, fixed points -------------------------------------------------

# The paths of the regimes from A to B, and the speed c.
PATHS = """('c2s-SN-SH', 0, 0, -0.5, 0.24, 0.09, -0.34, 0.01), ('c3s-SN-supH', 0, 0, -0.5, 0.2636, 0.0909, -0.3182, 0.01), ('c10s-supH-SH', 0.0727, 0, -0.4273, 0.3273, 0, -0.2273, 0.01),
  ('c11s-supH-supH', 0.1091, 0, -0.3909, 0.3636, 0, -0.1909, 0.01), ('c2b-SN-SH', 0, 0, -0.5, 0.16, 0.1, -0.38, 0.02), ('c4b-SN-FLC', 0.1871, -0.0251, -0.3526, 0.3072, 0.0655, -0.2476, 0.02),
  ('c14b-subH-SH', 0.0873, -0.0524, -0.4413, 0.24, 0.03, -0.33, 0.02), ('c16b-subH-FLC', 0.1091, -0.03, -0.4182, 0.2727, 0.05, -0.3, 0.02)"""
PATH_TABLE = f"path AS (SELECT regime, a1::DOUBLE AS a1, a2::DOUBLE AS a2, a3::DOUBLE AS a3, b1::DOUBLE AS b1, b2::DOUBLE AS b2, b3::DOUBLE AS b3, c::DOUBLE AS c FROM (VALUES {PATHS}) v(regime, a1, a2, a3, b1, b2, b3, c))"


def epileptor_sql(points: str) -> str:
    """Drift parts at the rows (regime, x, y, z) of ``points``: out to the sphere of radius 0.4, then
    the largest root of the cubic."""
    return f"""{PATH_TABLE}, o AS (SELECT p.*, c, a1 + z * (b1 - a1) AS q1, a2 + z * (b2 - a2) AS q2, a3 + z * (b3 - a3) AS q3 FROM {points} p JOIN path USING (regime)),
s AS (SELECT *, 0.4e0 / sqrt(q1 * q1 + q2 * q2 + q3 * q3) AS f FROM o), n AS (SELECT *, q1 * f AS mu2, -q2 * f AS mu1, q3 * f AS nu FROM s),
d AS (SELECT *, mu1 * mu1 / 4 - mu2 * mu2 * mu2 / 27 AS disc FROM n),
xs AS (SELECT *, CASE WHEN disc > 0 THEN cbrt(mu1 / 2 + sqrt(disc)) + cbrt(mu1 / 2 - sqrt(disc)) WHEN mu2 <= 0 THEN 0e0
  ELSE 2 * sqrt(mu2 / 3) * cos(acos(greatest(-1e0, least(1e0, mu1 / (2 * sqrt(mu2 / 3) ** 3)))) / 3) END AS root FROM d)"""


@query(f"""WITH g AS (SELECT regime, x / 10e0 AS x, y / 10e0 AS y, z / 10e0 AS z FROM (SELECT unnest(range(-6, 7, 3)) AS x), (SELECT unnest(range(-4, 5, 2)) AS y), (SELECT unnest(range(0, 10, 3)) AS z),
  (SELECT unnest(['c2s-SN-SH', 'c3s-SN-supH', 'c10s-supH-SH', 'c11s-supH-supH', 'c2b-SN-SH', 'c4b-SN-FLC', 'c14b-subH-SH', 'c16b-subH-FLC']) AS regime)), {epileptor_sql('g')}
SELECT regime, round(x, 1) AS x, round(y, 1) AS y, round(z, 1) AS z, {shown(6, f1='-y', f2='x * x * x - mu2 * x - mu1 - y * (nu + x + x * x)', f3='-c * (sqrt((x - root) ** 2 + y * y) - 0.3e0)', g1='0.2e0 * abs(x - root)', g2='0e0', g3='0e0')} FROM xs""")
def epileptor_field(spark, sf_dir):
    """Drift and state-dependent noise of all eight Epileptor regimes on a grid of states."""
    axis = lambda c, a, b, s: spark.range(a, b, s).select((F.col("id") / 10.0).alias(c))
    g = axis("x", -6, 7, 3).crossJoin(axis("y", -4, 5, 2)).crossJoin(axis("z", 0, 10, 3))
    out = None
    for r in dynamics.list_regimes("epileptor3d"):
        p = dynamics.parameters("epileptor3d", r, "state_dependent", 0.2)
        at = g.select(F.lit(r).alias("regime"), "x", "y", "z", F.array("x", "y", "z").alias("s"))
        one = simulate.evaluated(at, p, ["regime", "x", "y", "z"], "s")
        out = one if out is None else out.unionByName(one)
    return out.select("regime", *[F.round(c, 1).alias(c) for c in "xyz"], *entries(out, "f", 3, name="f"), *entries(out, "g", 3, name="g"))


@query(f"""WITH g AS (SELECT regime, 0e0 AS x, 0e0 AS y, 0e0 AS z FROM (VALUES {PATHS}) v(regime, a, b, c, d, e, f, g)), {epileptor_sql('g')},
h AS (SELECT unnest(['stable-node', 'three-equilibrium-regime']) AS regime, unnest([-0.4e0, 0.32e0]) AS i),
w AS (SELECT regime, 3 * (1 / 0.8e0 - 1) AS p, 3 * (0.7e0 / 0.8e0 - i) AS q FROM h),
v AS (SELECT *, q * q / 4 + p * p * p / 27 AS disc FROM w)
SELECT 'epileptor3d' AS system, regime, 1::INT AS k, dim::INT AS dim, round(CASE dim WHEN 0 THEN root ELSE 0 END, 5) + 0e0 AS value FROM xs, (SELECT unnest([0, 1, 2]) AS dim)
UNION ALL SELECT 'fhn', regime, 1, dim, round(CASE dim WHEN 0 THEN r ELSE (r + 0.7e0) / 0.8e0 END, 5) + 0e0 FROM (SELECT regime, cbrt(-q / 2 + sqrt(disc)) + cbrt(-q / 2 - sqrt(disc)) AS r FROM v WHERE disc > 0), (SELECT unnest([0, 1]) AS dim)""")
def fixed_points_cubic(spark, sf_dir):
    """Fixed points by a cubic: FHN with b > 0, and the Epileptor's fast state."""
    t = dynamics.fixed_points_table(spark).where("system = 'epileptor3d' OR (system = 'fhn' AND regime <> 'stable-limit-cycle')")
    return cells(t.select("system", "regime", "k", F.posexplode("x").alias("dim", "value")), 5)


# Shown names and folders of the regimes.
CATALOGUE = """('fhn', 'stable-limit-cycle', 'FHN — stable limit cycle', 'limit-cycle-regime', './Results/FHN-limit-cycle-regime'), ('fhn', 'stable-node', 'FHN — stable node', 'stable-node-regime', './Results/FHN-stable-node-regime'),
  ('fhn', 'three-equilibrium-regime', 'FHN — three-equilibrium regime', 'three-equilibrium-regime', './Results/FHN-three-equilibrium-regime'),
  ('duffing', 'stable-node', 'Duffing — stable node', 'stable-node-regime', './Results/Duffing-stable-node-regime'),
  ('duffing', 'three-equilibrium-attractors', 'Duffing — three attractors', 'three-equilibrium-attractors-regime', './Results/Duffing-three-equilibrium-attractors-regime'),
  ('duffing', 'three-equilibrium-centers', 'Duffing — three centers', 'three-equilibrium-centers-regime', './Results/Duffing-three-equilibrium-centers-regime'),
  ('lorenz', 'chaotic', 'Lorenz — chaotic', 'chaotic-regime', './Results/Lorenz-chaotic-regime'), ('vanderpol', 'stable-focus', 'Van der Pol (3rd order) — stable focus', 'stable-focus-regime', './Results/VanderPol-stable-focus-regime'),
  ('vanderpol', 'stable-limit-cycle', 'Van der Pol (3rd order) — stable limit cycle', 'limit-cycle-regime', './Results/VanderPol-limit-cycle-regime'),
  ('vanderpol', 'chaotic', 'Van der Pol (3rd order) — chaotic', 'chaotic-regime', './Results/VanderPol-chaotic-regime'),
  ('rossler', 'stable-limit-cycle', 'Rössler — stable limit cycle', 'limit-cycle-regime', './Results/Rossler-limit-cycle-regime'), ('rossler', 'chaotic', 'Rössler — chaotic attractor', 'chaotic-regime', './Results/Rossler-chaotic-regime')"""


@query(f"""SELECT system, regime, regime_name, suffix, save_dir FROM (VALUES {CATALOGUE}) v(system, regime, regime_name, suffix, save_dir)
UNION ALL SELECT 'epileptor3d', regime, 'Epileptor 3D — ' || regime, regime, './Results/Epileptor3D-' || regime FROM (VALUES {PATHS}) v(regime, a, b, c, d, e, f, g)""")
def regime_names(spark, sf_dir):
    return dynamics.regimes_table(spark).drop("params")


@query(f"""WITH {PATH_TABLE} SELECT 'epileptor3d' AS system, regime, name, value FROM (UNPIVOT (SELECT regime, a1 AS "A1", a2 AS "A2", a3 AS "A3", b1 AS "B1", b2 AS "B2", b3 AS "B3", c, 0.4e0 AS "R", 0.3e0 AS dstar, 1e0 AS tau0 FROM path)
  ON COLUMNS(* EXCLUDE regime) INTO NAME name VALUE value)
UNION ALL SELECT system, regime, name, value::DOUBLE FROM (VALUES ('fhn', 'stable-limit-cycle', 'a', 0.7), ('fhn', 'stable-limit-cycle', 'b', 0), ('fhn', 'stable-limit-cycle', 'eps', 0.08), ('fhn', 'stable-limit-cycle', 'I', 0.5),
  ('fhn', 'stable-node', 'a', 0.7), ('fhn', 'stable-node', 'b', 0.8), ('fhn', 'stable-node', 'eps', 0.08), ('fhn', 'stable-node', 'I', -0.4),
  ('fhn', 'three-equilibrium-regime', 'a', 0.7), ('fhn', 'three-equilibrium-regime', 'b', 0.8), ('fhn', 'three-equilibrium-regime', 'eps', 0.08), ('fhn', 'three-equilibrium-regime', 'I', 0.32),
  ('duffing', 'stable-node', 'delta', 0.3), ('duffing', 'stable-node', 'beta', 1), ('duffing', 'stable-node', 'alpha', -1), ('duffing', 'three-equilibrium-attractors', 'delta', 0.2), ('duffing', 'three-equilibrium-attractors', 'beta', -1),
  ('duffing', 'three-equilibrium-attractors', 'alpha', 1), ('duffing', 'three-equilibrium-centers', 'delta', 0), ('duffing', 'three-equilibrium-centers', 'beta', -1), ('duffing', 'three-equilibrium-centers', 'alpha', 1),
  ('lorenz', 'chaotic', 'sigma', 10), ('lorenz', 'chaotic', 'rho', 28), ('vanderpol', 'stable-focus', 'mu', -2), ('vanderpol', 'stable-limit-cycle', 'mu', 0.3), ('vanderpol', 'chaotic', 'mu', 0.58),
  ('rossler', 'stable-limit-cycle', 'a', 0.2), ('rossler', 'stable-limit-cycle', 'b', 0.2), ('rossler', 'stable-limit-cycle', 'c', 2.5), ('rossler', 'chaotic', 'a', 0.2), ('rossler', 'chaotic', 'b', 0.2), ('rossler', 'chaotic', 'c', 5.7)) v(system, regime, name, value)
UNION ALL SELECT 'lorenz', 'chaotic', 'beta', 8e0 / 3e0""")
def regime_values(spark, sf_dir):
    return dynamics.regimes_table(spark).select("system", "regime", F.explode("params").alias("name", "value"))


# --- statistics and dictionaries ----------------------------------------------------------


@query(f"""WITH {SERIES} SELECT event_type, t, {shown(6, v1='(value - 2.5e0) / 40e0', v2='(user_id - 10e0) / 7e0')} FROM s""")
def normalised(spark, sf_dir):
    e = events(spark, sf_dir).select("event_type", "t", F.array("value", "user_id").alias("x"))
    out = stats.apply_norm_stats(e, [(2.5, 40.0), (10.0, 7.0)])
    return out.select("event_type", "t", *entries(out, "x", 2))


SPECTRA = {"flat": [8.0, 7.9, 1.0, 0.1], "steep": [50.0, 20.0, 8.0, 3.0, 1.2, 0.5, 0.2], "pair": [9.0, 8.5, 0.3, 0.29, 0.01]}


@query("""WITH s AS (SELECT name, unnest(v)::DOUBLE AS sigma, unnest(range(1, len(v) + 1)) AS k FROM (VALUES ('flat', [8.0, 7.9, 1.0, 0.1]), ('steep', [50.0, 20.0, 8.0, 3.0, 1.2, 0.5, 0.2]), ('pair', [9.0, 8.5, 0.3, 0.29, 0.01])) t(name, v)),
a AS (SELECT unnest([1e0, 0.5e0, 0.1e0]) AS aspect), o AS (SELECT aspect, 0.56e0 * aspect ** 3 - 0.95e0 * aspect ** 2 + 1.82e0 * aspect + 1.43e0 AS omega FROM a),
d AS (SELECT name, k, ln(lead(sigma) OVER (PARTITION BY name ORDER BY k)) - ln(sigma) AS drop FROM s), m AS (SELECT name, median(sigma) AS med FROM s GROUP BY name)
SELECT name, 'hard_threshold' AS method, aspect, greatest(2, count(*) FILTER (sigma > omega * med))::INT AS rank FROM s JOIN m USING (name), o GROUP BY name, aspect
UNION ALL SELECT name, 'gap', 1e0, greatest(2, arg_max(k, drop))::INT FROM d WHERE drop IS NOT NULL GROUP BY name
UNION ALL SELECT name, 'largest_gap', 1e0, greatest(2, arg_min(k, drop))::INT FROM d WHERE drop IS NOT NULL GROUP BY name""")
def rank_methods(spark, sf_dir):
    rows = [(n, "hard_threshold", a, stats.select_rank(v, "hard_threshold", aspect=a)) for n, v in SPECTRA.items() for a in (1.0, 0.5, 0.1)]
    rows += [(n, m, 1.0, stats.select_rank(v, m)) for n, v in SPECTRA.items() for m in ("gap", "largest_gap")]
    return spark.createDataFrame(rows, "name string, method string, aspect double, rank int")


@query("""SELECT n::INT AS n, d::INT AS degree, round(exp(lgamma(n + d + 1) - lgamma(n + 1) - lgamma(d + 1)))::INT AS size
FROM (SELECT unnest(range(1, 6)) AS n), (SELECT unnest(range(0, 6)) AS d)""")
def dictionary_sizes(spark, sf_dir):
    return spark.createDataFrame([(n, d, stats.dictionary_size(n, d)) for n in range(1, 6) for d in range(6)], "n int, degree int, size int")


@query("""WITH x AS (SELECT a, b, c, row_number() OVER (ORDER BY a + b + c, a, b, c) AS j FROM (SELECT unnest(range(0, 3)) AS a), (SELECT unnest(range(0, 3)) AS b), (SELECT unnest(range(0, 3)) AS c) WHERE a + b + c <= 2)
SELECT kind, i::INT AS i, j::INT AS j, CASE WHEN a + b + c = 1 AND [a, b, c][i] = 1 THEN w ELSE 0e0 END AS value
FROM x, (SELECT unnest([1, 2, 3]) AS i), (SELECT unnest(['probabilist', 'physicist']) AS kind, unnest([1e0, 0.5e0]) AS w)""")
def hermite_projection(spark, sf_dir):
    parts = [matrix_table(spark, Hermite(3, 2, k).projection()).select(F.lit(k).alias("kind"), "i", "j", "value") for k in ("probabilist", "physicist")]
    return parts[0].unionByName(parts[1])


@query(f"""SELECT l_orderkey, l_linenumber, {shown(6, v1='1e0', v2='l_tax', v3='0.5e0', v4='l_discount', v5='l_tax * l_tax - 1', v6='0.5e0 * l_tax', v7='0.5e0 * 0.5e0 - 1', v8='l_discount * l_tax', v9='l_discount * 0.5e0', v10='l_discount * l_discount - 1')} FROM lineitem""")
def slice_lift(spark, sf_dir):
    """A polynomial of three coordinates on the slice where the second one is 0.5."""
    x = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array("l_discount", "l_tax").alias("v"))
    out = lift(x.withColumn("x", padded(F.col("v"), 3, [0, 2], {1: 0.5})), Hermite(3, 2))
    return out.select("l_orderkey", "l_linenumber", *entries(out, "psi", 10))


CENTRES = ((0.0, 0.0), (1.5, -0.5), (-1.0, 2.0))
POINTS = "p AS (SELECT s_suppkey AS id, s_acctbal / 2911e0 AS x, s_nationkey / 9.7e0 - 1 AS y FROM supplier)"


def suppliers(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), F.array(F.col("s_acctbal") / 2911.0, F.col("s_nationkey") / 9.7 - 1).alias("x"))


def gradient_sql(kernel: str) -> str:
    out = []
    for k, (a, b) in enumerate(CENTRES):
        r = f"sqrt((x - {a}::DOUBLE) ** 2 + (y - {b}::DOUBLE) ** 2)"
        factor = f"-1 * exp(-1 * ({r} ** 2) / (2 * (0.7e0 ** 2))) / (0.7e0 ** 2)" if kernel == "gaussian" else f"CASE WHEN {r} < 1e-10 THEN 0 ELSE (2 * ln({r} + 1e-12) + 1) * ({r} + 1e-12) / {r} END"
        out += [f"SELECT id, '{kernel}' AS kernel, {i}::INT AS i, {k + 4}::INT AS j, round(({factor}) * ({c} - {v}::DOUBLE), 5) + 0e0 AS value FROM p" for i, c, v in ((1, "x", a), (2, "y", b))]
    out += [f"SELECT id, '{kernel}', {i}, {j}, {'1e0' if j == i + 1 else '0e0'} FROM p" for i in (1, 2) for j in (1, 2, 3)]
    return " UNION ALL ".join(out)


@query(f"WITH {POINTS} {gradient_sql('thinplate')} UNION ALL {gradient_sql('gaussian')}")
def rbf_gradients(spark, sf_dir):
    """The Jacobian of [1, x, phi] at every supplier's point, for both kernels."""
    s = suppliers(spark, sf_dir)
    parts = [cells(gradients(s, d, ["id"]), 5).withColumn("kernel", F.lit(d.kernel)) for d in (Radial(CENTRES), Radial(CENTRES, "gaussian", 0.7))]
    return parts[0].unionByName(parts[1])


XI = np.array([[0.2 + 1j], [0.5 - 0.3j], [-1.0 + 0.1j], [0.25], [0.4 + 2j], [-0.6]])


@query(f"WITH {POINTS} SELECT id, 1::INT AS i, round(-1e0 + 0.4e0 * y + -0.6e0 * 2 * x, 5) + 0e0 AS value FROM p UNION ALL SELECT id, 2::INT, round(0.5e0 + 0.25e0 * 2 * y + 0.4e0 * x, 5) + 0e0 FROM p")
def mode_gradients(spark, sf_dir):
    """Gradient of a mode's real part in a polynomial dictionary at every supplier's point."""
    return cells(gradients(suppliers(spark, sf_dir), Hermite(2, 2), ["id"], xi=XI[:, 0]), 5)


@query("""WITH p AS (SELECT unnest([2e0, -1e0, 0.5e0]) AS x, unnest([3e0, 0e0, -2e0]) AS y)
SELECT x, y, i::INT AS i, j::INT AS j, round(CASE WHEN i = 1 AND j = 1 THEN 2 * x WHEN i = 1 THEN 1 WHEN j = 1 THEN y ELSE x END, 4) + 0e0 AS value FROM p, (SELECT unnest([1, 2]) AS i), (SELECT unnest([1, 2]) AS j)""")
def jacobians(spark, sf_dir):
    rows = []
    for x, y in ((2.0, 3.0), (-1.0, 0.0), (0.5, -2.0)):
        m = diagnostics.jacobian(lambda v: [v[0] ** 2 + v[1], v[0] * v[1]], [x, y])
        rows += [(x, y, i + 1, j + 1, float(m[i, j])) for i in (0, 1) for j in (0, 1)]
    return cells(spark.createDataFrame(rows, "x double, y double, i int, j int, value double"), 4)


@query("SELECT i::INT AS i, j::INT AS j, j * 0.5e0 AS x, i * i * 1e0 AS y FROM (SELECT unnest(range(1, 41)) AS j), (SELECT unnest(range(1, 31)) AS i)")
def meshgrid(spark, sf_dir):
    return diagnostics.meshgrid(spark, [0.5 * j for j in range(1, 41)], [float(i * i) for i in range(1, 31)])


# --- clusters and zero levels -------------------------------------------------------------


@query(f"""WITH {POINTS}, c AS (SELECT x + 100 * (id % 3) AS x, y - 50 * (id % 3) AS y, id % 3 AS g FROM p)
SELECT (row_number() OVER (ORDER BY avg(x)))::INT AS k, {shown(5, c1='avg(x)', c2='avg(y)')} FROM c GROUP BY g""")
def cluster_means(spark, sf_dir):
    """Three far groups of the suppliers' points: the centres are the groups' means."""
    s = suppliers(spark, sf_dir)
    g = F.col("id") % 3
    moved = s.select("id", F.array(F.get("x", F.lit(0)) + 100 * g, F.get("x", F.lit(1)) - 50 * g).alias("x"))
    centres = sorted(cluster_centers(moved, 3, key="id"))
    out = spark.createDataFrame([(k + 1, *c) for k, c in enumerate(centres)], "k int, c1 double, c2 double")
    return out.select("k", rounded("c1", 5).alias("c1"), rounded("c2", 5).alias("c2"))


@query(f"""WITH RECURSIVE {POINTS}, o AS (SELECT id, y, row_number() OVER (ORDER BY id) AS n FROM p),
r AS (SELECT 1::BIGINT AS n, [(SELECT y FROM o WHERE n = 1)] AS kept, [(SELECT id FROM o WHERE n = 1)] AS ids
  UNION ALL SELECT o.n, CASE WHEN len(list_filter(kept, lambda k: abs(k - y) < 0.05e0)) = 0 THEN list_append(kept, y) ELSE kept END,
  CASE WHEN len(list_filter(kept, lambda k: abs(k - y) < 0.05e0)) = 0 THEN list_append(ids, id) ELSE ids END FROM r JOIN o ON o.n = r.n + 1),
l AS (SELECT kept, ids FROM r ORDER BY n DESC LIMIT 1)
SELECT unnest(ids) AS start, 0.25e0 AS x1, round(unnest(kept), 3) + 0e0 AS x2, true AS converged FROM l""")
def zero_line(spark, sf_dir):
    """Where the mode x1 - 0.25 vanishes, from every supplier's point: straight down to the line,
    and of ends within 0.05 the first start's."""
    xi = np.array([[-0.25], [0.0], [1.0]], complex)
    s = suppliers(spark, sf_dir)
    out = diagnostics.zero_level_points(s, Hermite(2, 1), xi, [1], None, 200, key="id")
    return out.select("start", F.round(F.get("x", F.lit(0)), 3).alias("x1"), rounded(F.get("x", F.lit(1)), 3).alias("x2"), "converged")


@query(f"WITH {LIFT}, {ridge_sql('l', 3, '0e0')} " + " UNION ALL ".join(f"SELECT {i + 1}::INT AS i, {j}::INT AS j, round({e} / {DET}, 5) + 0e0 AS value FROM m" for j in (1, 2, 3) for i, e in enumerate(cramer(str(j)))))
def operator_states(spark, sf_dir):
    """A fit on snapshot pairs without embedding, by least squares."""
    s = embedding.delay_embed(one_series(spark, sf_dir), 2, 1, [])
    c = plans.Config(dict_type="hermite", dict_params={"max_deg": 1}, edmd_method="pinv")
    return cells(plans.state_analysis(embedding.snapshot_pairs(s, [], "s"), c).operator_table(spark), 5)


# --- spectra ------------------------------------------------------------------------------

ANGLES = [0.85, 1.5, 0.95, 0.2, 1.8]
TURNS = [complex(np.cos(s * a), np.sin(s * a)) for a in ANGLES for s in (1, -1)]
TURNS_SQL = """m AS (SELECT (row_number() OVER ())::INT AS k, cos(g * a) AS re, sin(g * a) AS im, g * a AS angle FROM (SELECT unnest([0.85e0, 0.85e0, 1.5e0, 1.5e0, 0.95e0, 0.95e0, 0.2e0, 0.2e0, 1.8e0, 1.8e0]) AS a, unnest([1, -1, 1, -1, 1, -1, 1, -1, 1, -1]) AS g))"""


def families_sql(steps: int) -> str:
    """The families one after another: ``near`` has each mode's members under the growing tolerance,
    ``flat`` under the same one, which the first family has."""
    near = lambda name, growth: f"""{name} AS (SELECT base, k FROM (SELECT b.k AS base, h, g, arg_min(m.k, sqrt((m.re - cos(h * g * b.angle)) ** 2 + (m.im - sin(h * g * b.angle)) ** 2)) AS k,
  min(sqrt((m.re - cos(h * g * b.angle)) ** 2 + (m.im - sin(h * g * b.angle)) ** 2)) AS d FROM m b, m, (SELECT unnest([2, 3, 4, 5]) AS h), (SELECT unnest([1, -1]) AS g) GROUP BY ALL) WHERE d < 0.05e0 * {growth}::DOUBLE ** (h - 1)
  UNION SELECT k, k FROM m UNION SELECT b.k, min(m.k) FROM m b, m WHERE sqrt((m.re - b.re) ** 2 + (m.im + b.im) ** 2) < 0.05e0 GROUP BY b.k)"""
    out = [near("near", 1.5), near("flat", 1.0), "f1 AS (SELECT 1 AS branch, k FROM flat WHERE base = (SELECT arg_min(k, im) FROM m WHERE im > 1e-4))"]
    for n in range(2, steps + 1):
        taken = " UNION ALL ".join(f"SELECT k FROM f{i}" for i in range(1, n))
        out.append(f"f{n} AS (SELECT {n} AS branch, k FROM near WHERE base = (SELECT arg_min(k, im) FROM m WHERE im > 1e-6 AND k NOT IN ({taken})))")
    return ", ".join(out)


@query(f"WITH {TURNS_SQL}, {families_sql(5)} " + " UNION ALL ".join(f"SELECT branch::INT AS branch, k::INT AS eig_index FROM f{n}" for n in range(1, 6)))
def harmonic_families(spark, sf_dir):
    """All families of ten modes on the circle, some in two of them."""
    return figures.harmonic_table(spark, TURNS, 0.1)


@query("""WITH m AS (SELECT unnest([1, 2, 3, 4, 5]) AS k, unnest([1e0, cos(0.5e0), cos(0.5e0), 0.95e0, 0.5e0]) AS re, unnest([0e0, sin(0.5e0), -sin(0.5e0), 0e0, 0e0]) AS im),
p AS (SELECT * FROM m WHERE im > 1e-4 AND abs(sqrt(re * re + im * im) - 1) < 1e-3 ORDER BY im LIMIT 1), a AS (SELECT m.* FROM m WHERE im = 0 AND abs(re - 1) > 1e-3 ORDER BY re DESC LIMIT 1)
SELECT p.k::INT AS phase, round(ln(sqrt(p.re ** 2 + p.im ** 2)) / 0.1e0, 6) + 0e0 AS phase_re, round(atan2(p.im, p.re) / 0.1e0, 6) AS phase_im, a.k::INT AS amplitude, round(ln(a.re) / 0.1e0, 6) AS amplitude_re FROM p, a""")
def phase_amplitude(spark, sf_dir):
    v = [1, complex(np.cos(0.5), np.sin(0.5)), complex(np.cos(0.5), -np.sin(0.5)), 0.95, 0.5]
    j, mu, r, nu, _ = spectral.phase_amplitude_modes(v, 0.1)
    row = (j + 1, float(mu.real), float(mu.imag), r + 1, float(nu.real))
    out = spark.createDataFrame([row], "phase int, phase_re double, phase_im double, amplitude int, amplitude_re double")
    return out.select("phase", rounded("phase_re").alias("phase_re"), rounded("phase_im").alias("phase_im"), "amplitude", rounded("amplitude_re").alias("amplitude_re"))


@query("""WITH m AS (SELECT unnest(range(1, 61)) AS n), v AS (SELECT n, ((n * 37) % 101) / 101e0 AS r, ((n * 53) % 97) / 10e0 AS a FROM m)
SELECT (row_number() OVER (ORDER BY r DESC))::INT AS k, round(r * cos(a), 6) + 0e0 AS re, round(r * sin(a), 6) + 0e0 AS im FROM v QUALIFY k <= 40""")
def leading_modes(spark, sf_dir):
    """The 40 largest of 60 modes in order of magnitude."""
    v = np.array([((n * 37) % 101) / 101 * np.exp(1j * (((n * 53) % 97) / 10)) for n in range(1, 61)])
    values, _ = spectral.ordered(v, np.eye(60, dtype=complex))
    return spectrum_table(spark, values[:40]).select("k", rounded("re").alias("re"), rounded("im").alias("im"))


@query(f"""WITH g AS (SELECT a / 4e0 AS g1, b / 4e0 AS g2 FROM (SELECT unnest(range(-4, 5)) AS a), (SELECT unnest(range(-4, 5)) AS b))
SELECT g1, g2, 1::INT AS mode, {shown(6, re='0.5e0 + 0.25e0 * g2 + 0.3e0 + 1e0 * g1', im='0.5e0 * g2 - 0.6e0 + 0.2e0 * g1')} FROM g""")
def eigenfunction_slice(spark, sf_dir):
    """A mode of three coordinates where the second one is 0.6: psi = [1, x3, x2, x1]."""
    xi = np.array([[0.5], [0.25 - 0.5j], [0.5 + 1j], [1.0 - 0.2j]])
    axis = [k / 4 for k in range(-4, 5)]
    out = spectral.eigenfunction_slice(spark, xi, Hermite(3, 1), [axis, axis], [1, 3], [0.6])
    return out.select("g1", "g2", "mode", rounded("re").alias("re"), rounded("im").alias("im"))


# --- figures ------------------------------------------------------------------------------

PATH = "l AS (SELECT l_linenumber AS traj_id, l_orderkey AS t, l_quantity AS x, l_extendedprice / 1000e0 AS y, l_discount * 100 AS z FROM lineitem)"


def curves(spark, sf_dir):
    x = F.array("l_quantity", F.col("l_extendedprice") / 1000.0, F.col("l_discount") * 100)
    return read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("traj_id"), F.col("l_orderkey").alias("t"), x.alias("x"))


def drawn(df: DataFrame, n: int) -> DataFrame:
    return df.select("traj_id", "t", *[rounded(f"d{i + 1}").alias(f"d{i + 1}") for i in range(n)])


@query(f"""WITH {PATH} SELECT 'curve' AS kind, traj_id, t, {shown(6, d1='x', d2='y')} FROM l
UNION ALL SELECT 'limit', 0, dim, round(min(v) - 0.1e0 * (max(v) - min(v)), 6) + 0e0, round(max(v) + 0.1e0 * (max(v) - min(v)), 6) + 0e0
FROM (SELECT 0 AS dim, x AS v FROM l WHERE traj_id = (SELECT min(traj_id) FROM l) UNION ALL SELECT 1, y FROM l WHERE traj_id = (SELECT min(traj_id) FROM l)) GROUP BY dim""")
def figure_portrait(spark, sf_dir):
    c, limits = figures.phase_portrait(curves(spark, sf_dir))
    rows = limits.select(F.lit("limit").alias("kind"), F.lit(0).alias("traj_id"), F.col("dim").cast("long").alias("t"), rounded("low").alias("d1"), rounded("high").alias("d2"))
    return drawn(c, 2).select(F.lit("curve").alias("kind"), F.col("traj_id").cast("int").alias("traj_id"), "t", "d1", "d2").unionByName(rows)


@query(f"""WITH {PATH} SELECT 'xyz' AS view, traj_id, t, {shown(6, d1='x', d2='y', d3='z')} FROM l UNION ALL SELECT 'xz', traj_id, t, round(x, 6) + 0e0, round(z, 6) + 0e0, 0e0 FROM l
UNION ALL SELECT 'yz', traj_id, t, round(y, 6) + 0e0, round(z, 6) + 0e0, 0e0 FROM l UNION ALL SELECT 'xy', traj_id, t, round(x, 6) + 0e0, round(y, 6) + 0e0, 0e0 FROM l""")
def figure_views(spark, sf_dir):
    out = None
    for name, view in figures.all_views(curves(spark, sf_dir)).items():
        n = 3 if name == "xyz" else 2
        one = drawn(view, n).withColumn("view", F.lit(name))
        one = one if n == 3 else one.withColumn("d3", F.lit(0.0))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {PATH} SELECT 'point' AS kind, {shown(6, d1='x', d2='z')} FROM l UNION ALL SELECT 'center', d1, d2 FROM (VALUES (1e0, 3e0), (20e0, 6e0)) v(d1, d2)""")
def figure_clusters(spark, sf_dir):
    """The training scatter with two centres."""
    out = figures.clustered(spark, curves(spark, sf_dir), [(1.0, 2.0, 3.0), (20.0, 5.0, 6.0)], (1, 3))
    return out.select("kind", rounded("d1").alias("d1"), rounded("d2").alias("d2"))


@query(f"WITH {PATH} SELECT traj_id, t, round((t - 1) * 0.25e0, 6) AS time, {shown(6, d1='x', d2='y', d3='z')} FROM l")
def figure_time_series(spark, sf_dir):
    out = figures.time_series(curves(spark, sf_dir), 0.25)
    return out.select("traj_id", "t", F.round("time", 6).alias("time"), *entries(out, "x", 3, name="d"))


@query(f"""WITH {TURNS_SQL} SELECT 'mode' AS kind, k, {shown(6, re='re', im='im')}, k IN (1, 2) AS highlighted FROM m
UNION ALL SELECT 'circle', 0, round(cos(2 * pi() * i / 200), 6) + 0e0, round(sin(2 * pi() * i / 200), 6) + 0e0, false FROM (SELECT unnest(range(0, 201)) AS i)
UNION ALL SELECT 'limit', 0, round(min(re) - 0.1e0 * (max(re) - min(re)), 6), round(max(re) + 0.1e0 * (max(re) - min(re)), 6), false FROM m
UNION ALL SELECT 'limit', 1, round(min(im) - 0.1e0 * (max(im) - min(im)), 6), round(max(im) + 0.1e0 * (max(im) - min(im)), 6), false FROM m""")
def figure_eigenvalues(spark, sf_dir):
    points, limits = figures.eigenvalues(spectrum_table(spark, TURNS), [1, 2])
    parts = [
        points.select(F.lit("mode").alias("kind"), "k", rounded("re").alias("re"), rounded("im").alias("im"), "highlighted"),
        figures.unit_circle(spark).select(F.lit("circle").alias("kind"), F.lit(0).alias("k"), rounded("re").alias("re"), rounded("im").alias("im"), F.lit(False).alias("highlighted")),
        limits.select(F.lit("limit").alias("kind"), F.col("dim").cast("int").alias("k"), rounded("low").alias("re"), rounded("high").alias("im"), F.lit(False).alias("highlighted")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


GRID = "g AS (SELECT a / 5e0 AS g1, b / 5e0 AS g2 FROM (SELECT unnest(range(-5, 6)) AS a), (SELECT unnest(range(-5, 6)) AS b))"
FIELD = f"""{GRID}, f AS (SELECT g1, g2, 1 AS mode, 0.5e0 + 0.25e0 * g2 + g1 AS re, -0.5e0 * g2 + 0.5e0 * g1 AS im FROM g UNION ALL SELECT g1, g2, 2, 1 - g2 + 0.5e0 * g1, -0.1e0 * g1 FROM g)"""


def fields(spark):
    xi = np.array([[0.5, 1.0], [0.25 + 0.5j, -1.0], [1.0 - 0.5j, 0.5 + 0.1j]])
    axis = [k / 5 for k in range(-5, 6)]
    return spectral.eigenfunction_grid(spark, xi, Hermite(2, 1), [axis, axis])


@query(f"""WITH {FIELD}, w AS (SELECT mode, min(re) AS lo, max(re) AS hi FROM f GROUP BY mode) SELECT g1, g2, f.mode::INT AS mode, round((re - lo) / (hi - lo), 6) + 0e0 AS re FROM f JOIN w ON f.mode = w.mode""")
def figure_eigenfunctions(spark, sf_dir):
    return figures.eigenfunctions(fields(spark)).select("g1", "g2", "mode", rounded("re").alias("re"))


@query(f"""WITH {FIELD} SELECT a.g1, a.g2, {shown(5, phase='atan2(a.im, a.re)', log_amplitude='ln(sqrt(b.re ** 2 + b.im ** 2) + 1e-12)')} FROM f a JOIN f b ON a.g1 = b.g1 AND a.g2 = b.g2 AND a.mode = 1 AND b.mode = 2
WHERE abs(a.re) > 1e-9 OR abs(a.im) > 1e-9""")
def figure_phase(spark, sf_dir):
    """Phase and amplitude over the plane; where a field is 0, there is no phase."""
    f = fields(spark)
    out = figures.phase_amplitude(f, 1, 2).join(f.where("mode = 1 AND (abs(re) > 1e-9 OR abs(im) > 1e-9)").select("g1", "g2"), ["g1", "g2"])
    return out.select("g1", "g2", rounded("phase", 5).alias("phase"), rounded("log_amplitude", 5).alias("log_amplitude"))


ROLLED = """d AS (SELECT t - 1 AS t, v AS s1, lag(v) OVER (ORDER BY t) AS s2 FROM e), r AS (SELECT t AS start_idx, 0 AS step, s1, s2 FROM d WHERE t BETWEEN 1 AND (SELECT max(t) FROM d) - 10 UNION ALL SELECT start_idx, step + 1, 0.9e0 * s1 + 0.2e0 * s2, -0.1e0 * s1 + 0.8e0 * s2 FROM r WHERE step < 10),
o AS (SELECT r.start_idx, r.step, d.s1 AS x_true, r.s1 AS x_pred FROM r JOIN d ON d.t = r.start_idx + r.step)"""


@query(f"""WITH RECURSIVE {ONE_SERIES}, {ROLLED} SELECT 'curve' AS kind, start_idx, step::INT AS step, {shown(6, x_true='x_true', x_pred='x_pred')}, 0e0 AS error FROM o
UNION ALL SELECT 'error', 0, step::INT, 0, 0, round(avg(abs(x_pred - x_true)), 6) + 0e0 FROM o GROUP BY step""")
def figure_prediction(spark, sf_dir):
    s = embedding.delay_embed(one_series(spark, sf_dir), 2, 1, [])
    lines, errors = figures.prediction(predict.predict_delay_space(s, np.array([[0.9, 0.2], [-0.1, 0.8]]), None, 10))
    a = lines.select(F.lit("curve").alias("kind"), "start_idx", "step", rounded("x_true").alias("x_true"), rounded("x_pred").alias("x_pred"), F.lit(0.0).alias("error"))
    b = errors.select(F.lit("error").alias("kind"), F.lit(0).cast("long").alias("start_idx"), "step", F.lit(0.0).alias("x_true"), F.lit(0.0).alias("x_pred"), rounded("error").alias("error"))
    return a.unionByName(b)


# --- more predictions and embeddings ------------------------------------------------------


@query(f"""WITH RECURSIVE {POINTS}, {K3_SQL}, {rk4_sql(FHN_NODE, '0.1e0', 'SELECT id AS traj_id, x AS x0, y AS x1 FROM p', 4)},
q AS (SELECT id AS start_idx, 0 AS step, x AS a, y AS b FROM p UNION ALL SELECT start_idx, step + 1, k13 + k23 * b + k33 * a, k12 + k22 * b + k32 * a FROM q, k WHERE step < 4)
SELECT start_idx, step::INT AS step, dim::INT AS dim, {shown(5, x_true='CASE dim WHEN 1 THEN x0 ELSE x1 END', x_pred='CASE dim WHEN 1 THEN a ELSE b END')}
FROM q JOIN r ON r.traj_id = start_idx AND r.t = step + 1, (SELECT unnest([1, 2]) AS dim)""")
def states_relifted(spark, sf_dir):
    """From every supplier's point, lifted anew at each step, beside the integrated truth."""
    starts = suppliers(spark, sf_dir).withColumnRenamed("id", "start_idx")
    d = Hermite(2, 1)
    out = predict.predict_states(starts, dynamics.parameters("fhn", "stable-node"), K3, d, d.projection(), 0.1, 4)
    return out.select("start_idx", "step", "dim", rounded("x_true", 5).alias("x_true"), rounded("x_pred", 5).alias("x_pred"))


@query(f"""WITH {ONE_SERIES}, l AS (SELECT t - 796 AS t, v, lag(v, 4) OVER w AS b, lag(v, 400) OVER w AS c, lag(v, 796) OVER w AS d, sum(v) OVER (ORDER BY t ROWS BETWEEN 796 PRECEDING AND CURRENT ROW) AS all_ FROM e WINDOW w AS (ORDER BY t))
SELECT t, 200::INT AS n, {shown(6, v1='v', v2='b', v101='c', v200='d')} FROM l WHERE t > 0""")
def long_delays(spark, sf_dir):
    """200 delays, four rows apart: the newest, the next, the middle and the oldest."""
    s = embedding.delay_embed(one_series(spark, sf_dir), 200, 4, [])
    return s.select("t", F.size("s").alias("n"), *[rounded(F.get("s", F.lit(i))).alias(f"v{i + 1}") for i in (0, 1, 100, 199)])


@query(f"""WITH {ONE_SERIES}, w AS (SELECT t AS r, v FROM e), n AS (SELECT count(*) - 199 AS n FROM e)
SELECT i::INT AS i, j::INT AS j, round(sum(a.v * b.v), 3) + 0e0 AS value FROM (SELECT unnest([1, 7, 50, 200]) AS i), (SELECT unnest([1, 7, 50, 200]) AS j), w a, w b, n
WHERE a.r - (200 - i) BETWEEN 1 AND n.n AND b.r = a.r + i - j GROUP BY i, j""")
def long_gram(spark, sf_dir):
    """Entries of the sum of outer products of 200 delays."""
    s = embedding.delay_embed(one_series(spark, sf_dir), 200, 1, [])
    g = fit.gram(s, (), "s", "s", (200, 200)).where("i IN (1, 7, 50, 200) AND j IN (1, 7, 50, 200)")
    return cells(g.select("i", F.col("j").cast("int").alias("j"), "value"), 3)


# --- level lines of a fitted field, thinning, draws ---------------------------------------

AXIS = [round(-0.6 + 0.13 * k, 2) for k in range(25)]
LEVELS = [0.0, -0.2]
AXIS_SQL = "(SELECT unnest([" + ", ".join(f"{v}::DOUBLE" for v in AXIS) + f"]) AS {{0}}, unnest(range(1, {len(AXIS) + 1})) AS {{1}})"
#: The second principal axis of the kernel features of all pairs, and its field on the grid.
FIELD = f"""{KERNEL.rsplit(', m AS (', 1)[0]}, s AS (SELECT sum(a1 * a1) AS a, sum(a1 * a2) AS b, sum(a2 * a2) AS c FROM l),
w AS (SELECT *, (a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b * b) AS l2 FROM s), n AS (SELECT b / sqrt(b * b + (l2 - a) ** 2) AS q1, (l2 - a) / sqrt(b * b + (l2 - a) ** 2) AS q2 FROM w),
u AS (SELECT q1 * sign(CASE WHEN abs(q1) >= abs(q2) THEN q1 ELSE q2 END) AS q1, q2 * sign(CASE WHEN abs(q1) >= abs(q2) THEN q1 ELSE q2 END) AS q2 FROM n),
g AS MATERIALIZED (SELECT i, j, x, y, q1 * {kernel_sql('x', 'y', 0)} + q2 * {kernel_sql('x', 'y', 1)} AS v FROM {AXIS_SQL.format('x', 'j')}, {AXIS_SQL.format('y', 'i')}, u)"""

#: Which edges (0 below, 1 right, 2 above, 3 left) a line joins, by the corners that are high (1, 2, 4, 8
#: in turn) and, where both diagonals differ, by the middle (1 high, 0 low, -1 either).
SQUARES = """q(code, middle, s, e) AS (VALUES (1, -1, 0, 3), (2, -1, 1, 0), (3, -1, 1, 3), (4, -1, 2, 1), (6, -1, 2, 0), (7, -1, 2, 3), (8, -1, 3, 2), (9, -1, 0, 2), (11, -1, 1, 2), (12, -1, 3, 1),
  (13, -1, 0, 1), (14, -1, 3, 0), (5, 0, 0, 3), (5, 0, 2, 1), (5, 1, 0, 1), (5, 1, 2, 3), (10, 0, 1, 0), (10, 0, 3, 2), (10, 1, 1, 2), (10, 1, 3, 0))"""
LINES = f"""WITH RECURSIVE {FIELD}, lv AS (SELECT unnest([{', '.join(f'{v}::DOUBLE' for v in LEVELS)}]) AS level),
k AS (SELECT level, a.i, a.j, a.x AS x0, b.x AS x1, a.y AS y0, d.y AS y1, a.v AS v0, b.v AS v1, c.v AS v2, d.v AS v3,
  (a.v >= level)::INT + 2 * (b.v >= level)::INT + 4 * (c.v >= level)::INT + 8 * (d.v >= level)::INT AS code, ((a.v + b.v + c.v + d.v) / 4 >= level)::INT AS middle
  FROM g a JOIN g b ON b.i = a.i AND b.j = a.j + 1 JOIN g c ON c.i = a.i + 1 AND c.j = a.j + 1 JOIN g d ON d.i = a.i + 1 AND d.j = a.j, lv),
pc AS (SELECT *, [(i * 2147483648 + j * 2), (i * 2147483648 + (j + 1) * 2 + 1), ((i + 1) * 2147483648 + j * 2), (i * 2147483648 + j * 2 + 1)] AS ids,
  [x0 + (level - v0) / (v1 - v0) * (x1 - x0), x1, x0 + (level - v3) / (v2 - v3) * (x1 - x0), x0] AS xs, [y0, y0 + (level - v1) / (v2 - v1) * (y1 - y0), y1, y0 + (level - v0) / (v3 - v0) * (y1 - y0)] AS ys FROM k),
{SQUARES}, t AS MATERIALIZED (SELECT level, ids[s + 1] AS a, xs[s + 1] AS xa, ys[s + 1] AS ya, ids[e + 1] AS b, xs[e + 1] AS xb, ys[e + 1] AS yb FROM pc JOIN q ON pc.code = q.code AND (q.middle = -1 OR q.middle = pc.middle)),
o AS (SELECT DISTINCT level, a AS p, xa AS x, ya AS y FROM t UNION SELECT DISTINCT level, b, xb, yb FROM t),
h AS (SELECT level, p AS start, p, 1 AS place FROM o UNION ALL SELECT h.level, start, b, place + 1 FROM h JOIN t ON t.level = h.level AND t.a = h.p WHERE t.b <> start),
f AS (SELECT level, start, min(p) AS least, max(place) AS last FROM h GROUP BY level, start),
r AS (SELECT f.level, start, least, EXISTS (SELECT 1 FROM h JOIN t ON t.level = h.level AND t.a = h.p WHERE h.level = f.level AND h.start = f.start AND h.place = f.last AND t.b = f.start) AS closed FROM f),
z AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY least) AS line FROM r WHERE CASE WHEN closed THEN start = least ELSE NOT EXISTS (SELECT 1 FROM t WHERE t.level = r.level AND t.b = r.start) END)
SELECT z.level, line::INT AS line, closed, place::INT AS place, round(x, 5) + 0e0 AS x, round(y, 5) + 0e0 AS y FROM z JOIN h ON h.level = z.level AND h.start = z.start JOIN o ON o.level = h.level AND o.p = h.p"""


@query(LINES)
def zero_contour(spark, sf_dir):
    """Level lines of a principal axis of kernel features, fitted on all pairs: one runs through
    the grid, the other closes."""
    pairs = embedding.snapshot_pairs(embedding.delay_embed(one_series(spark, sf_dir), 2, 1, []), [], "s")
    u, _ = fit.principal_axes_by_gram(fit.kernel_rows(pairs.select("x"), LANDMARKS, 0.5).select("k"), "k")
    d = Radial(tuple(map(tuple, LANDMARKS.tolist())), "gaussian", 0.5, include_states=False)
    on_grid = contour.field_grid(spark, u[:, 1:].astype(complex), d, AXIS, AXIS)
    out = None
    for level in LEVELS:
        one = contour.segments(on_grid, level).withColumn("level", F.lit(level))
        out = one if out is None else out.unionByName(one)
    lines = contour.polylines(out, ["level"])
    return lines.select("level", "line", "closed", "place", rounded("x", 5).alias("x"), rounded("y", 5).alias("y"))


RADIUS = 0.4


@query(f"""WITH RECURSIVE p AS (SELECT row_number() OVER (ORDER BY c_custkey) AS n, c_custkey AS k, c_acctbal / 1e3 AS x, (c_custkey % 97) / 10e0 AS y FROM customer),
r AS (SELECT 0::BIGINT AS n, []::STRUCT(k BIGINT, x DOUBLE, y DOUBLE)[] AS kept
  UNION ALL SELECT p.n, CASE WHEN len(list_filter(kept, lambda q: sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)) < {RADIUS}::DOUBLE)) = 0 THEN list_append(kept, {{'k': p.k, 'x': p.x, 'y': p.y}}) ELSE kept END FROM r JOIN p ON p.n = r.n + 1),
f AS (SELECT unnest(kept) AS q FROM r WHERE n = (SELECT max(n) FROM p)) SELECT q.k AS start, {shown(6, x1='q.x', x2='q.y')} FROM f""")
def thinned_customers(spark, sf_dir):
    """Of all customers' points, in the order of their keys, those that no earlier one is near to."""
    p = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("start"), F.array(F.col("c_acctbal").cast("double") / 1e3, (F.col("c_custkey") % 97) / 10.0).alias("x"))
    out = thinning.thinned(p, RADIUS)
    return out.select("start", *entries(out, "x", 2, name="x"))


@query("""WITH o AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) AS t FROM orders), n AS (SELECT count(*) AS n FROM orders),
d AS (SELECT k AS draw, least(floor(((('0x' || substr(md5(k || ':7:draw'), 1, 12))::BIGINT::DOUBLE + 0.5e0) / 281474976710656e0) * n) + 1, n)::BIGINT AS t FROM n, (SELECT unnest(range(1, n + 1)) AS k FROM n))
SELECT draw, o_orderkey, o_totalprice FROM d JOIN o ON o.t = d.t""")
def drawn_orders(spark, sf_dir):
    """As many draws with replacement as there are orders: a bootstrap sample."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return sampling.sampled_with_replacement(o, o.count(), "o_orderkey", 7).select("draw", "o_orderkey", "o_totalprice")
