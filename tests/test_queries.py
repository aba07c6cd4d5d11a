import duckdb
import numpy as np
import pytest

from tidewright.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, data, compare, name):
    compare(QUERIES[name](spark, data), ORACLES[name])


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["regimes", "fixed_points_all", "euler_maruyama", "limit_cycle", "analysis_rff", "analysis_kernel", "state_analysis"])
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_median_sigma_of_a_larger_table(spark, tmp_path):
    x = np.random.default_rng(6).normal(size=(1500, 4))
    spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert QUERIES["median_sigma"](spark, str(tmp_path)).first().sigma == con.execute(ORACLES["median_sigma"]).fetchone()[0]


def test_kernel_query_returns_the_whole_spectrum(spark, data):
    assert QUERIES["analysis_kernel"](spark, data).count() == 500


def test_hankel_prediction_starts_from_every_row(spark, data):
    n = spark.read.parquet(f"{data}/events.parquet").count() - 5
    truth = QUERIES["hankel_prediction"](spark, data).groupBy("start_idx").count().collect()
    assert sorted(map(tuple, truth)) == [(i + 1, 6) for i in range(n - 5)]
