import os
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
os.environ.setdefault("OMP_NUM_THREADS", "1")

import duckdb  # noqa: E402
import pytest  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    d = tmp_path_factory.mktemp("spark")
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", f"{d}/warehouse").config("spark.checkpoint.dir", f"{d}/shared")
        .config("spark.local.dir", f"{d}/local").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in sorted(Path(DATA).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def same_rows(frame, sql, con):
    """Whether a Spark result and a query's have the same columns and rows in any order."""
    a, b = frame.toPandas(), con.execute(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    columns = sorted(b.columns)
    rows = lambda x: sorted(map(str, x[columns].astype(object).where(x[columns].notna(), None).itertuples(index=False, name=None)))
    assert len(a) == len(b)
    assert rows(a) == rows(b)


@pytest.fixture(scope="session")
def compare(duck):
    return lambda frame, sql: same_rows(frame, sql, duck)
