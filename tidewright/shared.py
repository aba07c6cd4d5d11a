"""Tables written once to the folder that the driver and all executors share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where that is unset, the warehouse serves a local
    session, and a cluster has to name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "local")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/tidewright"


def write_once(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written to a new shared folder and read back, and the folder: what was evaluated once
    stays as it was, and a lost executor costs a re-read."""
    path = f"{shared_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    return write_once(df, name)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that ``write_once`` made."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def forget(spark: SparkSession) -> None:
    """Lets Spark delete the shuffles of finished jobs that nothing refers to: it does so when the driver
    collects its garbage, which may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
