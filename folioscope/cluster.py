"""Session facts the jobs depend on: the shared folder and broadcast bounds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DIR_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: the configured one.

    Where none is set, a local session uses a folder of its warehouse.
    """
    configured = spark.conf.get(_DIR_KEY, "")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_DIR_KEY} to a folder all executors can reach")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_runs"


def _application_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def new_run_dir(spark: SparkSession, name: str) -> str:
    """A path not used before, in the folder of this application."""
    return f"{_application_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove_run_dirs(spark: SparkSession) -> None:
    """Delete what this application has settled; call it when its results are written."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    path = hadoop.fs.Path(_application_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write a result that several consumers read to the shared folder, and read it back.

    Cuts the lineage, survives lost executors, and the table's size is known to the
    planner, which a checkpointed RDD's is not. The tables of an application stay until
    `remove_run_dirs`; give a `path` to keep one.
    """
    path = path or new_run_dir(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = 50_000) -> DataFrame:
    """Hint a broadcast only after checking that the side has at most `max_rows` rows.

    The check reads at most `max_rows + 1` rows. A bigger side keeps its shuffle join.
    """
    rows = df.limit(max_rows + 1).count()
    return F.broadcast(df) if rows <= max_rows else df
