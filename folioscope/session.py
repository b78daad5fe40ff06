"""Session settings the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Times are UTC; the catalogue's are and so is `as_of`.
    "spark.sql.session.timeZone": "UTC",
    # Adaptive execution sizes the shuffles, so the number below is only a ceiling.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Keyed streaming state needs a store that keeps each key apart.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # Rows hold whole texts: small Arrow batches keep a Python worker's memory flat.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
}


def build_session(
    name: str,
    master: str | None = None,
    shuffle_partitions: int = 20_000,
    **more: str,
) -> SparkSession:
    """A session with the settings above; `more` takes keys with "_" for ".".

    Whole texts are not shuffled, so shuffles are a few percent of the input: 20,000
    partitions keep one of 4 TB at 200 MB a task, and smaller ones are merged at run
    time.
    """
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        **{key.replace("_", "."): value for key, value in more.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
