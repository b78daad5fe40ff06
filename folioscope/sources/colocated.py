"""Tables bucketed by paper, so that joins between them need no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_colocated(
    df: DataFrame, table: str, key: str = "paper_id", buckets: int = 2_000
) -> None:
    """Save papers, texts and evaluations with the same key and bucket count.

    Their lookups, hit splits and upserts then read matching buckets side by side and
    long texts never move. Rows are sent to their bucket first: one file per bucket.
    """
    (
        df.repartition(buckets, key)
        .write.mode("overwrite")
        .bucketBy(buckets, key)
        .sortBy(key)
        .saveAsTable(table)
    )
