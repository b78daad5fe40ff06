"""Paper metadata: scan, catalogue search, time window, pending content."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.fixed_values import NEWEST_LIMIT
from folioscope.functions.matching import catalogue_match
from folioscope.schemas import PAPER


def newest_first() -> list:
    """Newest first; the id settles equal times, so results never depend on partitions."""
    return [F.col("published").desc(), F.col("id").asc()]


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue records on storage, with the declared schema (no inference pass)."""
    return spark.read.schema(PAPER).parquet(path)


def match_catalogue(
    papers: DataFrame, keywords: Sequence[str], categories: Sequence[str]
) -> DataFrame:
    return papers.where(catalogue_match(keywords, categories))


def newest(papers: DataFrame, limit: int = NEWEST_LIMIT) -> DataFrame:
    """The newest records, cut before any time window (a per-partition heap, no sort)."""
    return papers.orderBy(*newest_first()).limit(limit)


def newest_dated(
    spark: SparkSession, path: str, limit: int = NEWEST_LIMIT, date_column: str = "date"
) -> DataFrame:
    """`newest` of a table in folders by the UTC date of `published`, reading few of them.

    Folders are counted from the newest back, in steps that double, until `limit` rows
    are safe: no older folder can hold one of them, and ties lie within the last one.
    Only those folders are read then. Papers without a date are read only when all the
    others are too few.
    """
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = files.Path(path)
    listed = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    names = [status.getPath().getName() for status in listed]
    dates = sorted(n.split("=", 1)[1] for n in names if n.startswith(f"{date_column}="))[::-1]
    dates = [d for d in dates if d[:1].isdigit()]
    papers = spark.read.option("basePath", path)
    taken, rows, step = 0, 0, 1
    while rows < limit and taken < len(dates):
        more = dates[taken : taken + step]
        rows += papers.parquet(*(f"{path}/{date_column}={d}" for d in more)).count()
        taken, step = taken + len(more), 2 * step
    if rows < limit:
        return newest(spark.read.parquet(path), limit)
    return newest(papers.parquet(*(f"{path}/{date_column}={d}" for d in dates[:taken])), limit)


def within_days(
    papers: DataFrame, as_of: datetime, days: int, date_partition: str | None = None
) -> DataFrame:
    """Keep `published >= as_of - days`, inclusive; `as_of` is given, in UTC.

    Name the date column a table is partitioned by and whole folders are skipped.
    """
    since = as_of - timedelta(days=days)
    kind = papers.schema["published"].dataType.simpleString()
    if kind == "timestamp":  # an instant, whatever the session's zone
        micros = (since - datetime(1970, 1, 1)) // timedelta(microseconds=1)
        bound = F.timestamp_micros(F.lit(micros))
    else:
        bound = F.lit(since.strftime("%Y-%m-%d %H:%M:%S.%f")).cast(kind)
    if date_partition:
        papers = papers.where(F.col(date_partition) >= F.lit(since.date()))
    return papers.where(F.col("published") >= bound)


def search(
    papers: DataFrame,
    keywords: Sequence[str],
    categories: Sequence[str],
    as_of: datetime,
    days: int,
    limit: int | None = None,
) -> DataFrame:
    """Catalogue search: match, the newest `limit` if one is given, then the time window.

    Without a limit nothing is cut, and the window can prune the scan.
    """
    found = match_catalogue(papers, keywords, categories)
    if limit is not None:
        found = newest(found, limit)
    return within_days(found, as_of, days)


def pending_content(papers: DataFrame, manifest: DataFrame, key: str = "id") -> DataFrame:
    """Papers whose content is not stored yet; being listed alone decides."""
    return papers.join(manifest.select(key).distinct(), key, "left_anti")
