"""Run counts, progress, and the split of failed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def progress(analysed: Column, total: Column) -> Column:
    """Share done, at most 1; null while there is nothing to do."""
    return F.when(total > 0, F.least(analysed / total, F.lit(1.0)))


def run_counts(
    papers: DataFrame, relevant: Column, analysed: Column, top_k: int | None = None
) -> DataFrame:
    """One row: fetched, total after the filter, analysed, exported, progress.

    The export holds the `top_k` best of the analysed papers, or all of them. A single
    pass of partial counts; an empty input gives zeros.
    """
    flagged = papers.select(relevant.alias("_r"), analysed.alias("_a"))
    counts = flagged.agg(
        F.count(F.lit(1)).alias("fetched"),
        F.count_if("_r").alias("total"),
        F.count_if(F.col("_r") & F.col("_a")).alias("analysed"),
    )
    done = F.col("analysed")
    exported = done if top_k is None else F.least(done, F.lit(top_k).cast("long"))
    return counts.withColumn("exported", exported).withColumn(
        "progress", progress(done, F.col("total"))
    )


def observe_rows(df: DataFrame, seen: Observation, where: Column | None = None) -> DataFrame:
    """`df`, whose next job also counts its rows, or those of `where`, into `seen`.

    The count is made where the rows pass, so it costs no scan. Filters above it are not
    pushed below it: put it after those that prune the scan.
    """
    counted = F.count(F.lit(1)) if where is None else F.count_if(where)
    return df.observe(seen, counted.alias("rows"))


def observed_counts(
    fetched: Observation, relevant: Observation, analysed: Observation, top_k: int | None = None
) -> dict[str, int]:
    """The counts of `run_counts` from the run's own jobs, which have ended by now."""
    done = analysed.get["rows"]
    return {
        "fetched": fetched.get["rows"],
        "total": relevant.get["rows"],
        "analysed": done,
        "exported": done if top_k is None else min(done, top_k),
    }


def split_failed(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(good rows, failed rows); together they are the input."""
    failed = F.col(error).isNotNull()
    return df.where(~failed), df.where(failed)


def with_route(df: DataFrame, error: str = "error") -> DataFrame:
    """The same split as a column, for one write partitioned by `route`."""
    return df.withColumn(
        "route", F.when(F.col(error).isNull(), "good").otherwise("quarantine")
    )
