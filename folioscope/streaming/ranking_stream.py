"""Rank papers as they arrive: every micro-batch updates a top-k and the counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from folioscope.operators.counts import split_failed
from folioscope.operators.ranking import top_k

Score = Callable[[DataFrame], DataFrame]

_PROGRESS = "batch BIGINT, arrived BIGINT, analysed BIGINT"


def _slot(path: str, part: str, batch: int) -> str:
    """State of a batch: two folders in turn, so the one before survives a rewrite."""
    return f"{path}/{part}/slot={batch % 2}"


def rank_stream(papers: DataFrame, score: Score, k: int, path: str) -> DataStreamWriter:
    """Writer for a stream of papers; start it with the trigger you want.

    `score` maps papers to scored rows (`id`, `published`, `final_score`, ...) without
    state; a column `error`, if there is one, sends a row to quarantine. Under `path`:
    `scored` and `quarantine` hold each batch's rows; `best` the top-k and `progress` a
    table of the counts, after the last batch and the one before.

    The top-k of a union is the top-k of the parts' top-k, so the state is k rows. State
    goes to two folders in turn and a batch reads only the other one, so a batch run
    again after a failure leaves the same state.
    """
    spark = papers.sparkSession
    shape = score(spark.createDataFrame([], papers.schema)).schema

    def absorb(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        here = f"{path}/scored/at={number}"
        # Written before it is read: scoring runs once per batch.
        score(batch).write.mode("overwrite").parquet(here)
        rows = session.read.schema(shape).parquet(here)
        good, failed = split_or_all(rows)
        if failed is not None:
            failed.write.mode("overwrite").parquet(f"{path}/quarantine/at={number}")
        ok = F.col("error").isNull() if failed is not None else F.lit(True)
        best = top_k(good, k)
        now = rows.agg(
            F.lit(number).cast("bigint").alias("batch"),
            F.count(F.lit(1)).alias("arrived"),
            F.count_if(ok).alias("analysed"),
        )
        if number:
            before = session.read.schema(shape).parquet(_slot(path, "best", number - 1))
            best = top_k(before.unionByName(best), k)
            steps = session.read.schema(_PROGRESS).parquet(_slot(path, "progress", number - 1))
            last = steps.orderBy(F.desc("batch")).limit(1)
            now = steps.unionByName(
                last.unionByName(now).agg(
                    F.lit(number).cast("bigint").alias("batch"),
                    F.sum("arrived").alias("arrived"),
                    F.sum("analysed").alias("analysed"),
                )
            )
        best.write.mode("overwrite").parquet(_slot(path, "best", number))
        now.coalesce(1).write.mode("overwrite").parquet(_slot(path, "progress", number))

    return papers.writeStream.foreachBatch(absorb).option(
        "checkpointLocation", f"{path}/_checkpoint"
    )


def split_or_all(scored: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    return split_failed(scored) if "error" in scored.columns else (scored, None)


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """`batch`, `arrived`, `analysed` after each batch; no rows when nothing arrived."""
    steps = _state(spark, path, "progress", _PROGRESS)
    return steps.select("batch", "arrived", "analysed").distinct()


def read_best(spark: SparkSession, path: str, shape: StructType | str) -> DataFrame:
    """The top-k after the last finished batch; empty when nothing arrived.

    `shape` is the schema of the scored rows.
    """
    last = read_progress(spark, path).agg(F.max("batch")).first()[0]
    if last is None:
        return spark.createDataFrame([], shape)
    return spark.read.schema(shape).parquet(_slot(path, "best", last))


def _state(spark: SparkSession, path: str, part: str, shape: str) -> DataFrame:
    try:
        return spark.read.schema(shape).parquet(f"{path}/{part}")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], shape)
