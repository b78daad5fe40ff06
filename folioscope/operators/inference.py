"""Batched model calls and the rating task built on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.responses import parse_rating, strip_fence
from folioscope.functions.scoring import rubric_score
from folioscope.operators.evaluations import misses
from folioscope.schemas import RESPONSE

ModelFn = Callable[[Sequence[str]], Sequence[str]]

RATING_FIELDS = ("innovation", "rigor", "impact", "total_score", "raw_response")


def infer(
    pending: DataFrame,
    task: str,
    model_fn: ModelFn,
    batch_rows: int = 64,
    parallelism: int = 64,
) -> DataFrame:
    """Columns `paper_id`, `prompt` to `paper_id`, `task`, `raw_response`, `error`.

    `model_fn` gets up to `batch_rows` prompts at a time. The prompts are dealt by id
    over `parallelism` partitions, which bounds how many calls run at once; a stated
    number of partitions is not merged at run time. When a batch fails its prompts are
    tried one by one, so a single bad paper gives one error row and the rest go on.
    """
    dealt = pending.select("paper_id", F.lit(task).alias("task"), "prompt").repartition(
        parallelism, "paper_id"
    )
    return infer_dealt(dealt, {task: model_fn}, batch_rows)


def infer_dealt(
    pending: DataFrame, models: Mapping[str, ModelFn], batch_rows: int = 64
) -> DataFrame:
    """`paper_id`, `task`, `prompt` rows, partitioned as wanted, to answers."""

    def answer(task: str, prompts: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            replies = list(models[task](prompts))
            if len(replies) != len(prompts):
                raise ValueError(f"{len(replies)} answers for {len(prompts)} prompts")
            return [(reply, None) for reply in replies]
        except Exception as problem:
            if len(prompts) == 1:
                return [(None, str(problem) or type(problem).__name__)]
            return [answer(task, [prompt])[0] for prompt in prompts]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for arrived in batches:
            for task, rows in arrived.groupby("task", sort=False):
                for start in range(0, len(rows), batch_rows):
                    batch = rows.iloc[start : start + batch_rows]
                    done = pd.DataFrame(
                        answer(task, batch["prompt"].tolist()),
                        columns=["raw_response", "error"],
                    )
                    done.insert(0, "paper_id", batch["paper_id"].to_numpy())
                    done.insert(1, "task", task)
                    yield done

    replies = pending.select("paper_id", "task", "prompt").mapInPandas(run, RESPONSE)
    return replies.withColumn("raw_response", strip_fence(F.col("raw_response")))


def answered(spark: SparkSession, path: str) -> DataFrame:
    """Answers kept at `path` so far; none when nothing was written yet."""
    try:
        return spark.read.schema(RESPONSE).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RESPONSE)


def infer_once(
    pending: DataFrame, task: str, model_fn: ModelFn, path: str, parallelism: int = 64
) -> DataFrame:
    """Run `infer` for what has no answer at `path` yet, and give all answers there.

    A Python stage read by two consumers runs twice, and a lost executor runs it
    again; the written table keeps paid answers. Name the path by the run, and a run
    started again goes on where it was.
    """
    spark = pending.sparkSession
    done = answered(spark, path).where((F.col("task") == task) & F.col("error").isNull())
    todo = pending.join(done.select("paper_id"), "paper_id", "left_anti")
    fresh = infer(todo, task, model_fn, parallelism=parallelism)
    fresh.write.mode("append").parquet(path)
    return answered(spark, path)


def rate_responses(responses: DataFrame, raw: str = "raw_response") -> DataFrame:
    """Add the ratings, `total_score` and `parse_status` of cleaned rating responses.

    A missing or unreadable rating counts as 0; `parse_status` tells them apart.
    """
    keep = [F.col(c) for c in responses.columns]
    read = responses.select(*keep, parse_rating(F.col(raw)).alias("_r"))
    ratings = {c: F.col(f"_r.parsed.{c}") for c in ("innovation", "rigor", "impact")}
    return read.select(
        *keep,
        *[F.coalesce(v, F.lit(0.0)).alias(c) for c, v in ratings.items()],
        rubric_score(*ratings.values()).alias("total_score"),
        F.col("_r.parse_status").alias("parse_status"),
    )


def evaluate_papers(
    papers: DataFrame,
    store: DataFrame,
    prompt: Column,
    model_fn: ModelFn,
    parallelism: int = 64,
) -> DataFrame:
    """Rating of every paper: stored where there is one, else inferred now.

    Columns: `paper_id`, the rating fields, `source` ("stored" or "model"),
    `parse_status`, `error`. Only rows with `parse_status = 'ok'` and source "model"
    belong back into the store.
    """
    stored = (
        store.where(F.col("innovation").isNotNull())
        .join(papers.select("paper_id"), "paper_id", "left_semi")
        .select(
            "paper_id",
            F.col("innovation").cast("double"),
            *[
                F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
                for c in ("rigor", "impact", "total_score")
            ],
            F.coalesce("raw_response", F.lit("")).alias("raw_response"),
            F.lit("stored").alias("source"),
            F.lit("ok").alias("parse_status"),
            F.lit(None).cast("string").alias("error"),
        )
    )
    todo = misses(papers, store, "innovation").select("paper_id", prompt.alias("prompt"))
    rated = rate_responses(infer(todo, "rating", model_fn, parallelism=parallelism))
    fresh = rated.withColumn("source", F.lit("model"))
    return stored.unionByName(fresh.select(stored.columns))
