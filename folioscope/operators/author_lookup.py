"""Author lookups through functions you supply, source after source, asking nothing twice."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.cluster import settle
from folioscope.operators.authors import resolve_authors
from folioscope.operators.inference import answered, infer_dealt

Ask = Callable[[Sequence[str]], Sequence[str | None]]


@dataclass(frozen=True)
class LookupSource:
    """A service: `ask` maps names to JSON payloads (None: not known), `read` their shape.

    `read` is `from_flat_payload`, `from_nested_payload` or one like them.
    """

    name: str
    ask: Ask
    read: Callable[[DataFrame, str], DataFrame]


def _payloads(names: DataFrame, source: LookupSource, path: str) -> DataFrame:
    """`name`, `payload` of what the source has answered for these names, errors left out."""
    good = answered(names.sparkSession, path).where("error IS NULL")
    # A broken write may have left an answer twice; the least of them counts.
    once = good.groupBy(F.col("paper_id").alias("name")).agg(F.min("raw_response").alias("payload"))
    return once.join(names, "name", "left_semi")


def lookup_authors(
    names: DataFrame,
    sources: Sequence[LookupSource],
    run_dir: str,
    batch_names: int = 64,
    parallelism: int = 16,
    waves: int = 4,
) -> DataFrame:
    """The profile of every distinct `name`, as `resolve_authors` gives it.

    The sources are asked in order, each only for the names that those before it do not
    know or failed on; the first that knows a name gives the whole profile. At most
    `parallelism` calls of up to `batch_names` names run at once. Answers, also that a
    name is not known, are committed under `run_dir` in `waves` parts: started again with
    the same folder, a run asks only for what has no answer, failed calls included. A call
    that fails is tried name by name, and what fails then counts as not known in this run.
    """
    wanted = settle(names.select("name").where(F.col("name").isNotNull()).distinct())
    open_names, profiles = wanted, {}
    for source in sources:
        path = f"{run_dir.rstrip('/')}/{source.name}"
        spark = wanted.sparkSession
        done = answered(spark, path).where("error IS NULL")
        todo = settle(
            open_names.join(done.select(F.col("paper_id").alias("name")), "name", "left_anti")
            .withColumn("wave", F.pmod(F.xxhash64(F.lit(3), "name"), F.lit(waves)))
        )
        due = {r["wave"] for r in todo.select("wave").distinct().collect()}  # at most `waves`
        for wave in sorted(due):
            asked = (
                todo.where(F.col("wave") == wave)
                .select(F.col("name").alias("paper_id"), F.lit(source.name).alias("task"), F.col("name").alias("prompt"))
                .repartition(parallelism, "paper_id")
            )
            infer_dealt(asked, {source.name: source.ask}, batch_names).write.mode("append").parquet(path)
        known = settle(source.read(_payloads(open_names, source, path), source.name))
        profiles[source.name] = known
        open_names = settle(open_names.join(known.select("name"), "name", "left_anti"))
    return resolve_authors(wanted, profiles, [s.name for s in sources])
