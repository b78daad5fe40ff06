"""The best papers of each source as they arrive, in keyed streaming state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from folioscope.functions.display import utc_micros

_STATE = "scores ARRAY<DOUBLE>, times ARRAY<BIGINT>, ids ARRAY<STRING>"
OUTPUT = "source STRING, best_ids ARRAY<STRING>, best_scores ARRAY<DOUBLE>"
#: RocksDB keeps the state of each key apart, so a batch reads that of its own keys only.
PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Rows that a task cuts to the best of each source at once.
_RUN = 50_000
_ENTRY = "source STRING, score DOUBLE, time BIGINT, id STRING"


def _cut(rows: pa.Table, k: int) -> pa.Table:
    """The k best different entries of each source."""
    if not rows.num_rows:
        return rows
    by = [(name, "ascending") for name in ("source", "score", "time", "id")]
    rows = rows.take(pc.sort_indices(rows, sort_keys=by)).combine_chunks()

    def changes(name: str) -> np.ndarray:
        column = rows[name].combine_chunks()
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            column = column.dictionary_encode(null_encoding="encode").indices
        values = np.asarray(column)
        return np.append(True, values[1:] != values[:-1])

    begins = changes("source")
    fresh = begins | changes("score") | changes("time") | changes("id")
    number = np.cumsum(fresh)
    first = np.flatnonzero(begins)
    place = number - np.repeat(number[first], np.diff(first, append=len(begins)))
    return rows.filter(pa.array(fresh & (place < k)))


def _foremost(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """What of a task's rows can be among the k best of a source.

    So the state of a source sees k rows a task, however many papers arrive. With more
    sources than a run has room for, rows go on as they are cut.
    """
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= _RUN:
            held = _cut(pa.Table.from_batches(held), k).to_batches()
            count = sum(b.num_rows for b in held)
            if 2 * count > _RUN:
                yield from held
                held, count = [], 0
    if held:
        yield from _cut(pa.Table.from_batches(held), k).to_batches()


class BestOfSource(StatefulProcessor):
    """A list of the k best (score, time, id) of each source, least first, and nothing else.

    An entry has its score and time negated. A paper that comes again is in the list
    already, or is as far behind as it was; so neither repeats nor the order of arrival
    change what is left.
    """

    def __init__(self, k: int) -> None:
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        kept = []
        if self.best.exists():
            kept = list(zip(*self.best.get(), strict=True))
        now = kept
        for row in rows:
            entry = (row["score"], row["time"], row["id"])
            if entry not in now and (len(now) < self.k or entry < now[-1]):
                now = sorted([*now, entry])[: self.k]
        if now != kept:
            self.best.update(tuple(list(column) for column in zip(*now, strict=True)))
            yield Row(source=key[0], best_ids=[e[2] for e in now], best_scores=[-e[0] for e in now])


def rank_by_source(
    scored: DataFrame, k: int, path: str, group: str = "source", score: str = "final_score"
) -> DataStreamWriter:
    """Writer for a stream of scored papers (`id`, `published`, the group and the score).

    Each batch writes the lists of the groups that it changed to `path/best/at=<batch>`;
    a batch run again writes the same. `read_source_best` reads the last list of each.
    Best is score down (missing counts as 0), newest first, then id; a missing group is a
    group. The session needs the state store `PROVIDER` (as `build_session` sets it).
    """
    if scored.sparkSession.conf.get(PROVIDER_KEY) != PROVIDER:
        raise ValueError(f"set {PROVIDER_KEY} to {PROVIDER}")
    entries = scored.select(
        F.col(group).cast("string").alias("source"),
        (-F.coalesce(F.col(score).cast("double"), F.lit(0.0))).alias("score"),
        F.coalesce(-utc_micros(F.col("published")), F.lit(2**63 - 1)).alias("time"),
        F.col("id").cast("string").alias("id"),
    )
    # The best of a union are among the best of its parts.
    few = entries.mapInArrow(lambda it: _foremost(it, k), _ENTRY)
    changed = few.groupBy("source").transformWithState(
        statefulProcessor=BestOfSource(k), outputStructType=OUTPUT, outputMode="Update", timeMode="None"
    )

    def absorb(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/best/at={number}")

    return changed.writeStream.outputMode("update").foreachBatch(absorb).option(
        "checkpointLocation", f"{path}/_checkpoint"
    )


def read_source_best(spark: SparkSession, path: str) -> DataFrame:
    """`source`, `best_ids`, `best_scores` after the last batch; no rows when nothing arrived."""
    try:
        lists = spark.read.schema(f"{OUTPUT}, at BIGINT").parquet(f"{path}/best")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], OUTPUT)
    last = F.max_by(F.struct("best_ids", "best_scores"), "at").alias("last")
    return lists.groupBy("source").agg(last).select("source", "last.*")
