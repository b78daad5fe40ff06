"""Ranking: top-k, full order, rank numbers, running best and running top-k."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappush, heapreplace
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.cluster import broadcast_if_small, settle
from folioscope.functions.display import utc_micros


def best_first(score: str = "final_score") -> list:
    """Score down (missing counts as 0), then newest first, then id."""
    return [
        F.coalesce(F.col(score), F.lit(0.0)).desc(),
        F.col("published").desc(),
        F.col("id").asc(),
    ]


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """A heap of k rows per partition, then one of k rows; nothing is sorted whole."""
    return scored.orderBy(*best_first()).limit(k)


def rank_all(scored: DataFrame) -> DataFrame:
    """Everything in rank order: a range-partitioned sort, which reads its input twice
    (once to choose the ranges). Settle computed scores first; keep texts out of it.
    """
    return scored.orderBy(*best_first())


def number_top_k(scored: DataFrame, k: int) -> DataFrame:
    """Top-k with `rank` from 1. The unpartitioned window sees the k rows only."""
    order = W.orderBy(*best_first())
    return top_k(scored, k).withColumn("rank", F.row_number().over(order))


def number_all(scored: DataFrame) -> DataFrame:
    """Everything with `rank` from 1, dense over the whole table.

    The computed rows are settled, then dealt into ranges of the order and settled with
    their place in the range, so each number is the place plus the sizes of the ranges
    before. There is one size for each partition; no window and no single task sees the
    rows.
    """
    placed = settle(
        settle(scored)
        .repartitionByRange(*best_first())
        .sortWithinPartitions(*best_first())
        .withColumn("_place", F.monotonically_increasing_id())
    )
    # The upper bits are the partition, the lower 33 the row in it.
    ranged = placed.withColumn("_range", F.shiftright("_place", 33).cast("int"))
    sizes = ranged.groupBy("_range").count().orderBy("_range").collect()
    starts, total = [], 0
    for r in sizes:
        starts.append((r["_range"], total))
        total += r["count"]
    known = placed.sparkSession.createDataFrame(starts, "_range INT, _start BIGINT")
    place = F.col("_place").bitwiseAND((1 << 33) - 1)
    return (
        ranged.join(F.broadcast(known), "_range")
        .withColumn("rank", F.col("_start") + place + 1)
        .drop("_range", "_start", "_place")
    )


def with_texts(ranked: DataFrame, texts: DataFrame, key: str = "id") -> DataFrame:
    """Fetch the wide columns for the ranked rows; few of them are broadcast."""
    return texts.join(broadcast_if_small(ranked), key)


def _slotted(scored: DataFrame, order: list[Column]) -> DataFrame:
    """Rows in ranges of `order`, numbered by `_slot`.

    Dealing by range reads its input twice, so computed rows are settled first.
    """
    ranged = settle(scored).repartitionByRange(*order)
    return settle(ranged.sortWithinPartitions(*order).withColumn("_slot", F.spark_partition_id()))


def running_best(scored: DataFrame, group: str, score: str = "final_score") -> DataFrame:
    """Add `best_so_far`: the best score of the group up to each paper, by time and id.

    A paper without a time comes first in its group; a missing group is a group.

    A group may hold most rows, even at one time, so rows are range-partitioned by group,
    time and id: a slot is a range of rows, whatever the clock says. Windows run inside
    a slot, the best scores of (group, slot) form a small table, and each row takes the
    larger of its slot's running best and the best of the group's earlier slots.
    """
    order = [F.asc_nulls_first(group), F.asc_nulls_first("published"), F.col("id")]
    slotted = _slotted(scored, order)
    slots = slotted.groupBy(group, "_slot").agg(F.max(score).alias("_best"))
    earlier = W.partitionBy(group).orderBy("_slot")
    before = slots.select(
        F.col(group).alias("_group"),
        F.col("_slot").alias("_at"),
        F.max("_best").over(earlier.rowsBetween(W.unboundedPreceding, -1)).alias("_prior"),
    )
    inside = W.partitionBy(group, "_slot").orderBy(F.asc_nulls_first("published"), "id")
    running = F.max(score).over(inside.rowsBetween(W.unboundedPreceding, 0))
    same = F.col(group).eqNullSafe(F.col("_group")) & (F.col("_slot") == F.col("_at"))
    # greatest() skips nulls, which the first slot of a group has.
    return (
        slotted.withColumn("_running", running)
        .join(before, same)
        .withColumn("best_so_far", F.greatest("_running", "_prior"))
        .drop("_slot", "_at", "_group", "_running", "_prior")
    )


class _Best:
    """The k best of what was added, where a smaller entry is better."""

    def __init__(self, k: int) -> None:
        self.k, self.heap = k, []

    def add(self, entry: tuple) -> bool:
        item = _Worst(entry)
        if len(self.heap) < self.k:
            heappush(self.heap, item)
        elif self.heap and self.heap[0] < item:
            heapreplace(self.heap, item)
        else:
            return False
        return True

    def listed(self) -> list[tuple]:
        return sorted(x.entry for x in self.heap)


class _Worst:
    """Turns the order, so that a heap has its worst entry on top."""

    __slots__ = ("entry",)

    def __init__(self, entry: tuple) -> None:
        self.entry = entry

    def __lt__(self, other: _Worst) -> bool:
        return self.entry > other.entry


_ENTRY = pa.struct([("score", pa.float64()), ("time", pa.int64()), ("id", pa.string())])
_BEST = "array<struct<score:double,time:bigint,id:string>>"


def _scan(
    batches: Iterator[pa.RecordBatch], k: int, keys: list[str], before: bool
) -> Iterator[pa.RecordBatch]:
    """Each row's `_best`: the k best entries so far among rows of the same `keys`.

    With `before`, those of the earlier rows only. A row's own `_entries` are one or more.
    A state is kept for the current keys alone, as the rows come by them.
    """
    state, now, last = _Best(k), [], None
    for batch in batches:
        out: list[Any] = []
        found = zip(*(batch.column(c).to_pylist() for c in keys), strict=True)
        for key, entries in zip(found, batch.column("_entries").to_pylist(), strict=True):
            if key != last:
                state, now, last = _Best(k), [], key
            if before:
                out.append(now)
            changed = False
            for e in entries:
                changed |= state.add((e["score"], e["time"], e["id"]))
            if changed:
                now = [dict(zip(("score", "time", "id"), x, strict=True)) for x in state.listed()]
            if not before:
                out.append(now)
        names = [n for n in batch.schema.names if n != "_entries"]
        columns = [batch.column(n) for n in names]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(out, pa.list_(_ENTRY))], [*names, "_best"]
        )


def _scanned(rows: DataFrame, k: int, keys: list[str], before: bool = False) -> DataFrame:
    kept = [f for f in rows.schema.fields if f.name != "_entries"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(lambda it: _scan(it, k, keys, before), f"{fields}, _best {_BEST}")


def running_top_k(scored: DataFrame, group: str, k: int, score: str = "final_score") -> DataFrame:
    """Add `best_ids`: the ids of the k best papers of the group up to each, best first.

    Papers come by time (missing ones first) and id; best is as in `top_k`: score down
    (missing counts as 0), newest first, then id. A missing group is a group.

    Top-k lists merge in any grouping, so this is a scan over ranges of rows (slots), as
    a group may hold most of them. Each slot is read once in order with k entries of
    state for the current group; the last list of each (group, slot) goes to a small
    table, over which the same scan gives what is best before each slot; and each row
    merges two lists of k.
    """
    order = [F.asc_nulls_first(group), F.asc_nulls_first("published"), F.col("id")]
    name = F.col(group).cast("string")
    entry = F.struct(
        (-F.coalesce(F.col(score).cast("double"), F.lit(0.0))).alias("score"),
        F.coalesce(-utc_micros(F.col("published")), F.lit(2**63 - 1)).alias("time"),
        F.col("id").cast("string").alias("id"),
    )
    slotted = _slotted(
        scored.withColumn("_group", name).withColumn("_entries", F.array(entry)), order
    )
    # Files of one slot are read in pieces where they are large, so slots are dealt anew.
    dealt = slotted.repartition("_slot").sortWithinPartitions("_slot", *order)
    local = settle(_scanned(dealt, k, ["_slot", "_group"]))
    fullest = F.max_by("_best", F.struct(F.col("published").isNotNull(), "published", "id"))
    last = local.groupBy("_group", "_slot").agg(fullest.alias("_entries"))
    by_group = last.repartition("_group").sortWithinPartitions("_group", "_slot")
    earlier = _scanned(by_group, k, ["_group"], before=True).select(
        F.col("_group").alias("_of"), F.col("_slot").alias("_at"), F.col("_best").alias("_prior")
    )
    same = F.col("_group").eqNullSafe(F.col("_of")) & (F.col("_slot") == F.col("_at"))
    merged = F.slice(F.array_sort(F.concat("_best", "_prior")), 1, k)
    return (
        local.join(earlier, same)
        .withColumn("best_ids", F.transform(merged, lambda e: e["id"]))
        .drop("_group", "_slot", "_of", "_at", "_best", "_prior")
    )
