"""Rendezvous hashing of record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.ordering import running_total

_SEED = 20_011


def _draw(key: Column, shard: int, weight: float) -> Column:
    """-ln(u) / weight with u uniform in (0, 1): the smallest draw wins the record."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(_SEED), F.lit(shard), key), 11)
    uniform = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return F.struct((-F.log(uniform) / F.lit(weight)).alias("d"), F.lit(shard).alias("s"))


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard (int from 0) of a key; shard i wins in proportion to `weights[i]`.

    Every (key, shard) pair has its own draw, so a further shard takes keys only into
    itself and a removed last shard gives only its own keys away. A null key is one key.
    """
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("weights must be positive, one for each shard")
    draws = [_draw(key, i, w) for i, w in enumerate(weights)]
    return F.array_min(F.array(*draws))["s"]


def assign_shards(
    docs: DataFrame, weights: Sequence[float], key: str = "doc_id"
) -> DataFrame:
    """`key`, `size`, `text_crc32`, `law`, `shard`, `slot`, `grown_shard` of each row.

    `size` is the UTF-8 bytes of `text` plus 8. A null text has no bytes: size 8, CRC 0.
    `slot` numbers the rows of a shard from 0 without gaps, by key and CRC; equal rows
    get different slots in any order. `grown_shard` is the shard with one more shard of
    weight 1. A null key is one key, first in its shard. An empty table gives no rows.
    Other columns of `docs` are left out.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    placed = docs.select(
        F.col(key),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous_shard(F.col(key), weights).alias("shard"),
        rendezvous_shard(F.col(key), [*weights, 1.0]).alias("grown_shard"),
    )
    order = [F.col("shard"), F.col(key), F.col("text_crc32")]
    numbered = running_total(placed, order, "_position", F.lit(1))
    # One row for each shard.
    starts = numbered.groupBy("shard").agg(F.min("_position").alias("_first"))
    return numbered.join(F.broadcast(starts), "shard").select(
        key,
        "size",
        "text_crc32",
        "law",
        "shard",
        (F.col("_position") - F.col("_first")).alias("slot"),
        "grown_shard",
    )


def write_shards(
    docs: DataFrame, path: str, weights: Sequence[float], key: str = "doc_id", files: int = 16
) -> None:
    """Write whole rows to one folder for each shard, each in up to `files` files."""
    spread = F.pmod(F.xxhash64(key, "text"), F.lit(files))
    placed = docs.withColumn("shard", rendezvous_shard(F.col(key), weights))
    count = len(weights) * files
    placed.repartition(count, "shard", spread).write.partitionBy("shard").parquet(path)
