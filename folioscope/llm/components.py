"""Connected components of a links table, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.cluster import settle


def _state(pairs: DataFrame) -> tuple:
    return tuple(
        pairs.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
        ).first()
    )


def connected_components(links: DataFrame, left: str, right: str) -> DataFrame:
    """`id` and `component` (the smallest id reachable) of every id in `links`.

    Links are undirected; loops and repeats are fine; rows with a null end are no links.
    Each round is written to the shared folder, so the lineage stays short; the rounds
    grow with the logarithm of the longest chain. A round joins each id to its smallest
    neighbour, one row, so a hub with very many links is split by the skew join.
    """
    a, b = F.col(left), F.col(right)
    pairs = settle(
        links.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    state = _state(pairs)
    while state[0]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        mins = both.groupBy("u").agg(F.min("v").alias("m"))
        mins = mins.select("u", F.least("u", "m").alias("m"))
        large = settle(
            both.join(mins, "u")
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).distinct()
        large = settle(large)
        mins = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(mins, "u").where(F.col("v") != F.col("m"))
        moved = small.select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = settle(
            moved.unionByName(mins.select("u", F.col("m").alias("v"))).distinct()
        )
        new = _state(after)
        pairs = after
        if new == state:
            break
        state = new
    ids = pairs.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return settle(ids.unionByName(roots))
