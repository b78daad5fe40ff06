"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosines."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.cluster import settle
from folioscope.llm.components import connected_components
from folioscope.llm.text_arrays import in_small_batches

#: Vectors of a block; a bucket with more is compared block by block.
BLOCK = 2_048
_SEED = 4_242


def plan_tables(rows: int, threshold: float, miss: float, bucket: int = 256) -> tuple[int, int]:
    """Sign bits for about `bucket` rows a bucket, and tables for at most `miss` lost links.

    Two vectors at the threshold agree in a bit with 1 - angle / pi, so in all bits of
    at least one table with the wanted probability.
    """
    bits = max(1, min(60, round(math.log2(max(2.0, rows / bucket)))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-agree)))


def _signatures(batches, bits: int, tables: int):
    weights = 1 << np.arange(bits, dtype=np.int64)

    @lru_cache(maxsize=8)
    def planes(dim: int) -> np.ndarray:
        return np.random.default_rng(_SEED).standard_normal((dim, tables * bits))

    for batch in batches:
        dims = np.asarray(batch.column("dim"))
        codes = np.zeros((len(dims), tables), dtype=np.int64)
        for dim in np.unique(dims).tolist():
            rows = np.flatnonzero(dims == dim)
            vectors = _matrix(batch.column("unit").take(pa.array(rows)), dim)
            signs = (vectors @ planes(dim) >= 0).reshape(len(vectors), tables, bits)
            codes[rows] = signs @ weights
        out = pa.array(list(codes), type=pa.list_(pa.int64()))
        yield batch.append_column("codes", out)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys in batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(k)) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change), batch.num_rows]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[begin].item() for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(begin, end - begin))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _spanning(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of a and b that join what was apart: a forest of the links."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            yield x, y


def _compare(batches, tables: int, threshold: float):
    """Links of each block pair: per vector the rows linked to it, and a forest of links.

    A pair that shares buckets of several tables counts in the first of them only.
    """
    for group in _groups(batches, ["dim", "label", "table", "code", "left", "right"]):
        group = group.combine_chunks()
        dim = group["dim"][0].as_py()
        table = group["table"][0].as_py()
        ids = np.asarray(group["vec_id"])
        part = np.asarray(group["part"])
        weight = np.asarray(group["copies"])
        unit = _matrix(group["unit"].combine_chunks(), dim)
        codes = _matrix(group["codes"].combine_chunks(), tables)
        left, right = group["left"][0].as_py(), group["right"][0].as_py()
        rows = np.flatnonzero(part == left)
        columns = np.flatnonzero(part == right)
        count = np.zeros(len(ids), dtype=np.int64)
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        for begin in range(0, len(rows), 512):
            some = rows[begin : begin + 512]
            near = unit[some] @ unit[columns].T >= threshold
            i, j = np.nonzero(near)
            i, j = some[i], columns[j]
            keep = (ids[i] < ids[j]) if left == right else np.ones(len(i), dtype=bool)
            if table:
                keep &= (codes[i, :table] != codes[j, :table]).all(axis=1)
            i, j = i[keep], j[keep]
            np.add.at(count, i, weight[j])
            np.add.at(count, j, weight[i])
            ends.append((i, j))
        linked = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids[linked]),
                pa.array(count[linked]),
                pa.nulls(len(linked), pa.int64()),
            ],
            ["a", "n", "b"],
        )
        i = np.concatenate([e[0] for e in ends])
        j = np.concatenate([e[1] for e in ends])
        forest = list(_spanning(ids[i], ids[j]))
        if forest:
            a, b = zip(*forest, strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(a, pa.int64()),
                    pa.nulls(len(a), pa.int64()),
                    pa.array(b, pa.int64()),
                ],
                ["a", "n", "b"],
            )


def link_vectors(
    vectors: DataFrame,
    threshold: float = 0.93,
    miss: float = 1e-4,
    block: int = BLOCK,
) -> DataFrame:
    """`vec_id`, `n_links`, `component_id`, `kept` of every row of `vectors`.

    Vectors of one label and length are linked when their cosine, in double precision, is at least
    `threshold`. Equal vectors are compared once, with their number. Vectors that share
    all sign bits of a table meet in a bucket; there every pair is checked exactly, in
    pairs of blocks if the bucket is large, so only links between vectors that share no
    bucket are lost, at most `miss` of those at the threshold. A vector that is null or
    zero, or has a null or non-finite component, and one without a label, link with
    nothing, as does a row with a null `vec_id` (its component is null; it is kept).
    Only vectors of one length are compared. Repeated ids count as rows.
    """
    raw = F.transform("embedding", lambda x: x.cast("double"))
    # Scaled by the largest component first, so that no square overflows or vanishes.
    top = F.array_max(F.transform(raw, F.abs))
    clean = (
        F.col("label").isNotNull()
        & F.col("vec_id").isNotNull()
        & (F.size("embedding") > 0)
        & F.forall(
            raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
        )
        & (top > 0)
    )
    base = in_small_batches(vectors).select("vec_id", "label", "embedding")
    good = base.where(F.coalesce(clean, F.lit(False))).select(
        "vec_id", "label", F.transform(raw, lambda x: x / top).alias("scaled")
    )
    norm = F.sqrt(F.aggregate("scaled", F.lit(0.0), lambda s, x: s + x * x))
    good = good.select(
        "vec_id", "label", "scaled", F.transform("scaled", lambda x: x / norm).alias("unit")
    )
    good = settle(good.withColumn("same", F.xxhash64("label", "scaled")))
    if not good.limit(1).count():
        return base.select(
            "vec_id",
            F.lit(0).cast("long").alias("n_links"),
            F.col("vec_id").alias("component_id"),
            F.lit(True).alias("kept"),
        )
    # Equal vectors: one stands for all, with their number.
    stands = good.groupBy("label", "scaled").agg(
        F.min("vec_id").alias("stand"), F.count(F.lit(1)).alias("copies"),
        F.first("unit").alias("unit"), F.first("same").alias("same"),
    )
    stands = settle(stands)
    most = stands.groupBy("label", F.size("unit")).count().agg(F.max("count")).first()[0]
    bits, tables = plan_tables(most, threshold, miss)
    coded_schema = "vec_id long, label int, dim int, copies long, unit array<double>, codes array<long>"
    coded = settle(
        stands.select(
            F.col("stand").alias("vec_id"), F.col("label").cast("int").alias("label"),
            F.size("unit").alias("dim"), "copies", "unit",
        ).mapInArrow(lambda it: _signatures(it, bits, tables), coded_schema)
    )
    opened = coded.select("*", F.posexplode("codes").alias("table", "code"))
    bucket = ["dim", "label", "table", "code"]
    held = opened.groupBy(*bucket).count().where("count > 1")
    parts = F.ceil(F.col("count") / block).cast("int")
    placed = opened.join(held, bucket).select(
        *bucket, "vec_id", "copies", "unit", "codes",
        F.pmod(F.xxhash64("vec_id", "table"), parts).cast("int").alias("part"),
        parts.alias("parts"),
    )
    # Every pair of blocks is a task's group; a block goes once to each pair it is in.
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    spread = placed.withColumn("other", F.explode(others)).select(
        *bucket,
        F.least("part", "other").alias("left"),
        F.greatest("part", "other").alias("right"),
        "part", "vec_id", "copies", "unit", "codes",
    )
    key = [*bucket, "left", "right"]
    found = settle(
        spread.repartition(*key)
        .sortWithinPartitions(*key)
        .mapInArrow(lambda it: _compare(it, tables, threshold), "a long, n long, b long")
    )
    counts = found.where("b is null").groupBy(F.col("a").alias("stand")).agg(
        F.sum("n").alias("n")
    )
    links = found.where("b is not null").select("a", "b")
    components = connected_components(links, "a", "b")
    known = (
        stands.select("label", "scaled", "stand", "copies", "same")
        .join(counts, "stand", "left")
        .join(components.withColumnRenamed("id", "stand"), "stand", "left")
        .select(
            "same", "label", "scaled",
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"),
            F.coalesce("component", "stand").alias("component"),
        )
    )
    judged = good.join(known, ["same", "label", "scaled"]).select("vec_id", "n", "component")
    ids = judged.groupBy("vec_id").agg(
        F.max("n").alias("n"), F.min("component").alias("component")
    )
    return base.select("vec_id").join(ids, "vec_id", "left").select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
