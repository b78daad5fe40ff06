"""Stored evaluations: lookup, hit split, patch fold, field-level upsert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.display import utc_micros


def lookup(papers: DataFrame, store: DataFrame, key: str = "paper_id") -> DataFrame:
    """Each paper with its stored record, nulls when there is none."""
    return papers.join(store, key, "left")


def _done(store: DataFrame, field: str, key: str) -> DataFrame:
    # One row per paper, and a semi join needs no more than that.
    return store.where(F.col(field).isNotNull()).select(key)


def hits(
    papers: DataFrame, store: DataFrame, field: str, key: str = "paper_id"
) -> DataFrame:
    """Papers whose stored record has the task's field."""
    return papers.join(_done(store, field, key), key, "left_semi")


def misses(
    papers: DataFrame, store: DataFrame, field: str, key: str = "paper_id"
) -> DataFrame:
    return papers.join(_done(store, field, key), key, "left_anti")


def sequence_of(ts: Column, tie: Column) -> Column:
    """One exact sortable number from a time and a tie-breaking BIGINT.

    A decimal fits the fixed-width hash aggregation buffer; a struct would force a
    sort of all rows.
    """
    micros = utc_micros(ts).cast("decimal(18,0)")
    return micros * F.expr("10000000000000000000BD") + tie.cast("decimal(19,0)")


def fold_patches(
    patches: DataFrame,
    fields: Sequence[str],
    key: str = "paper_id",
    field: str = "field",
    value: str = "value",
    seq: Column | str = "seq",
) -> DataFrame:
    """A patch log to one wide row per paper, the last patch of each field winning.

    One pass with map-side combining: a paper with most of the log's rows shrinks to
    one partial row per task before the shuffle.
    """
    order = F.col(seq) if isinstance(seq, str) else seq
    latest = [
        F.max_by(F.col(value), F.when(F.col(field) == name, order)).alias(name)
        for name in fields
    ]
    return patches.groupBy(key).agg(*latest)


def upsert(
    store: DataFrame, patch: DataFrame, fields: Sequence[str], key: str = "paper_id"
) -> DataFrame:
    """New non-null fields overwrite, the others survive. One row per paper on each side."""
    merged = [F.coalesce(F.col(f"p.{f}"), F.col(f"s.{f}")).alias(f) for f in fields]
    same = F.col(f"s.{key}") == F.col(f"p.{key}")
    return (
        store.alias("s")
        .join(patch.alias("p"), same, "full_outer")
        .select(F.coalesce(f"p.{key}", f"s.{key}").alias(key), *merged)
    )


def evaluation_key(paper_id: Column, model: str, prompt_version: str) -> Column:
    """Record key that keeps answers of another model or prompt apart."""
    return F.concat_ws("|", paper_id, F.lit(model), F.lit(prompt_version))
