"""CSV and JSON exports. Each `*_view` gives the rows, each `write_*` the files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.fixed_values import CSV_COLUMNS
from folioscope.functions.display import utc_micros
from folioscope.operators.ranking import top_k

_BOM = "\ufeff"
_ALL_FIELDS = {"ignoreNullFields": "false"}
_ISO = "yyyy-MM-dd'T'HH:mm:ss"


def csv_view(papers: DataFrame) -> DataFrame:
    """The export columns in their fixed order, those present."""
    return papers.select([c for c in CSV_COLUMNS if c in papers.columns])


def full_view(papers: DataFrame) -> DataFrame:
    """Every column; nested ones as JSON text, which CSV can hold."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    return papers.select(
        [
            F.to_json(f.name, _ALL_FIELDS).alias(f.name)
            if isinstance(f.dataType, nested)
            else F.col(f.name)
            for f in papers.schema.fields
        ]
    )


def _write_csv(df: DataFrame, path: str, files: int | None) -> None:
    """Header and UTF-8 with BOM in every file, so each opens on its own."""
    first, *rest = df.columns
    marked = df.select(F.col(first).alias(_BOM + first), *[F.col(c) for c in rest])
    if files is not None:
        marked = marked.coalesce(files)
    marked.write.mode("overwrite").options(
        header=True,
        escape='"',
        lineSep="\n",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
        timestampNTZFormat=_ISO,
        timestampFormat=_ISO,
    ).csv(path)


def write_csv(papers: DataFrame, path: str, files: int | None = None) -> None:
    """`files=1` is for a top-k; by default the files follow the partitions."""
    _write_csv(csv_view(papers), path, files)


def write_full_csv(papers: DataFrame, path: str, files: int | None = None) -> None:
    _write_csv(full_view(papers), path, files)


def json_rows(papers: DataFrame, key: str = "id") -> DataFrame:
    """One JSON document per paper, non-ASCII text kept as it is."""
    return papers.select(key, F.to_json(F.struct(*papers.columns), _ALL_FIELDS).alias("json"))


def write_json(papers: DataFrame, path: str) -> None:
    """JSON Lines, all fields, missing ones as null."""
    papers.write.mode("overwrite").options(**_ALL_FIELDS).json(path)


def json_array(papers: DataFrame, k: int) -> DataFrame:
    """The top-k as one JSON array, best first; k bounds the single row."""
    return _ordered(papers, k).select(F.to_json("data", _ALL_FIELDS).alias("json"))


def api_envelope(papers: DataFrame, k: int, generated_at: str) -> DataFrame:
    """`{"meta": {total, generated_at}, "data": [...]}` of the top-k, as one JSON text."""
    meta = F.struct(
        F.size("data").alias("total"), F.lit(generated_at).alias("generated_at")
    )
    whole = F.struct(meta.alias("meta"), F.col("data"))
    return _ordered(papers, k).select(F.to_json(whole, _ALL_FIELDS).alias("json"))


def _ordered(papers: DataFrame, k: int) -> DataFrame:
    """One row with the k best papers as an array. Equal scores: newest, then id."""
    rank = F.struct(
        (-F.coalesce("final_score", F.lit(0.0))).alias("a"),
        (-utc_micros(F.col("published"))).alias("b"),
        F.col("id").alias("c"),
        F.struct(*papers.columns).alias("paper"),
    )
    best = top_k(papers, k).agg(F.collect_list(rank).alias("rows"))
    ordered = F.array_sort("rows", _by_rank)
    return best.select(F.transform(ordered, lambda r: r["paper"]).alias("data"))


def _by_rank(x, y):
    step = F.lit(0)
    for part in ("c", "b", "a"):
        step = (
            F.when(x[part] < y[part], F.lit(-1))
            .when(x[part] > y[part], F.lit(1))
            .otherwise(step)
        )
    return step
