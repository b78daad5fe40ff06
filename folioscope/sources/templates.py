"""Prompt templates kept on storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from folioscope.functions.prompts import TEMPLATES

def read_templates(
    spark: SparkSession, path: str, names: Sequence[str] | None = None
) -> dict[str, str]:
    """Built-in templates, overridden by the `<name>.txt` files of a folder.

    A plan is built from the templates, so they come to the driver; name the ones
    wanted if the folder holds others.
    """
    files = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt$", 1).alias("name"),
        F.col("value").alias("body"),
    )
    wanted = F.col("name") != "" if names is None else F.col("name").isin(*names)
    rows = files.where(wanted).collect()
    return {**TEMPLATES, **{row["name"]: row["body"] for row in rows}}
