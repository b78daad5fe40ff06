"""Binary documents: two extractors with failover, run batch by batch in the tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.cluster import broadcast_if_small, settle
from folioscope.functions.text import head_chars

Extractor = Callable[[bytes], str | None]

_RESULT = (
    "path STRING, basename STRING, mtime TIMESTAMP, full_text STRING, error STRING, "
    "parser STRING"
)


def read_binaries(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("basename"),
        F.col("modificationTime").alias("mtime"),
        "content",
    )


def read_unsettled(
    spark: SparkSession, path: str, manifest: DataFrame, pattern: str = "*.pdf", seconds: int = 2
) -> DataFrame:
    """Files (as of `read_binaries`) whose content has to be looked at.

    The manifest has `basename`, `mtime`, `length` and `parsed_at` of what was parsed. A
    file listed there with the same time and length is settled, but only if it was parsed
    at least `seconds` after that time: one that changes within the step of the file
    system's clock keeps its time. The listing reads no content, and contents are read
    from the oldest unsettled time on; what is read is decided by `content_status`.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    listed = found.select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("basename"),
        F.col("modificationTime").alias("mtime"),
        "length",
    )
    sure = F.col("parsed_at") >= F.col("mtime") + F.make_dt_interval(secs=F.lit(seconds))
    settled = manifest.where(sure).select("basename", "mtime", "length").distinct()
    rest = settle(listed.join(settled, ["basename", "mtime", "length"], "left_anti"))
    oldest = rest.agg(F.min("mtime")).first()[0]
    if oldest is None:
        return read_binaries(spark, path, pattern).where(F.lit(False))
    # Pushed to the source, which opens no older file.
    recent = read_binaries(spark, path, pattern).where(F.col("mtime") >= F.lit(oldest))
    return recent.join(broadcast_if_small(rest.select("path")), "path", "left_semi")


def extract_binaries(
    files: DataFrame,
    plain: Extractor,
    structured: Extractor | None = None,
    max_chars: int | None = None,
) -> DataFrame:
    """Structured extractor first; without it, or when it fails, the plain one.

    When both fail the text is null and `error` says why. Files already parsed
    should be dropped before (see `parse_cache_status`).
    """
    tiers = [("structured", structured), ("plain", plain)]

    def one(content: bytes) -> tuple[str | None, str | None, str | None]:
        errors = []
        for name, extract in tiers:
            if extract is None:
                continue
            try:
                text = extract(content)
            except Exception as problem:  # a bad file must not end the job
                errors.append(f"{name}: {problem}")
                continue
            if text is not None:
                return text, None, name
            errors.append(f"{name}: no text")
        return None, "; ".join(errors), None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            results = [one(content) for content in batch["content"]]
            done = pd.DataFrame(results, columns=["full_text", "error", "parser"])
            kept = batch[["path", "basename", "mtime"]].reset_index(drop=True)
            yield pd.concat([kept, done], axis=1)

    parsed = files.select("path", "basename", "mtime", "content")
    return parsed.mapInPandas(run, _RESULT).withColumn(
        "full_text", head_chars(F.col("full_text"), max_chars)
    )
