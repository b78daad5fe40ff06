"""Author service payloads to one profile shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.fixed_values import FLAT_SOURCE, NESTED_SOURCE
from folioscope.schemas import FLAT_PAYLOAD, NESTED_PAYLOAD

PROFILE_FIELDS = (
    "h_index",
    "paper_count",
    "citation_count",
    "affiliations",
    "source_used",
)


def _non_empty(names: Column) -> Column:
    kept = F.filter(names, lambda n: n.isNotNull() & (n != ""))
    return F.coalesce(kept, F.array().cast("array<string>"))


def from_flat_payload(payloads: DataFrame, source: str = FLAT_SOURCE) -> DataFrame:
    """Columns `name`, `payload`; the first result counts, no result gives no row."""
    first = F.get(F.from_json("payload", FLAT_PAYLOAD)["data"], F.lit(0))
    found = payloads.select("name", first.alias("hit")).where("hit IS NOT NULL")
    return found.select(
        "name",
        F.col("hit.hIndex").alias("h_index"),
        F.col("hit.paperCount").alias("paper_count"),
        F.col("hit.citationCount").alias("citation_count"),
        _non_empty(F.col("hit.affiliations.name")).alias("affiliations"),
        F.lit(source).alias("source_used"),
    )


def from_nested_payload(payloads: DataFrame, source: str = NESTED_SOURCE) -> DataFrame:
    """Same for the source that nests the h-index and the institutions."""
    first = F.get(F.from_json("payload", NESTED_PAYLOAD)["results"], F.lit(0))
    found = payloads.select("name", first.alias("hit")).where("hit IS NOT NULL")
    institutions = F.transform(
        "hit.affiliations", lambda a: a["institution"]["display_name"]
    )
    return found.select(
        "name",
        F.col("hit.summary_stats.h_index").alias("h_index"),
        F.col("hit.works_count").alias("paper_count"),
        F.col("hit.cited_by_count").alias("citation_count"),
        _non_empty(institutions).alias("affiliations"),
        F.lit(source).alias("source_used"),
    )
