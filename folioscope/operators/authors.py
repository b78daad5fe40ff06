"""Authors: unnest, resolve against prioritised sources, re-nest, metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.cluster import settle
from folioscope.fixed_values import NO_SOURCE, UNKNOWN_AUTHOR
from folioscope.functions.display import first_or_default, shown_number
from folioscope.sources.profiles import PROFILE_FIELDS


def unnest_authors(
    papers: DataFrame, key: str = "id", authors: str = "authors"
) -> DataFrame:
    """One row per paper and author in order (`pos` from 0), blanks and unknowns gone."""
    return papers.select(key, F.posexplode(authors).alias("pos", "name")).where(
        (F.col("name") != "") & (F.col("name") != UNKNOWN_AUTHOR)
    )


def merge_sources(
    profiles: Mapping[str, DataFrame], order: Sequence[str]
) -> DataFrame:
    """One profile per name: the whole row of the first source, in `order`, that has it.

    Of several rows of one source the least by its fields counts, so reruns agree.
    """
    ranked = [
        profiles[source].select("name", F.struct(F.lit(rank), *PROFILE_FIELDS).alias("info"))
        for rank, source in enumerate(order)
    ]
    every = reduce(DataFrame.unionByName, ranked)
    best = every.groupBy("name").agg(F.min("info").alias("info"))
    return best.select("name", *[f"info.{f}" for f in PROFILE_FIELDS])


def resolve_authors(
    names: DataFrame, profiles: Mapping[str, DataFrame], order: Sequence[str]
) -> DataFrame:
    """Profile of every distinct name; a name in no source is kept with nulls.

    Each name is looked up once however often it is written on papers.
    """
    wanted = names.select("name").distinct()
    found = wanted.join(merge_sources(profiles, order), "name", "left")
    return found.withColumns(
        {
            "affiliations": F.coalesce("affiliations", F.array().cast("array<string>")),
            "source_used": F.coalesce("source_used", F.lit(NO_SOURCE)),
        }
    ).select("name", *PROFILE_FIELDS)


def attach_profiles(
    authored: DataFrame, profiles: Mapping[str, DataFrame], order: Sequence[str]
) -> DataFrame:
    """Author rows with their profiles.

    There is one profile per name, so a name on very many rows is split by the adaptive
    skew join, which repeats only that one row. The profiles are settled first, as only
    a side that comes straight from its shuffle can be repeated.
    """
    return authored.join(settle(resolve_authors(authored, profiles, order)), "name", "left")


def nest_authors(
    attached: DataFrame, key: str = "id", fields: Sequence[str] = PROFILE_FIELDS
) -> DataFrame:
    """`authors_info` per paper in author order, duplicates kept.

    The array is as long as the author array it came from, which was one cell too.
    """
    entry = F.struct("pos", F.struct("name", *fields).alias("info"))
    gathered = attached.groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("e"))
    return gathered.select(key, F.col("e.info").alias("authors_info"))


def enrich_with_authors(
    papers: DataFrame,
    profiles: Mapping[str, DataFrame],
    order: Sequence[str],
    enabled: bool = True,
    key: str = "id",
) -> DataFrame:
    """Add `authors_info`; off, or without sources, the papers pass unchanged."""
    if not enabled or not order:
        return papers
    named = papers.select(key, "authors")  # the wide rows meet only the result
    attached = attach_profiles(unnest_authors(named, key), profiles, order)
    nested = nest_authors(attached, key)
    return papers.join(nested, key, "left").withColumn(
        "authors_info",
        F.coalesce("authors_info", F.array().cast(nested.schema["authors_info"].dataType)),
    )


def author_cards(resolved: DataFrame) -> DataFrame:
    """Profiles as shown: numbers or "N/A", the first affiliation or "N/A"."""
    return resolved.select(
        "name",
        shown_number(F.col("h_index")).alias("h_index"),
        first_or_default(F.col("affiliations")).alias("affiliation"),
        "source_used",
    )


def author_metrics(citations: DataFrame) -> DataFrame:
    """Per `author`: `paper_count`, `citation_count`, `h_index` from rows
    (`author`, `citations`), one per paper.

    An h-index of h needs h papers with h citations each, so h * h is at most the
    author's citations. Counts above the root of the largest total are cut to it and
    equal counts merge: the window sees at most root + 1 rows for any author, however
    many papers that author has.
    """
    whole = F.floor(F.coalesce("citations", F.lit(0))).cast("long")
    rows = citations.select("author", whole.alias("c"))
    totals = rows.groupBy("author").agg(
        F.count(F.lit(1)).alias("paper_count"),
        F.sum("c").alias("citation_count"),
        F.sum(F.greatest("c", F.lit(0))).alias("positive"),
    )
    largest = F.coalesce(F.max("positive"), F.lit(0))
    bound = totals.agg(F.ceil(F.sqrt(largest)).alias("bound")).scalar()
    merged = rows.groupBy("author", F.least("c", bound).alias("c")).agg(
        F.count(F.lit(1)).alias("n")
    )
    most_first = W.partitionBy("author").orderBy(F.desc("c"))
    at_least = F.sum("n").over(most_first.rowsBetween(W.unboundedPreceding, 0))
    indexed = (
        merged.select("author", F.least("c", at_least).alias("h"))
        .groupBy("author")
        .agg(F.greatest(F.max("h"), F.lit(0)).alias("h_index"))
    )
    return totals.drop("positive").join(indexed, "author")
