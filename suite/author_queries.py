"""Authors."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.fixed_values import FLAT_SOURCE, NESTED_SOURCE
from folioscope.operators.authors import (
    author_cards,
    author_metrics,
    enrich_with_authors,
    resolve_authors,
    unnest_authors,
)
from folioscope.sources.profiles import from_flat_payload, from_nested_payload
from suite.ctes import sql
from suite.registry import query
from suite.views import authored_papers, flat_payloads, nested_payloads, table

_ORDER = (FLAT_SOURCE, NESTED_SOURCE)


def _profiles(spark, sf_dir):
    return {
        FLAT_SOURCE: from_flat_payload(flat_payloads(spark, sf_dir)),
        NESTED_SOURCE: from_nested_payload(nested_payloads(spark, sf_dir)),
    }


def _resolved(spark, sf_dir):
    names = unnest_authors(authored_papers(spark, sf_dir))
    return resolve_authors(names, _profiles(spark, sf_dir), _ORDER)


@query("author_unnest", sql("SELECT id, pos, name FROM authored", "authored"))
def unnest(spark, sf_dir):
    return unnest_authors(authored_papers(spark, sf_dir))


@query(
    "author_payload_normalize",
    sql(
        "SELECT name, h_index, paper_count, citation_count, affiliation AS affiliations, "
        "source_used FROM (SELECT * FROM flat UNION ALL SELECT * FROM nested)",
        "flat",
        "nested",
    ),
)
def normalize(spark, sf_dir):
    flat, nested = _profiles(spark, sf_dir).values()
    both = flat.unionByName(nested)
    return both.withColumn("affiliations", F.array_join("affiliations", "|"))


@query("author_resolve", sql("SELECT * FROM resolved", "resolved"))
def resolve(spark, sf_dir):
    resolved = _resolved(spark, sf_dir)
    return resolved.withColumn("affiliations", F.array_join("affiliations", "|"))


@query(
    "author_card",
    sql(
        "SELECT name, coalesce(CAST(h_index AS VARCHAR), 'N/A') AS h_index, "
        "CASE affiliations WHEN '' THEN 'N/A' ELSE affiliations END AS affiliation, "
        "source_used FROM resolved",
        "resolved",
    ),
)
def card(spark, sf_dir):
    return author_cards(_resolved(spark, sf_dir))


@query(
    "author_enrich",
    sql(
        """
        SELECT p.id, CAST(count(a.name) AS INTEGER) AS n_authors,
               coalesce(string_agg(a.name || ':' || coalesce(CAST(r.h_index AS VARCHAR), 'N/A')
                 || ':' || r.affiliations || ':' || r.source_used, ';' ORDER BY a.pos), '')
                 AS authors_info
        FROM (SELECT CAST(event_id AS VARCHAR) AS id FROM events) p
        LEFT JOIN authored a ON a.id = p.id
        LEFT JOIN resolved r ON r.name = a.name
        GROUP BY p.id""",
        "resolved",
    ),
)
def enrich(spark, sf_dir):
    enriched = enrich_with_authors(
        authored_papers(spark, sf_dir), _profiles(spark, sf_dir), _ORDER
    )
    shown = F.transform(
        "authors_info",
        lambda a: F.concat_ws(
            ":",
            a["name"],
            F.coalesce(a["h_index"].cast("string"), F.lit("N/A")),
            F.array_join(a["affiliations"], "|"),
            a["source_used"],
        ),
    )
    return enriched.select(
        "id",
        F.size("authors_info").alias("n_authors"),
        F.array_join(shown, ";").alias("authors_info"),
    )


@query(
    "author_metrics",
    """
    WITH papers AS (
      SELECT l_suppkey AS author, l_orderkey, CAST(floor(sum(l_quantity)) AS BIGINT) AS c
      FROM lineitem GROUP BY ALL),
    ranked AS (
      SELECT author, c, row_number() OVER (PARTITION BY author ORDER BY c DESC) AS n FROM papers)
    SELECT author, count(*) AS paper_count, CAST(sum(c) AS BIGINT) AS citation_count,
           count(*) FILTER (c >= n) AS h_index
    FROM ranked GROUP BY author""",
)
def metrics(spark, sf_dir):
    citations = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("author"), "l_orderkey")
        .agg(F.sum("l_quantity").alias("citations"))
    )
    return author_metrics(citations)
