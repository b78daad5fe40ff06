"""Scans, filters and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators.filters import (
    exclude_topics,
    filter_papers,
    head_cap,
    keyword_any,
)
from folioscope.sources.papers import (
    match_catalogue,
    newest,
    pending_content,
    within_days,
)
from suite import params as P
from suite.ctes import ANY_KEYWORD, HAYSTACK, ON_TOPIC, RECENT, sql, words
from suite.registry import query
from suite.views import papers, table

_CATS = ", ".join(f"'{c}'" for c in P.CATEGORIES)
_ROW = ("id", "title", "published")


@query(
    "scan_papers",
    sql(
        "SELECT id, title, md5(summary) AS summary_md5, pdf_url, published, "
        "array_to_string(authors, ',') AS authors, "
        "array_to_string(categories, ',') AS categories FROM papers",
        "papers",
    ),
)
def scan_papers(spark, sf_dir):
    return papers(spark, sf_dir).select(
        "id",
        "title",
        F.md5("summary").alias("summary_md5"),
        "pdf_url",
        "published",
        F.array_join("authors", ",").alias("authors"),
        F.array_join("categories", ",").alias("categories"),
    )


@query(
    "catalog_match",
    sql(
        f"SELECT id, title, published FROM papers "
        f"WHERE {words(P.CATALOGUE_KEYWORDS, HAYSTACK, ' AND ')} "
        f"AND list_has_any(categories, [{_CATS}])",
        "papers",
    ),
)
def catalog_match(spark, sf_dir):
    found = match_catalogue(papers(spark, sf_dir), P.CATALOGUE_KEYWORDS, P.CATEGORIES)
    return found.select(*_ROW)


@query(
    "newest_200",
    sql(
        "SELECT id, published, source FROM papers ORDER BY published DESC, id LIMIT 200",
        "papers",
    ),
)
def newest_200(spark, sf_dir):
    return newest(papers(spark, sf_dir).select("id", "published", "source"))


@query("time_window", sql(f"SELECT id, title, published FROM papers WHERE {RECENT}", "papers"))
def time_window(spark, sf_dir):
    return within_days(papers(spark, sf_dir).select(*_ROW), P.AS_OF, P.DAYS)


@query(
    "pending_content",
    sql(
        "SELECT id, pdf_url FROM papers p WHERE NOT EXISTS "
        "(SELECT 1 FROM labels l WHERE CAST(l.doc_id AS VARCHAR) = p.id)",
        "papers",
    ),
)
def pending(spark, sf_dir):
    stored = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"))
    return pending_content(papers(spark, sf_dir).select("id", "pdf_url"), stored)


@query("exclude_topics", sql(f"SELECT id, title, published FROM papers WHERE {ON_TOPIC}", "papers"))
def topics(spark, sf_dir):
    return exclude_topics(papers(spark, sf_dir), P.EXCLUSIONS).select(*_ROW)


@query("keyword_any", sql(f"SELECT id, title, published FROM papers WHERE {ANY_KEYWORD}", "papers"))
def keywords(spark, sf_dir):
    return keyword_any(papers(spark, sf_dir), P.KEYWORDS).select(*_ROW)


@query(
    "relevance_filter",
    sql(f"SELECT id, title, published FROM papers WHERE {ON_TOPIC} AND {ANY_KEYWORD}", "papers"),
)
def relevance(spark, sf_dir):
    return filter_papers(papers(spark, sf_dir), P.KEYWORDS, P.EXCLUSIONS).select(*_ROW)


@query(
    "head_cap",
    sql(
        f"SELECT id, published FROM papers WHERE {ON_TOPIC} AND {ANY_KEYWORD} "
        f"ORDER BY published DESC, id LIMIT {P.HEAD_CAP}",
        "papers",
    ),
)
def cap(spark, sf_dir):
    found = filter_papers(papers(spark, sf_dir), P.KEYWORDS, P.EXCLUSIONS)
    return head_cap(found.select("id", "published"), P.HEAD_CAP)
