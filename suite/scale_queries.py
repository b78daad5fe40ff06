"""Keyword tables, language profiles, scans over ranges, stored tables and their filters."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from folioscope.cluster import new_run_dir
from folioscope.fixed_values import FLAT_SOURCE, NESTED_SOURCE
from folioscope.operators.author_lookup import LookupSource, lookup_authors
from folioscope.operators.authors import unnest_authors
from folioscope.operators.evaluation_table import EvaluationTable
from folioscope.operators.extraction import content_status
from folioscope.operators.language_profiles import FACTORS, SLOTS, label_languages, learn_profiles
from folioscope.operators.membership import pending_by_filter, settled_filter
from folioscope.operators.phrases import match_phrases, phrase_table
from folioscope.operators.ranking import number_all, running_top_k
from folioscope.sources.papers import newest_dated
from folioscope.sources.profiles import from_flat_payload, from_nested_payload
from suite.ctes import BEST_FIRST, HAYSTACK, sql
from suite.registry import query
from suite.views import authored_papers, evaluation_store, papers, scored, table

PHRASE_LETTERS = 6
RUNNING_K = 5


@query(
    "keyword_table",
    sql(
        f"""
        SELECT id, coalesce(string_agg(phrase, '|' ORDER BY phrase), '') AS phrases
        FROM papers LEFT JOIN (
          SELECT DISTINCT lower(left(text, {PHRASE_LETTERS})) AS phrase FROM conversations
          WHERE text <> '') ON contains({HAYSTACK}, phrase)
        GROUP BY id""",
        "papers",
    ),
)
def keyword_table(spark, sf_dir):
    """The first letters of every conversation's turns as a table of keywords."""
    turns = table(spark, sf_dir, "conversations")
    phrases = phrase_table(turns.select(F.substring("text", 1, PHRASE_LETTERS).alias("phrase")))
    found = match_phrases(papers(spark, sf_dir), phrases)
    return found.select("id", F.array_join("phrases", "|").alias("phrases"))


@query(
    "language_profiles",
    f"""
    WITH letters AS (
      SELECT doc_id, lang, list_transform(string_split(lower(text), ''), lambda c: unicode(c)) AS c
      FROM documents),
    grams AS (
      SELECT doc_id, lang,
        (c[i] * {FACTORS[0]} + c[i + 1] * {FACTORS[1]} + c[i + 2] * {FACTORS[2]}) % {SLOTS} AS slot
      FROM (SELECT *, unnest(range(1, len(c) - 1)) AS i FROM letters)),
    counts AS (
      SELECT lang, slot, count(*) AS n FROM grams
      WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY ALL),
    totals AS (SELECT lang, sum(n) AS t FROM counts GROUP BY ALL),
    shares AS (
      SELECT lang, slot, ln((coalesce(n, 0) + 0.5::DOUBLE) / (t + 0.5::DOUBLE * {SLOTS})) AS share
      FROM totals CROSS JOIN (SELECT unnest(range({SLOTS})) AS slot) LEFT JOIN counts USING (lang, slot)),
    weights AS (
      SELECT lang AS language, slot,
        floor(1000 * (share - avg(share) OVER (PARTITION BY slot)) + 0.5)::BIGINT AS weight
      FROM shares),
    sums AS (
      SELECT doc_id, language, sum(weight) AS s FROM grams JOIN weights USING (slot) GROUP BY ALL),
    ranked AS (
      SELECT *, s - lead(s) OVER w AS ahead, row_number() OVER w AS place FROM sums
      WINDOW w AS (PARTITION BY doc_id ORDER BY s DESC, language))
    SELECT CAST(doc_id AS VARCHAR) AS id, coalesce(language, 'en') AS language,
      coalesce(ahead, 0)::BIGINT AS language_lead
    FROM documents LEFT JOIN (FROM ranked WHERE place = 1) USING (doc_id)""",
)
def language_profiles(spark, sf_dir):
    """Profiles learnt from the documents that have labels, applied to all of them."""
    known = table(spark, sf_dir, "labels").select("doc_id").distinct()
    documents = table(spark, sf_dir, "documents")
    learnt = documents.join(known, "doc_id", "left_semi").select("text", F.col("lang").alias("label"))
    rows = documents.select(F.col("doc_id").cast("string").alias("id"), "text")
    found = label_languages(rows, learn_profiles(learnt))
    return found.select("id", "language", "language_lead")


@query(
    "rank_all_numbered",
    sql(
        f"SELECT row_number() OVER (ORDER BY {BEST_FIRST}) AS rank, id, final_score FROM scored",
        "scored",
    ),
)
def rank_all_numbered(spark, sf_dir):
    narrow = scored(spark, sf_dir).select("id", "published", "final_score")
    return number_all(narrow).select("rank", "id", "final_score")


@query(
    "running_topk",
    sql(
        f"""
        SELECT id, source, array_to_string(
          list_transform(list_sort(so_far)[1:{RUNNING_K}], lambda x: x.id), ',') AS best_ids
        FROM (
          SELECT id, source, list({{'s': -coalesce(final_score, 0),
              't': coalesce(-epoch_us(published), 9223372036854775807), 'id': id}})
            OVER (PARTITION BY source ORDER BY published NULLS FIRST, id ROWS UNBOUNDED PRECEDING)
            AS so_far
          FROM (SELECT * REPLACE (nullif(source, 'src3') AS source,
                CASE WHEN n_chars % 11 > 0 THEN published END AS published) FROM scored))""",
        "scored",
    ),
)
def running_topk(spark, sf_dir):
    """The five best papers of the source so far; one source and some times are missing."""
    narrow = scored(spark, sf_dir).select(
        "id",
        F.nullif("source", F.lit("src3")).alias("source"),
        F.when(F.col("n_chars") % 11 > 0, F.col("published")).alias("published"),
        "final_score",
    )
    found = running_top_k(narrow, "source", RUNNING_K)
    return found.select("id", "source", F.array_join("best_ids", ",").alias("best_ids"))


@query(
    "store_upserts",
    sql("", "store")
    + """, first AS (
          SELECT coalesce(p.k, s.paper_id) AS paper_id, innovation, impact,
                 coalesce(p.url, s.translation) AS translation
          FROM store s FULL JOIN (SELECT CAST(page_id AS VARCHAR) AS k, url FROM pages) p
            ON p.k = s.paper_id),
        second AS (
          SELECT coalesce(p.k, s.paper_id) AS paper_id, innovation, coalesce(p.n, impact) AS impact,
                 translation
          FROM first s FULL JOIN (
            SELECT CAST(doc_id AS VARCHAR) AS k, n_chars::DOUBLE AS n FROM documents
            WHERE lang = 'de') p ON p.k = s.paper_id)
        SELECT coalesce(p.k, s.paper_id) AS paper_id, coalesce(p.n, innovation) AS innovation,
               impact, translation
        FROM second s FULL JOIN (
          SELECT CAST(item_id AS VARCHAR) AS k, length(text)::DOUBLE AS n FROM benchmark) p
          ON p.k = s.paper_id""",
)
def store_upserts(spark, sf_dir):
    """A stored table after three patches, each of which rewrites the buckets it touches."""
    fields = "paper_id STRING, innovation DOUBLE, impact DOUBLE, translation STRING"
    shape = spark.createDataFrame([], fields).schema
    stored = EvaluationTable(spark, new_run_dir(spark, "evaluations"), shape, buckets=32)
    stored.upsert(evaluation_store(spark, sf_dir).select(*shape.names))
    none = F.lit(None).cast("double")
    pages = table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("string").alias("paper_id"),
        none.alias("innovation"),
        none.alias("impact"),
        F.col("url").alias("translation"),
    )
    german = table(spark, sf_dir, "documents").where("lang = 'de'").select(
        F.col("doc_id").cast("string").alias("paper_id"),
        none.alias("innovation"),
        F.col("n_chars").cast("double").alias("impact"),
        F.lit(None).cast("string").alias("translation"),
    )
    items = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("paper_id"),
        F.length("text").cast("double").alias("innovation"),
        none.alias("impact"),
        F.lit(None).cast("string").alias("translation"),
    )
    for patch in (pages, german, items):
        stored.upsert(patch)
    return stored.read()


@query(
    "pending_by_filter",
    sql(
        "SELECT id, pdf_url FROM papers p WHERE NOT EXISTS "
        "(SELECT 1 FROM labels l WHERE CAST(l.doc_id AS VARCHAR) = p.id)",
        "papers",
    ),
)
def pending(spark, sf_dir):
    stored = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"))
    wanted = papers(spark, sf_dir).select("id", "pdf_url")
    return pending_by_filter(wanted, stored, settled_filter(stored))


@query(
    "newest_dated",
    sql(
        "SELECT id, published, source FROM papers ORDER BY published DESC, id LIMIT 200",
        "papers",
    ),
)
def dated(spark, sf_dir):
    """The newest papers of a table in folders by day."""
    path = new_run_dir(spark, "dated")
    rows = papers(spark, sf_dir).select("id", "published", "source")
    rows.withColumn("date", F.to_date("published")).repartition("date").write.partitionBy(
        "date"
    ).parquet(path)
    return newest_dated(spark, path).select("id", "published", "source")


@query(
    "content_cache_status",
    sql(
        """
        SELECT id AS basename, 'structured' AS parser, sha256(summary) AS digest,
               sha256(summary) IN (
                 SELECT sha256(CASE WHEN quality = 1 THEN d.text ELSE d.text || '.' END)
                 FROM documents d JOIN labels USING (doc_id)) AS cached
        FROM papers""",
        "papers",
    ),
)
def content_cache(spark, sf_dir):
    """Labelled papers were parsed before; those of quality 0 have lost a full stop since."""
    files = papers(spark, sf_dir).select(
        F.col("id").alias("basename"),
        F.lit("structured").alias("parser"),
        F.encode("summary", "UTF-8").alias("content"),
    )
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    text = F.when(F.col("quality") == 1, F.col("text")).otherwise(F.concat("text", F.lit(".")))
    parsed = documents.join(labels, "doc_id").select(
        F.lit("structured").alias("parser"), F.sha2(text.cast("binary"), 256).alias("digest")
    )
    return content_status(files, parsed).select("basename", "parser", "digest", "cached")


def ask_flat(names):
    """The first service knows two customers of three, and fails on some calls."""
    numbers = [int(n[-9:]) for n in names]
    if any(n % 97 == 0 for n in numbers):
        raise OSError("the service is busy")
    hit = [{"hIndex": n % 40, "paperCount": n, "citationCount": 2 * n} for n in numbers]
    return [json.dumps({"data": [h] if n % 3 else []}) for n, h in zip(numbers, hit, strict=True)]


def ask_nested(names):
    """The second one knows the even ones."""
    numbers = [int(n[-9:]) for n in names]
    return [
        json.dumps({"results": [{"works_count": n + 7, "cited_by_count": 3 * n}]}) if n % 2 == 0 else None
        for n in numbers
    ]


@query(
    "author_lookup",
    sql(
        """
        SELECT name,
          CASE WHEN n % 3 > 0 AND n % 97 > 0 THEN n % 40 END AS h_index,
          CASE WHEN n % 3 > 0 AND n % 97 > 0 THEN n WHEN n % 2 = 0 THEN n + 7 END AS paper_count,
          CASE WHEN n % 3 > 0 AND n % 97 > 0 THEN 2 * n WHEN n % 2 = 0 THEN 3 * n END AS citation_count,
          CASE WHEN n % 3 > 0 AND n % 97 > 0 THEN 'semantic_scholar'
               WHEN n % 2 = 0 THEN 'openalex' ELSE 'none' END AS source_used
        FROM (SELECT DISTINCT name, CAST(right(name, 9) AS INTEGER) AS n FROM authored)""",
        "authored",
    ),
)
def author_lookup(spark, sf_dir):
    """Every author asked of two services in turn, of which the first is at times busy."""
    sources = [
        LookupSource(FLAT_SOURCE, ask_flat, from_flat_payload),
        LookupSource(NESTED_SOURCE, ask_nested, from_nested_payload),
    ]
    names = unnest_authors(authored_papers(spark, sf_dir))
    found = lookup_authors(names, sources, new_run_dir(spark, "lookups"))
    return found.drop("affiliations")
