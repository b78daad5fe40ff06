"""Ranking, exports and the stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope import fixed_values as V
from folioscope.cluster import new_run_dir, settle
from folioscope.functions.display import iso_text
from folioscope.operators.filters import filter_papers
from folioscope.operators.ranking import number_top_k, rank_all, running_best, top_k
from folioscope.sinks.exports import api_envelope, csv_view, full_view, json_rows
from folioscope.sinks.report import REPORT_TITLE, paper_cards, report_lines, report_sections
from folioscope.sources.papers import within_days
from folioscope.streaming.ranking_stream import rank_stream, read_best, read_progress
from folioscope.streaming.source_topk import (
    PROVIDER,
    PROVIDER_KEY,
    rank_by_source,
    read_source_best,
)
from suite import params as P
from suite.ctes import BEST_FIRST, sql
from suite.registry import query
from suite.views import as_papers, papers, score, scored, table

_SHOWN = (
    "id",
    "title",
    "published",
    "final_score",
    "total_score",
    "insight_bonus",
    "innovation",
    "rigor",
    "impact",
    "language",
    "breakthrough",
)
_COLUMNS = ", ".join(_SHOWN)


def _with_gaps(rows):
    """A column that is missing for most papers."""
    return rows.withColumn("translation", F.when(F.col("language") == "de", F.col("title")))


_GAPS = "CASE WHEN language = 'de' THEN title END"


#: Batches that the documents arrive in.
_BATCHES = 4


def _arriving(spark, sf_dir):
    """The documents as a stream of several batches.

    The files are as many as the table's own splits, so that all cores write them.
    """
    source, documents = new_run_dir(spark, "arriving"), table(spark, sf_dir, "documents")
    files = max(_BATCHES, documents.rdd.getNumPartitions())
    documents.repartition(files, "doc_id").write.parquet(source)
    stream = spark.readStream.schema(documents.schema)
    stream = stream.option("maxFilesPerTrigger", -(-files // _BATCHES))
    return as_papers(stream.parquet(source))


def _candidates(spark, sf_dir):
    """Scores of the relevant papers of the time window; the long texts stay behind."""
    recent = within_days(papers(spark, sf_dir), P.AS_OF, P.DAYS)
    chosen = filter_papers(recent, P.KEYWORDS, P.EXCLUSIONS)
    return score(chosen).select(*_SHOWN)


@query("insight_topk", sql(f"SELECT {_COLUMNS} FROM best", "best"))
def insight_topk(spark, sf_dir):
    return top_k(_candidates(spark, sf_dir), P.TOP_K)


@query("rank_all", sql(f"SELECT id, published, final_score FROM scored ORDER BY {BEST_FIRST}", "scored"))
def ranked(spark, sf_dir):
    narrow = scored(spark, sf_dir).select("id", "published", "final_score")
    return rank_all(settle(narrow))


@query("topk_ranked", sql("SELECT rank, id, title, final_score FROM best", "best"))
def numbered(spark, sf_dir):
    best = number_top_k(_candidates(spark, sf_dir), P.TOP_K)
    return best.select("rank", "id", "title", "final_score")


@query(
    "running_best",
    sql(
        "SELECT id, source, published, final_score, max(final_score) OVER (PARTITION BY source "
        "ORDER BY published NULLS FIRST, id ROWS UNBOUNDED PRECEDING) AS best_so_far "
        "FROM (SELECT * REPLACE (nullif(source, 'src3') AS source, "
        "CASE WHEN n_chars % 11 > 0 THEN published END AS published) FROM scored)",
        "scored",
    ),
)
def running(spark, sf_dir):
    """One source and some of the times are missing."""
    narrow = scored(spark, sf_dir).select(
        "id",
        F.nullif("source", F.lit("src3")).alias("source"),
        F.when(F.col("n_chars") % 11 > 0, F.col("published")).alias("published"),
        "final_score",
    )
    return running_best(narrow, "source")


@query(
    "paper_card",
    sql(
        f"""
        SELECT id, '{V.PAPER_KEY_PREFIX}' || id AS paper_key, title,
               strftime(published, '%Y-%m-%d') AS published_day,
               '{V.ABSTRACT_PAGE}' || id AS abstract_link,
               '{V.PDF_PAGE}' || id AS pdf_link,
               CASE language WHEN 'zh' THEN '{V.LABEL_ZH}' ELSE '{V.LABEL_OTHER}' END AS language_label,
               printf('%.2f (base %.2f, bonus %.2f)', final_score, total_score, insight_bonus)
                 AS score_line,
               '{V.NO_TRANSLATION}' AS translation, '{V.NO_MINDMAP}' AS mindmap_markdown
        FROM scored""",
        "scored",
    ),
)
def cards(spark, sf_dir):
    return paper_cards(scored(spark, sf_dir))


@query("export_csv_view", sql(f"SELECT {_COLUMNS} FROM best", "best"))
def csv_rows(spark, sf_dir):
    return csv_view(top_k(_candidates(spark, sf_dir), P.TOP_K))


_JSON = (
    "to_json(struct_pack(id := id, title := title, "
    "published := strftime(published, '%Y-%m-%dT%H:%M:%S+00:00'), "
    + ", ".join(f"{c} := {c}" for c in _SHOWN[3:])
    + f", translation := {_GAPS}))"
)


@query("export_json_rows", sql(f"SELECT id, CAST({_JSON} AS VARCHAR) AS json FROM candidates", "candidates"))
def json_documents(spark, sf_dir):
    shown = _candidates(spark, sf_dir).withColumn("published", iso_text(F.col("published")))
    return json_rows(_with_gaps(shown))


@query(
    "export_full_view",
    sql(
        "SELECT * REPLACE (CAST(to_json(authors) AS VARCHAR) AS authors, "
        "CAST(to_json(categories) AS VARCHAR) AS categories) FROM scored",
        "scored",
    ),
)
def full_rows(spark, sf_dir):
    """Every column of the scored papers."""
    return full_view(scored(spark, sf_dir).drop("response"))


_SECTION = f"""
    '## ' || rank || '. [' || title || ']({V.ABSTRACT_PAGE}' || id || ')'
      || chr(10) || chr(10) || '**Published**: ' || strftime(published, '%Y-%m-%d') || '  '
      || chr(10) || '**Score**: '
      || printf('%.2f (base %.2f, bonus %.2f)', final_score, total_score, insight_bonus)
      || '  ' || chr(10) || chr(10) || '{V.REPORT_GUIDE_HEADING}' || chr(10)
      || '> ' || breakthrough || chr(10) || chr(10)
      || '{V.REPORT_TRANSLATION_HEADING}' || chr(10) || '```text' || chr(10) || chr(10)
      || '```' || chr(10) || chr(10) || '{V.REPORT_MINDMAP_HEADING}' || chr(10)
      || '```markdown' || chr(10) || chr(10) || '```' || chr(10) || chr(10) || '---'"""


@query("report_sections", sql(f"SELECT rank, id, {_SECTION} AS section FROM best", "best"))
def sections(spark, sf_dir):
    return report_sections(number_top_k(_candidates(spark, sf_dir), P.TOP_K))


@query(
    "report_lines",
    sql(
        f"""
        SELECT '# {REPORT_TITLE}' || chr(10) || chr(10) || '- Keywords: {", ".join(P.KEYWORDS)}'
          || chr(10) || '- Time Window: Last {P.DAYS} days' || chr(10)
          || '- Total Papers Analyzed: ' || (SELECT count(*) FROM candidates) || chr(10)
          || '- Top ' || (SELECT count(*) FROM best) || ' Selected' || chr(10) AS value
        UNION ALL SELECT {_SECTION} FROM best""",
        "best",
    ),
)
def report(spark, sf_dir):
    """The whole report, header included."""
    found = settle(_candidates(spark, sf_dir))
    return report_lines(number_top_k(found, P.TOP_K), P.KEYWORDS, P.DAYS, found.count())


@query(
    "api_envelope",
    sql(
        f"""SELECT '{{"meta":{{"total":' || count(*) || ',"generated_at":"{P.GENERATED_AT}"}},"data":['
        || string_agg(CAST(to_json(struct_pack(id := id, final_score := final_score,
             published := strftime(published, '%Y-%m-%dT%H:%M:%S.000'), title := title,
             translation := {_GAPS})) AS VARCHAR),
             ',' ORDER BY rank) || ']}}' AS json
        FROM best""",
        "best",
    ),
)
def envelope(spark, sf_dir):
    rows = _with_gaps(_candidates(spark, sf_dir)).select(
        "id", "final_score", "published", "title", "translation"
    )
    return api_envelope(rows, P.TOP_K, P.GENERATED_AT)


@query(
    "stream_topk",
    sql(
        f"SELECT id, published, title, breakthrough, final_score, "
        f"(SELECT count(*) FROM scored) AS arrived, "
        f"(SELECT count(*) FROM scored WHERE parse_status = 'ok') AS analysed "
        f"FROM scored WHERE parse_status = 'ok' ORDER BY {BEST_FIRST} LIMIT {P.TOP_K}",
        "scored",
    ),
)
def stream(spark, sf_dir):
    """The documents as a stream of several batches; the state after the last one.

    Papers whose rating can't be read go to quarantine.
    """
    path, documents = new_run_dir(spark, "stream-topk"), table(spark, sf_dir, "documents")

    def score_batch(batch):
        unread = F.when(F.col("parse_status") != "ok", F.lit("unreadable rating"))
        return score(batch).select(
            "id", "published", "title", "breakthrough", "final_score", unread.alias("error")
        )

    writer = rank_stream(_arriving(spark, sf_dir), score_batch, P.TOP_K, path)
    writer.trigger(availableNow=True).start().awaitTermination()
    shape = score_batch(as_papers(documents)).schema
    counts = read_progress(spark, path).orderBy(F.desc("batch")).first()
    return (
        read_best(spark, path, shape)
        .drop("error")
        .withColumn("arrived", F.lit(counts["arrived"] if counts else 0).cast("long"))
        .withColumn("analysed", F.lit(counts["analysed"] if counts else 0).cast("long"))
    )


@query(
    "stream_source_topk",
    sql(
        f"""
        SELECT source, string_agg(id, ',' ORDER BY n) AS best_ids FROM (
          SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY {BEST_FIRST}) AS n
          FROM scored QUALIFY n <= {P.HEAD_CAP})
        GROUP BY source""",
        "scored",
    ),
)
def stream_by_source(spark, sf_dir):
    """The best papers of each source, kept in the stream's keyed state."""
    path = new_run_dir(spark, "stream-sources")
    # A session of its own, so that the caller's settings stay as they are.
    own = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set(PROVIDER_KEY, PROVIDER)
    rows = score(_arriving(own, sf_dir)).select("id", "source", "published", "final_score")
    rank_by_source(rows, P.HEAD_CAP, path).trigger(availableNow=True).start().awaitTermination()
    best = read_source_best(spark, path)
    return best.select("source", F.array_join("best_ids", ",").alias("best_ids"))
