"""Responses, scores, batched inference and the evaluation store."""

from __future__ import annotations

import hashlib
from dataclasses import replace

from pyspark.sql import functions as F

from folioscope.functions.prompts import TEMPLATES, render
from folioscope.functions.responses import accept_insight, parse_insight, parse_rating, strip_fence
from folioscope.functions.scoring import insight_bonus
from folioscope.operators.counts import run_counts, with_route
from folioscope.functions.matching import relevant
from folioscope.operators.evaluations import (
    evaluation_key,
    fold_patches,
    hits,
    lookup,
    misses,
    sequence_of,
    upsert,
)
from folioscope.operators.inference import evaluate_papers, infer, rate_responses
from folioscope.operators.sentences import key_sentence
from folioscope.plans.analysis import analyse, language_of
from folioscope.schemas import EVALUATION_FIELDS
from suite import params as P
from suite.ctes import ANY_KEYWORD, HAYSTACK, ON_TOPIC, RECENT, bonus, sql
from suite.registry import query
from suite.text_queries import _quoted
from suite.views import evaluation_store, papers, scored, table, with_response


def _cleaned(spark, sf_dir):
    answered = with_response(papers(spark, sf_dir))
    return answered.withColumn("content", strip_fence(F.col("response")))


@query(
    "strip_fence",
    sql("SELECT id, response, content FROM responses JOIN cleaned USING (id)", "cleaned"),
)
def fence(spark, sf_dir):
    return _cleaned(spark, sf_dir).select("id", "response", "content")


@query(
    "parse_response",
    sql(
        "SELECT id, innovation, rigor, impact, CASE WHEN ok THEN 'ok' ELSE 'invalid' END "
        "AS parse_status, CASE WHEN NOT ok THEN content END AS raw FROM parsed",
        "parsed",
    ),
)
def parse(spark, sf_dir):
    read = _cleaned(spark, sf_dir).select("id", parse_rating(F.col("content")).alias("r"))
    return read.select("id", "r.parsed.*", "r.parse_status", "r.raw")


@query("rubric_score", sql("SELECT * FROM rated", "rated"))
def rubric(spark, sf_dir):
    cleaned = _cleaned(spark, sf_dir).select("id", "content")
    return rate_responses(cleaned, "content").drop("content")


@query(
    "insight_accept",
    sql(
        """
        SELECT id, CASE WHEN lang <> 'es' THEN md5(title) ELSE md5(summary) END AS abstract_md5,
               CASE WHEN lang NOT IN ('es', 'fr') THEN pdf_url ELSE '（LLM 提取失败）' END
                 AS breakthrough,
               lang NOT IN ('es', 'fr') AS accepted
        FROM (SELECT * REPLACE (CASE WHEN lang = 'fr' THEN summary ELSE title END AS title)
              FROM papers)""",
        "papers",
    ),
)
def accept(spark, sf_dir):
    """Spanish answers are not JSON, French ones have a null breakthrough."""
    answer = F.to_json(
        F.struct(
            F.col("title").alias("abstract"),
            F.when(F.col("lang") != "fr", F.col("pdf_url")).alias("breakthrough"),
        ),
        {"ignoreNullFields": "false"},
    )
    content = F.when(F.col("lang") == "es", F.lit("no answer")).otherwise(answer)
    read = papers(spark, sf_dir).select(
        "id", "summary", parse_insight(content)["parsed"].alias("p")
    )
    judged = read.select("id", accept_insight(F.col("p"), F.col("summary")).alias("a"))
    return judged.select(
        "id",
        F.md5("a.abstract").alias("abstract_md5"),
        "a.breakthrough",
        "a.accepted",
    )


@query(
    "insight_bonus",
    sql(
        f"SELECT id, language, ({bonus('summary')}) / 10.0::DOUBLE AS summary_bonus, "
        f"({bonus('title')}) / 10.0::DOUBLE AS title_bonus FROM labelled",
        "labelled",
    ),
)
def bonus_of_texts(spark, sf_dir):
    labelled = papers(spark, sf_dir).withColumn(
        "language", language_of("summary", P.CONFIG)
    )
    language = F.col("language")
    return labelled.select(
        "id",
        "language",
        insight_bonus(F.col("summary"), language, P.RULES).alias("summary_bonus"),
        insight_bonus(F.col("title"), language, P.RULES).alias("title_bonus"),
    )


@query(
    "key_sentence",
    sql("SELECT id, language, breakthrough, insight_bonus FROM insights", "insights"),
)
def best_sentence(spark, sf_dir):
    labelled = papers(spark, sf_dir).select(
        "id", "summary", language_of("summary", P.CONFIG).alias("language")
    )
    return key_sentence(labelled, rules=P.RULES).select(
        "id",
        "language",
        "breakthrough",
        (F.col("bonus_tenths") / F.lit(10.0)).alias("insight_bonus"),
    )


@query(
    "final_score",
    sql("SELECT id, total_score, insight_bonus, final_score FROM scored", "scored"),
)
def final(spark, sf_dir):
    return scored(spark, sf_dir).select("id", "total_score", "insight_bonus", "final_score")


# The stand-in models are closures, so they travel to the workers by value.


def _digest_model():
    """Its answer depends on every character of the prompt."""

    def run(prompts):
        digests = [hashlib.md5(p.encode("utf-8")).hexdigest() for p in prompts]
        return [f'```json\n{{"digest": "{d}"}}\n```' for d in digests]

    return run


def _length_model():
    """Rates by prompt length."""

    def run(prompts):
        return [
            f'{{"innovation": {1 + n % 7}, "rigor": {1 + n % 9}, "impact": {1 + n % 10}}}'
            for n in map(len, prompts)
        ]

    return run


def _sql_prompt(template: str, slot: str, column: str) -> str:
    head, tail = template.split(slot)
    plain = [_quoted(p.replace("{{", "{").replace("}}", "}")) for p in (head, tail)]
    return f"{plain[0]} || {column} || {plain[1]}"


_RATING_PROMPT = _sql_prompt(TEMPLATES["rating"], "{full_text}", "summary")
_TRANSLATION_PROMPT = _sql_prompt(TEMPLATES["translation"], "{abstract}", "summary")


@query(
    "batch_infer",
    sql(
        f"""SELECT id AS paper_id, 'rating' AS task,
               '{{"digest": "' || md5({_RATING_PROMPT}) || '"}}' AS raw_response,
               CAST(NULL AS VARCHAR) AS error
        FROM papers""",
        "papers",
    ),
)
def batch_infer(spark, sf_dir):
    prompt = render(TEMPLATES["rating"], {"full_text": F.col("summary")})
    pending = papers(spark, sf_dir).select(
        F.col("id").alias("paper_id"), prompt.alias("prompt")
    )
    return infer(pending, "rating", _digest_model())


@query(
    "evaluate_papers",
    sql(
        f"""
        SELECT id AS paper_id, coalesce(s.innovation, i) AS innovation, coalesce(s.rigor, r) AS rigor,
               coalesce(s.impact, m) AS impact,
               coalesce(s.total_score, round((i + r + m) / 3, 2)) AS total_score,
               CASE WHEN s.paper_id IS NULL THEN 'model' ELSE 'stored' END AS source,
               'ok' AS parse_status, CAST(NULL AS VARCHAR) AS error
        FROM (SELECT id, (1 + n % 7)::DOUBLE AS i, (1 + n % 9)::DOUBLE AS r, (1 + n % 10)::DOUBLE AS m
              FROM (SELECT id, length({_RATING_PROMPT}) AS n FROM papers))
        LEFT JOIN store s ON s.paper_id = id""",
        "papers",
        "store",
    ),
)
def evaluate(spark, sf_dir):
    work = papers(spark, sf_dir).select(F.col("id").alias("paper_id"), "summary")
    prompt = render(TEMPLATES["rating"], {"full_text": F.col("summary")})
    store = evaluation_store(spark, sf_dir)
    return evaluate_papers(work, store, prompt, _length_model()).drop("raw_response")


@query(
    "translation_pending",
    sql(
        f"""
        SELECT id AS paper_id, md5({_TRANSLATION_PROMPT}) AS prompt_md5 FROM papers
        WHERE id NOT IN (SELECT paper_id FROM store WHERE translation IS NOT NULL)""",
        "papers",
        "store",
    ),
)
def translation_pending(spark, sf_dir):
    work = papers(spark, sf_dir).select(F.col("id").alias("paper_id"), "summary")
    prompt = render(TEMPLATES["translation"], {"abstract": F.col("summary")})
    prompts = work.select("paper_id", F.md5(prompt).alias("prompt_md5"))
    return misses(prompts, evaluation_store(spark, sf_dir), "translation")


def _unreliable_model():
    """Rates by prompt length and breaks down on every tenth length."""
    rate = _length_model()

    def run(prompts):
        if any(len(p) % 10 == 0 for p in prompts):
            raise RuntimeError("model is down")
        return rate(prompts)

    return run


_RUN_PROMPT = _sql_prompt(TEMPLATES["rating"], "{full_text}", "summary")
_RUN_WORD = "ention"


@query(
    "analysis_run",
    sql(
        f"""
        SELECT id, CASE WHEN bad THEN 0 WHEN s.paper_id IS NOT NULL THEN s.total_score
                        WHEN n % 10 = 0 THEN 0 ELSE round((i + r + m) / 3, 2) END AS total_score,
               CASE WHEN bad THEN 'Failed to parse paper, error: broken page'
                    WHEN s.paper_id IS NULL AND n % 10 = 0 THEN 'rating: model is down' END AS error,
               CASE WHEN bad OR (s.paper_id IS NULL AND n % 10 = 0) THEN 'quarantine'
                    ELSE 'good' END AS route
        FROM (SELECT id, n, (1 + n % 7)::DOUBLE AS i, (1 + n % 9)::DOUBLE AS r,
                     (1 + n % 10)::DOUBLE AS m,
                     id IN (SELECT CAST(page_id AS VARCHAR) FROM pages WHERE page_id % 3 = 0) AS bad
              FROM (SELECT id, length({_RUN_PROMPT}) AS n FROM papers
                    WHERE {RECENT} AND {ON_TOPIC} AND contains({HAYSTACK}, '{_RUN_WORD}')))
        LEFT JOIN store s ON s.paper_id = id""",
        "papers",
        "store",
    ),
)
def analysis_run(spark, sf_dir):
    """The batch run: some pages can't be read, some ratings are stored, some calls fail."""
    pages = table(spark, sf_dir, "pages").where("page_id % 3 = 0")
    broken = pages.select(F.col("page_id").cast("string").alias("id"), F.lit(True).alias("broken"))
    found = papers(spark, sf_dir).drop("lang", "source", "n_chars")
    texts = found.select("id", "summary").join(broken, "id", "left").select(
        "id",
        F.when(F.col("broken").isNull(), F.col("summary")).alias("full_text"),
        F.when(F.col("broken"), F.lit("broken page")).alias("error"),
    )
    cfg = replace(P.CONFIG, keywords=(_RUN_WORD,), waves=2, parallelism=8)
    key = evaluation_key(F.col("paper_id"), cfg.model, cfg.prompt_version)
    known = evaluation_store(spark, sf_dir).withColumn("paper_id", key)
    store = known.select(
        "paper_id",
        *[
            F.col(f) if f in known.columns else F.lit(None).cast("string").alias(f)
            for f in EVALUATION_FIELDS
        ],
    )
    run = analyse(found, texts, store, {"rating": _unreliable_model()}, cfg)
    both = run.scored.select(run.failed.columns).unionByName(run.failed)
    return with_route(both.select("id", "total_score", "error"))


def _keyed(spark, sf_dir):
    return papers(spark, sf_dir).select(F.col("id").alias("paper_id"), "source", "n_chars")


@query(
    "cache_lookup",
    sql(
        "SELECT id AS paper_id, source, n_chars, innovation, impact, total_score, translation "
        "FROM papers LEFT JOIN store ON paper_id = id",
        "papers",
        "store",
    ),
)
def cache_lookup(spark, sf_dir):
    return lookup(_keyed(spark, sf_dir), evaluation_store(spark, sf_dir)).drop(
        "rigor", "raw_response"
    )


_HIT = "id IN (SELECT paper_id FROM store WHERE translation IS NOT NULL)"


@query(
    "cache_hits",
    sql(f"SELECT id AS paper_id, source, n_chars FROM papers WHERE {_HIT}", "papers", "store"),
)
def cache_hits(spark, sf_dir):
    return hits(_keyed(spark, sf_dir), evaluation_store(spark, sf_dir), "translation")


@query(
    "cache_misses",
    sql(f"SELECT id AS paper_id, source, n_chars FROM papers WHERE NOT {_HIT}", "papers", "store"),
)
def cache_misses(spark, sf_dir):
    return misses(_keyed(spark, sf_dir), evaluation_store(spark, sf_dir), "translation")


@query(
    "cache_upsert",
    sql(
        """
        SELECT coalesce(g.key, s.paper_id) AS paper_id, innovation, impact,
               coalesce(g.url, s.translation) AS translation
        FROM store s FULL JOIN (SELECT CAST(page_id AS VARCHAR) AS key, url FROM pages) g
          ON g.key = s.paper_id""",
        "store",
    ),
)
def cache_upsert(spark, sf_dir):
    patch = table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("string").alias("paper_id"),
        F.lit(None).cast("double").alias("innovation"),
        F.lit(None).cast("double").alias("impact"),
        F.col("url").alias("translation"),
    )
    fields = ["innovation", "impact", "translation"]
    return upsert(evaluation_store(spark, sf_dir), patch, fields)


_FIELDS = ("view", "signup", "error", "click", "purchase")


@query(
    "cache_fold",
    "SELECT user_id, "
    + ", ".join(
        f"arg_max(value, (ts, event_id)) FILTER (event_type = '{f}') AS {f}" for f in _FIELDS
    )
    + " FROM events GROUP BY user_id",
)
def cache_fold(spark, sf_dir):
    order = sequence_of(F.col("ts"), F.col("event_id"))
    return fold_patches(
        table(spark, sf_dir, "events"),
        _FIELDS,
        key="user_id",
        field="event_type",
        value="value",
        seq=order,
    )


_COUNTS = (
    f"count(*) AS fetched, count(*) FILTER ({ON_TOPIC} AND {ANY_KEYWORD}) AS total, "
    f"count(*) FILTER ({ON_TOPIC} AND {ANY_KEYWORD} AND parse_status = 'ok') AS analysed"
)


@query(
    "run_counts",
    sql(
        f"SELECT *, least(analysed, {P.TOP_K}) AS exported, "
        f"CASE WHEN total > 0 THEN least(analysed::DOUBLE / total, 1) END AS progress "
        f"FROM (SELECT {_COUNTS} FROM papers JOIN rated USING (id))",
        "rated",
    ),
)
def counts(spark, sf_dir):
    rated = rate_responses(_cleaned(spark, sf_dir), "content")
    ok = F.col("parse_status") == "ok"
    return run_counts(rated, relevant(P.KEYWORDS, P.EXCLUSIONS), ok, P.TOP_K)


@query(
    "quarantine_split",
    sql(
        "SELECT id, total_score, CASE WHEN parse_status = 'invalid' THEN content END AS error, "
        "CASE WHEN parse_status = 'ok' THEN 'good' ELSE 'quarantine' END AS route "
        "FROM rated JOIN cleaned USING (id)",
        "rated",
    ),
)
def quarantine(spark, sf_dir):
    rated = rate_responses(_cleaned(spark, sf_dir).select("id", "content"), "content")
    bad = F.when(F.col("parse_status") == "invalid", F.col("content"))
    return with_route(rated.select("id", "total_score", bad.alias("error")))
