"""The batch run: select, read, rate, score, enrich, rank."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from folioscope.cluster import broadcast_if_small, new_run_dir, settle
from folioscope.fixed_values import SURVEY_WORDS
from folioscope.functions.language import HAN, LetterClass, detect_language
from folioscope.functions.prompts import TEMPLATES, render, render_by_name, template_name
from folioscope.functions.responses import accept_insight, parse_insight
from folioscope.functions.scoring import BonusRules, final_score, insight_bonus
from folioscope.operators.authors import enrich_with_authors
from folioscope.operators.counts import observe_rows, observed_counts, split_failed
from folioscope.operators.evaluations import evaluation_key
from folioscope.operators.extraction import parse_outcome
from folioscope.operators.filters import filter_papers, head_cap
from folioscope.operators.inference import ModelFn, answered, infer_dealt, rate_responses
from folioscope.operators.sentences import key_sentence
from folioscope.schemas import EVALUATION_FIELDS, TASK_FIELD
from folioscope.sources.papers import search

_NUMBERS = ("innovation", "rigor", "impact", "total_score")


@dataclass(frozen=True)
class AnalysisConfig:
    """Parameters of a run. `as_of` is UTC. `max_papers=None` analyses everything.

    Users know caps of 20 (command line), 15 (batch) and 6 (streaming) papers, the
    newest 200 records, and 12,000 characters of text in a prompt (18,000 for the mind
    map). They kept a single process responsive, so they are off unless asked for:
    `max_papers`, `newest_limit`, `full_text_chars`, `outline_chars`.

    `parallelism` bounds the model calls at a time. Answers are committed in `waves`
    parts of the papers; a broken run loses at most the part it was in.
    """

    keywords: Sequence[str]
    as_of: datetime
    categories: Sequence[str] = ()
    days: int = 7
    top_k: int = 5
    newest_limit: int | None = None
    max_papers: int | None = None
    exclusions: Sequence[str] = SURVEY_WORDS
    languages: Sequence[LetterClass] = (HAN,)
    language_floor: float = 0.1
    rules: BonusRules = field(default_factory=BonusRules)
    templates: Mapping[str, str] = field(default_factory=lambda: dict(TEMPLATES))
    author_info: bool = False
    author_sources: Sequence[str] = ()
    model: str = "model"
    prompt_version: str = "1"
    full_text_chars: int | None = None
    outline_chars: int | None = None
    parallelism: int = 64
    waves: int = 8


def select_candidates(
    papers: DataFrame, cfg: AnalysisConfig, fetched: Observation | None = None
) -> DataFrame:
    """What the search finds, filtered and capped; `fetched` observes what it found."""
    found = search(
        papers, cfg.keywords, cfg.categories, cfg.as_of, cfg.days, cfg.newest_limit
    )
    if fetched is not None:
        found = observe_rows(found, fetched)
    return head_cap(filter_papers(found, cfg.keywords, cfg.exclusions), cfg.max_papers)


def language_of(text: str, cfg: AnalysisConfig) -> Column:
    return detect_language(F.col(text), cfg.languages, cfg.language_floor)


def add_scores(rated: DataFrame, rules: BonusRules = BonusRules()) -> DataFrame:
    """`insight_bonus` and `final_score` from `breakthrough`, `language`, `total_score`."""
    bonus = insight_bonus(F.col("breakthrough"), F.col("language"), rules)
    return rated.withColumn("insight_bonus", bonus).withColumn(
        "final_score", final_score(F.col("total_score"), F.col("insight_bonus"))
    )


def score_baseline(
    candidates: DataFrame, response: str, cfg: AnalysisConfig
) -> DataFrame:
    """Scores without a model for the insight: the key sentence stands in for it.

    `response` names the column with the cleaned rating response.
    """
    labelled = candidates.withColumn("language", language_of("summary", cfg))
    insight = key_sentence(labelled, "summary", "language", cfg.rules)
    rated = rate_responses(insight, response)
    # The bonus of the chosen sentence is known; it is not computed a second time.
    bonus = F.col("bonus_tenths") / F.lit(10.0)
    return (
        rated.withColumn("insight_bonus", bonus)
        .withColumn("final_score", final_score(F.col("total_score"), bonus))
        .drop("bonus_tenths")
    )


@dataclass(frozen=True)
class Analysis:
    """What a run gives.

    `scored`: the papers to rank, all of them rated. `failed`: the papers with an
    `error` (no text, a model failure, an unreadable rating), which no ranking holds.
    `patch`: the evaluation fields to keep, rows of this run only; merge them with
    `upsert`, or append them to a log that `fold_patches` reads. `counts`: papers that
    the search fetched, that are relevant (after the cap) and that were analysed, and how
    many the `top_k` best export.
    """

    scored: DataFrame
    failed: DataFrame
    patch: DataFrame
    counts: Mapping[str, int]


def analyse(
    papers: DataFrame,
    texts: DataFrame,
    store: DataFrame,
    models: Mapping[str, ModelFn],
    cfg: AnalysisConfig,
    profiles: Mapping[str, DataFrame] | None = None,
    run_dir: str | None = None,
) -> Analysis:
    """Select, read, ask the models, score and enrich.

    `texts`: `id`, `full_text`, `error`, one row per id. `store`: `paper_id` and the
    evaluation fields, one row per paper. `models`: a function per task ("rating",
    "insight", "translation", "mindmap"); a task without one keeps what the store has.

    Answers are kept under `run_dir` as they come: a run that broke and is started again
    with the same folder asks for nothing it has an answer to.

    Texts are scanned once: those of the papers with a task to do are written by wave,
    and each wave deals its own by id over `parallelism` partitions, where they become
    prompts. Of the store, only the rows of the candidates are read into the run, and none
    are rewritten.

    What was fetched, relevant and analysed is counted by observing the jobs that write
    these rows anyway (`Analysis.counts`).
    """
    spark = papers.sparkSession
    folder = run_dir or new_run_dir(spark, "analysis")
    key = evaluation_key(F.col("id"), cfg.model, cfg.prompt_version)
    detected = language_of("summary", cfg)
    fetched, relevant, analysed = Observation(), Observation(), Observation()
    chosen = observe_rows(select_candidates(papers, cfg, fetched), relevant)
    candidates = settle(chosen.withColumn("paper_id", key).withColumn("detected", detected))
    wanted = broadcast_if_small(candidates.select("paper_id"))
    known = settle(
        store.select("paper_id", *EVALUATION_FIELDS).join(wanted, "paper_id", "left_semi")
    )
    outcome = settle(
        parse_outcome(
            candidates.select("id", "summary"),
            texts.select("id", F.when(F.col("full_text").isNotNull(), "").alias("full_text"), "error")
            .join(broadcast_if_small(candidates.select("id")), "id", "left_semi"),
        ).select("id", F.col("error").alias("parse_error"))
    )
    path = f"{folder}/answers"
    _ask(candidates.join(outcome, "id"), texts, known, models, cfg, path)

    answers = _read_answers(answered(spark, path), candidates)
    work = candidates.join(outcome, "id").join(answers, "paper_id", "left").join(
        known.select("paper_id", *[F.col(c).alias(f"k_{c}") for c in EVALUATION_FIELDS]),
        "paper_id",
        "left",
    )
    values = {c: F.coalesce(f"n_{c}", f"k_{c}") for c in EVALUATION_FIELDS}
    unread = F.col("parse_error").isNotNull()
    insight = accept_insight(
        F.struct(values["abstract"].alias("abstract"), values["breakthrough"].alias("breakthrough")),
        F.col("summary"),
    )
    problems = [F.col("parse_error"), F.when(~unread, F.col("task_error"))]
    missing = F.when(
        ~unread & F.col("task_error").isNull() & values["innovation"].isNull(), "no rating"
    )
    error = F.array_join(F.array_compact(F.array(*problems, missing)), "; ")
    rated = work.withColumn("_i", insight).select(
        *[F.col(c) for c in papers.columns],
        *[F.when(unread, 0.0).otherwise(F.coalesce(values[c], F.lit(0.0))).alias(c) for c in _NUMBERS],
        F.when(unread, F.col("summary")).otherwise(F.col("_i.abstract")).alias("abstract"),
        F.when(unread, F.lit("")).otherwise(F.col("_i.breakthrough")).alias("breakthrough"),
        F.when(unread, F.lit("na"))
        .otherwise(F.coalesce(values["language"], "detected"))
        .alias("language"),
        *[F.when(~unread, values[c]).alias(c) for c in ("translation", "mindmap_markdown")],
        "parse_status",
        F.when(error != "", error).alias("error"),
    )
    rated = settle(observe_rows(add_scores(rated, cfg.rules), analysed, F.col("error").isNull()))
    good, failed = split_failed(rated)
    enriched = enrich_with_authors(
        good, profiles or {}, cfg.author_sources, cfg.author_info
    )
    fresh = F.coalesce(*[F.col(f"n_{f}").cast("string") for f in EVALUATION_FIELDS])
    patch = answers.where(fresh.isNotNull()).select(
        "paper_id", *[F.col(f"n_{f}").alias(f) for f in EVALUATION_FIELDS]
    )
    counts = observed_counts(fetched, relevant, analysed, cfg.top_k)
    return Analysis(enriched, failed, settle(patch), counts)


def _head(column: str, *limits: int | None) -> Column:
    given = [n for n in limits if n is not None]
    return F.substring(column, 1, min(given)) if given else F.col(column)


def _prompts(cfg: AnalysisConfig) -> dict[str, Column]:
    text = _head("full_text", cfg.full_text_chars)
    name = template_name(F.col("detected"), "insight", "insight_en", cfg.templates)
    bodies = {k: v for k, v in cfg.templates.items() if k.startswith("insight_")}
    outline = _head("full_text", cfg.full_text_chars, cfg.outline_chars)
    return {
        "rating": render(cfg.templates["rating"], {"full_text": text}),
        "insight": render_by_name(
            name, {"abstract": F.col("summary"), "full_text": text}, bodies
        ),
        "translation": render(cfg.templates["translation"], {"abstract": F.col("summary")}),
        "mindmap": render(cfg.templates["mindmap"], {"full_text": outline}),
    }


def _ask(
    readable: DataFrame,
    texts: DataFrame,
    known: DataFrame,
    models: Mapping[str, ModelFn],
    cfg: AnalysisConfig,
    path: str,
) -> None:
    """Append the answers that are neither stored nor kept by an earlier start."""
    tasks = [t for t in TASK_FIELD if t in models]
    if not tasks:
        return
    spark = readable.sparkSession
    have = known.select(
        "paper_id", *[F.col(TASK_FIELD[t]).isNotNull().alias(f"has_{t}") for t in tasks]
    )
    kept = answered(spark, path).where("error is null").groupBy("paper_id").agg(
        *[F.max(F.col("task") == t).alias(f"kept_{t}") for t in tasks]
    )
    needs = [
        F.when(~F.coalesce(f"has_{t}", F.lit(False)) & ~F.coalesce(f"kept_{t}", F.lit(False)), t)
        for t in tasks
    ]
    todo = settle(
        readable.where(F.col("parse_error").isNull())
        .join(have, "paper_id", "left")
        .join(kept, "paper_id", "left")
        .withColumn("tasks", F.array_compact(F.array(*needs)))
        .where(F.size("tasks") > 0)
        .select("id", "paper_id", "summary", "detected", "tasks")
    )
    # All texts are scanned once: the wanted ones go to a folder for each wave. A wave
    # deals its own to the partitions that call the models.
    wave = F.pmod(F.xxhash64("id"), F.lit(cfg.waves)).cast("int")
    bodies = texts.select("id", "full_text").join(broadcast_if_small(todo), "id")
    bodies = bodies.withColumn("wave", wave)
    placed = new_run_dir(spark, "wanted")
    bodies.write.partitionBy("wave").parquet(placed)
    wanted = spark.read.schema(bodies.schema).parquet(placed)
    built = _prompts(cfg)
    prompt = F.coalesce(*[F.when(F.col("task") == t, built[t]) for t in tasks])
    for number in range(cfg.waves):
        own = wanted.where(F.col("wave") == number).repartition(cfg.parallelism, "id")
        asked = own.withColumn("task", F.explode("tasks")).select("paper_id", "task", prompt.alias("prompt"))
        infer_dealt(asked, models).write.mode("append").parquet(path)


def _read_answers(answers: DataFrame, candidates: DataFrame) -> DataFrame:
    """A row per paper: the new fields, `parse_status` of the rating and `task_error`.

    An answer makes up for an earlier error of the same task.
    """
    def raw(task: str) -> Column:
        return F.max(F.when(F.col("task") == task, F.col("raw_response")))

    per_task = answers.groupBy("paper_id", "task").agg(
        F.max("raw_response").alias("raw_response"), F.max("error").alias("error")
    )
    problem = F.when(
        F.col("raw_response").isNull(), F.concat("task", F.lit(": "), F.col("error"))
    )
    wide = per_task.groupBy("paper_id").agg(
        *[raw(t).alias(t) for t in TASK_FIELD],
        F.array_join(F.array_sort(F.collect_list(problem)), "; ").alias("task_error"),
    )
    rated = rate_responses(wide, "rating").withColumn(
        "_p", parse_insight(F.col("insight"))["parsed"]
    )
    read = rated.join(candidates.select("paper_id", "summary", "detected"), "paper_id")
    read = read.withColumn("_a", accept_insight(F.col("_p"), F.col("summary")))
    ok = F.col("rating").isNotNull() & (F.col("parse_status") == "ok")
    unreadable = F.when(F.col("rating").isNotNull() & ~ok, F.lit("rating: unreadable answer"))
    errors = F.array(F.when(F.col("task_error") != "", F.col("task_error")), unreadable)
    new = {
        **{c: F.when(ok, F.col(c)) for c in _NUMBERS},
        "raw_response": F.when(ok, F.col("rating")),
        "abstract": F.when(F.col("_a.accepted"), F.col("_a.abstract")),
        "breakthrough": F.when(F.col("_a.accepted"), F.col("_a.breakthrough")),
        "language": F.when(F.col("_a.accepted"), F.col("detected")),
        "translation": F.col("translation"),
        "mindmap_markdown": F.col("mindmap"),
    }
    joined = F.array_join(F.array_compact(errors), "; ")
    return settle(
        read.select(
            "paper_id",
            *[new[f].alias(f"n_{f}") for f in EVALUATION_FIELDS],
            F.when(F.col("rating").isNotNull(), F.col("parse_status")).alias("parse_status"),
            F.when(joined != "", joined).alias("task_error"),
        )
    )
