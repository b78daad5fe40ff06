from __future__ import annotations

import json
from datetime import datetime

import pytest
from tests.conftest import plan_of, rows

from folioscope.fixed_values import INSIGHT_FAILED
from folioscope.operators.evaluations import upsert
from folioscope.operators.inference import infer_dealt
from folioscope.operators.ranking import top_k
from folioscope.plans import analysis
from folioscope.plans.analysis import AnalysisConfig, analyse, select_candidates
from folioscope.schemas import EVALUATION_FIELDS

AS_OF = datetime(2024, 1, 31)
PAPERS = [
    ("1", "Reasoning models", "large language models", datetime(2024, 1, 30), ["Ann", "Unknown"]),
    ("2", "Survey of reasoning", "large language models", datetime(2024, 1, 30), ["Ann"]),
    ("3", "Reasoning", "about large language models 大语言模型推理研究", datetime(2024, 1, 29), []),
    ("4", "Reasoning", "large language models, old", datetime(2024, 1, 1), ["Bob"]),
    ("5", "Reasoning", "large language models unread", datetime(2024, 1, 28), ["Bob"]),
    ("6", "Reasoning", "large language models odd", datetime(2024, 1, 27), ["Bob"]),
    ("7", "Off", "topic", datetime(2024, 1, 30), ["Bob"]),
]
NUMBERS = ("innovation", "rigor", "impact", "total_score")


@pytest.fixture(scope="module")
def inputs(spark):
    papers = spark.createDataFrame(
        PAPERS, "id STRING, title STRING, summary STRING, published TIMESTAMP, authors ARRAY<STRING>"
    )
    texts = spark.createDataFrame(
        [(p[0], f"body of {p[0]} {{abstract}}", None) for p in PAPERS if p[0] != "5"],
        "id STRING, full_text STRING, error STRING",
    )
    fields = ", ".join(
        f"{f} {'DOUBLE' if f in NUMBERS else 'STRING'}" for f in EVALUATION_FIELDS
    )
    store = spark.createDataFrame([], f"paper_id STRING, {fields}")
    return papers, texts, store


def config(**more):
    more = {"waves": 2, "parallelism": 2, **more}
    return AnalysisConfig(
        keywords=["reasoning", "large language models"], as_of=AS_OF, language_floor=0.1, **more
    )


def models(calls):
    """Answers by prompt; every prompt is written to `calls`."""

    def note(task, prompts):
        with open(calls, "a", encoding="utf-8") as log:
            log.writelines(f"{task}\n" for _ in prompts)

    def rating(prompts):
        note("rating", prompts)
        return [
            "not JSON"
            if "body of 6" in p
            else '```json\n{"innovation": 9, "rigor": 6, "impact": 6}\n```'
            for p in prompts
        ]

    def insight(prompts):
        note("insight", prompts)
        answer = {"abstract": "copied", "breakthrough": "We propose a novel way to solve it"}
        zh = {"abstract": "摘要", "breakthrough": "首次提出新方法，显著提升"}
        return [
            json.dumps({"abstract": "x"})
            if "body of 6" in p
            else json.dumps(zh if "摘要" in p else answer, ensure_ascii=False)
            for p in prompts
        ]

    def text(task):
        def answer(prompts):
            note(task, prompts)
            return [f"{task} text" for _ in prompts]

        return answer

    return {
        "rating": rating,
        "insight": insight,
        "translation": text("translation"),
        "mindmap": text("mindmap"),
    }


def test_candidates(spark, inputs):
    papers = inputs[0]
    assert rows(select_candidates(papers, config()).select("id")) == [("1",), ("3",), ("5",), ("6",)]
    assert rows(select_candidates(papers, config(max_papers=2)).select("id")) == [("1",), ("3",)]
    assert rows(select_candidates(papers, config(newest_limit=3)).select("id")) == [("1",), ("3",)]


def ask(papers, texts, store, made, cfg=None, **more):
    return analyse(papers, texts, store, made, cfg or config(), **more)


def test_full_run_and_second_run(spark, inputs, tmp_path):
    papers, texts, store = inputs
    calls = tmp_path / "calls"
    run = ask(papers, texts, store, models(calls))
    got = {r["id"]: r for r in run.scored.collect()}
    failed = {r["id"]: r for r in run.failed.collect()}
    assert set(got) == {"1", "3"} and set(failed) == {"5", "6"}

    one = got["1"]
    assert (one["innovation"], one["total_score"], one["parse_status"]) == (9.0, 7.0, "ok")
    assert (one["abstract"], one["language"]) == ("copied", "en")
    # propose, novel, solve; 34 characters are outside the English band.
    assert (one["insight_bonus"], one["final_score"]) == (0.9, 7.9)
    assert (one["translation"], one["mindmap_markdown"]) == ("translation text", "mindmap text")

    assert (got["3"]["language"], got["3"]["abstract"]) == ("zh", "摘要")
    assert got["3"]["insight_bonus"] == 1.2

    unread = failed["5"]
    assert (unread["total_score"], unread["language"], unread["breakthrough"]) == (0.0, "na", "")
    assert unread["abstract"] == "large language models unread"
    assert unread["error"].startswith("Failed to parse") and unread["translation"] is None

    odd = failed["6"]
    assert (odd["parse_status"], odd["error"]) == ("invalid", "rating: unreadable answer")
    assert odd["breakthrough"] == INSIGHT_FAILED
    assert odd["abstract"] == "large language models odd"

    assert [r["id"] for r in top_k(run.scored, 2).collect()] == ["3", "1"]

    first = calls.read_text().splitlines()
    assert {t: first.count(t) for t in set(first)} == {
        "rating": 3,
        "insight": 3,
        "translation": 3,
        "mindmap": 3,
    }
    # The unreadable answers are not kept, so only they are asked for again.
    kept = {r["paper_id"]: r for r in run.patch.collect()}
    assert set(kept) == {"1|model|1", "3|model|1", "6|model|1"}
    assert kept["6|model|1"]["innovation"] is None
    assert kept["6|model|1"]["translation"] == "translation text"
    records = upsert(store, run.patch, EVALUATION_FIELDS)
    again = ask(papers, texts, records, models(calls))
    columns = [c for c in run.scored.columns if c != "parse_status"]
    assert rows(again.scored.select(columns)) == rows(run.scored.select(columns))
    second = calls.read_text().splitlines()[len(first) :]
    assert sorted(second) == ["insight", "rating"]
    # Another prompt version does not reuse the answers.
    ask(papers, texts, records, models(calls), config(prompt_version="2"))
    assert len(calls.read_text().splitlines()) == len(first) + len(second) + 12


def test_a_model_failure_is_an_error_not_a_zero(spark, inputs, tmp_path):
    papers, texts, store = inputs
    made = models(tmp_path / "calls")

    def broken(prompts):
        raise RuntimeError("model is down")

    run = ask(papers, texts, store, {**made, "rating": broken})
    assert run.scored.count() == 0
    errors = {r["id"]: r["error"] for r in run.failed.collect()}
    assert set(errors) == {"1", "3", "5", "6"}
    assert errors["1"] == "rating: model is down"
    # What the other tasks gave is kept all the same.
    assert {r["translation"] for r in run.patch.collect()} == {"translation text"}


def test_a_broken_run_goes_on_where_it_was(spark, inputs, tmp_path):
    papers, texts, store = inputs
    calls, folder = tmp_path / "calls", str(tmp_path / "run")
    made = models(calls)
    only_rating = {"rating": made["rating"]}
    ask(papers, texts, store, only_rating, run_dir=folder)
    assert calls.read_text().splitlines().count("rating") == 3
    run = ask(papers, texts, store, made, run_dir=folder)
    assert {r["id"] for r in run.scored.collect()} == {"1", "3"}
    asked = calls.read_text().splitlines()
    assert {t: asked.count(t) for t in set(asked)} == dict.fromkeys(made, 3)
    # An answer that failed is asked for again, one that came is not.
    folder = str(tmp_path / "other")

    def broken(prompts):
        raise RuntimeError("model is down")

    ask(papers, texts, store, {**made, "insight": broken}, run_dir=folder)
    before = calls.read_text().splitlines()
    run = ask(papers, texts, store, made, run_dir=folder)
    assert calls.read_text().splitlines()[len(before) :] == ["insight"] * 3
    assert {r["id"] for r in run.scored.collect()} == {"1", "3"}


def test_texts_are_scanned_once_and_rows_counted_by_the_run(spark, inputs, tmp_path):
    """Eight waves read the texts in one job; the counts come from the jobs that run anyway."""
    papers, texts, store = inputs
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    watched = texts.mapInArrow(count, texts.schema)
    run = ask(papers, watched, store, models(tmp_path / "calls"), config(waves=8))
    # Once for the outcome of parsing, once for the wanted texts.
    assert seen.value == 2 * texts.count()
    again = ask(papers, texts, store, models(tmp_path / "more"), config(top_k=1))
    scored, failed = again.scored.count(), again.failed.count()
    assert dict(again.counts) == {
        "fetched": run.counts["fetched"], "total": scored + failed, "analysed": scored, "exported": 1,
    }
    assert run.counts["fetched"] >= run.counts["total"] > run.counts["analysed"] > 1


def test_calls_spread_over_the_stated_partitions(spark, inputs, monkeypatch):
    papers, texts, store = inputs
    plans = []

    def spy(asked, made, *rest):
        plans.append((asked.rdd.getNumPartitions(), plan_of(asked)))
        return infer_dealt(asked, made, *rest)

    monkeypatch.setattr(analysis, "infer_dealt", spy)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        monkeypatch.setattr(analysis, "broadcast_if_small", lambda df: df)
        cfg = config(parallelism=7, waves=1)
        ask(papers, texts, store, {"rating": lambda p: ["{}"] * len(p)}, cfg)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    ((partitions, plan),) = plans
    assert partitions == 7
    assert plan.split("== Initial Plan ==")[0].count("REPARTITION_BY_NUM") == 1


def test_authors_are_added_when_asked(spark, inputs, tmp_path):
    papers, texts, store = inputs
    profile = spark.createDataFrame(
        [("Ann", 5, 1, 2, ["U"], "openalex")],
        "name STRING, h_index INT, paper_count INT, citation_count INT, "
        "affiliations ARRAY<STRING>, source_used STRING",
    )
    cfg = config(author_info=True, author_sources=("openalex",))
    made = models(tmp_path / "calls")
    run = ask(papers, texts, store, made, cfg, profiles={"openalex": profile})
    got = {r["id"]: r for r in run.scored.collect()}
    assert [a["h_index"] for a in got["1"]["authors_info"]] == [5]
    assert got["3"]["authors_info"] == []
    # No model at all: nothing is rated, which is an error.
    none = ask(papers, texts, store, {}, cfg, profiles={"openalex": profile})
    assert none.scored.count() == 0
    assert {r["error"] for r in none.failed.where("id != '5'").collect()} == {"no rating"}
