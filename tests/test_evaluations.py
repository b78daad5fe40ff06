from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from tests.conftest import rows

from folioscope.operators.evaluations import (
    evaluation_key,
    fold_patches,
    hits,
    lookup,
    misses,
    sequence_of,
    upsert,
)
from folioscope.operators.inference import evaluate_papers, infer, infer_once, rate_responses
from folioscope.schemas import PATCH

STORE = "paper_id STRING, innovation DOUBLE, translation STRING"


def store(spark):
    data = [("1", 5.0, None), ("2", None, "x"), ("3", 0.0, ""), ("9", 1.0, "y")]
    return spark.createDataFrame(data, STORE)


def papers(spark):
    return spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "paper_id STRING")


def test_hits_and_misses_split_the_papers(spark):
    for field, expected in (("innovation", ["1", "3"]), ("translation", ["2", "3"])):
        hit = [r[0] for r in rows(hits(papers(spark), store(spark), field))]
        miss = [r[0] for r in rows(misses(papers(spark), store(spark), field))]
        assert hit == expected
        assert sorted(hit + miss) == ["1", "2", "3", "4"]


def test_hit_split_with_an_empty_store(spark):
    empty = store(spark).where("false")
    assert hits(papers(spark), empty, "innovation").count() == 0
    assert misses(papers(spark), empty, "innovation").count() == 4
    assert misses(papers(spark).where("false"), store(spark), "innovation").count() == 0


def test_lookup_keeps_every_paper(spark):
    got = {r["paper_id"]: r["translation"] for r in lookup(papers(spark), store(spark)).collect()}
    assert got == {"1": None, "2": "x", "3": "", "4": None}


def test_upsert_is_per_field_and_idempotent(spark):
    fields = ["innovation", "translation"]
    patch = spark.createDataFrame([("1", None, "new"), ("4", 2.0, None), ("9", 3.0, None)], STORE)
    once = upsert(store(spark), patch, fields)
    assert rows(once) == [
        ("1", 5.0, "new"),
        ("2", None, "x"),
        ("3", 0.0, ""),
        ("4", 2.0, None),
        ("9", 3.0, "y"),
    ]
    assert rows(upsert(once, patch, fields)) == rows(once)


def test_fold_equals_replaying_the_log(spark):
    rng = random.Random(3)
    fields = ["innovation", "translation", "mindmap_markdown"]
    log = [
        # One paper owns most of the log.
        (rng.choice(["hot"] * 5 + ["a", "b"]), rng.choice([*fields, "other"]), f"v{n}", n)
        for n in range(500)
    ]
    replayed: dict[str, dict[str, str]] = {}
    for paper, field, value, _ in log:
        replayed.setdefault(paper, {})[field] = value
    rng.shuffle(log)
    df = spark.createDataFrame(log, PATCH).repartition(4)
    folded = {r["paper_id"]: r.asDict() for r in fold_patches(df, fields).collect()}
    assert set(folded) == set(replayed)
    for paper, record in replayed.items():
        assert {f: folded[paper][f] for f in fields} == {f: record.get(f) for f in fields}


def test_sequence_orders_by_time_then_tie(spark):
    start = datetime(2024, 1, 1)
    big = 2**63 - 1
    data = [
        (start, 5),
        (start, 6),
        (start, big),
        (start + timedelta(microseconds=1), 0),
        (datetime(2099, 1, 1), 1),
        (datetime(1960, 1, 1), 1),
    ]
    df = spark.createDataFrame(data, "ts TIMESTAMP, tie BIGINT")
    ordered = df.orderBy(sequence_of(F.col("ts"), F.col("tie"))).collect()
    assert [tuple(r) for r in ordered] == sorted(data)


def test_key_separates_models_and_prompts(spark):
    key = evaluation_key(F.lit("7"), "m", "2")
    assert spark.range(1).select(key).first()[0] == "7|m|2"


def prompts(spark, n=40):
    data = [(str(i), f"prompt {i}") for i in range(n)]
    return spark.createDataFrame(data, "paper_id STRING, prompt STRING").repartition(3)


def test_one_bad_prompt_does_not_stop_the_others(spark):
    def model(batch):
        if any(p == "prompt 7" for p in batch):
            raise RuntimeError("no answer for 7")
        return [f" ```json{p}``` " for p in batch]

    got = {r["paper_id"]: r for r in infer(prompts(spark), "insight", model).collect()}
    assert len(got) == 40
    assert got["7"]["raw_response"] is None
    assert got["7"]["error"] == "no answer for 7"
    assert all(r["raw_response"] == f"prompt {i}" for i, r in got.items() if i != "7")
    assert {r["task"] for r in got.values()} == {"insight"}


def test_wrong_number_of_answers_is_an_error(spark):
    got = infer(prompts(spark, 4), "insight", lambda batch: []).collect()
    assert len(got) == 4 and all(r["error"] for r in got)


def test_small_model_batches_cover_every_prompt(spark):
    def model(batch):
        return [str(len(batch))] * len(batch)

    got = infer(prompts(spark), "rating", model, batch_rows=5).collect()
    assert len(got) == 40 and all(int(r["raw_response"]) <= 5 for r in got)


def test_written_answers_are_not_asked_again(spark, tmp_path):
    calls = tmp_path / "calls"

    def model(batch):
        with open(calls, "a", encoding="utf-8") as log:
            log.write("x" * len(batch))
        return ["{}"] * len(batch)

    answers = infer_once(prompts(spark), "rating", model, str(tmp_path / "answers"))
    assert answers.count() == 40
    assert answers.where("error IS NULL").count() == 40
    assert calls.read_text() == "x" * 40
    infer_once(prompts(spark), "rating", model, str(tmp_path / "answers"))
    assert calls.read_text() == "x" * 40


def test_unreadable_ratings_are_zero_and_marked(spark):
    df = spark.createDataFrame(
        [("1", '{"innovation": 3, "rigor": 4}'), ("2", "x")],
        "paper_id STRING, raw_response STRING",
    )
    got = {r["paper_id"]: r for r in rate_responses(df).collect()}
    assert (got["1"]["total_score"], got["1"]["parse_status"]) == (2.33, "ok")
    assert (got["2"]["total_score"], got["2"]["parse_status"]) == (0.0, "invalid")


def test_evaluation_asks_only_for_what_is_missing(spark):
    full = store(spark).select(
        "paper_id",
        "innovation",
        F.lit(1.0).alias("rigor"),
        F.lit(None).cast("double").alias("impact"),
        F.lit(2.0).alias("total_score"),
        F.lit(None).cast("string").alias("raw_response"),
    )

    def model(batch):
        return ['{"innovation": 9, "rigor": 9, "impact": 9}' for p in batch]

    prompt = F.concat(F.lit("p"), F.col("paper_id"))
    got = {
        r["paper_id"]: (r["innovation"], r["impact"], r["total_score"], r["source"])
        for r in evaluate_papers(papers(spark), full, prompt, model).collect()
    }
    assert got == {
        "1": (5.0, 0.0, 2.0, "stored"),
        "3": (0.0, 0.0, 2.0, "stored"),
        "2": (9.0, 9.0, 9.0, "model"),
        "4": (9.0, 9.0, 9.0, "model"),
    }
