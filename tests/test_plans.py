"""The plans that must hold at a thousand times the data."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F
from tests.conftest import plan_of

import __spark_entry__  # noqa: F401  (fills the registry)
from folioscope.cluster import broadcast_if_small, settle, shared_dir
from folioscope.operators.evaluations import hits, lookup, misses, upsert
from folioscope.sources.colocated import write_colocated
from suite.registry import QUERIES

# Built from at most k rows, so one task is enough.
TOP_K_ONLY = {
    "topk_ranked", "report_sections", "report_lines", "api_envelope", "stream_topk",
}
# One row of counts at the end of partial aggregates.
ONE_ROW = {"run_counts", "author_metrics"}


@pytest.fixture(scope="module")
def plans(spark):
    return {n: plan_of(q(spark, "/root/testdata/sf0.001")) for n, q in QUERIES.items()}


def test_no_all_pairs_joins(plans):
    for name, plan in plans.items():
        assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan), name


def test_nothing_but_top_k_and_totals_runs_in_one_task(plans):
    for name, plan in plans.items():
        if name not in TOP_K_ONLY | ONE_ROW:
            assert "SinglePartition" not in plan, name


#: Model calls, and what is run over texts and rows in Arrow batches.
PYTHON = {"batch_infer", "evaluate_papers", "keyword_table", "language_profiles", "running_topk"}


def test_only_inference_and_scans_run_in_python(plans):
    for name, plan in plans.items():
        python = re.search(r"InPandas|PythonUDF|EvalPython|InArrow", plan) is not None
        assert python == (name in PYTHON), name


def test_limits_are_heaps_not_sorts(plans):
    for name in ("newest_200", "head_cap", "insight_topk", "export_csv_view"):
        assert "TakeOrderedAndProject" in plans[name]
        assert "Exchange" not in plans[name]


def test_scans_read_only_what_is_used(plans):
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in plans["newest_200"]
    assert "ReadSchema: struct<doc_id:bigint>" in plans["pending_content"]
    assert "full" not in plans["cache_hits"] and "text:string" not in plans["cache_hits"]


def test_text_operators_do_not_shuffle(plans):
    for name in (
        "scan_papers",
        "catalog_match",
        "exclude_topics",
        "keyword_any",
        "relevance_filter",
        "time_window",
        "extract_text",
        "truncate_text",
        "detect_language",
        "prompt_select",
        "prompt_render",
        "parse_keyword_list",
        "outline_baseline",
        "strip_fence",
        "parse_response",
        "rubric_score",
        "insight_accept",
        "insight_bonus",
        "key_sentence",
        "final_score",
        "paper_card",
        "quarantine_split",
    ):
        assert "Exchange" not in plans[name], name


def test_model_calls_keep_their_stated_partitions(plans):
    assert re.search(r"hashpartitioning\(paper_id#\d+, 64\), REPARTITION_BY_NUM", plans["batch_infer"])
    assert plans["batch_infer"].count("Exchange") == 1


def test_log_fold_is_one_hash_aggregation(plans):
    assert plans["cache_fold"].count("Exchange") == 1
    assert "SortAggregate" not in plans["cache_fold"]


def test_stored_window_prunes_the_scan(spark, tmp_path):
    from datetime import datetime

    from folioscope.sources.papers import within_days

    papers = spark.range(100).select(
        F.col("id").cast("string").alias("id"),
        F.timestamp_seconds(F.col("id") * 86_400).alias("published"),
    )
    dated = papers.withColumn("day", F.to_date("published"))
    dated.write.partitionBy("day").parquet(str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    recent = within_days(stored, datetime(1970, 4, 1), 7, date_partition="day")
    plan = plan_of(recent)
    assert re.search(r"PartitionFilters: \[[^\]]*day", plan)
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(published", plan)
    assert recent.count() == 17


def test_colocated_tables_join_without_a_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        ids = spark.range(500).select(F.col("id").cast("string").alias("paper_id"))
        write_colocated(ids.withColumn("text", F.lit("t")), "papers_b", buckets=8)
        evaluated = ids.where("paper_id < '3'").withColumn("innovation", F.lit(1.0))
        write_colocated(evaluated, "store_b", buckets=8)
        papers, store = spark.table("papers_b"), spark.table("store_b")
        for joined in (
            lookup(papers, store),
            hits(papers, store, "innovation"),
            misses(papers, store, "innovation"),
            upsert(store, store, ["innovation"]),
        ):
            assert "Exchange" not in plan_of(joined)
        assert hits(papers, store, "innovation").count() == evaluated.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS papers_b")
        spark.sql("DROP TABLE IF EXISTS store_b")


def test_broadcast_only_below_the_bound(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        big, small = spark.range(1000), spark.range(50)
        assert "Broadcast" in plan_of(big.join(broadcast_if_small(small, 50), "id"))
        assert "Broadcast" not in plan_of(big.join(broadcast_if_small(small, 49), "id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_settled_results_lie_in_the_shared_folder(spark):
    settled = settle(spark.range(3))
    assert settled.count() == 3
    assert all(shared_dir(spark) in f for f in settled.inputFiles())
