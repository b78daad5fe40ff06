"""The registered queries against brute force over a whole small table."""

from __future__ import annotations

import hashlib
import zlib

import pytest

import __spark_entry__
import corpus_pipeline
from folioscope.llm.pii_tagger import base_spans, joined

from . import brute


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    return {r.doc_id: r.text for r in rows}


def run(spark, sf_dir, name):
    return __spark_entry__.queries()[name](spark, sf_dir).collect()


def test_ten_operators_and_the_pipeline_are_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)}


def test_op1(spark, sf_dir, texts):
    got = run(spark, sf_dir, "op1_sentencepiece")
    assert {r.doc_id for r in got} == set(texts) and all(r.lossless for r in got)
    assert all(len(r.pieces) == r.n_pieces for r in got)


def test_op2(spark, sf_dir, texts):
    got = {r.doc_id: r.component_id for r in run(spark, sf_dir, "op2_near_duplicates")}
    assert got == brute.near_duplicates(texts)


def test_op4(spark, sf_dir, texts):
    got = run(spark, sf_dir, "op4_host_rules")
    assert {r.doc_id: r.n_repeat_words for r in got} == {
        i: brute.repeat_words(t) for i, t in texts.items()
    }


def test_op6(spark, sf_dir, texts):
    got = run(spark, sf_dir, "op6_sharding")
    assert {r.doc_id: r.text_crc32 for r in got} == {
        i: zlib.crc32(t.encode()) for i, t in texts.items()
    }
    assert {r.shard for r in got} == set(range(24))


def test_op9(spark, sf_dir, texts):
    got = run(spark, sf_dir, "op9_pii")
    assert {r.doc_id: r.base_sha256 for r in got} == {
        i: hashlib.sha256(joined(base_spans(t)).encode()).hexdigest() for i, t in texts.items()
    }


@pytest.mark.parametrize("name", ["op3_mixing", "op5_vectors", "op7_token_counts", "op8_quality", "op10_interpolation"])
def test_one_row_for_each_input_row(spark, sf_dir, name):
    table = "embeddings" if name == "op5_vectors" else "documents"
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
    assert len(run(spark, sf_dir, name)) == rows


def test_pipeline(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    seen = []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(number))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if number < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        seen.append(docs.collect())
    quality, unique, clean, mixed, last = seen
    kept = {r.doc_id for r in quality}
    assert kept == {r.doc_id for r in run(spark, sf_dir, "op8_quality") if r.predicted}
    assert 0.8 * 200 <= len(kept) < 200
    expected = brute.near_duplicates({r.doc_id: r.text for r in quality})
    assert {r.doc_id for r in unique} == set(expected.values())
    assert len(clean) == len(unique)
    assert not any(base_spans(r.text) for r in clean)
    size = {r.doc_id: len(brute.words(r.text)) for r in clean}
    taken = sum(len(brute.words(r.text)) for r in mixed)
    assert abs(taken - 1.5 * sum(size.values())) <= 20
    assert len(last) == len(mixed) and all(r.lossless for r in last)


def test_pipeline_of_odd_rows(spark, sf_dir, tmp_path):
    """Nulls in every column, empty and repeated rows, and an empty table."""
    text = "one two three four five six seven eight nine ten eleven a@b.org"
    rows = [
        (1, text, "en", "s", 9), (1, text, "en", "s", 9), (1, "other words here", None, "s", 1),
        (2, text, "en", None, None), (3, None, None, None, None), (4, "", "en", "s", 0),
        (None, text, None, "s", 3), (None, None, None, None, None), (5, "x " * 50_000, "en", "s", 2),
    ]
    for number, some in enumerate([rows, []]):
        docs = spark.createDataFrame(some, brute.DOC_SCHEMA)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{number}-{k}")
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
            if k == 1:
                ids = [r.doc_id for r in docs.collect() if r.doc_id is not None]
                assert len(ids) == len(set(ids)) and 2 not in ids
        assert (docs.count() > 0) == bool(some)


def test_run_is_the_stages(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).where("not lossless").count() == 0


def test_quality_stage_rejects_junk(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 0")
    junk = {r.doc_id for r in labels.collect()}
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["quality"](spark, docs, sf_dir).collect()}
    assert len(kept & junk) <= 0.25 * len(junk) and len(kept) >= 0.8 * 200
