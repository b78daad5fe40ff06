from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from folioscope.llm import nearest_vote as nv
from folioscope.llm.queries import QUERIES

from . import brute


def test_terms():
    texts = ["ab ab ab cd", "", None, "1 1", "A-B | xé"]
    terms = nv.text_terms(pa.array(texts, pa.string()))
    assert terms[:, : nv.TRIGRAMS].sum(axis=1).tolist() == [9, 0, 0, 1, 7]
    events = terms[:, nv.TRIGRAMS :].astype(int).tolist()
    # like the last, like the last but one, window again, punctuation, no lower case, all
    assert events[0] == [2, 1, 0, 0, 0, 4]
    assert events[1] == events[2] == [0] * 6
    assert events[3] == [1, 0, 0, 0, 2, 2]
    assert events[4] == [0, 0, 0, 1, 2, 3]
    assert (nv.text_terms(pa.array(["ab ab ab cd"])) == terms[:1]).all()


def test_vote_equals_brute_force():
    r = np.random.default_rng(0)
    terms = r.poisson(0.2, (60, nv.TRIGRAMS + nv.EVENTS)).astype(np.float32)
    labels = (np.arange(60) % 3 > 0).astype(int)
    model = nv.fit_neighbours(terms, labels, share=0.9, dims=8, k=5)
    asked = r.poisson(0.2, (20, nv.TRIGRAMS + nv.EVENTS)).astype(np.float32)
    got = nv.vote(model, asked)
    latent = nv._latent(nv._shares(asked), model.weights, model.projection)
    for x, value in zip(latent, got, strict=True):
        cosine = [float(x @ v) for v in model.vectors]
        near = sorted(range(60), key=lambda i: -cosine[i])[:5]
        weight = [max(cosine[i], 0) * (0.9 / labels.mean() if labels[i] else 0.1 / (1 - labels.mean())) for i in near]
        good = sum(w for w, i in zip(weight, near, strict=True) if labels[i])
        assert value == pytest.approx(good / sum(weight), rel=1e-3)


def test_learns_from_the_other_folds_only(spark):
    texts = [f"good words {i}" if i % 2 else f"BAD!! BAD!! {i}" for i in range(200)]
    docs = brute.docs_of(spark, texts)
    rows = [(i, i % 2, 0) for i in range(200)]
    wrong = [(i, 1 - q if brute.fold(i, 5) == 0 else q, t) for i, q, t in rows]
    schema = "doc_id long, quality int, toxic int"
    one = nv.learn(docs, spark.createDataFrame(rows, schema))
    two = nv.learn(docs, spark.createDataFrame([*wrong, (5, None, 0), (None, 1, 0)], schema))
    assert (one.vectors == two.vectors).all() and (one.labels == two.labels).all()
    scored = nv.score(docs, one).collect()
    assert all((r.score > 0.5) == bool(r.doc_id % 2) for r in scored)
    small = nv.learn(docs, spark.createDataFrame(rows, schema), sample=20)
    assert len(small.labels) == 40


def test_without_text_or_labels(spark):
    docs = brute.docs_of(spark, ["", None, " ", "x", "word " * 30_000])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in nv.score(docs, nv.learn(docs, labels)).collect()] == [0.5] * 5
    labelled = spark.createDataFrame([(3, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in nv.score(docs, nv.learn(docs, labelled)).collect()}
    assert got[0] == got[1] and all(0 <= s <= 1 for s in got.values())
    zeros = spark.createDataFrame([(3, 0, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in nv.score(docs, nv.learn(docs, zeros)).collect()}
    assert got[0] == got[1] == 0 and all(s == 0 for s in got.values())
    none = docs.limit(0)
    assert nv.score(none, nv.learn(docs, labelled)).collect() == []


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = QUERIES["op8_quality"](spark, sf_dir).collect()
    assert len(got) == 1_000
    assert all(r.held_out == (brute.fold(r.doc_id, 5) == 0) for r in got)
    judged = [(r.predicted, quality[r.doc_id]) for r in got if r.held_out and r.doc_id in quality]
    assert sum(p == q for p, q in judged) / len(judged) > 0.93
    assert all(p == 1 for p, q in judged if q == 1)


def test_learns_from_the_whole_sample_in_a_task(spark, monkeypatch):
    """2,048 distinct texts of each label; the driver fits nothing itself."""
    docs = spark.range(6_000).selectExpr(
        "id doc_id", "concat(if(id % 2 = 0, 'BAD!! ', 'good words '), id) text"
    )
    rows = spark.range(6_000).selectExpr("id doc_id", "int(id % 2) quality")
    monkeypatch.setattr(nv, "fit_neighbours", None)
    model = nv.learn(docs, rows.union(rows))
    assert np.bincount(model.labels).tolist() == [2_048, 2_048]
    assert len(model.weights) == 2_048 + nv.EVENTS - 1
