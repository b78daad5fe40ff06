from __future__ import annotations

import math

import pytest

from folioscope.llm import toxic_grammar as tg
from folioscope.llm.queries import QUERIES

from . import brute


def weight(text, **stems):
    _, clauses = tg.Grammar(stems or {"fool": 4.0}, 0.0).clauses(text)
    return [(text[a:b], w) for a, b, w in clauses]


def test_clauses_and_their_contexts():
    assert weight("Fools here. all fine; no harm") == [("Fools here", 4.0)]
    assert weight("what a fool") == [("what a fool", 4.0)]
    assert weight("not a fool") == [("not a fool", 4.0 * tg.NEGATED)]
    assert weight("it isn't a fool")[0][1] == 4.0 * tg.NEGATED
    assert weight("not this one here a fool")[0][1] == 4.0
    assert weight("you old fool") == [("you old fool", 4.0 * tg.AIMED)]
    assert weight("anna said fool") == [("anna said fool", 4.0 * tg.REPORTED)]
    assert weight('"fool"')[0][1] == 4.0 * tg.REPORTED
    assert weight('"well. fool" he') == [('fool" he', 4.0 * tg.REPORTED)]
    assert weight('"well\nfool') == [("fool", 4.0)]
    assert weight("you are not a fool")[0][1] == pytest.approx(4.0 * tg.NEGATED)
    assert weight("fool. fool, foolish")[1][1] == 8.0
    assert weight("l'idiote", idiot=3.0) == [("l'idiote", 3.0)]
    assert weight("") == weight("a fo fOo") == []


def test_threats_need_a_target():
    assert weight("i will kill you") == [("i will kill you", tg.THREATENED)]
    assert weight("kill the lights") == []
    assert weight("i will not kill you")[0][1] == tg.THREATENED * tg.NEGATED
    assert weight("kill. you") == []


def test_composition_equals_its_parts():
    parts = (tg.negation, tg.reported, tg.target, tg.threat)
    machine, state, states = tg.Composition(), 0, [0, 0, 0, 0]
    for word in [0, 1, 6, 0, 2, 5, 0, 2, 3, 4, 6, 1, 4, 6, 5, 5, 2] * 3:
        state, factor, _ = machine.arc(state, word)
        out = [f(s, word) for f, s in zip(parts, states, strict=True)]
        states = [s for s, _ in out]
        assert machine.names[state] == tuple(states)
        assert factor == pytest.approx(out[0][1] * out[1][1] * out[2][1])


def test_stems():
    counts = {
        "moron": (50, 0), "moro": (50, 0), "mor": (60, 90), "moronx": (20, 0),
        "the": (900, 9_000), "rare": (2, 0), "low": (40, 1), "lowei": (39, 0), "lowe": (39, 1),
    }
    stems = tg.choose_stems(counts, 1_000, 10_000, len(counts))
    assert set(stems) == {"moron", "lowei"}
    assert stems["moron"] == pytest.approx(math.log((50.5 / 1_001) / (0.5 / 10_001)))
    assert tg.choose_stems({}, 0, 0, 0) == {}


def test_learns_inflected_stems_and_ignores_the_held_out_fold(spark):
    texts, labels = [], []
    for i in range(300):
        toxic = i % 5 == 0
        filler = " ".join(f"w{chr(97 + (i * k) % 26)}{chr(97 + k)}" for k in range(20))
        extra = f" grub{chr(97 + i % 26)} {filler[:3]} grub{chr(97 + i % 7)}o" if toxic else ""
        texts.append(filler + extra)
        # labels of the held-out fold are all wrong
        labels.append((i, int(toxic != (brute.fold(i, 3) == 1))))
    docs = brute.docs_of(spark, texts)
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    grammar = tg.learn_grammar(docs, table)
    assert set(grammar.stems) == {"grub"}
    rows = tg.weigh(docs.withColumn("text", docs.text), grammar).collect()
    assert all((r.score >= 0.7) == (r.doc_id % 5 == 0) for r in rows)
    assert all(r.size == "extra" and r.n_tokens >= 20 for r in rows)


def test_odd_rows(spark):
    texts = [None, "", "...", "x" * 300_000, "fool " * 50_000, "a", "a"]
    docs = brute.docs_of(spark, texts, ids=[1, None, 2, 3, 4, 5, 5])
    grammar = tg.Grammar({"fool": 4.0}, -1.0, 1.0, -0.5)
    rows = tg.weigh(docs, grammar).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 7 and by[1].score == by[None].score == by[2].score
    assert by[4].n_tokens == 50_000 and by[4].weight == 200_000
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    none = tg.learn_grammar(docs, labels)
    assert {r.score for r in tg.weigh(docs, none).collect()} == {0.5}
    some = [(i, 0) for i in range(9)] + [(7, None), (None, 1)]
    only = tg.learn_grammar(docs, spark.createDataFrame(some, "doc_id long, toxic int"))
    assert max(r.score for r in tg.weigh(docs, only).collect()) < 0.01
    assert tg.weigh(docs.limit(0), none).count() == 0


def test_query_accuracy_on_the_held_out_fold(spark):
    path = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    rows = QUERIES["op12_toxicity"](spark, path).collect()
    assert len(rows) == spark.read.parquet(f"{path}/documents.parquet").count()
    assert all(r.held_out == (brute.fold(r.doc_id, 3) == 1) for r in rows)
    out = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    toxic = [p for t, p in out if t == 1]
    clean = [p for t, p in out if t == 0]
    assert sum(toxic) >= 0.8 * len(toxic) and sum(clean) <= 0.01 * len(clean)
