from __future__ import annotations

import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from folioscope.llm import interpolation
from folioscope.llm.interpolation import learn_mixture, score_texts
from folioscope.llm.text_arrays import distinct

from . import brute

BEGIN, END = "<begin>", "<end>"


def corpus():
    r = random.Random(9)
    words = [f"w{int(r.paretovariate(0.8))}" for _ in range(400)]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 60))) for _ in range(150)]
    return [*texts, None, "", "UPPER upper Upper", "new " * 40_000]


def model(texts):
    folds = [brute.fold(i, 10) for i in range(len(texts))]
    tokens = [[*brute.words(t, lower=True), END] for t in texts]
    pairs = [list(zip([BEGIN, *t], t, strict=False)) for t in tokens]

    def counts(keep):
        one, two = Counter(), Counter()
        for t, p, f in zip(tokens, pairs, folds, strict=True):
            if keep(f):
                one.update(t)
                two.update(p)
        return one, two

    return folds, tokens, pairs, counts


def bucket(c):
    return 1 + int(math.log2(c)) if c else 0


def learned(folds, pairs, counts):
    one, two = counts(lambda f: f > 1)
    n, v = sum(one.values()), len(one)
    seen = one | Counter({BEGIN: one[END]})
    items = Counter(p for p_, f in zip(pairs, folds, strict=True) if f == 1 for p in p_)
    mix = np.full((64, 3), 1 / 3)
    mix[0] = [0, 0.5, 0.5]
    for _ in range(40):
        sums = np.zeros((64, 3))
        for (h, w), k in items.items():
            b = bucket(seen[h])
            part = mix[b] * [two[h, w] / max(seen[h], 1), one[w] / n, 1 / (v + 1)]
            sums[b] += k * part / part.sum()
        new = mix.copy()
        full = sums.sum(axis=1) > 0
        new[full] = sums[full] / sums[full].sum(axis=1, keepdims=True)
        new[:, 2] = np.maximum(new[:, 2], 1e-6)
        new /= new.sum(axis=1, keepdims=True)
        change = np.abs(new - mix).max()
        mix = new
        if change < 1e-4:
            break
    return mix


@pytest.mark.parametrize("batch_bytes", [8_000_000, 2_000])
def test_equals_brute_force(spark, batch_bytes):
    texts = corpus()
    folds, tokens, pairs, counts = model(texts)
    one, two = counts(lambda f: f > 0)
    n, v = sum(one.values()), len(one)
    seen = one | Counter({BEGIN: one[END]})
    mix = learned(folds, pairs, counts)
    docs = brute.docs_of(spark, texts)
    got = score_texts(docs, batch_bytes=batch_bytes).collect()
    assert len(got) == len(texts)
    for r in got:
        t, p = tokens[r.doc_id], pairs[r.doc_id]
        assert r.held_out == (folds[r.doc_id] == 0)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(one[w] > 0 for w in t), n)
        base = sum(math.log10((one[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        score = sum(
            math.log10(mix[bucket(seen[h])] @ [two[h, w] / max(seen[h], 1), one[w] / n, 1 / (v + 1)])
            for h, w in p
        )
        assert r.score == pytest.approx(score, rel=1e-6)


def test_probabilities_of_a_context_sum_to_one(spark):
    """The mixture is a distribution: over the vocabulary and one unknown word."""
    texts = ["a b a c", "a b", "b c a"] * 20
    folds, _, _, counts = model(texts)
    one, two = counts(lambda f: f > 0)
    n, v = sum(one.values()), len(one)
    mix = learned(folds, model(texts)[2], counts)[bucket(one["a"])]
    follows = sum(k for (h, _), k in two.items() if h == "a")
    assert follows == one["a"]
    total = sum(mix @ [two["a", w] / one["a"], one[w] / n, 1 / (v + 1)] for w in one)
    assert total + mix[2] / (v + 1) == pytest.approx(1)


def test_mixture_prefers_what_predicts(spark):
    totals = {"n_kept": 1_000, "v_kept": 10}
    rows = [(90, 100, 50, 500), (0, 100, 50, 5), (0, 1, 50, 300), (0, 0, 50, 300), (0, 0, 0, 20)]
    mix = learn_mixture(spark.createDataFrame(rows, "pair long, context long, word long, n long"), totals)
    assert mix[bucket(100), 0] > 0.9 and mix[bucket(1), 0] < 0.1 and mix[0, 0] == 0
    assert mix.sum(axis=1) == pytest.approx(1)


def test_keys_survive_packing():
    r = np.random.default_rng(0)
    for keys in (r.integers(0, 2**63, 50), r.integers(0, 2**36, 500), [], [7], [0, 2**63]):
        keys = np.unique(np.array(keys, dtype=np.uint64))
        assert (interpolation._unpack(interpolation._pack(keys)) == keys).all()


def test_nameless_repeated_and_no_rows(spark):
    docs = brute.docs_of(spark, ["x y", "x y", "x y", None], ids=[None, 2, 2, 2])
    got = score_texts(docs).collect()
    assert len(got) == 4
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert {r.train_tokens for r in got} == {0 if brute.fold(2, 10) == 0 else 7}
    assert score_texts(brute.docs_of(spark, [])).collect() == []


def test_counts_beyond_32_bits_are_answered_whole():
    keys = interpolation._pack(np.array([3, 2**40], dtype=np.uint64))
    many = interpolation._pack_counts(np.array([3 * 10**9, 1]))
    row = [5, 0, keys, keys, many, many, many, many]
    names = ["batch", "range", *interpolation._FIELDS]
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 6]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([x, x], k) for x, k in zip(row, kinds, strict=True)], names
    )
    (answer,) = interpolation._answer(iter([batch]))
    for name in interpolation._COUNTS:
        got = interpolation._unpack_counts(answer.column(name)[0].as_py())
        assert got.tolist() == [6 * 10**9, 2]
    assert answer.column("n_kept")[0].as_py() == 6 * 10**9 + 2
    assert interpolation._pack_counts(np.array([7]))[:1] == b"4"


@pytest.mark.parametrize("top", [2**36, 2**44, 2**52, 2**62])
def test_wide_steps_survive_packing(top):
    keys = np.unique(np.random.default_rng(1).integers(0, top, 9).astype(np.uint64))
    assert (interpolation._unpack(interpolation._pack(keys)) == keys).all()


def test_pair_keys_widen_with_the_corpus(spark, monkeypatch):
    assert interpolation.pair_bits_for(5 * 10**8, 10**5) == 48
    for size in (3 * 10**10, 10**13):
        tokens = size // 2
        assert tokens / 2 ** interpolation.pair_bits_for(size, size // 5_000) <= 1e-6
    docs = brute.docs_of(spark, corpus())
    narrow = {r.doc_id: r.score for r in score_texts(docs).collect()}
    monkeypatch.setattr(interpolation, "_SPARE_BITS", 60)
    wide = {r.doc_id: r.score for r in score_texts(docs, batch_bytes=2_000).collect()}
    assert wide == pytest.approx(narrow, rel=1e-9)


def test_a_batch_takes_little_more_than_its_places():
    """Peak memory of a batch's tables, by token: 32-bit places, no 64-bit inverse beside."""
    r = np.random.default_rng(2)
    words = [f"w{i}" for i in range(50_000)]
    texts = [" ".join(words[k] for k in r.integers(0, 50_000, 1_000)) for _ in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    interpolation._Batch([batch])
    tracemalloc.start()
    made = interpolation._Batch([batch])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak / len(made.word_at) < 60
    assert made.word_at.dtype == made.pair_at.dtype == np.int32
    assert (np.diff(made.words.astype(object)) > 0).all()


def test_distinct_values_and_places():
    for values in ([], [5], [3, 1, 3, 2**63, 1]):
        values = np.array(values, dtype=np.uint64)
        found, at = distinct(values)
        assert found.tolist() == sorted(set(values.tolist()))
        assert (found[at] == values).all()
