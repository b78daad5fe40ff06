from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from folioscope.llm import spelling_groups as sg
from folioscope.llm.queries import QUERIES

from . import brute

UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def counted(docs):
    """Words of (doc_id, text) by the contract, and how often they occur."""
    out = Counter()
    for doc_id, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def grouped(words):
    """The contract's rows; candidates by all places where one letter is left out or any."""
    holes = {}
    for w in words:
        for k in range(len(w)):
            holes.setdefault(w[:k] + "*" + w[k + 1 :], set()).add(w)
    out = {}
    for w, n in words.items():
        near = set().union(*(holes[w[:k] + "*" + w[k + 1 :]] for k in range(len(w)))) - {w}
        near |= {w[:k] + w[k + 1 :] for k in range(len(w))} & words.keys()
        near |= {x for k in range(len(w) + 1) for x in holes.get(w[:k] + "*" + w[k:], ())}
        assert all(one_edit(w, x) for x in near)
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form = best if best is not None and words[best] >= 10 * n else None
        out[w] = (form, n, len(near), words.get(form))
    rows = {}
    for w, (form, n, number, form_n) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows[w] = (form, root, n, number, form_n)
    return rows


def as_dict(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = df.collect()
    got = {r.word: tuple(r)[1:] for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("letters", ["ab", "abcdefgé"])
def test_near_pairs_equal_brute_force(letters):
    r = random.Random(3)
    words = sorted({"abab" + "".join(r.choices(letters, k=r.randrange(2, 7))) for _ in range(90)})
    coded = [w.encode("latin-1") for w in words]
    block = np.arange(len(words)) * 0
    lists = np.array([r.random() < 0.8 for _ in words])
    asks = np.array([r.random() < 0.8 for _ in words])
    i, j = sg.near_pairs(coded, block + 4, block, lists, asks)
    got = Counter(zip(i.tolist(), j.tolist(), strict=True))
    want = {
        (a, b) for a in np.flatnonzero(asks) for b in np.flatnonzero(lists)
        if one_edit(words[a], words[b])
    }
    assert set(got) == want and set(got.values()) <= {1}
    for a in coded[:30]:
        for b in coded[:30]:
            assert sg._one_edit(a, b) == one_edit(a.decode("latin-1"), b.decode("latin-1"))


@pytest.mark.parametrize("block", [sg.BLOCK, 3])
def test_groups_of_variants(spark, block):
    """Chains of forms, ties, repeated rows, very long words; blocks whole and in parts."""
    r = random.Random(5)
    texts = []
    base = ["strassenbahn", "wonderfully", "aaaaaaaa", "aaaaaaaaa", "Ünglücklich", "x" * 30_000]
    for w in base:
        made = [w, w + "s", w[1:], w[:-1], w[:3] + "q" + w[4:], w[:-2] + "zz", w[:5] + "é" + w[5:]]
        for k, v in enumerate(made):
            texts += [f"{v} and {v.upper()}."] * r.choice([1, 2, 12] if k else [130])
    texts += ["chainword"] * 300 + ["chainwore"] * 25 + ["chaidwore"] * 2
    rows = [(n // 2, t, "en", "s", 1, "mine", 1.0) for n, t in enumerate(texts)]
    rows += [(None, "wonderfully wonderfullx wonderfullx", *[None] * 5), (1, *[None] * 6)]
    rows += [(2, "", "", "", 0, "", 0.0)] * 2
    df = spark.createDataFrame(rows, f"{brute.DOC_SCHEMA}, word string, n double")
    want = grouped(counted((x[0], x[1]) for x in rows))
    assert as_dict(sg.group_spellings(df, block=block)) == want
    chains = [w for w, x in want.items() if x[0] is not None and x[1] != x[0]]
    assert chains and any(len(w) > 1_000 and x[2] for w, x in want.items())


def test_small_slices(spark, monkeypatch):
    r = random.Random(8)
    words = {"".join(r.choices("abc", k=r.randrange(7, 10))): r.randrange(2, 300) for _ in range(700)}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(1)
    monkeypatch.setattr(sg, "_ASKING", 50)
    got = {x.word: (x.n_near, x.best, x.best_n) for x in sg.near_words(df).collect()}
    want = grouped(words)
    assert {w: x[0] for w, x in got.items()} == {w: x[3] for w, x in want.items() if x[3]}
    for w, (_, best, n) in got.items():
        assert n == max(k for x, k in words.items() if one_edit(w, x)) and words[best] == n


def test_no_words(spark):
    docs = spark.createDataFrame([], brute.DOC_SCHEMA)
    assert sg.group_spellings(docs).count() == 0
    docs = spark.createDataFrame([(1, "short words", "en", "s", 1)], brute.DOC_SCHEMA)
    assert sg.group_spellings(docs).count() == 0


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert as_dict(QUERIES["op13_spelling"](spark, sf_dir)) == grouped(counted(docs))
