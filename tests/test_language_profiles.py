from __future__ import annotations

import numpy as np
import pytest

from folioscope.operators import language_profiles as lp

SAMPLES = {
    "ja": ["これは日本語の文章です。漢字とかなが混ざっています。", "機械学習の研究について述べる。結果を示した。", "私たちは新しい方法を提案します。"],
    "zh": ["这是中文的文章。我们提出了一种新的方法。", "机器学习研究的结果表明。", "本文介绍了语言模型的应用。"],
    "en": ["this is an english text about methods", "we propose a new method and show results", "the study of learning machines"],
    "nl": ["dit is een nederlandse tekst over methoden", "wij stellen een nieuwe methode voor", "het onderzoek naar lerende machines"],
}


def learnt(spark, samples=SAMPLES):
    rows = [(label, t) for label, texts in samples.items() for t in texts]
    return lp.learn_profiles(spark.createDataFrame(rows, "label STRING, text STRING"))


def labelled(spark, texts, profiles):
    df = spark.createDataFrame(list(enumerate(texts)), "id LONG, text STRING")
    return {r["id"]: r for r in lp.label_languages(df, profiles).collect()}


def test_languages_of_one_alphabet_and_of_shared_ideographs(spark):
    texts = [
        "日本語の研究です", "中文的研究方法", "a new study of the method", "een nieuwe methode over het onderzoek",
        None, "", "ab", "THE METHOD IS NEW AND THE RESULTS SHOW",
    ]
    got = labelled(spark, texts, learnt(spark))
    assert [got[i]["language"] for i in range(len(texts))] == ["ja", "zh", "en", "nl", "en", "en", "en", "en"]
    assert got[0]["language_lead"] > 0 and got[4]["language_lead"] == 0


def test_scores_equal_plain_sums(spark):
    profiles = learnt(spark)
    text = "we propose nieuwe methoden 方法 " * 3
    sums = []
    for weights in profiles.weights:
        total = 0
        for a, b, c in zip(text, text[1:], text[2:], strict=False):
            slot = sum(ord(x) * f for x, f in zip((a, b, c), lp.FACTORS, strict=True)) % lp.SLOTS
            total += int(weights[slot])
        sums.append(total)
    best = max(range(len(sums)), key=lambda k: (sums[k], -k))
    row = labelled(spark, [text], profiles)[0]
    assert row["language"] == profiles.labels[best]
    assert row["language_lead"] == sorted(sums)[-1] - sorted(sums)[-2]


def test_ties_repeats_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(lp, "_SLICE", 50)
    profiles = learnt(spark)
    df = spark.createDataFrame([(1, "een nieuwe " * 30_000, "mine")] * 3, "id LONG, text STRING, language STRING")
    rows = lp.label_languages(df, profiles).collect()
    assert len(rows) == 3 and {r["language"] for r in rows} == {"nl"}
    same = lp.Profiles(("b", "c"), np.zeros((2, lp.SLOTS), dtype=np.int64))
    assert labelled(spark, ["abcdef"], same)[0]["language"] == "b"


def test_without_labels(spark):
    none = lp.learn_profiles(spark.createDataFrame([(None, "x"), ("en", None)], "label STRING, text STRING"))
    assert none.labels == ()
    assert labelled(spark, ["some text", None], none)[0]["language"] == "en"
    one = learnt(spark, {"fr": ["un texte"]})
    assert labelled(spark, ["autre"], one)[0]["language"] == "fr"


@pytest.mark.parametrize("sf", ["0.01"])
def test_held_out_accuracy(spark, sf):
    """Learnt from the documents with labels, right on the others for each language."""
    path = f"/root/testdata/sf{sf}"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    known = spark.read.parquet(f"{path}/labels.parquet").select("doc_id").distinct()
    rows = docs.join(known, "doc_id", "left_semi").selectExpr("text", "lang AS label")
    rest = docs.join(known, "doc_id", "left_anti")
    got = lp.label_languages(rest, lp.learn_profiles(rows)).collect()
    for lang in {r["lang"] for r in got}:
        own = [r["language"] == lang for r in got if r["lang"] == lang and len(r["text"].split()) >= 5]
        assert sum(own) >= 0.98 * len(own), lang
