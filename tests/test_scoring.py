from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from folioscope.fixed_values import CUES_EN, CUES_ZH
from folioscope.functions.scoring import (
    BonusRules,
    CueRule,
    final_score,
    insight_bonus,
    rubric_score,
)


def bonus_in_python(text: str, language: str) -> float:
    cues, low, high = (CUES_ZH, 30, 100) if language == "zh" else (CUES_EN, 50, 150)
    lowered = text.lower()
    score = sum([0.3 for cue in cues if cue in lowered], 0.0)
    return min(2.0, score + (0.5 if low <= len(lowered) <= high else 0.0))


def texts():
    for size in (0, 1, 29, 30, 49, 50, 100, 101, 150, 151):
        yield "x" * size
        yield "创" * size
    for n in range(len(CUES_EN) + 1):
        yield " ".join(CUES_EN[:n]).upper()
        yield "".join(CUES_ZH[:n])
    yield " ".join(CUES_EN) + " " * 20  # all cues inside the band: the cap
    yield "".join(CUES_ZH) + "一" * 20
    yield "novel novel novel"  # presence, not count
    yield "renovelated resolved"  # substrings
    yield "İstanbul first" + "é" * 40


def test_bonus_truth_table(spark):
    cases = [(t, lang) for t in texts() for lang in ("zh", "en", "na", "fr")]
    df = spark.createDataFrame(cases, "t STRING, lang STRING")
    got = df.select("t", "lang", insight_bonus(F.col("t"), F.col("lang")).alias("b"))
    for t, lang, b in got.collect():
        assert b == pytest.approx(bonus_in_python(t, lang), abs=1e-12), (t, lang)


def test_bonus_of_nothing(spark):
    df = spark.createDataFrame([(None, None)], "t STRING, lang STRING")
    assert df.select(insight_bonus(F.col("t"), F.col("lang"))).first()[0] == 0.0


def test_own_rules(spark):
    rules = BonusRules(CueRule(("alpha",), (1, 5)), {"de": CueRule(("beta",), (1, 3))})
    df = spark.createDataFrame(
        [("alpha", "en"), ("beta", "de"), ("alpha", "de"), ("beta", "en")],
        "t STRING, lang STRING",
    )
    got = [r[0] for r in df.select(insight_bonus(F.col("t"), F.col("lang"), rules)).collect()]
    assert got == [0.8, 0.3, 0.0, 0.5]


def test_scores_equal_python_over_the_whole_domain(spark):
    cases = [
        (total, cues, band)
        for total, cues, band in itertools.product(range(31), range(9), (0, 1))
    ]
    df = spark.createDataFrame(cases, "total INT, cues INT, band INT")
    base = rubric_score(F.col("total").cast("double"), F.lit(None), F.lit(0.0))
    bonus = F.least(F.lit(20), F.col("cues") * 3 + F.col("band") * 5) / F.lit(10.0)
    got = df.select("*", base.alias("base"), final_score(base, bonus).alias("final"))
    for total, cues, band, base_, final in got.collect():
        assert base_ == round(total / 3, 2)
        python_bonus = min(sum([0.3] * cues, 0.0) + 0.5 * band, 2.0)
        assert final == round(round(total / 3, 2) + python_bonus, 2)
