from __future__ import annotations

import random

import pytest
from tests.conftest import plan_of

from folioscope.operators.phrases import keyword_table_any, match_phrases, phrase_table

SCHEMA = "id STRING, title STRING, summary STRING"


def brute(rows, phrases):
    wanted = {p.lower() for p in phrases if p}
    out = {}
    for id_, title, summary in rows:
        text = " ".join(x for x in (title, summary) if x is not None).lower()
        out[id_] = sorted(p for p in wanted if p in text)
    return out


def found(df):
    return {r["id"]: list(r["phrases"]) for r in df.collect()}


@pytest.mark.parametrize("max_bytes", [32 << 20, 60])
def test_matches_equal_contains(spark, max_bytes):
    """Overlapping phrases, one across the border, nulls, empty texts, accents and a long text."""
    rows = [
        ("1", "A Large", "Model of models"), ("2", None, "ÉTUDE of ions"), ("3", "only title", None),
        ("4", None, None), ("5", "", ""), ("6", "x" * 200_000, "needle end"), ("7", "large", "model"),
    ]
    phrases = ["model", "Models", "el of", "large model", "étude", "x needle", "only", "", None, "model", "on", "zz"]
    df = spark.createDataFrame(rows, SCHEMA)
    table = phrase_table(spark.createDataFrame([(p,) for p in phrases], "phrase STRING"))
    assert found(match_phrases(df, table, max_bytes)) == brute(rows, phrases)


def test_hundred_thousand_phrases(spark):
    r = random.Random(1)
    words = ["".join(r.choices("abcdefgh", k=r.randrange(2, 6))) for _ in range(3_000)]
    rows = [(str(i), " ".join(r.choices(words, k=5)), " ".join(r.choices(words, k=40))) for i in range(60)]
    phrases = {" ".join(r.choices(words, k=2)) for _ in range(100_000)}
    phrases |= {row[2][k : k + 20] for row in rows for k in (0, 50, 100)}
    df = spark.createDataFrame(rows, SCHEMA)
    table = phrase_table(spark.createDataFrame([(p,) for p in phrases], "phrase STRING"))
    matched = match_phrases(df, table)
    assert found(matched) == brute(rows, phrases)
    assert "NestedLoop" not in plan_of(matched) and "Exchange" not in plan_of(matched)


def test_keyword_table_any(spark):
    df = spark.createDataFrame([("1", "a b", "c"), ("2", "d", "e")], SCHEMA)
    none = spark.createDataFrame([], "phrase STRING")
    assert keyword_table_any(df, none).count() == 2
    some = spark.createDataFrame([("b c",), ("q",)], "phrase STRING")
    assert [r["id"] for r in keyword_table_any(df, some).collect()] == ["1"]
    assert match_phrases(df.limit(0), some).count() == 0
    assert found(match_phrases(df, none)) == {"1": [], "2": []}
