from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from folioscope.fixed_values import INSIGHT_FAILED
from folioscope.functions.responses import (
    accept_insight,
    parse_insight,
    parse_rating,
    strip_fence,
)

FENCED = [
    ("", ""),
    ("  plain \n", "plain"),
    ('```json\n{"a": 1}\n```', '{"a": 1}'),
    ('```json{"a": 1}', '{"a": 1}'),
    ('{"a": 1}```', '{"a": 1}'),
    ('```\n{"a": 1}\n```', '```\n{"a": 1}'),
    ('　 ```json {"a": 1} ``` \x1c', '{"a": 1}'),
    ("```json```", ""),
    ("```json", ""),
    ("```", ""),
    ("``````", "```"),
    ("```JSON {}```", "```JSON {}"),
    ("x ```json y```", "x ```json y"),
]


@pytest.mark.parametrize(("text", "expected"), FENCED)
def test_fence(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t STRING")
    assert df.select(strip_fence(F.col("t"))).first()[0] == expected


RATINGS = [
    '{"innovation": 7, "rigor": 8, "impact": 9}',
    '{"innovation": 7.5}',
    '{"impact": 1, "impact": 2}',
    '{"innovation": null, "rigor": 3}',
    '{"other": [1, {"x": "}"}]}',
    "{}",
    "",
    "   ",
    "null",
    "7",
    '"text"',
    "[]",
    "[1, 2]",
    '[{"innovation": 1}]',
    '{"innovation": 7',
    '{"innovation": 7} tail',
    '{"innovation": 7}}',
    '{"innovation": 7} {"rigor": 1}',
    '{"innovation": 7}, {"rigor": 1}',
    '{"innovation": 7},',
    "{'innovation': 7}",
    '{"innovation": 07}',
    "no JSON at all",
    "]",
    "],[",
]


@pytest.mark.parametrize("text", RATINGS)
def test_rating_reads_what_a_strict_parser_reads(spark, text):
    try:
        value = json.loads(text)
    except ValueError:
        value = None
    expected = value if isinstance(value, dict) else None
    df = spark.createDataFrame([(text,)], "t STRING")
    got = df.select(parse_rating(F.col("t")).alias("r")).first()["r"]
    assert got["parse_status"] == ("invalid" if expected is None else "ok")
    assert got["raw"] == (text if expected is None else None)
    for name in ("innovation", "rigor", "impact"):
        wanted = (expected or {}).get(name)
        assert (got["parsed"] or {name: None})[name] == wanted


def test_a_missing_response_is_invalid(spark):
    df = spark.createDataFrame([(None,)], "t STRING")
    got = df.select(parse_rating(F.col("t")).alias("r")).first()["r"]
    assert got["parse_status"] == "invalid"


@pytest.mark.parametrize(
    ("text", "accepted"),
    [
        ('{"abstract": "A", "breakthrough": "B"}', True),
        ('{"abstract": "", "breakthrough": ""}', True),
        ('{"abstract": "A"}', False),
        ('{"breakthrough": "B"}', False),
        ('{"abstract": "A", "breakthrough": null}', False),
        ("broken", False),
    ],
)
def test_acceptance(spark, text, accepted):
    df = spark.createDataFrame([(text, "summary")], "t STRING, s STRING")
    parsed = parse_insight(F.col("t"))["parsed"]
    got = df.select(accept_insight(parsed, F.col("s")).alias("a")).first()["a"]
    assert got["accepted"] is accepted
    if accepted:
        assert (got["abstract"], got["breakthrough"]) == tuple(json.loads(text).values())
    else:
        assert (got["abstract"], got["breakthrough"]) == ("summary", INSIGHT_FAILED)
