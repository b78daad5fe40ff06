from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F
from tests.conftest import plan_of, rows

from folioscope.operators.authors import (
    attach_profiles,
    author_cards,
    author_metrics,
    enrich_with_authors,
    nest_authors,
    resolve_authors,
    unnest_authors,
)
from folioscope.sources.profiles import from_flat_payload, from_nested_payload

FLAT = [
    ("Ann", {"data": [{"name": "A. Ann", "hIndex": 3, "paperCount": 9, "citationCount": 50,
                       "affiliations": [{"name": ""}, {"name": None}, {"name": "Uni"}]},
                      {"name": "second", "hIndex": 99}]}),
    ("Bob", {"data": []}),
    ("Cy", {"data": [{"name": "Cy", "hIndex": None, "paperCount": 1}]}),
    ("Dee", {}),
]
NESTED = [
    ("Ann", {"results": [{"display_name": "x", "works_count": 1, "cited_by_count": 2,
                          "summary_stats": {"h_index": 8}, "affiliations": []}]}),
    ("Bob", {"results": [{"display_name": "Bob", "works_count": 4, "cited_by_count": 5,
                          "summary_stats": {"h_index": 6},
                          "affiliations": [{"institution": None},
                                           {"institution": {"display_name": ""}},
                                           {"institution": {"display_name": "Lab"}},
                                           {"institution": {"display_name": "Two"}}]}]}),
    ("Cy", {"results": [{"display_name": "Cy", "works_count": 77}]}),
]


def payloads(spark, data):
    return spark.createDataFrame(
        [(n, json.dumps(p)) for n, p in data], "name STRING, payload STRING"
    )


def profiles(spark):
    return {
        "semantic_scholar": from_flat_payload(payloads(spark, FLAT)),
        "openalex": from_nested_payload(payloads(spark, NESTED)),
    }


ORDER = ("semantic_scholar", "openalex")


def names(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "name STRING")


def test_first_source_wins_as_a_whole_row(spark):
    wanted = names(spark, "Ann", "Bob", "Cy", "Zed", "Ann")
    got = {r["name"]: tuple(r)[1:] for r in resolve_authors(wanted, profiles(spark), ORDER).collect()}
    assert got == {
        "Ann": (3, 9, 50, ["Uni"], "semantic_scholar"),
        "Bob": (6, 4, 5, ["Lab", "Two"], "openalex"),
        # Present but null stays null: no field comes from the other source.
        "Cy": (None, 1, None, [], "semantic_scholar"),
        "Zed": (None, None, None, [], "none"),
    }
    swapped = resolve_authors(wanted, profiles(spark), ORDER[::-1]).where("name = 'Ann'").first()
    assert (swapped["h_index"], swapped["source_used"]) == (8, "openalex")


def test_cards_show_defaults(spark):
    cards = author_cards(resolve_authors(names(spark, "Bob", "Zed"), profiles(spark), ORDER))
    assert rows(cards) == [("Bob", "6", "Lab", "openalex"), ("Zed", "N/A", "N/A", "none")]


PAPERS = [
    ("p1", ["Bob", "Unknown", "Ann", "", None, "Bob"]),
    ("p2", []),
    ("p3", None),
    ("p4", ["Unknown"]),
    ("p5", ["Zed"]),
]


def papers(spark):
    return spark.createDataFrame(PAPERS, "id STRING, authors ARRAY<STRING>")


def test_unnest_drops_blanks_and_keeps_order(spark):
    assert rows(unnest_authors(papers(spark))) == [
        ("p1", 0, "Bob"),
        ("p1", 2, "Ann"),
        ("p1", 5, "Bob"),
        ("p5", 0, "Zed"),
    ]


def test_enrichment_keeps_order_and_duplicates(spark):
    got = {
        r["id"]: [a["name"] for a in r["authors_info"]]
        for r in enrich_with_authors(papers(spark), profiles(spark), ORDER).collect()
    }
    assert got == {"p1": ["Bob", "Ann", "Bob"], "p2": [], "p3": [], "p4": [], "p5": ["Zed"]}


@pytest.mark.parametrize("options", [{"enabled": False, "order": ORDER}, {"order": ()}])
def test_gate_leaves_papers_unchanged(spark, options):
    df = papers(spark)
    assert enrich_with_authors(df, profiles(spark), **options) is df


def test_a_hot_name_is_spread_and_nothing_is_lost(spark):
    data = [(f"p{n}", ["Ann", "Bob" if n % 3 else "Zed", "Ann"]) for n in range(300)]
    df = spark.createDataFrame(data, "id STRING, authors ARRAY<STRING>")
    authored = unnest_authors(df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1k")
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "1k")
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "1.1")
    try:
        hot = attach_profiles(authored.repartition(8), profiles(spark), ORDER)
        found = sorted((r["id"], r["pos"], r["name"], r["source_used"]) for r in hot.collect())
        assert "skew=true" in plan_of(hot)
    finally:
        for key in ("adaptive.advisoryPartitionSizeInBytes", "autoBroadcastJoinThreshold",
                    "adaptive.skewJoin.skewedPartitionThresholdInBytes",
                    "adaptive.skewJoin.skewedPartitionFactor"):
            spark.conf.unset(f"spark.sql.{key}")
    cold = attach_profiles(authored, profiles(spark), ORDER)
    assert found == rows(cold.select("id", "pos", "name", "source_used"))
    assert len(found) == 900
    assert nest_authors(hot).count() == 300


def h_index(citations):
    ordered = sorted(citations, reverse=True)
    return sum(1 for n, c in enumerate(ordered, 1) if c >= n)


def test_metrics_match_brute_force(spark):
    rng = random.Random(11)
    authors = {
        "none": [0, 0, 0],
        "one": [1],
        "big": [10**9] * 3,
        "flat": [5] * 40,
        "hot": [rng.randrange(0, 3000) for _ in range(2000)],
        "small": [rng.randrange(0, 9) for _ in range(30)],
        "square": [10] * 10 + [0] * 5,
        "fractions": [2.9, 2.9, 2.1],
    }
    data = [(a, float(c)) for a, cs in authors.items() for c in cs] + [("one", None)]
    df = spark.createDataFrame(data, "author STRING, citations DOUBLE").repartition(4)
    got = {r["author"]: tuple(r)[1:] for r in author_metrics(df).collect()}
    for author, values in authors.items():
        whole = [int(c) for c in values] + ([0] if author == "one" else [])
        assert got[author] == (len(whole), sum(whole), h_index(whole)), author


def test_metrics_of_nothing(spark):
    empty = spark.createDataFrame([], "author STRING, citations DOUBLE")
    assert author_metrics(empty).count() == 0
