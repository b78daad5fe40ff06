from __future__ import annotations

import json
from collections import Counter

import pytest

from folioscope.cluster import new_run_dir
from folioscope.operators.author_lookup import LookupSource, lookup_authors
from folioscope.sources.profiles import from_flat_payload, from_nested_payload

NAMES = ["Ann", "Bob", "Cy", "Dee", "Ann", "Ann", None, "Eve"]


def flat(**known):
    return {n: json.dumps({"data": [v] if v is not None else []}) for n, v in known.items()}


def nested(**known):
    return {n: json.dumps({"results": [v]}) for n, v in known.items()}


def service(log, answers, down=()):
    def ask(names):
        with open(log, "a", encoding="utf-8") as f:
            f.writelines(f"{n}\n" for n in names)
        if set(down) & set(names):
            raise OSError("busy")
        return [answers.get(n) for n in names]

    return ask


def lookup(spark, first, second, folder, **more):
    names = spark.createDataFrame([(n,) for n in NAMES], "name STRING")
    sources = [LookupSource("a", first, from_flat_payload), LookupSource("b", second, from_nested_payload)]
    rows = lookup_authors(names, sources, folder, parallelism=2, **more).collect()
    assert len(rows) == len({r["name"] for r in rows})
    return {r["name"]: (r["h_index"], r["paper_count"], r["source_used"]) for r in rows}


@pytest.mark.parametrize("waves", [1, 3])
def test_the_second_source_sees_only_what_the_first_does_not_know(spark, tmp_path, waves):
    one, two = tmp_path / "one", tmp_path / "two"
    first = service(one, flat(Ann={"hIndex": 3}, Bob=None, Cy={"paperCount": 1}))
    second = service(two, nested(Ann={"works_count": 9}, Bob={"works_count": 4}, Cy={"works_count": 8}))
    folder = new_run_dir(spark, "lookups")
    expected = {
        "Ann": (3, None, "a"), "Bob": (None, 4, "b"),
        "Cy": (None, 1, "a"),  # known, so no field comes from the other source
        "Dee": (None, None, "none"), "Eve": (None, None, "none"),
    }
    assert lookup(spark, first, second, folder, waves=waves) == expected
    assert sorted(one.read_text().split()) == ["Ann", "Bob", "Cy", "Dee", "Eve"]
    assert sorted(two.read_text().split()) == ["Bob", "Dee", "Eve"]
    # Started again, nobody is asked again, not even for names that are not known.
    assert lookup(spark, first, second, folder, waves=waves) == expected
    assert len(one.read_text().split()) == 5 and len(two.read_text().split()) == 3


def test_failed_calls_go_on_to_the_next_source_and_are_asked_again(spark, tmp_path):
    one, two = tmp_path / "one", tmp_path / "two"
    answers = flat(Ann={"hIndex": 3}, Bob={"hIndex": 5}, Cy={"hIndex": 6}, Dee=None, Eve=None)
    second = service(two, nested(Bob={"works_count": 4}))
    folder = new_run_dir(spark, "lookups")
    got = lookup(spark, service(one, answers, down=["Bob"]), second, folder, waves=1)
    assert got["Bob"] == (None, 4, "b") and got["Ann"] == (3, None, "a") and got["Cy"] == (6, None, "a")
    before = Counter(one.read_text().split())
    again = lookup(spark, service(one, answers), second, folder, waves=1)
    assert again["Bob"] == (5, None, "a")
    assert Counter(one.read_text().split()) - before == Counter(["Bob"])


def test_no_names(spark, tmp_path):
    none = spark.createDataFrame([], "name STRING")
    source = LookupSource("a", service(tmp_path / "x", {}), from_flat_payload)
    assert lookup_authors(none, [source], new_run_dir(spark, "lookups")).count() == 0
    assert not (tmp_path / "x").exists()
