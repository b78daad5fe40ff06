from __future__ import annotations

import os
import random

import pytest
from tests.conftest import rows

from folioscope.cluster import new_run_dir
from folioscope.operators.evaluation_table import EvaluationTable

SCHEMA = "paper_id STRING, rating DOUBLE, translation STRING"


def table(spark, buckets=8):
    shape = spark.createDataFrame([], SCHEMA).schema
    return EvaluationTable(spark, new_run_dir(spark, "evaluations"), shape, buckets=buckets)


def patch(spark, values):
    return spark.createDataFrame(values, SCHEMA)


def apply(state, values):
    for key, *fields in values:
        if key is not None:
            old = state.get(key, [None, None])
            state[key] = [o if n is None else n for n, o in zip(fields, old, strict=True)]


def state_of(stored):
    return {r[0]: list(r)[1:] for r in rows(stored.read())}


def test_three_patches_equal_plain_upserts(spark):
    r = random.Random(2)
    stored, state = table(spark), {}
    assert stored.read().count() == 0
    for _ in range(3):
        keys = r.sample(range(60), 25)
        values = [(f"p{k}", r.choice([None, float(k)]), r.choice([None, "t"])) for k in keys]
        values.append((None, 1.0, "lost"))
        done = stored.upsert(patch(spark, values))
        apply(state, values)
        assert state_of(stored) == state and done.buckets == 8
    assert len(stored.versions()) == 3


def test_a_small_patch_rewrites_its_bucket_only(spark):
    stored = table(spark, buckets=100)
    stored.upsert(patch(spark, [(f"p{k}", 1.0, None) for k in range(400)]))
    first = stored._holders(stored.versions()[-1])
    done = stored.upsert(patch(spark, [("p7", None, "new")]))
    second = stored._holders(done.version)
    assert done.rewritten == 1
    assert sum(first[b] != second[b] for b in first) == 1
    assert [n for n in os.listdir(f"{stored.root}/data/{done.version}") if n.startswith("bucket=")] == [
        f"bucket={b}" for b in first if first[b] != second[b]
    ]
    assert state_of(stored)["p7"] == [1.0, "new"] and len(state_of(stored)) == 400


def test_a_run_broken_between_the_phases_leaves_the_old_state(spark, monkeypatch):
    stored = table(spark)
    stored.upsert(patch(spark, [("a", 1.0, None), ("b", 2.0, None)]))
    before = state_of(stored)

    def broken(*_):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(stored, "_publish", broken)
        with pytest.raises(OSError):
            stored.upsert(patch(spark, [("a", 9.0, "x")]))
    assert state_of(stored) == before
    stored.upsert(patch(spark, [("a", None, "y")]))
    assert state_of(stored) == {"a": [1.0, "y"], "b": [2.0, None]}
    gone = stored.remove_old()
    assert gone and state_of(stored) == {"a": [1.0, "y"], "b": [2.0, None]}
    assert len(stored.versions()) == 1


def test_two_upserts_from_one_version(spark, monkeypatch):
    stored = table(spark)
    stored.upsert(patch(spark, [("a", 1.0, None)]))
    other = EvaluationTable(spark, stored.root, stored.schema, buckets=8)
    publish = stored._publish

    def overtaken(*args):
        monkeypatch.setattr(stored, "_publish", publish)
        other.upsert(patch(spark, [("a", 2.0, None)]))
        publish(*args)

    monkeypatch.setattr(stored, "_publish", overtaken)
    with pytest.raises(RuntimeError, match="newer version"):
        stored.upsert(patch(spark, [("a", 3.0, None)]))
    assert state_of(stored) == {"a": [2.0, None]}


def test_old_versions_stay_readable_and_empty_patches_publish(spark):
    stored = table(spark)
    first = stored.upsert(patch(spark, [("a", 1.0, None)])).version
    done = stored.upsert(patch(spark, []))
    stored.upsert(patch(spark, [("a", 2.0, None)]))
    assert done.rewritten == 0
    assert rows(stored.read(first)) == [("a", 1.0, None)]
    assert stored.remove_old(keep=3) == []
