from __future__ import annotations

from datetime import datetime, timedelta
from pathlib import Path

from tests.conftest import rows

from folioscope.cluster import new_run_dir
from folioscope.operators.membership import (
    KeyFilter,
    add_keys,
    build_filter,
    mark_stored,
    pending_by_filter,
    settled_filter,
)
from folioscope.sources.papers import newest, newest_dated, pending_content


def ids(spark, *spans):
    values = [(f"id{k}", k) for a, b in spans for k in range(a, b)]
    return spark.createDataFrame(values, "id STRING, n LONG")


def test_equals_the_anti_join_and_shuffles_few(spark):
    papers = ids(spark, (0, 6_000)).unionByName(spark.createDataFrame([(None, -1)], "id STRING, n LONG"))
    stored = ids(spark, (5_000, 6_000), (5_000, 5_500)).select("id")
    known = settled_filter(stored)
    expected = rows(pending_content(papers, stored))
    assert rows(pending_by_filter(papers, stored, known)) == expected
    assert rows(pending_by_filter(papers, stored, known, max_words=1)) == expected
    # Rows that go on to the anti-join: 6,001 without the filter, the 1,000 stored and few more with it.
    through = mark_stored(papers, known).where("maybe_stored").count()
    assert 1_000 <= through <= 1_000 + 0.06 * 5_000


def test_kept_beside_the_manifest_and_added_to(spark):
    old, more = ids(spark, (0, 300)).select("id"), ids(spark, (300, 500)).select("id")
    path = new_run_dir(spark, "filter")
    build_filter(old, expected=1_000).write(path)
    grown = add_keys(KeyFilter.read(spark, path), more)
    marked = mark_stored(ids(spark, (0, 3_000)), grown)
    assert marked.where("n < 500 and not maybe_stored").count() == 0
    assert marked.where("n >= 500 and maybe_stored").count() <= 0.05 * 2_500
    both = old.unionByName(more)
    assert rows(pending_by_filter(ids(spark, (0, 700)), both, grown)) == rows(ids(spark, (500, 700)))


def test_nothing_stored_and_nothing_to_store(spark):
    none = ids(spark).select("id")
    known = settled_filter(none)
    assert pending_by_filter(ids(spark, (0, 5)), none, known).count() == 5
    assert pending_by_filter(ids(spark), none, known).count() == 0
    path = new_run_dir(spark, "filter")
    known.write(path)
    assert KeyFilter.read(spark, path).words == 1


def dated(spark, rows_):
    path = new_run_dir(spark, "dated")
    df = spark.createDataFrame(rows_, "id STRING, published TIMESTAMP_NTZ, date DATE")
    df.repartition("date").write.partitionBy("date").parquet(path)
    return path


def test_newest_of_dated_folders(spark):
    """Ties on the border day, papers without a date, and old folders that are not read."""
    start = datetime(2024, 3, 1)
    values = [(f"{k:03}", t := start + timedelta(days=k // 10), t.date()) for k in range(100)]
    values += [("null", None, None)]
    path = dated(spark, values)
    whole = spark.read.parquet(path)
    for limit in (1, 10, 15, 99, 100, 101, 500):
        got = newest_dated(spark, path, limit).select("id")
        assert [r["id"] for r in got.collect()] == [r["id"] for r in newest(whole, limit).collect()]
    for file in Path(f"{path.removeprefix('file:')}/date=2024-03-01").glob("*.parquet"):
        file.write_bytes(b"broken")
    got = newest_dated(spark, path, 15).select("id")
    assert [r["id"] for r in got.collect()] == [f"{k:03}" for k in [*range(90, 100), *range(80, 85)]]
