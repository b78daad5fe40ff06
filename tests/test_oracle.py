"""Every query against its SQL, and proof that the comparison can fail."""

from __future__ import annotations

import math
import os
from datetime import datetime
from decimal import Decimal

import duckdb
import pytest

from __spark_entry__ import entry
from suite.registry import ORACLE, QUERIES


def connect(sf_dir):
    con = duckdb.connect()
    for file in sorted(os.listdir(sf_dir)):
        name = file.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{file}'")
    return con


def plain(value):
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def normal(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


def spark_result(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    return sorted(df.columns), normal(df.columns, df.collect())


def sql_result(sf_dir, sql):
    result = connect(sf_dir).execute(sql)
    names = [column[0] for column in result.description]
    return sorted(names), normal(names, result.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, name):
    assert spark_result(spark, sf_dir, name) == sql_result(sf_dir, ORACLE[name])


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize(
    ("name", "old", "new"),
    [
        ("insight_bonus", "'thtion'", "'zzz'"),
        ("newest_200", "published DESC", "published"),
        ("rank_all", "insight_bonus, 2)", "insight_bonus, 0)"),
        ("relevance_filter", "'token'", "'zzz'"),
        ("key_sentence", "tenths DESC, pos", "tenths DESC, pos DESC"),
        ("topk_ranked", "published DESC, id", "published, id"),
    ],
)
def test_changed_rule_is_noticed(spark, name, old, new):
    sf_dir = "/root/testdata/sf0.01"  # large enough for the limits to cut
    sql = ORACLE[name]
    assert old in sql
    assert spark_result(spark, sf_dir, name) != sql_result(sf_dir, sql.replace(old, new))
