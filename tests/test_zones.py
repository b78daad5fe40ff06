"""Times are UTC whatever the zone of the session."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folioscope.functions.display import day_text, iso_text, utc_micros
from folioscope.sources.papers import within_days
from suite.registry import ORACLE, QUERIES
from tests.test_oracle import spark_result, sql_result

ZONES = ("UTC", "America/New_York")
QUERY_NAMES = (
    "time_window", "export_json_rows", "paper_card", "cache_fold", "running_best", "api_envelope",
)


@pytest.fixture(params=ZONES)
def zone(spark, request):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("name", QUERY_NAMES)
def test_queries_equal_their_sql(spark, sf_dir, zone, name):
    assert name in QUERIES
    assert spark_result(spark, sf_dir, name) == sql_result(sf_dir, ORACLE[name])


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_texts_and_bounds(spark, zone, kind):
    # 02:30 on that day doesn't exist in New York, and 01:30 in November comes twice.
    texts = ["2024-01-01 00:00:00", "2024-03-10 02:30:00", "2024-11-03 01:30:00", "2024-11-03 05:30:00"]
    rows = spark.createDataFrame([(t,) for t in texts], "t STRING")
    if kind == "timestamp":
        published = F.concat("t", F.lit("+00:00")).cast("timestamp")
    else:
        published = F.col("t").cast("timestamp_ntz")
    df = rows.select("t", published.alias("published"))
    got = df.select(
        "t",
        iso_text(F.col("published")).alias("iso"),
        day_text(F.col("published")).alias("day"),
        utc_micros(F.col("published")).alias("micros"),
    ).collect()
    for r in got:
        assert r["iso"] == r["t"].replace(" ", "T") + "+00:00" and r["day"] == r["t"][:10]
        since = datetime.fromisoformat(r["t"]) - datetime(1970, 1, 1)
        assert r["micros"] == since // timedelta(microseconds=1)
    for place, text in enumerate(texts):
        kept = within_days(df, datetime.fromisoformat(text) + timedelta(days=3), 3)
        assert kept.count() == len(texts) - place
