from __future__ import annotations

from pyspark.sql import functions as F
from tests.conftest import rows

from folioscope.operators.ranking import top_k
from folioscope.streaming.ranking_stream import rank_stream, read_best, read_progress

SCHEMA = "id STRING, published TIMESTAMP, value DOUBLE"
SHAPE = "id STRING, published TIMESTAMP, final_score DOUBLE, error STRING"
K = 4


def papers(spark, n=60):
    ids = spark.range(n)
    return ids.select(
        F.col("id").cast("string").alias("id"),
        F.timestamp_seconds(1_700_000_000 + F.col("id") * 37 % 11).alias("published"),
        F.when(F.col("id") % 13 != 5, (F.col("id") * 7 % 10).cast("double")).alias("value"),
    )


def score(batch):
    """Scores, and an error where there is no value."""
    return batch.select(
        "id",
        "published",
        F.col("value").alias("final_score"),
        F.when(F.col("value").isNull(), F.lit("no value")).alias("error"),
    )


def run(spark, source, path):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    query = rank_stream(stream, score, K, path).trigger(availableNow=True).start()
    query.awaitTermination()


def test_end_state_is_the_batch_result(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "state")
    papers(spark).repartition(5).write.parquet(source)
    run(spark, source, path)
    good = score(papers(spark)).where("error IS NULL")
    assert rows(read_best(spark, path, SHAPE)) == rows(top_k(good, K))
    steps = read_progress(spark, path).orderBy("batch").collect()
    assert [r["batch"] for r in steps] == [0, 1, 2, 3, 4]
    assert (steps[-1]["arrived"], steps[-1]["analysed"]) == (60, good.count())
    quarantined = spark.read.parquet(f"{path}/quarantine")
    assert quarantined.count() == 60 - good.count()
    assert spark.read.parquet(f"{path}/scored").count() == 60
    # State is two folders in turn, however many batches came.
    assert sorted(p.name for p in (tmp_path / "state" / "best").iterdir()) == ["slot=0", "slot=1"]
    assert len(list((tmp_path / "state" / "progress").iterdir())) == 2

    # More files arrive; the stream goes on from where it was.
    late = papers(spark).withColumns(
        {"id": F.concat(F.lit("late"), "id"), "value": F.col("value") + 0.5}
    )
    late.coalesce(2).write.mode("append").parquet(source)
    run(spark, source, path)
    every = good.union(score(late).where("error IS NULL"))
    assert rows(read_best(spark, path, SHAPE)) == rows(top_k(every, K))
    assert read_progress(spark, path).agg(F.max("arrived")).first()[0] == 120


def test_nothing_arrives(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "state")
    papers(spark).where("false").write.parquet(source)
    run(spark, source, path)
    best = read_best(spark, path, SHAPE)
    assert best.count() == 0 and "final_score" in best.columns


def test_a_repeated_batch_leaves_the_same_state(spark, tmp_path):
    """Runs a batch again, as the engine does after a failure between write and commit."""
    path = str(tmp_path / "state")
    taken = {}

    class Writer:
        def foreachBatch(self, absorb):
            taken["absorb"] = absorb
            return self

        def option(self, *_):
            return self

    class Stream:
        sparkSession = spark
        schema = papers(spark).schema
        writeStream = Writer()

    rank_stream(Stream(), score, K, path)
    parts = papers(spark).where("id < '3'"), papers(spark).where("id >= '3'")
    for number in (0, 1, 1):
        taken["absorb"](parts[number], number)
    good = score(papers(spark)).where("error IS NULL")
    assert rows(read_best(spark, path, SHAPE)) == rows(top_k(good, K))
    last = read_progress(spark, path).where("batch = 1").first()
    assert (last["arrived"], last["analysed"]) == (60, good.count())
