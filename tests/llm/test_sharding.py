from __future__ import annotations

import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from folioscope.llm.sharding import assign_shards, rendezvous_shard, write_shards

from . import brute


def test_columns(spark):
    texts = ["", "é", None, "x" * 100_000, "same", "same"] * 30
    got = assign_shards(brute.docs_of(spark, texts), [1.0] * 5).collect()
    slots = defaultdict(list)
    for r in got:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 8, zlib.crc32(data))
        assert r.law == "key" and r.grown_shard in (r.shard, 5)
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(5))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.grown_shard for r in got}) == 6


def test_key_alone_decides(spark):
    a = assign_shards(brute.docs_of(spark, ["a"] * 50), [1.0] * 7).collect()
    b = assign_shards(brute.docs_of(spark, ["b"] * 50).repartition(3), [1.0] * 7).collect()
    assert {r.doc_id: r.shard for r in a} == {r.doc_id: r.shard for r in b}


def test_weights_and_few_moves(spark):
    keys = spark.range(40_000)
    weights = [1.0, 2.0, 5.0]
    shard = rendezvous_shard(F.col("id"), weights)
    grown = rendezvous_shard(F.col("id"), [*weights, 2.0])
    pairs = keys.select(shard.alias("a"), grown.alias("b")).collect()
    counts = Counter(a for a, _ in pairs)
    for i, w in enumerate(weights):
        assert abs(counts[i] / len(pairs) - w / 8) < 0.01
    moved = [b for a, b in pairs if a != b]
    assert set(moved) == {3} and abs(len(moved) / len(pairs) - 0.2) < 0.01


def test_null_and_repeated_keys(spark):
    docs = brute.docs_of(spark, ["x", "x", "y", None], ids=[None, None, 4, 4])
    got = assign_shards(docs, [1.0, 1.0]).collect()
    assert len(got) == 4
    assert len({(r.shard, r.slot) for r in got}) == 4
    assert len({r.shard for r in got if r.doc_id is None}) == 1
    assert assign_shards(brute.docs_of(spark, []), [1.0]).collect() == []


def test_written_shards(spark, tmp_path):
    docs = brute.docs_of(spark, [f"t{i}" for i in range(60)])
    write_shards(docs, str(tmp_path / "out"), [1.0] * 3, files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    expected = {r.doc_id: r.shard for r in assign_shards(docs, [1.0] * 3).collect()}
    assert {r.doc_id: r.shard for r in back.collect()} == expected
