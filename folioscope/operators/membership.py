"""Which papers are stored already, with a filter that settles most of them unshuffled."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.cluster import settle
from folioscope.sources.papers import pending_content

#: Words of 64 bits that are broadcast at most: some 50 MB in a task.
MAX_WORDS = 2_000_000
_BITS = 4


@dataclass(frozen=True)
class KeyFilter:
    """A Bloom filter of keys as a table: `word` (number), `bits` (64) of `words` words.

    A key sets four bits of one word, so a test is one lookup. It lies beside the
    manifest whose keys it holds and is as large as its keys, 12 bits each by default.
    """

    rows: DataFrame
    words: int

    def write(self, path: str) -> None:
        self.rows.withColumn("words", F.lit(self.words)).write.parquet(path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> KeyFilter:
        table = spark.read.schema("word BIGINT, bits BIGINT, words BIGINT").parquet(path)
        first = table.first()
        return KeyFilter(table.select("word", "bits"), first["words"] if first else 1)


def _place(key: Column, words: int) -> tuple[Column, Column]:
    """The word of a key, and its bits in that word."""
    key = key.cast("string")
    picks = F.xxhash64(F.lit(2), key)
    one = F.lit(1).cast("long")
    places = [F.shiftright(picks, 6 * n).bitwiseAND(63).cast("int") for n in range(_BITS)]
    bits = [F.call_function("shiftleft", one, place) for place in places]
    return F.pmod(F.xxhash64(F.lit(1), key), F.lit(words)), reduce(Column.bitwiseOR, bits)


def build_filter(
    manifest: DataFrame, key: str = "id", bits_per_key: int = 12, expected: int | None = None
) -> KeyFilter:
    """A filter of the manifest's keys, with room for `expected` keys (their number now)."""
    keys = expected or manifest.count()
    words = max(1, -(-keys * bits_per_key // 64))
    return KeyFilter(_filled(manifest, key, words), words)


def _filled(manifest: DataFrame, key: str, words: int) -> DataFrame:
    word, bits = _place(F.col(key), words)
    known = manifest.where(F.col(key).isNotNull())
    return known.select(word.alias("word"), bits.alias("bits")).groupBy("word").agg(
        F.bit_or("bits").alias("bits")
    )


def add_keys(old: KeyFilter, more: DataFrame, key: str = "id") -> KeyFilter:
    """The filter with more keys, without reading the old ones again.

    Beyond the number it was built for it lets more through, but loses none.
    """
    both = old.rows.unionByName(_filled(more, key, old.words))
    return KeyFilter(both.groupBy("word").agg(F.bit_or("bits").alias("bits")), old.words)


def mark_stored(papers: DataFrame, known: KeyFilter, key: str = "id") -> DataFrame:
    """`papers` with `maybe_stored`: false only where the key is in no manifest of the filter.

    The filter is broadcast; callers check its size first.
    """
    word, bits = _place(F.col(key), known.words)
    own = papers.withColumn("_word", word).withColumn("_bits", bits)
    table = F.broadcast(known.rows.select(F.col("word").alias("_word"), F.col("bits").alias("_set")))
    hit = F.col("_set").bitwiseAND(F.col("_bits")) == F.col("_bits")
    return (
        own.join(table, "_word", "left")
        .withColumn("maybe_stored", F.coalesce(hit, F.lit(False)))
        .drop("_word", "_bits", "_set")
    )


def pending_by_filter(
    papers: DataFrame, manifest: DataFrame, known: KeyFilter, key: str = "id", max_words: int = MAX_WORDS
) -> DataFrame:
    """`pending_content`, shuffling only what the manifest's filter lets through.

    Papers that the filter does not know are pending as they are scanned; the others, the
    stored ones and a few percent more, go through the exact anti-join. `papers` is
    scanned once for each. A filter of more than `max_words` words is not broadcast, and
    all papers go through the anti-join.
    """
    if known.words > max_words:
        return pending_content(papers, manifest, key)
    judged = mark_stored(papers, known, key)
    new = judged.where(~F.col("maybe_stored")).drop("maybe_stored")
    doubtful = judged.where("maybe_stored").drop("maybe_stored")
    return new.unionByName(pending_content(doubtful, manifest, key))


def settled_filter(manifest: DataFrame, key: str = "id", bits_per_key: int = 12) -> KeyFilter:
    """`build_filter`, worked out once and kept in the shared folder."""
    made = build_filter(manifest, key, bits_per_key)
    return KeyFilter(settle(made.rows), made.words)
