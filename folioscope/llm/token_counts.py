"""Token counts through a cache of content digests: only distinct misses are encoded."""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.cluster import settle
from folioscope.llm.text_arrays import in_small_batches, slices


@dataclass(frozen=True)
class RankTokenizer:
    """A byte-pair vocabulary as ranks; every executor finds `ranks_file` at that path."""

    ranks_file: str
    pattern: str
    special: tuple[tuple[str, int], ...] = (("<|endoftext|>", 50_256),)

    def version(self) -> str:
        """Digest of all that decides a count: the ranks, the pattern, the specials."""
        with open(self.ranks_file, "rb") as f:
            content = hashlib.sha256(f.read()).hexdigest()
        return hashlib.sha256(repr((content, self.pattern, self.special)).encode()).hexdigest()


@functools.lru_cache(maxsize=2)
def _encoding(tokenizer: RankTokenizer):
    import tiktoken

    with open(tokenizer.ranks_file, "rb") as f:
        lines = [line.split() for line in f]
    ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
    return tiktoken.Encoding(
        "ranks",
        pat_str=tokenizer.pattern,
        mergeable_ranks=ranks,
        special_tokens=dict(tokenizer.special),
    )


#: White space of the pattern, in runs that its look-ahead could not take back.
_LONG_SPACE = re.compile(
    "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}"
)


def tokens_of(text: str, encoding, special: tuple[str, ...]) -> int:
    """Number of tokens of a text of any kind.

    The pattern takes a run of white space but for its last character, unless the text
    ends there or at a special token. Long runs are cut off so and encoded as they are,
    since the pattern's engine runs out of stack on some hundred thousand characters.
    """
    if not _LONG_SPACE.search(text):
        return len(encoding.encode(text, allowed_special="all"))
    total = 0
    for part in re.split("(" + "|".join(map(re.escape, special)) + ")", text) if special else [text]:
        if part in special:
            total += 1
            continue
        at = 0
        for run in _LONG_SPACE.finditer(part):
            end = run.end() if run.end() == len(part) else run.end() - 1
            total += len(encoding.encode_ordinary(part[at : run.start()]))
            total += len(encoding._encode_single_piece(part[run.start() : end]))
            at = end
        total += len(encoding.encode_ordinary(part[at:]))
    return total


def _count(batches: Iterator[pa.RecordBatch], tokenizer: RankTokenizer):
    encoding = _encoding(tokenizer)
    special = tuple(name for name, _ in tokenizer.special)
    for whole in batches:
        for batch in slices(whole, "text"):
            counts = [tokens_of(t, encoding, special) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"]
            )


def _cached(spark, cache_path: str, version: str) -> DataFrame:
    schema = "digest binary, n_tokens long, version string"
    try:
        stored = spark.read.schema(schema).parquet(cache_path).where(F.col("version") == version)
        stored.limit(0).count()
    except Exception as error:  # no cache yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        stored = spark.createDataFrame([], schema)
    # Two runs at a time may both append a digest.
    return stored.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def count_tokens(
    docs: DataFrame, tokenizer: RankTokenizer, cache_path: str, limit: int = 512
) -> DataFrame:
    """`doc_id`, `n_bytes`, `n_tokens`, `over_limit` of every row of `docs`.

    Contents are normalised by taking a null text as empty, nothing else, as any other
    change could change the count. Rows are joined to `cache_path` (a table of digests,
    counts and tokenizer versions in a folder all executors reach) by the SHA-256 of the
    content; one text of each digest not found is encoded and the counts are appended.
    Counts have no begin, end or added special tokens; the strings of special tokens
    inside a text count as those tokens. Repeated rows and null ids are rows like any
    others; an empty table gives no rows; other columns are left out.
    """
    spark = docs.sparkSession
    version = tokenizer.version()
    text = F.coalesce("text", F.lit(""))
    keyed = in_small_batches(docs).select("doc_id", text.alias("text")).withColumn(
        "digest", F.unhex(F.sha2(F.col("text"), 256))
    )
    rows = settle(
        keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    )
    missing = (
        rows.groupBy("digest")
        .agg(F.min("doc_id").alias("stand"))
        .join(_cached(spark, cache_path, version), "digest", "left_anti")
    )
    missing = settle(missing.select(F.col("digest").alias("wanted"), "stand"))
    # One row's text for each missing digest: the one shuffle of texts.
    picked = keyed.join(
        missing,
        F.col("doc_id").eqNullSafe(F.col("stand")) & (F.col("digest") == F.col("wanted")),
        "left_semi",
    )
    counted = picked.select("digest", "text").mapInArrow(
        lambda it: _count(it, tokenizer), "digest binary, n_tokens long"
    )
    counted.withColumn("version", F.lit(version)).write.mode("append").parquet(cache_path)
    # Written out, so that a digest with very many rows is split in the join.
    return rows.join(settle(_cached(spark, cache_path, version)), "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
