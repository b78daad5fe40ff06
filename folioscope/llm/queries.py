"""The queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.cluster import new_run_dir

from folioscope.llm import oracles
from folioscope.llm.dialogue_repair import damage, repair
from folioscope.llm.embedding_lsh import link_vectors
from folioscope.llm.host_rules import judge
from folioscope.llm.interpolation import score_texts
from folioscope.llm.minhash_join import near_duplicates
from folioscope.llm.mixing import mix_counts
from folioscope.llm.nearest_vote import learn, remainder, score
from folioscope.llm.pii_tagger import KINDS, count_kind, find_spans, learn_tagger
from folioscope.llm.sentencepiece_dropout import decode, encode
from folioscope.llm.sharding import assign_shards
from folioscope.llm.spelling_groups import group_spellings
from folioscope.llm.token_counts import RankTokenizer, count_tokens
from folioscope.llm.toxic_grammar import FOLDS, HELD_OUT, learn_grammar, weigh

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every text with merge-dropout, and whether they decode to the text."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = decode(encode(docs, model, dropout=0.1, seed=17), model)
    same = F.coalesce("text", F.lit("")) == F.col("decoded")
    return decoded.select(
        "doc_id", "pieces", F.size("pieces").cast("long").alias("n_pieces"), same.alias("lossless")
    )


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(_table(spark, sf_dir, "documents"))


def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_table(spark, sf_dir, "documents"))


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(_table(spark, sf_dir, "embeddings"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(_table(spark, sf_dir, "documents"), [1.0] * 24)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the byte-level vocabulary, through a cache that starts empty."""
    tokenizer = RankTokenizer(
        public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )
    cache = new_run_dir(spark, "token-counts")
    return count_tokens(_table(spark, sf_dir, "documents"), tokenizer, cache)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = learn(docs, _table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_spans(docs, learn_tagger(docs))
    return found.select(
        "doc_id",
        *(count_kind("base_spans", k).alias(f"n_{k}") for k in KINDS),
        F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"),
        "spans",
    )


def op10_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_table(spark, sf_dir, "documents"))


def op11_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damage(_table(spark, sf_dir, "conversations")))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = weigh(docs, learn_grammar(docs, _table(spark, sf_dir, "labels")))
    return found.select(
        "doc_id",
        F.coalesce(remainder("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
        "clauses",
    )


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_spellings(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_mixing": op3_mixing,
    "op4_host_rules": op4_host_rules,
    "op5_vectors": op5_vectors,
    "op6_sharding": op6_sharding,
    "op7_token_counts": op7_token_counts,
    "op8_quality": op8_quality,
    "op9_pii": op9_pii,
    "op10_interpolation": op10_interpolation,
    "op11_dialogue_repair": op11_dialogue_repair,
    "op12_toxicity": op12_toxicity,
    "op13_spelling": op13_spelling,
}
ORACLE: dict[str, str] = {
    "op2_near_duplicates": oracles.NEAR_DUPLICATES,
    "op4_host_rules": oracles.HOST_RULES,
    "op5_vectors": oracles.VECTORS,
    "op11_dialogue_repair": oracles.DIALOGUE_REPAIR,
}
