from __future__ import annotations

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioscope.llm import token_counts
from folioscope.llm.token_counts import RankTokenizer, count_tokens

from . import brute

RANKS = RankTokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
TEXTS = [
    "plain words, and more", "", None, "a<|endoftext|>b", " \n\n\t  x", "don't I'LL", "é漢字😀\u0000",
    "x" * 5_000, "word " * 20_000, " " * 3_000, "plain words, and more", "١٢٣ ½",
]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: len(tokenizer.encode(text or "", add_special_tokens=False).ids)


def test_equals_the_library(spark, tmp_path, library):
    got = count_tokens(brute.docs_of(spark, TEXTS), RANKS, str(tmp_path / "cache")).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        text = TEXTS[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), library(text))
        assert r.over_limit == (r.n_tokens > 512)


@pytest.mark.parametrize("unit", [" ", "\n", "\t", " \n", "\u3000", "7", "x", "-"])
def test_runs_of_two_megabytes(library, unit):
    """One text never ends the job; runs at the start, inside, before a special token, at the end."""
    encoding = token_counts._encoding(RANKS)
    run = unit * (2_000_000 // len(unit) // len(unit.encode()))
    for text in (run + "a", "a" + run, f"a{run}b", run + "<|endoftext|>" + run[:9_000] + "é"):
        assert token_counts.tokens_of(text, encoding, ("<|endoftext|>",)) == library(text)


def test_runs_of_white_space_by_chance(library):
    r = random.Random(6)
    encoding = token_counts._encoding(RANKS)
    for _ in range(60):
        pieces = ["ab", "<|endoftext|>", " ", "\n", " \t" * 2_100, "\n" * 4_200, " " * 5_000, "1", "\x1c"]
        text = "".join(r.choice(pieces) for _ in range(r.randrange(1, 9)))
        assert token_counts.tokens_of(text, encoding, ("<|endoftext|>",)) == library(text), text[:50]


def test_only_distinct_misses_are_encoded(spark, tmp_path):
    path = str(tmp_path / "cache")
    count_tokens(brute.docs_of(spark, ["a", "b", "b"]), RANKS, path).collect()
    cache = spark.read.parquet(path)
    assert cache.count() == 2
    # A stored count is used as it is, so encoding again would show.
    marked = str(tmp_path / "marked")
    cache.withColumn("n_tokens", F.lit(99).cast("long")).write.parquet(marked)
    got = count_tokens(brute.docs_of(spark, ["a", "c", "c", None]), RANKS, marked).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {0: 99, 1: 1, 2: 1, 3: 0}
    assert spark.read.parquet(marked).count() == 4


def test_another_version_is_another_entry(spark, tmp_path):
    path = str(tmp_path / "cache")
    docs = brute.docs_of(spark, ["a<|endoftext|>b"])
    plain = RankTokenizer(RANKS.ranks_file, RANKS.pattern, special=())
    assert plain.version() != RANKS.version()
    assert count_tokens(docs, RANKS, path).first().n_tokens == 3


def test_repeated_null_and_no_rows(spark, tmp_path):
    docs = brute.docs_of(spark, ["q", "q", "r", None], ids=[None, None, 5, 5])
    got = count_tokens(docs, RANKS, str(tmp_path / "a")).collect()
    assert sorted((r.doc_id is None, r.n_tokens) for r in got) == [
        (False, 0), (False, 1), (True, 1), (True, 1),
    ]
    assert count_tokens(brute.docs_of(spark, []), RANKS, str(tmp_path / "b")).collect() == []


def test_texts_of_the_table(spark, sf_dir, tmp_path, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in count_tokens(docs, RANKS, str(tmp_path / "c")).collect()}
    assert got == {r.doc_id: library(r.text) for r in docs.collect()}
