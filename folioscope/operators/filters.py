"""Relevance filters and the head cap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from folioscope.fixed_values import SURVEY_WORDS
from folioscope.functions.matching import mentions_any, on_topic, relevant
from folioscope.sources.papers import newest


def exclude_topics(
    papers: DataFrame, exclusions: Sequence[str] = SURVEY_WORDS
) -> DataFrame:
    return papers.where(on_topic(exclusions))


def keyword_any(papers: DataFrame, keywords: Sequence[str]) -> DataFrame:
    return papers.where(mentions_any(keywords))


def filter_papers(
    papers: DataFrame,
    keywords: Sequence[str],
    exclusions: Sequence[str] = SURVEY_WORDS,
) -> DataFrame:
    """Exclusions and keywords in one pass over the text."""
    return papers.where(relevant(keywords, exclusions))


def head_cap(papers: DataFrame, limit: int | None) -> DataFrame:
    """The first `limit` papers in arrival order (newest first); None keeps all."""
    return papers if limit is None else newest(papers, limit)
