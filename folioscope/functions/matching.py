"""Substring predicates over title and summary."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.fixed_values import SURVEY_WORDS
from folioscope.functions.binding import holds

def haystack(title: str = "title", summary: str = "summary") -> Column:
    return F.lower(F.concat_ws(" ", F.col(title), F.col(summary)))


def _any_word(text: Column, words: Sequence[str]) -> Column:
    tests = [text.contains(w.lower()) for w in words] or [F.lit(False)]
    while len(tests) > 1:  # in pairs, so that long lists make no deep tree
        pairs = [tests[i : i + 2] for i in range(0, len(tests), 2)]
        tests = [reduce(or_, pair) for pair in pairs]
    return tests[0]


def _wanted(text: Column, keywords: Sequence[str]) -> Column:
    return _any_word(text, keywords) if keywords else F.lit(True)


def on_topic(exclusions: Sequence[str] = SURVEY_WORDS) -> Column:
    """True unless any exclusion word occurs."""
    return holds(haystack(), lambda text: ~_any_word(text, exclusions))


def mentions_any(keywords: Sequence[str]) -> Column:
    """True when any keyword occurs, or when there are no keywords."""
    return holds(haystack(), lambda text: _wanted(text, keywords))


def relevant(keywords: Sequence[str], exclusions: Sequence[str] = SURVEY_WORDS) -> Column:
    """Both tests above on one lowered copy of the text."""
    return holds(
        haystack(),
        lambda text: ~_any_word(text, exclusions) & _wanted(text, keywords),
    )


def catalogue_match(keywords: Sequence[str], categories: Sequence[str]) -> Column:
    """All keyword phrases and any of the categories; an empty list matches everything."""
    tests = []
    if categories:
        tests.append(F.arrays_overlap("categories", F.array(*map(F.lit, categories))))
    if keywords:
        tests.append(
            holds(
                haystack(),
                lambda text: reduce(and_, [text.contains(k.lower()) for k in keywords]),
            )
        )
    return reduce(and_, tests, F.lit(True))
