"""Rubric score, insight bonus and final score."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.fixed_values import (
    BAND_EN,
    BAND_TENTHS,
    BAND_ZH,
    CAP_TENTHS,
    CUE_TENTHS,
    CUES_EN,
    CUES_ZH,
)
from folioscope.functions.binding import let


@dataclass(frozen=True)
class CueRule:
    cues: Sequence[str]
    band: tuple[int, int]


@dataclass(frozen=True)
class BonusRules:
    """One rule per language route, and the rule for every other language."""

    default: CueRule = CueRule(CUES_EN, BAND_EN)
    by_language: Mapping[str, CueRule] = field(
        default_factory=lambda: {"zh": CueRule(CUES_ZH, BAND_ZH)}
    )


def cue_tenths(lowered: Column, rule: CueRule) -> Column:
    """Bonus in tenths, an exact integer, of a lower-case text."""

    def worth(test: Column, tenths: int) -> Column:
        # Inside a lambda a CASE runs several times faster than a cast of a boolean.
        return F.when(test, F.lit(tenths)).otherwise(F.lit(0))

    hits = [worth(lowered.contains(cue), CUE_TENTHS) for cue in rule.cues]
    banded = worth(F.length(lowered).between(*rule.band), BAND_TENTHS)
    return F.least(F.lit(CAP_TENTHS), reduce(add, [*hits, banded]))


def by_language(
    language: Column, rules: BonusRules, value: Callable[[CueRule], Column]
) -> Column:
    """`value` of the rule for the language.

    The language is compared outside of `value`: inside a lambda Catalyst may inline
    its whole expression and run it per array element.
    """
    fallback = value(rules.default)
    chosen = None
    for label, rule in rules.by_language.items():
        test = language == label
        hit = value(rule)
        chosen = F.when(test, hit) if chosen is None else chosen.when(test, hit)
    return fallback if chosen is None else chosen.otherwise(fallback)


def insight_bonus(
    sentence: Column, language: Column, rules: BonusRules = BonusRules()
) -> Column:
    text = F.lower(F.coalesce(sentence, F.lit("")))
    tenths = by_language(
        language, rules, lambda rule: let(text, lambda t: cue_tenths(t, rule))
    )
    return tenths / F.lit(10.0)


def rubric_score(innovation: Column, rigor: Column, impact: Column) -> Column:
    parts = [F.coalesce(c, F.lit(0.0)) for c in (innovation, rigor, impact)]
    return F.round(reduce(add, parts) / F.lit(3), 2)


def final_score(total_score: Column, bonus: Column) -> Column:
    return F.round(total_score + bonus, 2)
