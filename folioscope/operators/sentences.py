"""Baselines that need no model: the key sentence and the outline.

Both work inside the row, on arrays, so no text is ever shuffled.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.scoring import BonusRules, by_language, cue_tenths
from folioscope.functions.text import strip

SENTENCE_END = r"[.!?\n]+"
WIDE_MARKS = ("\u3002", "\uff01", "\uff1f")
WIDE_SENTENCE_END = rf"[.!?{''.join(WIDE_MARKS)}\n]+"
PARAGRAPH_END = r"\n+"
SECTIONS = ("Introduction", "Method", "Experiment", "Conclusion")
ROOT = "论文核心内容"
PHRASE_WORDS = 15


def _clean(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda piece: piece != "")


def sentences(text: str) -> Column:
    """Trimmed, non-empty sentences.

    A character class with wide marks splits three times slower, so it is used only
    for the texts that contain one.
    """
    wide = reduce(or_, [F.col(text).contains(mark) for mark in WIDE_MARKS])
    parts = F.when(wide, F.split(text, WIDE_SENTENCE_END)).otherwise(
        F.split(text, SENTENCE_END)
    )
    return _clean(parts)


def paragraphs(text: str) -> Column:
    return _clean(F.split(text, PARAGRAPH_END))


def key_sentence(
    papers: DataFrame,
    text: str = "summary",
    language: str = "language",
    rules: BonusRules = BonusRules(),
) -> DataFrame:
    """Add `breakthrough` (the sentence with the highest bonus, the first on ties) and
    `bonus_tenths`. A text without sentences gives "" and 0.
    """
    keep = [F.col(c) for c in papers.columns]
    cut = papers.select(*keep, sentences(text).alias("_pieces"))
    low = cut.select(*keep, "_pieces", F.transform("_pieces", F.lower).alias("_low"))
    scored = low.select(
        *keep,
        "_pieces",
        by_language(
            F.col(language),
            rules,
            lambda rule: F.transform("_low", lambda s: cue_tenths(s, rule)),
        ).alias("_tenths"),
    )
    best = F.array_max("_tenths")
    at = (F.array_position("_tenths", best) - 1).cast("int")
    return scored.select(
        *keep,
        F.coalesce(F.get("_pieces", at), F.lit("")).alias("breakthrough"),
        F.coalesce(best, F.lit(0)).alias("bonus_tenths"),
    )


def outline(papers: DataFrame, text: str = "full_text") -> DataFrame:
    """Add `mindmap_markdown`: four sections, each with the lead of its first paragraph.

    Paragraphs are dealt to the sections in order, as evenly as possible, the earlier
    sections taking the remainder (the rule of ntile). Sections without paragraphs
    are left out.
    """
    count = F.size("_parts")
    share = F.floor(count / len(SECTIONS)).cast("int")
    extra = count % len(SECTIONS)
    keep = [F.col(c) for c in papers.columns]
    cut = papers.select(*keep, paragraphs(text).alias("_parts"))
    lines = []
    for number, section in enumerate(SECTIONS):
        start = F.lit(number) * share + F.least(F.lit(number), extra)
        # The split stops after the phrase; the rest of the paragraph stays one piece.
        words = F.split(F.get("_parts", start), r"\s+", PHRASE_WORDS + 1)
        lead = F.array_join(F.slice(words, 1, PHRASE_WORDS), " ")
        line = F.concat(F.lit(f"  - {section}\n    - "), lead)
        lines.append(F.when(count > number, line))
    return cut.select(
        *keep, F.concat_ws("\n", F.lit(f"- {ROOT}"), *lines).alias("mindmap_markdown")
    )
