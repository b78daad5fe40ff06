"""Prompt templates and single-pass rendering."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

TEMPLATES: dict[str, str] = {
    "rating": (
        "Rate the paper below from 1 to 10 on innovation, rigor and impact.\n\n"
        "Paper:\n{full_text}\n\n"
        "Answer with one JSON object and nothing else:\n"
        '{{"innovation": <1-10>, "rigor": <1-10>, "impact": <1-10>}}'
    ),
    "insight_en": (
        "Copy the abstract unchanged and state the paper's main advance in one "
        "sentence: what is new, what got better, what was open before.\n\n"
        "Abstract:\n{abstract}\n\nPaper:\n{full_text}\n\n"
        "Answer with one JSON object and nothing else:\n"
        '{{"abstract": "<abstract>", "breakthrough": "<one sentence>"}}'
    ),
    "insight_zh": (
        "原样保留摘要，并用一句话说明论文的主要进展。\n\n"
        "摘要：\n{abstract}\n\n正文：\n{full_text}\n\n"
        "只输出一个 JSON 对象：\n"
        '{{"abstract": "<摘要>", "breakthrough": "<一句话>"}}'
    ),
    "translation": (
        "Give a fluent Chinese translation of this abstract, and nothing else.\n\n"
        "{abstract}"
    ),
    "mindmap": (
        "Outline the paper as a Markdown list of at most three levels under one root. "
        "Use phrases of at most 15 words. Cover introduction, method, experiment and "
        "conclusion. Output the list only.\n\n{full_text}"
    ),
}


def render(template: str, values: Mapping[str, Column]) -> Column:
    """Fill `{name}` slots in one pass; `{{` and `}}` stand for braces.

    The template is cut into pieces on the driver, so braces inside a value are
    never read as slots.
    """
    pieces: list[Column] = []
    for literal, slot, _, _ in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if slot is not None:
            pieces.append(F.coalesce(values[slot].cast("string"), F.lit("")))
    return F.concat(*pieces) if pieces else F.lit("")


def template_name(
    language: Column, prefix: str, fallback: str, templates: Mapping[str, str] = TEMPLATES
) -> Column:
    """`<prefix>_<language>` when there is such a template, else `fallback`."""
    known = [name for name in templates if name.startswith(f"{prefix}_")]
    wanted = F.concat(F.lit(f"{prefix}_"), language)
    return F.when(wanted.isin(*known), wanted).otherwise(F.lit(fallback))


def template_body(name: Column, templates: Mapping[str, str] = TEMPLATES) -> Column:
    table = F.create_map(*map(F.lit, chain.from_iterable(templates.items())))
    return F.try_element_at(table, name)


def render_by_name(
    name: Column,
    values: Mapping[str, Column],
    templates: Mapping[str, str] = TEMPLATES,
) -> Column:
    """Render the template each row names; every template is compiled once."""
    rendered = None
    for key, body in templates.items():
        filled = render(body, values)
        rendered = (
            F.when(name == key, filled)
            if rendered is None
            else rendered.when(name == key, filled)
        )
    return rendered
