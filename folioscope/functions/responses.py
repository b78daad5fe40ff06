"""Model responses: fence removal, tolerant JSON reading, acceptance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.fixed_values import INSIGHT_FAILED
from folioscope.functions.binding import let
from folioscope.functions.text import strip
from folioscope.schemas import INSIGHT_JSON, RATING_JSON

_OPEN = "```json"
_CLOSE = "```"


def strip_fence(response: Column) -> Column:
    """Trim, drop a leading ```json and a trailing ```, each on its own, trim."""

    def without_open(text: Column) -> Column:
        rest = F.substring(text, F.lit(len(_OPEN) + 1), F.length(text))
        return F.when(text.startswith(_OPEN), rest).otherwise(text)

    def without_close(text: Column) -> Column:
        rest = F.substring(text, F.lit(1), F.length(text) - len(_CLOSE))
        return F.when(text.endswith(_CLOSE), rest).otherwise(text)

    opened = let(strip(response), without_open)
    return strip(let(opened, without_close))


def parse_object(content: Column, fields: str) -> Column:
    """`struct(parsed, parse_status, raw)` of a text that should be one JSON object.

    The text is read as the only element of an array: trailing text, a second
    object or a bare value then fails, as a strict parser would have it. `raw` keeps
    what could not be read.
    """

    def outcome(items: Column) -> Column:
        one = F.coalesce(F.size(items) == 1, F.lit(False))
        record = F.when(one, F.get(items, F.lit(0)))
        good = record.isNotNull()
        return F.struct(
            record.alias("parsed"),
            F.when(good, "ok").otherwise("invalid").alias("parse_status"),
            F.when(~good, content).alias("raw"),
        )

    wrapped = F.concat(F.lit("["), content, F.lit("]"))
    items = F.from_json(
        wrapped, f"ARRAY<STRUCT<{fields}>>", {"allowSingleQuotes": "false"}
    )
    return let(items, outcome)


def parse_rating(content: Column) -> Column:
    return parse_object(content, RATING_JSON)


def parse_insight(content: Column) -> Column:
    return parse_object(content, INSIGHT_JSON)


def accept_insight(parsed: Column, summary: Column) -> Column:
    """Both texts present: taken over. Else the summary and a failure mark, not cached."""
    accepted = parsed["abstract"].isNotNull() & parsed["breakthrough"].isNotNull()
    accepted = F.coalesce(accepted, F.lit(False))
    return F.struct(
        F.when(accepted, parsed["abstract"]).otherwise(summary).alias("abstract"),
        F.when(accepted, parsed["breakthrough"])
        .otherwise(F.lit(INSIGHT_FAILED))
        .alias("breakthrough"),
        accepted.alias("accepted"),
    )
