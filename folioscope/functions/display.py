"""Keys, links and display defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope import fixed_values as V


def paper_key(id_: Column) -> Column:
    return F.concat(F.lit(V.PAPER_KEY_PREFIX), id_)


def abstract_link(id_: Column) -> Column:
    return F.concat(F.lit(V.ABSTRACT_PAGE), id_)


def pdf_link(id_: Column) -> Column:
    return F.concat(F.lit(V.PDF_PAGE), id_)


def utc_text(published: Column) -> Column:
    """`yyyy-MM-dd HH:mm:ss` in UTC, fractions after it, whatever the session's zone.

    A TIMESTAMP is an instant; a TIMESTAMP_NTZ is taken as UTC already.
    """
    wall = published.cast("timestamp_ntz")
    moved = F.convert_timezone(F.current_timezone(), F.lit("UTC"), wall)
    plain = F.typeof(published) == "timestamp_ntz"  # known when the plan is made
    return F.when(plain, wall).otherwise(moved).cast("string")


def utc_micros(published: Column) -> Column:
    """Microseconds since 1970 in UTC, read the same way."""
    instant = F.concat(published.cast("timestamp_ntz").cast("string"), F.lit("+00:00"))
    plain = F.typeof(published) == "timestamp_ntz"
    time = F.when(plain, instant.cast("timestamp")).otherwise(published.cast("timestamp"))
    return F.unix_micros(time)


def iso_text(published: Column) -> Column:
    seconds = F.substring(utc_text(published), 1, 19)
    return F.concat(F.replace(seconds, F.lit(" "), F.lit("T")), F.lit("+00:00"))


def day_text(published: Column) -> Column:
    return F.substring(utc_text(published), 1, 10)


def language_label(language: Column) -> Column:
    return F.when(language == "zh", V.LABEL_ZH).otherwise(V.LABEL_OTHER)


def score_line(final: Column, base: Column, bonus: Column) -> Column:
    zero = F.lit(0.0)
    shown = [F.coalesce(c, zero) for c in (final, base, bonus)]
    return F.format_string("%.2f (base %.2f, bonus %.2f)", *shown)


def first_or_default(items: Column, default: str = V.NOT_AVAILABLE) -> Column:
    return F.coalesce(F.get(items, F.lit(0)), F.lit(default))


def shown_number(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(V.NOT_AVAILABLE))
