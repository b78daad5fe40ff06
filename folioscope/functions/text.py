"""Text clean-up, markup stripping and limits."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

HIDDEN_MARKUP = (
    r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->"
)
TAG = r"(?s)<[^>]*>"
_ARTICLE_TAG = r"(?i)(?=</?article\b)"
_ONE_ARTICLE = r"(?is)<article\b.*?(?=</article\b|\z)"
_REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def strip(text: Column) -> Column:
    """Remove all white space at both ends (Spark's trim removes spaces only)."""
    return F.btrim(text, F.lit(SPACES))


def head_chars(text: Column, limit: int | None) -> Column:
    """The first `limit` code points; no limit keeps the whole text."""
    return text if limit is None else F.substring(text, 1, limit)


def _character(reference: Column) -> Column:
    """What a reference without its "&" and ";" stands for, null if nothing."""
    number = F.when(
        reference.rlike("^#[xX]"), F.conv(F.substring(reference, 3, 8), 16, 10).cast("int")
    ).when(reference.startswith("#"), F.substring(reference, 2, 8).cast("int"))
    usable = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
    numbered = F.decode(F.unhex(F.lpad(F.hex(number.cast("long")), 8, "0")), "UTF-32")
    pairs = [F.lit(x) for name, code in name2codepoint.items() for x in (name, chr(code))]
    apostrophe = F.when(reference == "apos", "'")
    return F.when(usable, numbered).otherwise(
        F.coalesce(apostrophe, F.element_at(F.create_map(*pairs), reference))
    )


def decode_references(text: Column) -> Column:
    """Character references as characters, in one pass: "&amp;lt;" becomes "&lt;".

    Decimal, hexadecimal and the named ones of HTML 4; others stay as they are.
    """

    def decoded(piece: Column, place: Column) -> Column:
        name = F.regexp_extract(piece, _REFERENCE, 1)
        character = F.when(name != "", _character(name))
        rest = F.substring(piece, F.length(name) + 2, F.length(piece))
        return (
            F.when(place == 0, piece)
            .when(character.isNull(), F.concat(F.lit("&"), piece))
            .otherwise(F.concat(character, rest))
        )

    pieces = F.transform(F.split(text, "&"), decoded)
    return F.when(text.contains("&"), F.array_join(pieces, "")).otherwise(text)


def visible(html: Column) -> Column:
    """Markup without scripts, styles and comments."""
    return F.regexp_replace(html, HIDDEN_MARKUP, " ")


def text_of_visible(shown: Column) -> Column:
    plain = decode_references(F.regexp_replace(shown, TAG, " "))
    return F.trim(F.regexp_replace(plain, r"[\s\x{A0}]+", " "))


def markup_to_text(html: Column) -> Column:
    return text_of_visible(visible(html))


def article_of_visible(shown: Column) -> Column:
    """Markup inside all article elements, nested ones once; empty when there is none.

    A page with one opening tag is cut there and at the next closing one, or at its end.
    Others are cut before every article tag: a piece is inside while more articles were
    opened than closed.
    """
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("kept"))

    def step(state: Column, piece: Column) -> Column:
        change = (
            F.when(piece.rlike(r"^(?i)</article\b"), -1)
            .when(piece.rlike(r"^(?i)<article\b"), 1)
            .otherwise(0)
        )
        depth = F.greatest(state["depth"] + change, F.lit(0))
        kept = F.when(depth > 0, F.concat(state["kept"], F.array(piece))).otherwise(
            state["kept"]
        )
        return F.struct(depth.alias("depth"), kept.alias("kept"))

    pieces = F.split(shown, _ARTICLE_TAG)
    every = F.aggregate(pieces, start, step, lambda s: F.array_join(s["kept"], " "))
    opened = F.regexp_count(shown, F.lit(r"(?i)<article\b"))
    return F.when(opened > 1, every).otherwise(F.regexp_extract(shown, _ONE_ARTICLE, 0))


def article_of(html: Column) -> Column:
    return article_of_visible(visible(html))


def split_list(text: Column) -> Column:
    """Comma-separated text to an array of trimmed, non-empty items."""
    items = F.transform(F.split(text, ","), strip)
    return F.filter(items, lambda item: item != "")
