"""Text of documents: tiers, page concatenation, parse cache, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions.text import article_of_visible, head_chars, text_of_visible, visible

_PAGES_PER_PART = 1_024


def extract_text(
    pages: DataFrame,
    html: str = "html",
    structured: bool = True,
    failed: Column | None = None,
    max_chars: int | None = None,
) -> DataFrame:
    """Add `full_text`, `parser`, `error`: article text first, whole page as fallback.

    The structured tier fails where there is no article, its text is empty, or `failed`
    holds (for extractors that report a failure of their own).
    """
    shown = F.col("_visible")
    article = text_of_visible(article_of_visible(shown)) if structured else F.lit(None)
    if failed is not None:
        article = F.when(~F.coalesce(failed, F.lit(False)), article)
    # Used by both tiers, so the planner keeps this column as one of its own.
    tiers = pages.withColumn("_visible", visible(F.col(html)))
    tiers = tiers.withColumn("_article", article.cast("string"))
    good = F.coalesce(F.col("_article") != "", F.lit(False))
    tiers = tiers.withColumn(
        "_text",
        F.when(good, F.col("_article")).otherwise(text_of_visible(shown)),
    )
    found = F.coalesce(F.col("_text") != "", F.lit(False))
    return tiers.select(
        *pages.columns,
        F.when(found, head_chars(F.col("_text"), max_chars)).alias("full_text"),
        F.when(found, F.when(good, "structured").otherwise("plain")).alias("parser"),
        F.when(~found, F.lit("no text in the document")).alias("error"),
    )


def page_parts(
    pages: DataFrame,
    doc: str,
    page_no: str,
    text: str,
    pages_per_part: int = _PAGES_PER_PART,
    max_chars: int | None = None,
) -> DataFrame:
    """Pages in order joined by line breaks, an empty page counting as "".

    One row per document and run of `pages_per_part` page numbers, which only places the
    work: ordinary documents are one part, and one of any number of pages never gathers
    in one task. With `max_chars` pages are shortened to it first.
    Columns: doc, `part`, `n_pages`, `text`.
    """
    part = F.floor(F.col(page_no) / pages_per_part).cast("long")
    words = head_chars(F.coalesce(F.col(text), F.lit("")), max_chars)
    entry = F.struct(F.col(page_no).alias("page"), words.alias("text"))
    gathered = pages.groupBy(doc, part.alias("part")).agg(
        F.sort_array(F.collect_list(entry)).alias("entries")
    )
    return gathered.select(
        doc,
        "part",
        F.size("entries").alias("n_pages"),
        F.array_join("entries.text", "\n").alias("text"),
    )


def full_text_of_parts(
    parts: DataFrame, doc: str, max_chars: int | None = None
) -> DataFrame:
    """`n_pages` and the text of each document from its parts, or its first `max_chars`.

    Without a limit a document is one cell, whatever its length. With one, parts are
    shortened to it, and only those that start up to it are gathered (one that starts at
    the limit still gives its line break). Each part but the first adds a line break, so
    at most `max_chars` + 1 of them can be needed.
    """
    if max_chars is None:
        whole = F.array_join(F.sort_array(F.collect_list(F.struct("part", "text")))["text"], "\n")
        return parts.groupBy(doc).agg(F.sum("n_pages").alias("n_pages"), whole.alias("full_text"))
    order = W.partitionBy(doc).orderBy("part")
    before = F.sum(F.length("text") + 1).over(
        order.rowsBetween(W.unboundedPreceding, -1)
    )
    placed = parts.select(
        doc, "part", "n_pages", head_chars(F.col("text"), max_chars).alias("text")
    ).withColumn("start", F.coalesce(before, F.lit(0)))
    entry = F.when(F.col("start") <= max_chars, F.struct("part", "text"))
    gathered = placed.groupBy(doc).agg(
        F.sum("n_pages").alias("n_pages"),
        F.sort_array(F.collect_list(entry)).alias("e"),  # leaves out the nulls
    )
    whole = F.array_join("e.text", "\n")
    return gathered.select(doc, "n_pages", head_chars(whole, max_chars).alias("full_text"))


def concat_pages(
    pages: DataFrame,
    doc: str,
    page_no: str,
    text: str,
    max_chars: int | None = None,
    pages_per_part: int = _PAGES_PER_PART,
) -> DataFrame:
    """One row per document: `n_pages` and its pages in order as `full_text`.

    Users know a limit of 12,000 characters (`FULL_TEXT_CHARS`); give it as `max_chars`.
    """
    parts = page_parts(pages, doc, page_no, text, pages_per_part, max_chars)
    return full_text_of_parts(parts, doc, max_chars)


def parse_key(parser: str, basename: str, mtime: str):
    """`parser_basename_mtime`, the fraction of a second cut off."""
    seconds = F.floor(F.col(mtime).cast("timestamp").cast("double")).cast("long")
    return F.concat_ws("_", F.col(parser), F.col(basename), seconds.cast("string"))


def parse_cache_status(
    files: DataFrame,
    manifest: DataFrame,
    parser: str = "parser",
    basename: str = "basename",
    mtime: str = "mtime",
) -> DataFrame:
    """Add `cache_key` and `cached`; a file changed since it was parsed is a miss."""
    keys = manifest.select(parse_key(parser, basename, mtime).alias("cache_key"))
    known = keys.distinct().withColumn("_known", F.lit(True))
    keyed = files.withColumn("cache_key", parse_key(parser, basename, mtime))
    return (
        keyed.join(known, "cache_key", "left")
        .withColumn("cached", F.coalesce("_known", F.lit(False)))
        .drop("_known")
    )


def content_status(
    files: DataFrame, manifest: DataFrame, parser: str = "parser", content: str = "content"
) -> DataFrame:
    """`files` without their content, with `digest` and `cached`: its bytes decide.

    `manifest` has `parser` and `digest` of what was parsed. A file that was touched, moved
    or copied is a hit, one that changed a miss, whatever its time. Contents are digested
    as they are scanned and not shuffled. Without content the digest is null, a miss.
    """
    known = manifest.select(parser, "digest").distinct().withColumn("_known", F.lit(True))
    digested = files.withColumn("digest", F.sha2(F.col(content), 256)).drop(content)
    return (
        digested.join(known, [parser, "digest"], "left")
        .withColumn("cached", F.coalesce("_known", F.lit(False)))
        .select(*[c for c in files.columns if c != content], "digest", "cached")
    )


def parse_outcome(papers: DataFrame, texts: DataFrame) -> DataFrame:
    """Join parsed texts; a paper without one gets the neutral record.

    `texts` has one row per id: `id`, `full_text`, and `error` when parsing failed.
    Neutral record: zero ratings, the summary as abstract, an empty breakthrough and
    language "na". All of it is null for papers that go on to the model.
    """
    failed = F.col("full_text").isNull()
    zero = F.when(failed, F.lit(0.0))
    problem = F.concat(
        F.lit("Failed to parse paper, error: "),
        F.coalesce("error", F.lit("no parsed text")),
    )
    return papers.join(texts.select("id", "full_text", "error"), "id", "left").select(
        *[F.col(c) for c in papers.columns],
        "full_text",
        *[zero.alias(c) for c in ("innovation", "rigor", "impact", "total_score")],
        F.when(failed, F.col("summary")).alias("abstract"),
        F.when(failed, F.lit("")).alias("breakthrough"),
        F.when(failed, F.lit("na")).alias("language"),
        F.when(failed, problem).alias("error"),
    )
