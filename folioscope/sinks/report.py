"""Markdown report and the card shown per paper."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope import fixed_values as V
from folioscope.functions.display import (
    abstract_link,
    day_text,
    language_label,
    paper_key,
    pdf_link,
    score_line,
)

REPORT_TITLE = "Paper Report"


def paper_cards(papers: DataFrame) -> DataFrame:
    """Everything a paper card shows, defaults filled in."""
    shown = {
        "translation": V.NO_TRANSLATION,
        "mindmap_markdown": V.NO_MINDMAP,
    }
    texts = [
        F.coalesce(F.col(c) if c in papers.columns else F.lit(None), F.lit(d)).alias(c)
        for c, d in shown.items()
    ]
    return papers.select(
        "id",
        paper_key(F.col("id")).alias("paper_key"),
        "title",
        day_text(F.col("published")).alias("published_day"),
        abstract_link(F.col("id")).alias("abstract_link"),
        pdf_link(F.col("id")).alias("pdf_link"),
        language_label(F.col("language")).alias("language_label"),
        score_line(
            F.col("final_score"), F.col("total_score"), F.col("insight_bonus")
        ).alias("score_line"),
        *texts,
    )


def report_sections(ranked: DataFrame) -> DataFrame:
    """`rank`, `id`, `section`: one Markdown section per ranked paper.

    Missing texts render empty.
    """

    def text(name: str):
        value = F.col(name) if name in ranked.columns else F.lit(None).cast("string")
        return F.coalesce(value, F.lit(""))

    scores = score_line(F.col("final_score"), F.col("total_score"), F.col("insight_bonus"))
    section = F.concat(
        F.lit("## "),
        F.col("rank").cast("string"),
        F.lit(". ["),
        text("title"),
        F.lit("]("),
        abstract_link(F.col("id")),
        F.lit(")\n\n**Published**: "),
        day_text(F.col("published")),
        F.lit("  \n**Score**: "),
        scores,
        F.lit(f"  \n\n{V.REPORT_GUIDE_HEADING}\n> "),
        text("breakthrough"),
        F.lit(f"\n\n{V.REPORT_TRANSLATION_HEADING}\n```text\n"),
        text("translation"),
        F.lit(f"\n```\n\n{V.REPORT_MINDMAP_HEADING}\n```markdown\n"),
        text("mindmap_markdown"),
        F.lit("\n```\n\n---"),
    )
    return ranked.select("rank", "id", section.alias("section"))


def report_lines(
    ranked: DataFrame,
    keywords: Sequence[str],
    days: int,
    analysed: int,
    title: str = REPORT_TITLE,
) -> DataFrame:
    """Header and sections in order, as the rows of a text file. `ranked` is a top-k.

    `analysed` is the number of papers analysed; the number selected is that of sections.
    """
    spark = ranked.sparkSession
    head = (
        f"# {title}\n\n- Keywords: {', '.join(keywords)}\n"
        f"- Time Window: Last {days} days\n- Total Papers Analyzed: {analysed}\n"
        f"- Top {ranked.count()} Selected\n"
    )
    sections = report_sections(ranked).select("rank", F.col("section").alias("value"))
    top = spark.createDataFrame([(0, head)], "rank INT, value STRING")
    return top.unionByName(sections).orderBy("rank").select("value")


def write_report(lines: DataFrame, path: str) -> None:
    """One Markdown file; k sections fit one task."""
    lines.coalesce(1).write.mode("overwrite").option("lineSep", "\n\n").text(path)
