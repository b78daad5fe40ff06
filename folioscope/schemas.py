"""Record types of the engine, as Spark DDL."""

PAPER = (
    "id STRING, title STRING, summary STRING, pdf_url STRING, published TIMESTAMP, "
    "authors ARRAY<STRING>, categories ARRAY<STRING>"
)
PARSED_TEXT = "id STRING, full_text STRING, error STRING, parser STRING"
RATING_JSON = "innovation DOUBLE, rigor DOUBLE, impact DOUBLE"
INSIGHT_JSON = "abstract STRING, breakthrough STRING"
AUTHOR_PROFILE = (
    "STRUCT<name STRING, h_index INT, paper_count INT, citation_count INT, "
    "affiliations ARRAY<STRING>, source_used STRING>"
)
FLAT_PAYLOAD = (
    "data ARRAY<STRUCT<name STRING, hIndex INT, paperCount INT, citationCount INT, "
    "affiliations ARRAY<STRUCT<name STRING>>>>"
)
NESTED_PAYLOAD = (
    "results ARRAY<STRUCT<display_name STRING, works_count INT, cited_by_count INT, "
    "summary_stats STRUCT<h_index INT>, "
    "affiliations ARRAY<STRUCT<institution STRUCT<display_name STRING>>>>>"
)
PATCH = "paper_id STRING, field STRING, value STRING, seq BIGINT"
RESPONSE = "paper_id STRING, task STRING, raw_response STRING, error STRING"

# Fields an evaluation record may hold, and the field whose presence marks a task done.
EVALUATION_FIELDS = (
    "innovation",
    "rigor",
    "impact",
    "total_score",
    "raw_response",
    "abstract",
    "breakthrough",
    "language",
    "translation",
    "mindmap_markdown",
)
TASK_FIELD = {
    "rating": "innovation",
    "insight": "breakthrough",
    "translation": "translation",
    "mindmap": "mindmap_markdown",
}
