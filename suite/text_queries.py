"""Text extraction, language, prompts, outlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.fixed_values import FULL_TEXT_CHARS, OUTLINE_CHARS, PAPER_KEY_PREFIX
from folioscope.functions.prompts import (
    TEMPLATES,
    render_by_name,
    template_body,
    template_name,
)
from folioscope.functions.text import head_chars, split_list
from folioscope.operators.extraction import (
    concat_pages,
    extract_text,
    parse_cache_status,
    parse_outcome,
)
from folioscope.operators.sentences import PHRASE_WORDS, ROOT, SECTIONS, outline
from folioscope.plans.analysis import language_of
from suite import params as P
from suite.ctes import sql, strip
from suite.registry import query
from suite.views import papers, table


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


# The character references that occur in the pages; "&" goes last.
_REFERENCES = (
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&nbsp;", " "),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&amp;", "&"),
)


def _plain(html: str) -> str:
    text = (
        rf"regexp_replace(regexp_replace({html}, "
        r"'(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->', ' ', 'g'), "
        r"'(?s)<[^>]*>', ' ', 'g')"
    )
    for reference, character in _REFERENCES:
        text = f"replace({text}, '{reference}', {_quoted(character)})"
    return rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"


@query(
    "extract_text",
    f"""
    SELECT page_id, CASE WHEN a <> '' AND page_id % 9 > 0 THEN a ELSE b END AS full_text,
           CASE WHEN a <> '' AND page_id % 9 > 0 THEN 'structured' ELSE 'plain' END AS parser
    FROM (SELECT page_id,
            {_plain(r"regexp_extract(html, '(?is)<article[^>]*>(.*?)</article\s*>', 1)")} AS a,
            {_plain('html')} AS b
          FROM pages)""",
)
def extract(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    # The extractor reports a failure for every ninth page.
    read = extract_text(pages, failed=F.col("page_id") % 9 == 0)
    return read.select("page_id", "full_text", "parser")


@query(
    "truncate_text",
    f"""
    SELECT doc_id, CAST(length(substr(text, 1, {FULL_TEXT_CHARS})) AS INTEGER) AS text_chars,
           md5(substr(text, 1, {FULL_TEXT_CHARS})) AS text_md5,
           CAST(length(substr(text, 1, {OUTLINE_CHARS})) AS INTEGER) AS outline_chars
    FROM documents""",
)
def truncate(spark, sf_dir):
    short = head_chars(F.col("text"), FULL_TEXT_CHARS)
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.length(short).alias("text_chars"),
        F.md5(short).alias("text_md5"),
        F.length(head_chars(F.col("text"), OUTLINE_CHARS)).alias("outline_chars"),
    )


@query(
    "concat_pages",
    """
    SELECT conv_id, count(*) AS n_pages,
           string_agg(coalesce(text, ''), chr(10) ORDER BY turn, text) AS full_text
    FROM conversations GROUP BY conv_id""",
)
def concat(spark, sf_dir):
    return concat_pages(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query(
    "parse_cache_status",
    sql(
        """
        SELECT p.id AS basename, 'structured' AS parser,
               'structured_' || p.id || '_' || CAST(floor(epoch(p.published)) AS BIGINT) AS cache_key,
               EXISTS (SELECT 1 FROM labels l WHERE CAST(l.doc_id AS VARCHAR) = p.id
                       AND l.quality = 1) AS cached
        FROM papers p""",
        "papers",
    ),
)
def cache_status(spark, sf_dir):
    """Labelled papers were parsed before; those of quality 0 an hour before a change."""
    base = papers(spark, sf_dir).select(
        F.col("id").alias("basename"), F.lit("structured").alias("parser"), "published"
    )
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("basename"), "quality"
    )
    files = base.withColumn("mtime", F.col("published") + F.expr("INTERVAL 0.3 SECOND"))
    age = F.when(F.col("quality") == 1, F.expr("INTERVAL 0.7 SECOND")).otherwise(
        F.expr("INTERVAL -1 HOUR")
    )
    parsed = base.join(labels, "basename").withColumn("mtime", F.col("published") + age)
    status = parse_cache_status(files, parsed)
    return status.select("basename", "parser", "cache_key", "cached")


@query(
    "parse_outcome",
    sql(
        """
        SELECT p.id, CAST(length(g.html) AS INTEGER) AS text_chars,
               CASE WHEN g.html IS NULL THEN 0.0::DOUBLE END AS total_score,
               CASE WHEN g.html IS NULL THEN md5(p.summary) END AS abstract_md5,
               CASE WHEN g.html IS NULL THEN '' END AS breakthrough,
               CASE WHEN g.html IS NULL THEN 'na' END AS language,
               CASE WHEN g.html IS NULL THEN 'Failed to parse paper, error: no parsed text' END AS error
        FROM papers p LEFT JOIN pages g ON CAST(g.page_id AS VARCHAR) = p.id""",
        "papers",
    ),
)
def outcome(spark, sf_dir):
    texts = table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("string").alias("id"),
        F.col("html").alias("full_text"),
        F.lit(None).cast("string").alias("error"),
    )
    done = parse_outcome(papers(spark, sf_dir).select("id", "summary"), texts)
    return done.select(
        "id",
        F.length("full_text").alias("text_chars"),
        "total_score",
        F.md5("abstract").alias("abstract_md5"),
        "breakthrough",
        "language",
        "error",
    )


@query(
    "detect_language",
    sql("SELECT id, lang, language, lang = language AS agrees FROM labelled", "labelled"),
)
def language(spark, sf_dir):
    labelled = papers(spark, sf_dir).select(
        "id", "lang", language_of("summary", P.CONFIG).alias("language")
    )
    return labelled.withColumn("agrees", F.col("lang") == F.col("language"))


# One more language with a template of its own; the others fall back to English.
_TEMPLATES = {
    **TEMPLATES,
    "insight_de": "Nenne den Fortschritt {{kurz}}.\n{abstract}\n---\n{full_text}",
}
_CASES = " ".join(
    f"WHEN '{name}' THEN {_quoted(body)}" for name, body in _TEMPLATES.items()
)
_NAMED = """
    SELECT id, summary, CASE WHEN language IN ('de', 'en', 'zh') THEN 'insight_' || language
                             ELSE 'insight_en' END AS template FROM labelled"""


def _sql_render(template: str) -> str:
    parts = []
    for piece in template.replace("{abstract}", "\0").replace("{full_text}", "\0").split("\0"):
        parts.append(_quoted(piece.replace("{{", "{").replace("}}", "}")))
    return " || summary || ".join(parts)


@query(
    "prompt_select",
    sql(
        f"SELECT id, template, md5(CASE template {_CASES} END) AS body_md5 FROM ({_NAMED})",
        "labelled",
    ),
)
def prompt_select(spark, sf_dir):
    name = template_name(
        language_of("summary", P.CONFIG), "insight", "insight_en", _TEMPLATES
    )
    named = papers(spark, sf_dir).select("id", name.alias("template"))
    body = template_body(F.col("template"), _TEMPLATES)
    return named.withColumn("body_md5", F.md5(body))


@query(
    "prompt_render",
    sql(
        f"SELECT id, md5(prompt) AS prompt_md5, CAST(length(prompt) AS INTEGER) AS prompt_chars FROM ("
        f"SELECT id, CASE template WHEN 'insight_de' THEN {_sql_render(_TEMPLATES['insight_de'])} "
        f"ELSE {_sql_render(_TEMPLATES['insight_en'])} END AS prompt FROM ({_NAMED}))",
        "labelled",
    ),
)
def prompt_render(spark, sf_dir):
    name = template_name(
        language_of("summary", P.CONFIG), "insight", "insight_en", _TEMPLATES
    )
    slots = {"abstract": F.col("summary"), "full_text": F.col("summary")}
    bodies = {k: v for k, v in _TEMPLATES.items() if k.startswith("insight_")}
    named = papers(spark, sf_dir).select("id", "summary", name.alias("template"))
    prompts = named.select(
        "id", render_by_name(F.col("template"), slots, bodies).alias("prompt")
    )
    return prompts.select(
        "id", F.md5("prompt").alias("prompt_md5"), F.length("prompt").alias("prompt_chars")
    )


@query(
    "parse_keyword_list",
    sql(
        f"SELECT id, CAST(len(items) AS INTEGER) AS n_items, array_to_string(items, '|') AS items FROM ("
        f"SELECT id, list_filter(list_transform(string_split(summary, ','), lambda s: {strip('s')}), "
        f"lambda s: s <> '') AS items FROM papers)",
        "papers",
    ),
)
def keyword_list(spark, sf_dir):
    split = papers(spark, sf_dir).select("id", split_list(F.col("summary")).alias("i"))
    return split.select(
        "id", F.size("i").alias("n_items"), F.array_join("i", "|").alias("items")
    )


_SECTION = "CASE tile " + " ".join(
    f"WHEN {n} THEN '  - {name}'" for n, name in enumerate(SECTIONS, 1)
) + " END"


@query(
    "outline_baseline",
    rf"""
    WITH cut AS (
      SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n+'),
               lambda s: {strip('s')}), lambda s: s <> '') AS list FROM documents),
    tiled AS (
      SELECT doc_id, pos, part, ntile(4) OVER (PARTITION BY doc_id ORDER BY pos) AS tile
      FROM (SELECT doc_id, pos, list[pos] AS part
            FROM (SELECT *, unnest(range(1, len(list) + 1)) AS pos FROM cut))),
    leads AS (
      SELECT doc_id, tile, arg_min(part, pos) AS part FROM tiled GROUP BY ALL),
    lines AS (
      SELECT doc_id, string_agg({_SECTION} || chr(10) || '    - ' ||
               array_to_string(regexp_split_to_array(part, '\s+')[1:{PHRASE_WORDS}], ' '),
               chr(10) ORDER BY tile) AS body
      FROM leads GROUP BY doc_id)
    SELECT '{PAPER_KEY_PREFIX}' || d.doc_id AS paper_key,
           '- {ROOT}' || coalesce(chr(10) || body, '') AS mindmap_markdown
    FROM documents d LEFT JOIN lines USING (doc_id)""",
)
def outline_baseline(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select(
        F.concat(F.lit(PAPER_KEY_PREFIX), F.col("doc_id").cast("string")).alias("paper_key"),
        F.col("text").alias("full_text"),
    )
    return outline(documents).select("paper_key", "mindmap_markdown")
