"""Keyword tables: every phrase of a table that occurs in a text, in one pass."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from folioscope.cluster import settle
from folioscope.functions.matching import haystack

#: Bytes of phrases that one automaton holds; a node takes some 50 bytes a letter.
MAX_BYTES = 32 << 20
_BATCH_ROWS = 256


def phrase_table(phrases: DataFrame, column: str = "phrase") -> DataFrame:
    """`phrase`: the distinct lower-cased phrases; null and empty ones are no keywords."""
    phrase = F.lower(F.col(column)).alias("phrase")
    return phrases.select(phrase).where("phrase <> ''").distinct()


def _automaton(phrases: list[str]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for number, phrase in enumerate(phrases):
        automaton.add_word(phrase, number)
    automaton.make_automaton()
    return automaton


def _matches(batches: Iterator[pa.RecordBatch], shared, schema) -> Iterator[pa.RecordBatch]:
    phrases = shared.value
    automaton = _automaton(phrases)
    for whole in batches:
        for begin in range(0, whole.num_rows, _BATCH_ROWS):
            batch = whole.slice(begin, _BATCH_ROWS)
            found = [
                sorted({phrases[n] for _, n in automaton.iter(text)}) if text and phrases else []
                for text in batch.column("_text").to_pylist()
            ]
            columns = [*batch.columns[:-1], pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


def match_phrases(
    papers: DataFrame, phrases: DataFrame, max_bytes: int = MAX_BYTES, key: str = "id"
) -> DataFrame:
    """`key` and `phrases`: the sorted phrases of a `phrase_table` in title and summary.

    A phrase matches as `keyword_any` does: anywhere in the lowered title, space and
    summary, so across their border too. Papers without a match have an empty array.
    `key` is unique; a null title or summary is left out of the text.

    The phrases' bytes are summed first. Up to `max_bytes` they are one automaton, which
    each task builds from a broadcast list and runs over each text once, whatever the
    number of phrases; nothing is shuffled. More phrases are cut into parts by their hash,
    each a pass over the texts, whose few matches are then gathered by paper.
    """
    table = settle(phrases.select("phrase"))
    size = table.agg(F.sum(F.octet_length("phrase"))).first()[0] or 0
    parts = max(1, -(-size // max_bytes))
    texts = papers.select(key, haystack().alias("_text"))
    out = papers.select(key, F.array().cast("array<string>").alias("phrases")).schema
    arrow = to_arrow_schema(out)
    context = papers.sparkSession.sparkContext
    passes = []
    for part in range(parts):
        own = F.pmod(F.xxhash64("phrase"), F.lit(parts)) == part
        # About max_bytes, as checked above.
        chosen = sorted(r[0] for r in table.where(own).collect())
        shared = context.broadcast(chosen)
        passes.append(texts.mapInArrow(lambda it, s=shared: _matches(it, s, arrow), out))
    if parts == 1:
        return passes[0]
    rows = passes[0]
    for other in passes[1:]:
        rows = rows.unionByName(other)
    hits = rows.select(key, F.explode("phrases").alias("phrase"))
    found = hits.groupBy(key).agg(F.array_sort(F.collect_list("phrase")).alias("found"))
    none = F.array().cast("array<string>")
    return papers.select(key).join(found, key, "left").select(
        key, F.coalesce("found", none).alias("phrases")
    )


def keyword_table_any(
    papers: DataFrame, phrases: DataFrame, max_bytes: int = MAX_BYTES, key: str = "id"
) -> DataFrame:
    """`keyword_any` for a table of keywords; an empty table keeps all papers."""
    if phrases.isEmpty():
        return papers
    matched = match_phrases(papers, phrases, max_bytes, key).where(F.size("phrases") > 0)
    return papers.join(matched.select(key), key, "left_semi")
