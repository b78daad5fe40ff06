from __future__ import annotations

import os
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from tests.conftest import rows

from folioscope.operators.extraction import (
    extract_text,
    concat_pages,
    content_status,
    full_text_of_parts,
    page_parts,
    parse_cache_status,
    parse_outcome,
)
from folioscope.operators.sentences import ROOT, SECTIONS, key_sentence, outline
from folioscope.sources.binaries import extract_binaries, read_binaries, read_unsettled
from folioscope.sources.papers import pending_content

PAGES = [
    ("1", "<body>nav<article><p>main text</p></article></body>"),
    ("2", "<body>only plain</body>"),
    ("3", "<body>long page <article>x</article></body>"),
    ("4", "<body></body>"),
    ("5", None),
    ("6", ""),
]


def test_tiers_and_failover(spark):
    df = spark.createDataFrame(PAGES, "id STRING, html STRING")
    got = {r["id"]: (r["full_text"], r["parser"], r["error"]) for r in extract_text(df).collect()}
    none = (None, None, "no text in the document")
    assert got == {
        "1": ("main text", "structured", None),
        "2": ("only plain", "plain", None),
        "3": ("x", "structured", None),
        "4": none,
        "5": none,
        "6": none,
    }
    failed = extract_text(df, failed=F.col("id") == "3").collect()
    parsers = {r["id"]: r["parser"] for r in failed}
    assert (parsers["1"], parsers["3"]) == ("structured", "plain")
    off = {r["id"]: r["full_text"] for r in extract_text(df, structured=False).collect()}
    assert off["1"] == "nav main text"
    cut = {r["id"]: r["full_text"] for r in extract_text(df, max_chars=4).collect()}
    assert cut["1"] == "main"


def page_rows(seed=1):
    rng = random.Random(seed)
    data = []
    for doc, count in (("hot", 90), ("a", 1), ("b", 7), ("empty", 3)):
        for page in range(count):
            text = None if doc == "empty" else rng.choice([None, "", "x" * rng.randrange(1, 9)])
            data.append((doc, page, text))
    rng.shuffle(data)
    return data


def whole(data, doc):
    return "\n".join(t or "" for d, _, t in sorted(data, key=lambda r: r[:2]) if d == doc)


@pytest.mark.parametrize("per_part", [1, 4, 1024])
def test_parts_hold_whole_documents(spark, per_part):
    data = page_rows()
    df = spark.createDataFrame(data, "doc STRING, page INT, text STRING").repartition(3)
    parts = page_parts(df, "doc", "page", "text", per_part)
    joined: dict[str, list] = {}
    for r in parts.collect():
        assert r["n_pages"] <= per_part
        joined.setdefault(r["doc"], []).append((r["part"], r["text"]))
    for doc, pieces in joined.items():
        assert "\n".join(t for _, t in sorted(pieces)) == whole(data, doc)


@pytest.mark.parametrize("limit", [None, 1, 2, 5, 17, 60, 10_000])
def test_full_text_is_the_head_of_the_document(spark, limit):
    data = page_rows()
    df = spark.createDataFrame(data, "doc STRING, page INT, text STRING")
    parts = page_parts(df, "doc", "page", "text", 4)
    for r in full_text_of_parts(parts, "doc", limit).collect():
        assert r["full_text"] == whole(data, r["doc"])[:limit]


def test_one_row_for_a_document_of_many_and_repeated_pages(spark):
    data = [("long", n // 2, f"p{n}") for n in range(5_000)] + [("short", 7, None)]
    df = spark.createDataFrame(data, "doc STRING, page INT, text STRING").repartition(4)
    got = {r["doc"]: r for r in concat_pages(df, "doc", "page", "text").collect()}
    lines = [t for _, _, t in sorted(data[:5_000], key=lambda r: (r[1], r[2]))]
    assert got["long"]["full_text"] == "\n".join(lines) and got["long"]["n_pages"] == 5_000
    assert (got["short"]["full_text"], got["short"]["n_pages"]) == ("", 1)


def test_parse_cache_sees_changes(spark):
    schema = "parser STRING, basename STRING, mtime TIMESTAMP"
    at = datetime(2024, 1, 1, 12, 0, 0, 900_000)
    files = spark.createDataFrame(
        [("structured", "a.pdf", at), ("plain", "a.pdf", at), ("structured", "b.pdf", at)], schema
    )
    manifest = spark.createDataFrame(
        [
            ("structured", "a.pdf", at.replace(microsecond=1)),
            ("structured", "a.pdf", at.replace(microsecond=2)),
            ("structured", "b.pdf", at.replace(second=1)),
        ],
        schema,
    )
    got = rows(parse_cache_status(files, manifest).select("parser", "basename", "cached"))
    assert got == [("plain", "a.pdf", False), ("structured", "a.pdf", True), ("structured", "b.pdf", False)]
    key = parse_cache_status(files, manifest).where("parser = 'plain'").first()["cache_key"]
    assert key == f"plain_a.pdf_{int(datetime(2024, 1, 1, 12).timestamp())}"


def test_outcome_of_failed_papers_is_neutral(spark):
    papers = spark.createDataFrame([("1", "s1"), ("2", "s2"), ("3", "s3")], "id STRING, summary STRING")
    texts = spark.createDataFrame(
        [("1", "text", None), ("2", None, "broken")], "id STRING, full_text STRING, error STRING"
    )
    got = {r["id"]: r for r in parse_outcome(papers, texts).collect()}
    assert got["1"]["error"] is None and got["1"]["total_score"] is None
    for id_, reason in (("2", "broken"), ("3", "no parsed text")):
        r = got[id_]
        assert r["error"] == f"Failed to parse paper, error: {reason}"
        assert (r["total_score"], r["abstract"], r["breakthrough"], r["language"]) == (
            0.0,
            f"s{id_}",
            "",
            "na",
        )


def test_pending_content(spark):
    papers = spark.createDataFrame([("1",), ("2",)], "id STRING")
    manifest = spark.createDataFrame([("2",), ("2",), ("7",)], "id STRING")
    assert rows(pending_content(papers, manifest)) == [("1",)]


def test_binary_documents(spark, tmp_path):
    for name, content in (("good", b"S:one"), ("plain", b"P:two"), ("bad", b"??"), ("skip", b"x")):
        suffix = "txt" if name == "skip" else "pdf"
        (tmp_path / f"{name}.{suffix}").write_bytes(content)

    def structured(data):
        if not data.startswith(b"S:"):
            raise ValueError("no structure")
        return data[2:].decode()

    def plain(data):
        return data[2:].decode() if data[1:2] == b":" else None

    files = read_binaries(spark, str(tmp_path))
    got = {r["basename"]: r for r in extract_binaries(files, plain, structured).collect()}
    assert set(got) == {"good.pdf", "plain.pdf", "bad.pdf"}
    assert (got["good.pdf"]["full_text"], got["good.pdf"]["parser"]) == ("one", "structured")
    assert (got["plain.pdf"]["full_text"], got["plain.pdf"]["parser"]) == ("two", "plain")
    assert got["bad.pdf"]["full_text"] is None
    assert got["bad.pdf"]["error"] == "structured: no structure; plain: no text"
    assert got["good.pdf"]["mtime"] is not None
    only = extract_binaries(files, plain, max_chars=1).where("basename = 'good.pdf'").first()
    assert (only["full_text"], only["parser"]) == ("o", "plain")


def test_key_sentence(spark):
    cases = {
        "": "",
        "...\n\n": "",
        "Nothing. Here": "Nothing",
        "We try. We propose a novel idea! It is novel.": "We propose a novel idea",
        "novel one. novel two": "novel one",
        "We solve nothing？We propose and solve": "We propose and solve",
    }
    df = spark.createDataFrame([(t, "en") for t in cases], "summary STRING, language STRING")
    for r in key_sentence(df).collect():
        assert r["breakthrough"] == cases[r["summary"]]
    null = spark.createDataFrame([(None, "en")], "summary STRING, language STRING")
    first = key_sentence(null).first()
    assert (first["breakthrough"], first["bonus_tenths"]) == ("", 0)


def outline_in_python(text):
    parts = [p.strip() for p in text.split("\n") if p.strip()]
    tiles: list[list[str]] = [[], [], [], []]
    share, extra = divmod(len(parts), 4)
    at = 0
    for tile in range(4):
        size = share + (tile < extra)
        tiles[tile] = parts[at : at + size]
        at += size
    lines = [f"- {ROOT}"]
    for section, tile in zip(SECTIONS, tiles, strict=True):
        if tile:
            lines += [f"  - {section}", "    - " + " ".join(tile[0].split()[:15])]
    return "\n".join(lines)


def test_outline(spark):
    words = " ".join(f"w{n}" for n in range(40))
    texts = ["", *["\n".join(f"p{i} {words}" for i in range(n)) + "\n\n" for n in range(1, 11)]]
    df = spark.createDataFrame([(t,) for t in texts], "full_text STRING")
    for r in outline(df).collect():
        assert r["mindmap_markdown"] == outline_in_python(r["full_text"])
    assert outline(df.select(F.lit("one two").alias("full_text"))).first()[1].count("\n") == 2


def test_contents_decide_what_is_parsed_again(spark, tmp_path):
    """A touched file is a hit, one that changed in the same second and length a miss."""
    folder = tmp_path / "files"
    folder.mkdir()
    at = datetime(2024, 1, 1, 12).timestamp()

    def write(name, body, when=at):
        (folder / name).write_bytes(body)
        os.utime(folder / name, (when, when))

    for name in ("same.pdf", "touched.pdf", "racy.pdf", "old.pdf"):
        write(name, name.encode())
    made = read_binaries(spark, str(folder))
    digest, length = F.sha2("content", 256).alias("digest"), F.length("content").cast("long")
    later = F.when(F.col("basename") == "racy.pdf", 0).otherwise(60)
    parsed_at = (F.col("mtime") + F.make_dt_interval(secs=later)).alias("parsed_at")
    manifest = made.select(
        "basename", "mtime", length.alias("length"), digest, parsed_at, F.lit("plain").alias("parser")
    )
    manifest = spark.createDataFrame(manifest.collect(), manifest.schema)
    assert {r["basename"] for r in read_unsettled(spark, str(folder), manifest).collect()} == {"racy.pdf"}
    write("touched.pdf", b"touched.pdf", at + 100)
    write("racy.pdf", b"rAcy.pdf")
    write("new.pdf", b"new", at + 5)
    unsettled = read_unsettled(spark, str(folder), manifest).withColumn("parser", F.lit("plain"))
    status = content_status(unsettled, manifest)
    assert "content" not in status.columns
    got = {r["basename"]: r["cached"] for r in status.collect()}
    assert got == {"touched.pdf": True, "racy.pdf": False, "new.pdf": False}
    other = content_status(unsettled.withColumn("parser", F.lit("structured")), manifest)
    assert other.where("cached").count() == 0
