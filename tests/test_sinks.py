from __future__ import annotations

import csv
import json
from datetime import datetime
from pathlib import Path

from pyspark.sql import functions as F

from folioscope.fixed_values import CSV_COLUMNS, NO_MINDMAP, NO_TRANSLATION
from folioscope.operators.ranking import number_top_k
from folioscope.sinks.exports import (
    api_envelope,
    csv_view,
    full_view,
    json_array,
    json_rows,
    write_csv,
    write_full_csv,
    write_json,
)
from folioscope.sinks.report import paper_cards, report_lines, report_sections, write_report

SCHEMA = (
    "breakthrough STRING, id STRING, title STRING, published TIMESTAMP, language STRING, "
    "final_score DOUBLE, total_score DOUBLE, insight_bonus DOUBLE, authors ARRAY<STRING>"
)
PAPERS = [
    ('say "hi", 创新\nline', "b", 'T "1", x', datetime(2024, 1, 2), "zh", 7.5, 7.0, 0.5, ["A", "B"]),
    (None, "a", "T2", datetime(2024, 1, 3), "en", 7.5, 7.2, 0.3, []),
    ("low", "c", "T3", datetime(2024, 1, 4), "en", None, None, None, None),
    ("best", "d", "T4", datetime(2024, 1, 1), "fr", 9.0, 9.0, 0.0, ["C"]),
]


def papers(spark):
    return spark.createDataFrame(PAPERS, SCHEMA).repartition(3)


def files(path, suffix):
    return sorted(Path(path).glob(f"*.{suffix}"))


def test_csv_columns_are_those_present_in_order(spark):
    assert csv_view(papers(spark)).columns == [
        c for c in CSV_COLUMNS if c in papers(spark).columns
    ]


def test_csv_file(spark, tmp_path):
    write_csv(papers(spark), str(tmp_path / "out"), files=1)
    (file,) = files(tmp_path / "out", "csv")
    raw = file.read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfid,title,")
    with open(file, encoding="utf-8-sig", newline="") as f:
        read = {r["id"]: r for r in csv.DictReader(f)}
    assert set(read) == {"a", "b", "c", "d"}
    assert read["b"]["title"] == 'T "1", x'
    assert read["b"]["breakthrough"] == 'say "hi", 创新\nline'
    assert read["b"]["final_score"] == "7.5"
    assert read["b"]["published"] == "2024-01-02T00:00:00"
    assert read["a"]["breakthrough"] == ""


def test_csv_keeps_texts_as_they_are(spark, tmp_path):
    odd = ["  lead and trail  ", "", None, "a\r\nb", "\ttab", 'q"q', "a,b", " "]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(odd)], "id STRING, title STRING")
    write_csv(df, str(tmp_path / "out"), files=1)
    (file,) = files(tmp_path / "out", "csv")
    with open(file, encoding="utf-8-sig", newline="") as f:
        read = {r["id"]: r["title"] for r in csv.DictReader(f)}
    assert [read[str(i)] for i in range(len(odd))] == [t or "" for t in odd]


def test_missing_fields_are_null_in_json(spark, tmp_path):
    write_json(papers(spark), str(tmp_path / "out"))
    lines = [
        json.loads(line)
        for file in files(tmp_path / "out", "json")
        for line in file.read_text(encoding="utf-8").splitlines()
    ]
    rows = [json.loads(r["json"]) for r in json_rows(papers(spark)).collect()]
    data = json.loads(json_array(papers(spark), 4).first()["json"])
    envelope = json.loads(api_envelope(papers(spark), 4, "now").first()["json"])["data"]
    for found in (lines, rows, data, envelope):
        assert all(set(p) == set(papers(spark).columns) for p in found)
        assert next(p for p in found if p["id"] == "a")["breakthrough"] is None


def test_full_csv_holds_nested_columns(spark, tmp_path):
    write_full_csv(papers(spark), str(tmp_path / "out"), files=1)
    (file,) = files(tmp_path / "out", "csv")
    with open(file, encoding="utf-8-sig", newline="") as f:
        read = {r["id"]: r for r in csv.DictReader(f)}
    assert list(read["a"]) == papers(spark).columns
    assert json.loads(read["b"]["authors"]) == ["A", "B"]
    assert full_view(papers(spark)).schema["authors"].dataType.simpleString() == "string"


def test_every_part_file_has_its_own_header(spark, tmp_path):
    write_csv(papers(spark), str(tmp_path / "out"))
    parts = files(tmp_path / "out", "csv")
    assert parts and all(p.read_bytes().startswith(b"\xef\xbb\xbfid,") for p in parts)


def test_json_lines(spark, tmp_path):
    write_json(papers(spark), str(tmp_path / "out"))
    lines = [
        line
        for file in files(tmp_path / "out", "json")
        for line in file.read_text(encoding="utf-8").splitlines()
    ]
    assert len(lines) == 4 and any("创新" in line for line in lines)
    assert {json.loads(line)["id"] for line in lines} == {"a", "b", "c", "d"}
    rows = {r["id"]: json.loads(r["json"]) for r in json_rows(papers(spark)).collect()}
    assert rows["b"]["breakthrough"] == 'say "hi", 创新\nline'


def test_arrays_are_best_first(spark):
    data = json.loads(json_array(papers(spark), 3).first()["json"])
    assert [p["id"] for p in data] == ["d", "a", "b"]
    envelope = json.loads(api_envelope(papers(spark), 2, "now").first()["json"])
    assert envelope["meta"] == {"total": 2, "generated_at": "now"}
    assert [p["id"] for p in envelope["data"]] == ["d", "a"]
    empty = json.loads(api_envelope(papers(spark).where("false"), 2, "now").first()["json"])
    assert empty == {"meta": {"total": 0, "generated_at": "now"}, "data": []}


def test_cards_fill_defaults(spark):
    cards = {r["id"]: r for r in paper_cards(papers(spark)).collect()}
    assert cards["c"]["score_line"] == "0.00 (base 0.00, bonus 0.00)"
    assert cards["b"]["score_line"] == "7.50 (base 7.00, bonus 0.50)"
    assert (cards["b"]["language_label"], cards["d"]["language_label"]) == ("中文", "English")
    assert (cards["b"]["translation"], cards["b"]["mindmap_markdown"]) == (
        NO_TRANSLATION,
        NO_MINDMAP,
    )
    assert cards["b"]["paper_key"] == "arvix_b"
    assert cards["b"]["published_day"] == "2024-01-02"


def test_report(spark, tmp_path):
    ranked = number_top_k(papers(spark), 3).withColumn("translation", F.lit("译"))
    sections = {r["rank"]: r["section"] for r in report_sections(ranked).collect()}
    assert sections[1].startswith("## 1. [T4](https://arxiv.org/abs/d)\n")
    assert "> \n" in sections[2]  # a missing insight renders empty
    assert "```text\n译\n```" in sections[3]
    lines = report_lines(ranked, ["k1", "k2"], 7, analysed=4)
    write_report(lines, str(tmp_path / "report"))
    (file,) = files(tmp_path / "report", "txt")
    text = file.read_text(encoding="utf-8")
    assert "- Keywords: k1, k2\n- Time Window: Last 7 days\n- Total Papers Analyzed: 4\n- Top 3 Selected" in text
    places = [text.index(f"## {n}. [") for n in (1, 2, 3)]
    assert places == sorted(places)
