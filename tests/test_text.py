from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from folioscope.fixed_values import SURVEY_WORDS
from folioscope.functions.language import HAN, LetterClass, detect_language
from folioscope.functions.matching import catalogue_match, mentions_any, on_topic, relevant
from folioscope.functions.prompts import (
    TEMPLATES,
    render,
    render_by_name,
    template_body,
    template_name,
)
from folioscope.functions.text import article_of, head_chars, markup_to_text, split_list, strip
from folioscope.sources.papers import newest, search, within_days
from folioscope.sources.templates import read_templates


def one(spark, column, **values):
    cols = [F.lit(v).alias(k) for k, v in values.items()]
    return spark.range(1).select(*cols).select(column).first()[0]


def test_strip_is_pythons(spark):
    spaces = [chr(n) for n in range(0x3001) if chr(n).isspace()]
    texts = [s + "a" + s + "b" + s for s in spaces] + ["", "".join(spaces), "​a"]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    for text, got in df.select("t", strip(F.col("t"))).collect():
        assert got == text.strip()


def test_limits_count_code_points(spark):
    text = "a😀文" * 5
    for n in (0, 1, 2, 3, 14, 15, 16):
        assert one(spark, head_chars(F.col("t"), n), t=text) == text[:n]
    assert one(spark, head_chars(F.col("t"), None), t=text) == text


def test_split_list(spark):
    got = one(spark, split_list(F.col("t")), t=" a, ,b c ,,\td\n")
    assert got == ["a", "b c", "d"]
    assert one(spark, split_list(F.col("t")), t="") == []


def test_markup(spark):
    html = (
        "<html><head><style>p{}</style><SCRIPT src='x'>var a='<p>';</SCRIPT></head>"
        "<!-- <p>no</p> --><body><h1>T &amp;lt; &copy;</h1>\n<p\nid=1>a&nbsp;b</p></body>"
    )
    assert one(spark, markup_to_text(F.col("t")), t=html) == "T &lt; © a b"


PAPERS = [
    ("1", "A Survey of X", "text"),
    ("2", "Previewing", "nothing"),
    ("3", "Large language", "models that reason"),
    ("4", None, "LARGE LANGUAGE MODELS"),
    ("5", "title", None),
    ("6", "ends with large", "language models start"),
    ("7", "Reasoning", "about large language models"),
]


def papers(spark):
    data = [(*p, ["cs.CL"] if int(p[0]) % 2 else ["cs.AI", "x"]) for p in PAPERS]
    return spark.createDataFrame(
        data, "id STRING, title STRING, summary STRING, categories ARRAY<STRING>"
    )


def python_text(paper):
    return " ".join(part for part in paper[1:] if part is not None).lower()


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_predicates_match_brute_force(spark):
    keyword_sets = [
        [],
        ["large language models"],
        ["Reasoning", "models"],
        [f"word{n}" for n in range(80)] + ["NOTHING"],
    ]
    df = papers(spark)
    good = [p for p in PAPERS if not any(w in python_text(p) for w in SURVEY_WORDS)]
    assert ids(df.where(on_topic())) == [p[0] for p in good]
    for keywords in keyword_sets:

        def hit(paper, words=keywords):
            return not words or any(k.lower() in python_text(paper) for k in words)

        assert ids(df.where(mentions_any(keywords))) == [p[0] for p in PAPERS if hit(p)]
        assert ids(df.where(relevant(keywords))) == [p[0] for p in good if hit(p)]


def test_catalogue_needs_all_keywords_and_any_category(spark):
    df = papers(spark)
    both = ["large language models", "reason"]
    expected = [p[0] for p in PAPERS if all(k in python_text(p) for k in both)]
    assert ids(df.where(catalogue_match(both, []))) == expected
    assert ids(df.where(catalogue_match([], ["cs.AI", "cs.XX"]))) == ["2", "4", "6"]
    assert ids(df.where(catalogue_match([], []))) == [p[0] for p in PAPERS]


def test_newest_is_cut_before_the_window(spark):
    days = [(str(n), datetime(2024, 1, n)) for n in range(1, 11)]
    df = spark.createDataFrame(days, "id STRING, published TIMESTAMP").withColumns(
        {"title": F.lit("t"), "summary": F.lit("s"), "categories": F.array(F.lit("c"))}
    )
    assert ids(newest(df, 3)) == ["10", "8", "9"]
    inclusive = within_days(df, datetime(2024, 1, 10), 3)
    assert ids(inclusive) == ["10", "7", "8", "9"]
    assert ids(search(df, [], [], datetime(2024, 1, 10), 8, limit=2)) == ["10", "9"]
    assert len(ids(search(df, [], [], datetime(2024, 1, 10), 8, limit=None))) == 9


def test_equal_times_are_settled_by_id(spark):
    same = [(str(n), datetime(2024, 1, 1)) for n in range(9, 0, -1)]
    df = spark.createDataFrame(same, "id STRING, published TIMESTAMP").repartition(4)
    assert ids(newest(df, 3)) == ["1", "2", "3"]


def test_language(spark):
    classes = (HAN, LetterClass("de", "äöüß"), LetterClass("fr", "éèç"))
    cases = {
        "": "en",
        "plain text": "en",
        "突破 and more": "zh",
        "äé": "de",
        "ééä": "fr",
        "é" + "x" * 99: "en",
    }
    for text, expected in cases.items():
        assert one(spark, detect_language(F.col("t"), classes, 0.1), t=text) == expected
    assert one(spark, detect_language(F.lit(None).cast("string"), classes), t="") == "en"


def test_render_is_str_format(spark):
    template = "{{x}} {abstract} and {full_text}{{}} {abstract}"
    values = {"abstract": "A {full_text} {{}}", "full_text": "B {abstract}"}
    got = one(spark, render(template, {k: F.col(k) for k in values}), **values)
    assert got == template.format(**values)
    for body in TEMPLATES.values():
        got = one(spark, render(body, {k: F.col(k) for k in values}), **values)
        assert got == body.format(**values)
    assert one(spark, render("", {}), t="") == ""


def test_templates_by_language(spark, tmp_path):
    (tmp_path / "insight_de.txt").write_text("Hallo {abstract}", encoding="utf-8")
    (tmp_path / "rating.txt").write_text("Rate {full_text}", encoding="utf-8")
    templates = read_templates(spark, str(tmp_path))
    assert templates["rating"] == "Rate {full_text}"
    assert templates["insight_en"] == TEMPLATES["insight_en"]
    df = spark.createDataFrame([("de",), ("zh",), ("fr",), (None,)], "lang STRING")
    name = template_name(F.col("lang"), "insight", "insight_en", templates)
    got = [r[0] for r in df.select(name).collect()]
    assert got == ["insight_de", "insight_zh", "insight_en", "insight_en"]
    slots = {"abstract": F.lit("x"), "full_text": F.lit("y")}
    named = df.select(name.alias("n"))
    rendered = named.select(render_by_name(F.col("n"), slots, templates)).collect()
    assert rendered[0][0] == "Hallo x"
    assert named.select(template_body(F.col("n"), templates)).first()[0] == "Hallo {abstract}"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("a &mdash; b&eacute;&#8217;&#x2019;&#X41;", "a — bé’’A"),
        ("&amp;lt; &amp;amp; &lt;b&gt;", "&lt; &amp; <b>"),
        ("&unknown; & &; &# &#0; &#x110000; &#55296; AT&T", "&unknown; & &; &# &#0; &#x110000; &#55296; AT&T"),
        ("&apos;&quot;&copy;2024", "'\"©2024"),
        ("<p>&#128512;</p>", "😀"),
    ],
)
def test_character_references(spark, html, text):
    assert one(spark, markup_to_text(F.col("t")), t=html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("x<article>one</article>y<article class='b'>two</article>z", "one two"),
        ("<article>a<article>b</article>c</article>d", "a b c"),
        ("<ARTICLE>never closed <b>here</b>", "never closed here"),
        ("</article>before<articles>not one</articles>", ""),
        ("<!-- <article>no</article> --><article>yes</article >", "yes"),
    ],
)
def test_all_articles_are_read(spark, html, text):
    assert one(spark, markup_to_text(article_of(F.col("t"))), t=html) == text


def test_random_words_against_brute_force(spark):
    rng = random.Random(7)
    alphabet = "abÀß "
    data = [
        (str(n), "".join(rng.choices(alphabet, k=5)), "".join(rng.choices(alphabet, k=8)))
        for n in range(200)
    ]
    words = ["".join(rng.choices(alphabet, k=2)) for _ in range(4)]
    df = spark.createDataFrame(data, "id STRING, title STRING, summary STRING")
    expected = sorted(p[0] for p in data if any(w.lower() in python_text(p) for w in words))
    assert ids(df.where(mentions_any(words))) == expected
