from __future__ import annotations

import random

import pytest

from folioscope.llm.host_rules import host_verdicts, judge

from . import brute

CLEAN = "one two three four five six seven eight nine ten eleven"
COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def measures(text):
    text = text or ""
    w = brute.words(text)
    lines = [x for x in text.split("\n") if brute.words(x)]
    repeated = brute.repeat_words(text)
    return (
        len(w),
        sum(map(len, w)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        repeated,
        len(w) < 10 or 100 * repeated > 20 * len(w),
    )


def texts():
    r = random.Random(4)
    out = [None, "", " \n\t", CLEAN, "a b c d e a b c d e", "a " * 50, "x y z\u000b\u001cq 😀 é"]
    out += ["l1\nl1\n\n \nl1 \nl2\nl2", "a\r\na\r\nb", "#$ <|> & %% **"]
    for _ in range(40):
        out.append(r.choice([" ", "\n", "  ", "\t"]).join(r.choice("abcd") for _ in range(r.randint(1, 60))))
    out.append(" ".join(f"w{i}" for i in range(30_000)) + " w5 w6 w7 w8 w9")
    return out


def test_measures(spark):
    rows = texts()
    got = {r.doc_id: r for r in judge(brute.docs_of(spark, rows)).collect()}
    for i, text in enumerate(rows):
        assert tuple(got[i][c] for c in COLUMNS) == measures(text), text


def test_a_bad_host_takes_its_documents_along(spark):
    rows = [CLEAN] * 200 + ["short"] * 10 + ["short"] * 95 + [CLEAN] * 5 + [CLEAN, "short"]
    hosts = ["good"] * 210 + ["bad"] * 100 + [None, None]
    got = judge(brute.docs_of(spark, rows, hosts)).collect()
    for r in got:
        assert r.kept == (rows[r.doc_id] == CLEAN and hosts[r.doc_id] != "bad")


def test_shrunk_rates(spark):
    counts = {"a": (1_000, 50), "b": (1_000, 400), "c": (2, 2), "d": (500, 100)}
    rows = [(h, i < bad) for h, (n, bad) in counts.items() for i in range(n)]
    df = spark.createDataFrame(rows, "source string, base_failed boolean")
    got = {r.source: r for r in host_verdicts(df).collect()}
    mean = sum(b for _, b in counts.values()) / sum(n for n, _ in counts.values())
    # A host of two rows moves most of the way to the mean, large ones stay.
    assert mean < got["c"].fail_rate < 1
    assert got["b"].fail_rate == pytest.approx(0.4, abs=0.02)
    assert got["a"].fail_rate == pytest.approx(0.05, abs=0.02)


def test_equal_hosts_share_one_rate(spark):
    rows = [(h, i % 4 == 0) for h in "abc" for i in range(40)]
    df = spark.createDataFrame(rows, "source string, base_failed boolean")
    assert {round(r.fail_rate, 6) for r in host_verdicts(df).collect()} == {0.25}


def test_empty_table(spark):
    assert judge(brute.docs_of(spark, [])).collect() == []
