from __future__ import annotations

import numpy as np

from folioscope.llm import embedding_lsh
from folioscope.llm.embedding_lsh import link_vectors, plan_tables

from . import brute

SCHEMA = "vec_id long, embedding array<float>, label int, unit string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


def clusters():
    r = np.random.default_rng(2)
    rows, number = [], 0
    for label in (0, 1, None):
        for _ in range(12):
            centre = r.standard_normal(16)
            for noise in (0, 0.05, 0.15, 0.25, 0.3):
                v = (centre + noise * r.standard_normal(16)).astype(np.float32)
                rows.append((number, [float(x) for x in v], label))
                number += 1
    rows.append((number, [2 * x for x in rows[0][1]], 0))  # the same direction
    rows.append((number + 1, rows[3][1], 0))  # an equal vector
    return rows


def expected(rows):
    links, count = [], dict.fromkeys((r[0] for r in rows), 0)
    for i, (a, x, p) in enumerate(rows):
        for b, y, q in rows[i + 1 :]:
            if p is None or p != q:
                continue
            x_, y_ = np.array(x, float), np.array(y, float)
            if x_ @ y_ / np.sqrt((x_ @ x_) * (y_ @ y_)) >= 0.93:
                links.append((a, b))
                count[a] += 1
                count[b] += 1
    return count, brute.components(count, links)


def check(df, rows):
    count, component = expected(rows)
    got = df.collect()
    assert {r.vec_id: r.n_links for r in got} == count
    assert {r.vec_id: r.component_id for r in got} == component
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_equals_all_pairs(spark):
    rows = clusters()
    check(link_vectors(table(spark, rows)), rows)


def test_blocks_of_a_large_bucket(spark):
    rows = clusters()
    check(link_vectors(table(spark, rows), block=7), rows)


def test_several_tables_count_a_link_once(spark, monkeypatch):
    monkeypatch.setattr(embedding_lsh, "plan_tables", lambda *_: (3, 25))
    rows = clusters()
    check(link_vectors(table(spark, rows)), rows)


def test_vectors_that_link_with_nothing(spark):
    bad = [
        None, [], [0.0, 0.0], [None, 1.0], [float("nan"), 1.0], [float("inf"), 1.0],
    ]
    rows = [(i, v, 1) for i, v in enumerate([*bad, *bad])]
    rows += [(20, [1.0, 0.0], 1), (21, [1.0, 0.001], 1), (22, [1e30, 1e-30], 1), (23, [1.0, 0.0], None)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in link_vectors(table(spark, rows)).collect()}
    assert all(got[i] == (0, i) for i in range(12))
    assert got[20] == (2, 20) and got[21] == (2, 20) and got[22] == (2, 20)
    assert got[23] == (0, 23)
    nameless = link_vectors(table(spark, [(None, [1.0], 1), (1, [1.0], 1)])).collect()
    assert sorted((r.vec_id is None, r.n_links, r.kept) for r in nameless) == [
        (False, 0, True), (True, 0, True),
    ]


def test_no_usable_vector(spark):
    assert link_vectors(table(spark, [])).collect() == []
    assert [r.component_id for r in link_vectors(table(spark, [(4, None, 1)])).collect()] == [4]


def test_tables_reach_the_wanted_recall():
    for rows in (10, 10_000, 10**9):
        bits, tables = plan_tables(rows, 0.93, 1e-4)
        agree = (1 - np.arccos(0.93) / np.pi) ** bits
        assert (1 - agree) ** tables <= 1e-4


def test_every_length_is_compared(spark):
    rows = clusters()
    short = [(1_000 + i, v[:5], p) for i, v, p in rows[:40]]
    both = {r.vec_id: tuple(r) for r in link_vectors(table(spark, [*rows, *short])).collect()}
    alone = [*link_vectors(table(spark, rows)).collect(), *link_vectors(table(spark, short)).collect()]
    assert both == {r.vec_id: tuple(r) for r in alone}
    count, _ = expected(short)
    assert {i: both[i][1] for i in count} == count and max(count.values()) > 0
