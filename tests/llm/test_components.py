from __future__ import annotations

import random

from folioscope.llm.components import connected_components

from . import brute


def test_equals_search(spark):
    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(180)]
    links += [(i, i + 1) for i in range(1_000, 1_060)]  # a long chain
    links += [(5_000, i) for i in range(5_001, 5_050)] * 2  # a hub, twice
    df = spark.createDataFrame([*links, (None, 4), (4, None)], "a long, b long")
    got = {x.id: x.component for x in connected_components(df, "a", "b").collect()}
    ids = {x for pair in links if pair[0] != pair[1] for x in pair}
    expected = brute.components(ids, links)
    assert got == {i: expected[i] for i in ids}


def test_no_links(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []
