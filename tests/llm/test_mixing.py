from __future__ import annotations

import random
import re

import pytest

from folioscope.llm.mixing import mix_counts, mix_shards, mix_texts, plan_mix

from tests.conftest import plan_of

from . import brute


def corpus():
    r = random.Random(3)
    texts, sources = [], []
    for source, n in (("a", 40), ("b", 30), ("c", 25), ("d", 2), (None, 5)):
        for _ in range(n):
            texts.append("\t ".join(f"{source}{r.randrange(10**6)}" for _ in range(r.randint(0, 90))))
            sources.append(source)
    return [*texts, None, ""], [*sources, "a", None]


def targets(sizes):
    """Shares by weight, capped at twice the size, the excess shared again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total = 1.5 * sum(sizes.values())
    capped = {}
    while True:
        free = [s for s in names if s not in capped]
        if not free:
            return capped
        level = (total - sum(capped.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            return capped | {s: level * weight[s] for s in free}
        capped |= {s: 2.0 * sizes[s] for s in over}


@pytest.mark.parametrize("block", [16, 256])
def test_counts(spark, block):
    texts, sources = corpus()
    docs = brute.docs_of(spark, texts, sources)
    got = mix_counts(docs, block=block).collect()
    assert len(got) == len(texts)
    size = {i: len(brute.words(t)) for i, t in enumerate(texts)}
    by_source = {}
    for i, s in enumerate(sources):
        by_source[s] = by_source.get(s, 0) + size[i]
    wanted = targets(by_source)
    taken = dict.fromkeys(by_source, 0)
    for r in got:
        s = sources[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], by_source[s])
        assert r.target == pytest.approx(wanted[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - wanted[s]) <= 1 for s in wanted)
    again = mix_counts(docs.repartition(3), block=block).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_texts_hold_what_is_counted(spark):
    texts, sources = corpus()
    docs = brute.docs_of(spark, texts, sources)
    taken = {r.doc_id: r.taken for r in mix_counts(docs, block=16).collect()}
    mixed = mix_texts(docs, block=16)
    assert mixed.columns == docs.columns
    found = dict.fromkeys(taken, 0)
    for r in mixed.collect():
        own = brute.words(texts[r.doc_id])
        new = brute.words(r.text)
        rest = iter(own)
        assert all(w in rest for w in new)  # in the text's order
        assert r.text == texts[r.doc_id] or len(new) < len(own)
        assert r.n_chars == len(r.text)
        found[r.doc_id] += len(new)
    assert found == taken


def test_what_grows_with_the_words_is_not_broadcast(spark):
    docs = brute.docs_of(spark, *corpus())
    for mixed in (mix_counts(docs), mix_texts(docs)):
        plan = plan_of(mixed)
        # Sums of shuffle partitions and the table of sources may be; slots may not.
        assert "SortMergeJoin" in plan
        for side in re.findall(r"BroadcastExchange.*?(?=\n\S|\Z)", plan, re.S):
            assert "pass_no" not in side.split("\n")[0]


def test_repeated_and_nameless_rows(spark):
    docs = brute.docs_of(spark, ["x y z"] * 3 + ["q r"], ids=[1, 1, None, None])
    counts = mix_counts(docs).collect()
    assert len(counts) == 4 and sum(r.taken for r in counts) in (16, 17)
    assert {r.text for r in mix_texts(docs).collect()} <= {"x y z", "x y", "x", "q r", "q", "y z", "z", "r"}


def test_empty_tables(spark):
    for texts in ([], [None, ""]):
        docs = brute.docs_of(spark, texts)
        got = mix_counts(docs).collect()
        assert [(r.size, r.taken, r.target) for r in got] == [(0, 0, 0.0)] * len(texts)
        assert mix_texts(docs).collect() == []


def test_shards_hold_the_mix_in_blocks(spark):
    """Each slot once, whole words of its source's stream, as many as are counted."""
    texts, sources = corpus()
    docs = brute.docs_of(spark, texts, sources)
    rows = mix_shards(docs, block=16, shards=5).collect()
    assert len({(r.source, r.pass_no, r.block_no) for r in rows}) == len(rows)
    assert all(r.n_words == len(r.text.split(" ")) <= 16 for r in rows)
    assert {r.shard for r in rows} <= set(range(5)) and len({r.place for r in rows}) == len(rows)
    words = {}
    for text, source in zip(texts, sources, strict=True):
        words.setdefault(source, set()).update(brute.words(text))
    assert all(set(r.text.split(" ")) <= words[r.source] for r in rows)
    taken = sum(r.taken for r in mix_counts(docs, block=16).collect())
    assert sum(r.n_words for r in rows) == taken
    again = mix_shards(docs.repartition(4), block=16, shards=5).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))
    assert mix_shards(docs.limit(0)).count() == 0


def test_source_counts_of_shards_are_multinomial(spark):
    """Against equal chances of all shards for each source's slots, by chi-square."""
    texts = [" ".join(f"{s}{k}" for k in range(4_000)) for s in "ab" for _ in range(4)]
    docs = brute.docs_of(spark, texts, [t[0] for t in texts])
    _, _, slots = plan_mix(docs, block=8, shards=10)
    counts = slots.groupBy("source_rank", "shard").count().collect()
    for rank in (0, 1):
        own = [r["count"] for r in counts if r.source_rank == rank]
        even = sum(own) / 10
        chi = sum((n - even) ** 2 / even for n in own)
        assert len(own) == 10 and sum(own) > 1_000
        assert 1.2 < chi < 28  # 9 degrees: 0.1 % on either side


def test_columns_of_any_name(spark):
    docs = brute.docs_of(spark, ["x y z", "q r"], ids=[1, 2])
    for name in ("_text_key", "_words", "_id", "_own", "_row", "_new", "_taken"):
        docs = docs.withColumn(name, docs.doc_id * 10)
    mixed = mix_texts(docs)
    assert mixed.columns == docs.columns
    for r in mixed.collect():
        assert {r[c] for c in docs.columns if c[0] == "_"} == {r.doc_id * 10}
