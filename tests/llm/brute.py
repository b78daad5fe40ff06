"""Plain versions of what the operators compute, for small tables."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text, lower=False):
    text = text or ""
    return WORD.findall(text.translate(_LOWER) if lower else text)


def docs_of(spark, texts, sources=None, ids=None):
    """A documents table with two columns more, whose names operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    rows = [
        (i, t, "en", s, None if t is None else len(t), "extra", 1.0)
        for i, t, s in zip(ids, texts, sources or ["s"] * len(texts), strict=True)
    ]
    return spark.createDataFrame(rows, f"{DOC_SCHEMA}, size string, score double")


def shingles(text, size=5):
    w = words(text, lower=True)
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def components(ids, links):
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for i in sorted(ids):
        if i in out:
            continue
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = i
                todo += near[x]
    return out


def near_duplicates(texts):
    """Component of each id of a dict of texts."""
    sets = {i: shingles(t) for i, t in texts.items()}
    links = [
        (i, j)
        for i, j in combinations(sorted(sets), 2)
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    ]
    return components(sets, links)


def repeat_words(text):
    w = words(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if seen[x] > 1 for k in range(5)}
    return len(covered)


def fold(key, of):
    return zlib.crc32(str(key).encode()) % of
