"""Spelling variants: words one edit apart, by dynamic programming over sorted lists.

Two words one edit apart share the first half of the shorter one's length or the rest of
it at the end. So words are dealt to blocks by their first half, and, reversed, by their
last half. In a block the words are sorted, and each is compared with all others by the
rows of the banded edit matrix. Words with a common prefix lie in one range of the sorted
list, bounded by the adjacent longest common prefixes, and share the rows of that prefix;
a range whose row holds nothing below two is skipped whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.cluster import settle

#: Letters of words, and the shortest word.
LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH = 7
LEAST_COUNT = 2
#: A form occurs at least this many times as often.
RATIO = 10
#: Words of a block that one task compares with one another; larger blocks are dealt in parts.
BLOCK = 100_000
#: Rows and bytes of whole blocks worked on at once, and words that ask at once.
_ROWS = 50_000
_BYTES = 16 << 20
_ASKING = 50_000
#: Words from this width on, in lists of at most so many, are compared one by one.
_LONG = 128
_FEW = 32
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FAR = 2

_NEAR = "word string, n_near long, best_n long, best string"


def _dropped(word: Column, doc_id: Column) -> Column:
    """`word` without the code point that its hash names, where 31 divides the hash."""
    hashed = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word))
    at = (hashed % F.length(word)).cast("int")
    cut = F.concat(F.substr(word, F.lit(1), at), F.substr(word, at + 2))
    return F.when(hashed % 31 == 0, cut).otherwise(word)


def vocabulary(docs: DataFrame) -> DataFrame:
    """`word` and `n`: words of at least 7 letters that occur at least twice.

    Words are maximal runs of letters with A-Z lower-cased; where 31 divides the crc32 of
    `doc_id:word`, one letter is left out (a misspelling put in). Repeated documents count
    each; a null text has no words and a null doc_id an empty name. Counts are combined
    before they are shuffled, so a frequent word is one row of each task.
    """
    runs = F.regexp_extract_all(F.col("text"), F.lit(f"([{LETTERS}]{{{LEAST_LENGTH},}})"))
    word = F.translate("run", _UPPER, _UPPER.lower())
    return (
        docs.select("doc_id", F.explode(runs).alias("run"))
        .select("doc_id", word.alias("run"))
        .select(_dropped(F.col("run"), F.col("doc_id")).alias("word"))
        .where(F.length("word") >= LEAST_LENGTH)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= LEAST_COUNT)
    )


def _dealt(words: DataFrame) -> DataFrame:
    """Four rows a word: `least` (length of the shorter word), `back`, `key`, `spelt`, `n`."""
    length = F.length("word")
    each = F.explode(
        F.array(
            *(
                F.struct((length - less).alias("least"), F.lit(back).alias("back"))
                for less in (0, 1)
                for back in (False, True)
            )
        )
    )
    half = F.floor(F.col("least") / 2).cast("int")
    shared = F.when(F.col("back"), F.col("least") - half).otherwise(half)
    spelt = F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word"))
    return (
        words.select("word", "n", each.alias("e"))
        .select("n", "e.least", "e.back", "word")
        .where(F.col("least") >= LEAST_LENGTH)
        .select("least", "back", spelt.alias("spelt"), "n", shared.alias("shared"))
        .select("least", "back", F.substr("spelt", F.lit(1), F.col("shared")).alias("key"), "spelt", "n")
    )


def _parts(dealt: DataFrame, block: int) -> DataFrame:
    """`dealt` with `part`, and whether the row is in the part's list and asks there.

    A block of more than `block` words is cut into k lists and k sets of asking words,
    each list meeting each set in a part of its own; other blocks are one part.
    """
    large = (
        dealt.groupBy("least", "back", "key")
        .agg(F.count(F.lit(1)).alias("size"))
        .where(F.col("size") > block)
        .select("least", "back", "key", F.ceil(F.col("size") / block).cast("int").alias("k"))
    )
    joined = dealt.join(large, ["least", "back", "key"], "left").withColumn(
        "own", F.pmod(F.xxhash64("spelt"), F.coalesce("k", F.lit(1))).cast("int")
    )
    k = F.coalesce("k", F.lit(1))
    return (
        joined.withColumn("part", F.explode(F.sequence(F.lit(0), k * k - 1)))
        .withColumn("lists", F.floor(F.col("part") / k) == F.col("own"))
        .withColumn("asks", F.col("part") % k == F.col("own"))
        .where("lists or asks")
        .select("least", "back", "key", "part", "spelt", "n", "lists", "asks")
    )


def _one_edit(a: bytes, b: bytes) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    short = min(len(a), len(b))
    x, y = (np.frombuffer(w, dtype=np.uint8, count=short) for w in (a, b))
    differ = x != y
    p = int(differ.argmax()) if differ.any() else short
    return a[p + (len(a) >= len(b)) :] == b[p + (len(b) >= len(a)) :]


def _next_rows(letters, lengths, q, c, d, before, here, after) -> tuple[np.ndarray, ...]:
    """The band after letter `c` of the range (its d-th, from 0), for each pair."""
    length = lengths[q]

    def differs(j: int) -> np.ndarray:
        return letters[q, min(max(j, 0), letters.shape[1] - 1)] != c

    one = np.minimum(here + 1, before + differs(d - 1))
    two = np.minimum(np.minimum(here + differs(d), after + 1), one + 1)
    three = np.minimum(after + differs(d + 1), two + 1)
    one = np.where(d <= length, one, _FAR)
    two = np.where(d + 1 <= length, two, _FAR)
    three = np.where(d + 2 <= length, three, _FAR)
    return tuple(np.minimum(v, _FAR).astype(np.int8) for v in (one, two, three))


def near_pairs(
    words: list[bytes], shared: np.ndarray, block: np.ndarray, lists: np.ndarray, asks: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j): word i asks, word j is in the list of the same block, one edit apart.

    The words come by block and then sorted, and those of a block share `shared` letters.
    Ranges of the lists are followed letter by letter. A pair of a word i and a range
    keeps the three values of the matrix row on the band: the edits from the range's
    prefix of d letters to the first d - 1, d and d + 1 letters of word i. It starts where
    all letters so far are shared, and ends when none of the three is below two.
    """
    listed = np.flatnonzero(lists)
    lengths = np.array([len(w) for w in words])
    width = int(lengths.max(initial=0)) + 2
    # Where each block's list begins and ends, for the words that ask.
    asking = np.flatnonzero(asks)
    low = np.searchsorted(block[listed], block[asking], side="left")
    high = np.searchsorted(block[listed], block[asking], side="right")
    # A word alone with itself has nothing to be compared with.
    some = high - low > lists[asking]
    asking, low, high = asking[some], low[some], high[some]
    found_i, found_j = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    if width > _LONG:
        few = high - low <= _FEW
        for i, a, b in zip(asking[few].tolist(), low[few].tolist(), high[few].tolist(), strict=True):
            js = [j for j in listed[a:b].tolist() if _one_edit(words[i], words[j])]
            found_i.append(np.full(len(js), i))
            found_j.append(np.array(js, dtype=np.int64))
        asking, low, high = asking[~few], low[~few], high[~few]
    if not len(asking):
        return np.concatenate(found_i), np.concatenate(found_j)
    letters = np.array(words, dtype=f"S{width}").view(np.uint8).reshape(len(words), width)
    row, size = letters[listed], lengths[listed]
    # lcp[k]: letters that listed words k - 1 and k share; none where a list begins.
    lcp = np.full(len(listed), -1)
    differ = row[1:] != row[:-1]
    alike = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    lcp[1:] = np.where(block[listed][1:] == block[listed][:-1], alike, -1)
    borders_at = [np.flatnonzero(lcp == d) for d in range(width)]
    for first in range(0, len(asking), _ASKING):
        now = slice(first, first + _ASKING)
        q, lo, hi = asking[now], low[now], high[now]
        waiting: dict[int, list[tuple]] = {}
        for d in np.unique(shared[q]).tolist():
            at = shared[q] == d
            one = np.ones(int(at.sum()), dtype=np.int8)
            waiting[d] = [(q[at], lo[at], hi[at], one, 0 * one, one)]
        while waiting:
            d = min(waiting)
            q, lo, hi, *band = (np.concatenate(x) for x in zip(*waiting.pop(d), strict=True))
            # A word that ends here comes first in its range.
            ends = size[lo] == d
            gap = lengths[q] - d
            left = np.select([gap == -1, gap == 0, gap == 1], band, _FAR)
            hit = ends & (left == 1)
            found_i.append(q[hit])
            found_j.append(listed[lo[hit]])
            lo = lo + ends
            open_ = lo < hi
            q, lo, hi, *band = (x[open_] for x in (q, lo, hi, *band))
            # The range parts where adjacent words share exactly d letters.
            borders = borders_at[d]
            a = np.searchsorted(borders, lo, side="right")
            kids = np.searchsorted(borders, hi, side="left") - a + 1
            of = np.repeat(np.arange(len(q)), kids)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(kids) - kids, kids)
            begin, end = lo[of], hi[of]
            later, earlier = nth > 0, nth < kids[of] - 1
            begin[later] = borders[a[of[later]] + nth[later] - 1]
            end[earlier] = borders[a[of[earlier]] + nth[earlier]]
            q = q[of]
            band = _next_rows(letters, lengths, q, row[begin, d], d, *(x[of] for x in band))
            keep = np.minimum(np.minimum(band[0], band[1]), band[2]) < _FAR
            if keep.any():
                step = tuple(x[keep] for x in (q, begin, end, *band))
                waiting.setdefault(d + 1, []).append(step)
    return np.concatenate(found_i), np.concatenate(found_j)


def _near(table: pa.Table) -> pa.RecordBatch:
    """For each asking word of whole blocks: its near words in the lists, and the best of them."""
    column = {c: table.column(c).combine_chunks() for c in table.column_names}
    n = table.num_rows
    new = np.zeros(n, dtype=np.int64)
    for c in ("least", "back", "key", "part"):
        new[1:] |= np.asarray(pc.not_equal(column[c][1:], column[c][:-1]).cast(pa.int8()))
    least = np.asarray(column["least"]).astype(np.int64)
    flags = {c: np.asarray(column[c].cast(pa.int8())) > 0 for c in ("back", "lists", "asks")}
    back, half = flags["back"], least // 2
    words = [w.encode("latin-1") for w in column["spelt"].to_pylist()]
    shared = np.where(back, least - half, half)
    i, j = near_pairs(words, shared, np.cumsum(new), flags["lists"], flags["asks"])
    length = np.array([len(w) for w in words])
    # Of two words of the longer length, the block of that length tells.
    keep = np.minimum(length[i], length[j]) == least[i]
    i, j = i[keep], j[keep]
    # A pair that shares both halves is one of the first halves' blocks alone.
    keep = [
        not turned or words[a][-h:] != words[b][-h:]
        for a, b, turned, h in zip(i.tolist(), j.tolist(), back[i], half[i].tolist(), strict=True)
    ]
    i, j = i[keep], j[keep]
    plain = [w[::-1] if turned else w for w, turned in zip(words, back, strict=True)]
    counts = np.asarray(column["n"])
    names = sorted({plain[b] for b in j.tolist()})
    place = {w: k for k, w in enumerate(names)}
    order = np.lexsort(([place[plain[b]] for b in j.tolist()], -counts[j], i))
    i, j = i[order], j[order]
    first = np.flatnonzero(np.diff(i, prepend=-1))
    number = np.diff(np.append(first, len(i)))

    def texts(places: np.ndarray) -> pa.Array:
        return pa.array([plain[k].decode("latin-1") for k in places.tolist()], pa.string())

    return pa.RecordBatch.from_arrays(
        [texts(i[first]), pa.array(number, pa.int64()), pa.array(counts[j[first]]), texts(j[first])],
        names=["word", "n_near", "best_n", "best"],
    )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts the sorted rows between blocks, at about `_ROWS` rows or `_BYTES` bytes."""
    names = ("least", "back", "key", "part")
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for whole in batches:
        for begin in range(0, whole.num_rows, _ROWS):
            batch = whole.slice(begin, _ROWS)
            held.append(batch)
            rows += batch.num_rows
            size += batch.nbytes
            if rows < _ROWS and size < _BYTES:
                continue
            table = pa.Table.from_batches(held)
            last = [table.column(c)[rows - 1].as_py() for c in names]
            goes_on = np.ones(rows, dtype=bool)
            for c, value in zip(names, last, strict=True):
                goes_on &= np.asarray(pc.equal(table.column(c), value))
            cut = int(goes_on.argmax())
            if cut:
                yield from _by_length(table.slice(0, cut))
                rest = table.slice(cut).combine_chunks()
                held, rows, size = rest.to_batches(), rest.num_rows, rest.nbytes
    if rows:
        yield from _by_length(pa.Table.from_batches(held))


def _by_length(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Very long words go by their length, so that short ones are not padded to it."""
    least = np.asarray(table.column("least"))
    begin = 0
    while begin < len(least):
        end = int(np.searchsorted(least, max(least[begin], _LONG - 2), side="right"))
        yield _near(table.slice(begin, end - begin))
        begin = end


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """`word`, `n_near`, `best`, `best_n`: of the words of `words` (`word`, `n`, distinct).

    Words without a near word have no row. `best` is the near word of the largest n, of
    these the smallest in code-point order. Each pair meets in one block, or in one part
    of it.
    """
    found = (
        _parts(_dealt(words), block)
        .repartition("least", "back", "key", "part")
        .sortWithinPartitions("least", "back", "key", "part", "spelt")
        .mapInArrow(_blocks, _NEAR)
    )
    least = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), least.alias("b")).select(
        "word", "n_near", F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n")
    )


def _roots(forms: DataFrame) -> DataFrame:
    """`word`, `root` of words with a form: chains are doubled until they end.

    A form occurs ten times as often, so a chain has at most as many links as the largest
    count has digits.
    """
    now = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = settle(
            now.join(on, "root", "left").select(
                "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
            )
        )
        now = after.select("word", "root")
        if after.where("moved").isEmpty():
            return now


def group_spellings(docs: DataFrame, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """`word`, `form`, `root`, `n`, `n_near`, `form_n`: one row per word of `vocabulary`.

    `form` is the near word of the largest n (ties: the smallest), where that is at least
    `ratio` times the word's n, else null, and `form_n` its n. `root` is where following
    forms ends. Words as near to a frequent word as to each other fall to that word. No
    documents or no words give no rows; columns other than `doc_id` and `text` are left out.
    """
    words = settle(vocabulary(docs.select("doc_id", "text")))
    near = near_words(words, block)
    formed = F.col("best_n") >= ratio * F.col("n")
    judged = settle(
        words.join(near, "word", "left").select(
            "word", "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(formed, F.col("best")).alias("form"),
            F.when(formed, F.col("best_n")).alias("form_n"),
        )
    )
    roots = _roots(judged.where(F.col("form").isNotNull()))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
