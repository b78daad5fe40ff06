"""Log probabilities of texts by deleted interpolation of n-gram estimates.

A word's probability after another mixes the maximum-likelihood estimates of the pair
and of the word alone with a uniform floor. The weights of the mixture depend on how
often the context was seen, in doubling buckets, and are learned by expectation
maximisation on counts of a part of the training texts that the estimates leave out.

Texts are dealt over batches by a hash. A batch asks for each of its distinct words and
pairs once and sends along how often it has them; the task that owns a range of keys
adds up all batches and answers each. So what moves is a batch's distinct keys, packed,
and no task holds more than a range of keys or a batch of texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.cluster import settle
from folioscope.llm.nearest_vote import remainder
from folioscope.llm.text_arrays import distinct, in_small_batches, mix64, slices, words_of

#: UTF-8 bytes of text in a batch, on average, and batches for each range of keys.
BATCH_BYTES = 8_000_000
BATCHES_PER_RANGE = 1
#: Tokens scored at once; one longer text is scored whole.
_RUN = 100_000

_U = np.uint64
_END = mix64(np.array([0xE0D], dtype=np.uint64))
_BEGIN = mix64(np.array([0xBE6], dtype=np.uint64))
#: Bits of a pair's key at least, and those beyond what numbers all pairs: a pair shares
#: its key with another one with a chance of 1e-6. Words keep all 64.
_PAIR_BITS = 48
_SPARE_BITS = 20
_BUCKETS = 64


class _Batch:
    """Tokens of a batch's texts: words and one end each, as places in sorted keys."""

    def __init__(self, parts: list[pa.RecordBatch], pair_bits: int = _PAIR_BITS) -> None:
        tokens, counts = [], []
        for whole in parts:
            for batch in slices(whole, "text"):
                words = words_of(batch.column("text"))
                many = np.diff(words.first)
                tokens.append(np.insert(words.hashes, words.first[1:], _END))
                counts.append(many + 1)
        token = np.concatenate(tokens)
        del tokens
        self.n_tokens = np.concatenate(counts)
        self.begin = np.concatenate([[0], np.cumsum(self.n_tokens)])
        context = np.empty_like(token)
        context[1:] = token[:-1]
        context[self.begin[:-1]] = _BEGIN
        pair = mix64(context * _U(0xD6E8FEB86659FD93) + token) >> _U(64 - pair_bits)
        del context
        # Places in a batch fit 32 bits.
        self.pairs, self.pair_at = distinct(pair)
        del pair
        self.words, self.word_at = distinct(token)
        del token
        self.context_at = np.empty_like(self.word_at)
        self.context_at[1:] = self.word_at[:-1]
        # A text's start is a context seen as often as an end.
        end_at = int(np.searchsorted(self.words, _END[0]))
        self.context_at[self.begin[:-1]] = end_at

    def counts(self, role: np.ndarray) -> list[np.ndarray]:
        """Per word and per pair: occurrences in kept (role 1) and deleted (2) texts."""
        role = np.repeat(role, self.n_tokens)
        return [
            np.bincount(at[role == r], minlength=size)
            for at, size in ((self.word_at, len(self.words)), (self.pair_at, len(self.pairs)))
            for r in (1, 2)
        ]


def _cuts(keys: np.ndarray, bits: int, ranges: int) -> np.ndarray:
    """Where sorted keys cross into the next of `ranges` equal ranges."""
    edges = [(r << bits) // ranges for r in range(1, ranges)]
    inner = np.searchsorted(keys, np.array(edges, dtype=np.uint64))
    return np.concatenate([[0], inner, [len(keys)]]).astype(np.int64)


def _pack(keys: np.ndarray) -> bytes:
    """Sorted keys as steps of 4 bytes, or of the fewest more that hold the largest."""
    steps = np.diff(keys, prepend=_U(0))
    width = max(4, -(-int(steps[1:].max(initial=0)).bit_length() // 8))
    if len(keys) and width < 8:
        low = steps[1:].view(np.uint8).reshape(-1, 8)[:, :width]
        return bytes([width]) + keys[:1].tobytes() + low.tobytes()
    return b"k" + keys.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    if data[:1] == b"k":
        return np.frombuffer(data[1:], dtype=np.uint64)
    low = np.frombuffer(data[9:], dtype=np.uint8).reshape(-1, data[0])
    steps = np.zeros((len(low), 8), dtype=np.uint8)
    steps[:, : data[0]] = low
    first = np.frombuffer(data[1:9], dtype=np.uint64)
    return np.cumsum(np.concatenate([first, steps.reshape(-1).view(np.uint64)]))


def _pack_counts(counts: np.ndarray) -> bytes:
    """Counts in 4 bytes each, or in 8 where the largest needs them."""
    wide = counts.max(initial=0) >= 1 << 32
    return (b"8" if wide else b"4") + counts.astype(np.uint64 if wide else np.uint32).tobytes()


def _unpack_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64 if data[:1] == b"8" else np.uint32, offset=1)


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list]]:
    """Rows with equal `key`, which come one after another."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.asarray(batch.column(key))
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            if held and keys[begin] != last:
                yield int(last), held
                held = []
            last = keys[begin]
            held.append(batch.slice(begin, end - begin))
    if held:
        yield int(last), held


_FIELDS = ("words", "pairs", "word_kept", "word_deleted", "pair_kept", "pair_deleted")
_REQUEST = "batch long, range int, " + ", ".join(f"{f} binary" for f in _FIELDS)
_COUNTS = _FIELDS[2:]
_ANSWER = (
    "batch long, range int, " + ", ".join(f"{f} binary" for f in _COUNTS)
    + ", n_kept long, n_all long, v_kept long, v_all long"
)


def _ask(
    batches: Iterator[pa.RecordBatch], ranges: int, pair_bits: int
) -> Iterator[pa.RecordBatch]:
    for number, parts in _runs(batches, "batch"):
        batch = _Batch(parts, pair_bits)
        role = np.concatenate([np.asarray(p.column("role")) for p in parts])
        counts = batch.counts(role)
        word_cuts = _cuts(batch.words, 64, ranges)
        pair_cuts = _cuts(batch.pairs, pair_bits, ranges)

        def cut(values, cuts, r):
            return values[cuts[r] : cuts[r + 1]]

        rows = {
            "batch": [number] * ranges,
            "range": list(range(ranges)),
            "words": [_pack(cut(batch.words, word_cuts, r)) for r in range(ranges)],
            "pairs": [_pack(cut(batch.pairs, pair_cuts, r)) for r in range(ranges)],
        }
        for name, values in zip(_COUNTS, counts, strict=True):
            cuts = word_cuts if name.startswith("word") else pair_cuts
            rows[name] = [_pack_counts(cut(values, cuts, r)) for r in range(ranges)]
        schema = pa.schema(
            [("batch", pa.int64()), ("range", pa.int32()), *((f, pa.binary()) for f in _FIELDS)]
        )
        yield pa.RecordBatch.from_pydict(rows, schema=schema)


def _numbers(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [_unpack_counts(x) for x in column.to_pylist()]


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up the counts of a range of keys over all batches and answer each batch."""
    for number, parts in _runs(batches, "range"):
        table = pa.Table.from_batches(parts)
        out: dict[str, list] = {"batch": table["batch"].to_pylist()}
        totals = []
        for field, kept, deleted in (
            ("words", "word_kept", "word_deleted"), ("pairs", "pair_kept", "pair_deleted")
        ):
            keys = [_unpack(x) for x in table[field].to_pylist()]
            cuts = np.cumsum([len(k) for k in keys])[:-1]
            joined = np.concatenate(keys)
            del keys
            found, at = distinct(joined)
            del joined
            sums = []
            for name in (kept, deleted):
                counts = np.concatenate(_numbers(table[name]))
                # Sums of whole numbers in doubles are exact far beyond any count here.
                added = np.bincount(at, weights=counts, minlength=len(found))
                del counts
                sums.append(added)
                answer = added.astype(np.uint64)
                out[name] = [_pack_counts(answer[a]) for a in np.split(at, cuts)]
            totals.append(sums)
        kept, both = totals[0][0], totals[0][0] + totals[0][1]
        rows = len(out["batch"])
        sizes = [kept.sum(), both.sum(), (kept > 0).sum(), (both > 0).sum()]
        # The totals of the range go with its first row.
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(out["batch"], pa.int64()),
                pa.array([number] * rows, pa.int32()),
                *(pa.array(out[name], pa.binary()) for name in _COUNTS),
                *(pa.array([int(s), *[0] * (rows - 1)], pa.int64()) for s in sizes),
            ],
            ["batch", "range", *_COUNTS, "n_kept", "n_all", "v_kept", "v_all"],
        )


def _bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + the binary logarithm of its count."""
    return np.where(
        context > 0, 1 + np.floor(np.log2(np.maximum(context, 1))).astype(np.int64), 0
    )


def _answered(parts: list[pa.RecordBatch]) -> tuple[list, list[np.ndarray]]:
    """The texts of a batch and its answers, words and pairs in the order of their keys."""
    texts, answers = [], {}
    for p in parts:
        ranges = p.column("range").to_pylist()
        texts.append(p.filter(pa.array([r is None for r in ranges])))
        for i, r in enumerate(ranges):
            if r is not None:
                answers[r] = [_unpack_counts(p.column(c)[i].as_py()) for c in _COUNTS]
    ranges = sorted(answers)
    # The packed answers of a column go as soon as they are joined.
    return texts, [np.concatenate([answers[r].pop(0) for r in ranges]) for _ in _COUNTS]


def _sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of counts, in 32 bits where all are sure to fit."""
    narrow = int(a.max(initial=0)) + int(b.max(initial=0)) < 1 << 32
    return np.add(a, b, dtype=np.uint32 if narrow else np.uint64)


def _text_runs(begin: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts, from the first to before the last, of up to `most` tokens, or one text."""
    first = 0
    while first < len(begin) - 1:
        last = int(np.searchsorted(begin, begin[first] + most, side="right")) - 1
        last = max(first + 1, last)
        yield first, last
        first = last


def _held_out(batches: Iterator[pa.RecordBatch], pair_bits: int) -> Iterator[pa.RecordBatch]:
    """Occurrences in deleted texts by how often pair, context and word are kept."""
    for _, parts in _runs(batches, "batch"):
        texts, (word_kept, _, pair_kept, _) = _answered(parts)
        batch = _Batch(texts, pair_bits)
        rows = np.stack(
            [pair_kept[batch.pair_at], word_kept[batch.context_at], word_kept[batch.word_at]],
            axis=1,
        ).astype(np.int64)
        rows, n = np.unique(rows, axis=0, return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(rows[:, k]) for k in range(3)), pa.array(n.astype(np.int64))],
            ["pair", "context", "word", "n"],
        )


def _score(
    batches: Iterator[pa.RecordBatch], totals: dict, mix: np.ndarray, pair_bits: int
):
    n, v = totals["n_all"], totals["v_all"]
    for _, parts in _runs(batches, "batch"):
        texts, counts = _answered(parts)
        parts.clear()  # the answers are unpacked
        word, pair = _sum(*counts[:2]), _sum(*counts[2:])
        del counts
        batch = _Batch(texts, pair_bits)
        ids = pa.concat_arrays([p.column("doc_id") for p in texts])
        for first, last in _text_runs(batch.begin, _RUN):
            tokens = slice(int(batch.begin[first]), int(batch.begin[last]))
            c = word[batch.word_at[tokens]].astype(np.float64)
            context = word[batch.context_at[tokens]].astype(np.float64)
            weight = mix[_bucket(context)]
            chance = (
                weight[:, 0] * pair[batch.pair_at[tokens]] / np.maximum(context, 1)
                + weight[:, 1] * c / max(n, 1)
                + weight[:, 2] / (v + 1)
            )
            begin = batch.begin[first:last] - batch.begin[first]
            base = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
            yield pa.RecordBatch.from_arrays(
                [
                    ids[first:last],
                    pa.array(batch.n_tokens[first:last].astype(np.int64)),
                    pa.array(np.add.reduceat((c > 0).astype(np.int64), begin)),
                    pa.array(np.add.reduceat(base, begin)),
                    pa.array(np.add.reduceat(np.log10(chance), begin)),
                ],
                ["doc_id", "n_tokens", "n_known", "base_score", "score"],
            )


def learn_mixture(items: DataFrame, totals: dict, rounds: int = 40) -> np.ndarray:
    """Weights of pair, word and floor for each context bucket, by expectation maximisation.

    `items`: `pair`, `context`, `word` kept counts and `n` held-out occurrences. Each
    round adds up the shares of the three in all occurrences; only the sums of the
    buckets come to the driver. A bucket without occurrences has even weights; an
    unseen context has no pair estimate.
    """
    mix = np.full((_BUCKETS, 3), 1 / 3)
    mix[0] = [0, 0.5, 0.5]
    bucket = F.when(
        F.col("context") > 0, F.floor(F.log2("context")).cast("int") + 1
    ).otherwise(F.lit(0))
    prepared = settle(
        items.groupBy("pair", "context", "word").agg(F.sum("n").alias("n")).select(
            bucket.alias("bucket"),
            F.when(F.col("context") > 0, F.col("pair") / F.col("context")).otherwise(0.0).alias("p"),
            (F.col("word") / F.lit(float(max(totals["n_kept"], 1)))).alias("w"),
            "n",
        )
    )
    floor = 1.0 / (totals["v_kept"] + 1)
    for _ in range(rounds):
        weights = [
            F.element_at(F.array(*(F.lit(float(x)) for x in mix[:, k])), F.col("bucket") + 1)
            for k in range(3)
        ]
        shares = prepared.select(
            "bucket", "n",
            (weights[0] * F.col("p")).alias("a"),
            (weights[1] * F.col("w")).alias("b"),
            (weights[2] * F.lit(floor)).alias("c"),
        ).withColumn("all", F.col("a") + F.col("b") + F.col("c"))
        sums = shares.groupBy("bucket").agg(
            *(F.sum(F.col("n") * F.col(x) / F.col("all")).alias(x) for x in "abc")
        ).collect()
        new = mix.copy()
        for row in sums:
            total = row["a"] + row["b"] + row["c"]
            new[row["bucket"]] = [row["a"] / total, row["b"] / total, row["c"] / total]
        # The floor never vanishes, so every text has a probability.
        new[:, 2] = np.maximum(new[:, 2], 1e-6)
        new /= new.sum(axis=1, keepdims=True)
        change = np.abs(new - mix).max()
        mix = new
        if change < 1e-4:
            break
    return mix


def pair_bits_for(size: int, rows: int) -> int:
    """Bits of pair keys for `rows` texts of `size` bytes: a word takes two, each has an end."""
    tokens = (size + rows) // 2 + rows
    return min(64, max(_PAIR_BITS, tokens.bit_length() + _SPARE_BITS))


def score_texts(docs: DataFrame, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """`doc_id`, `held_out`, `n_tokens`, `n_known`, `train_tokens`, `base_score`, `score`.

    Tokens are the words of the text (A-Z lower-cased) and one end. Texts with
    `remainder` 0 of 10 are held out from all counts; those with 1 are deleted from the
    counts from which the mixture weights are learned, and counted for the scores. A
    null or empty text is an end alone. A row without an id is scored and not learnt
    from. Repeated rows count each; an empty table gives no rows; other columns are left
    out. `score` is the log10 probability of the text.
    """
    text = F.coalesce("text", F.lit(""))
    fold = remainder("doc_id", 10)
    role = F.when(fold > 1, 1).when(fold == 1, 2).otherwise(0).cast("int")
    known = in_small_batches(docs).select("doc_id", text.alias("text"), role.alias("role"))
    size, rows = known.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    size = size or 0
    pair_bits = pair_bits_for(size, rows)
    count = max(1, math.ceil(size / batch_bytes))
    ranges = max(1, math.ceil(count / BATCHES_PER_RANGE))
    # Deleted texts, a tenth, have batches of their own: the mixture needs only those.
    deleted = math.ceil(count / 10)
    hashed = F.xxhash64("doc_id", "text")
    batch = F.when(F.col("role") == 2, F.pmod(hashed, F.lit(deleted)) + count).otherwise(
        F.pmod(hashed, F.lit(count))
    )
    placed = known.withColumn("batch", batch)
    asked = (
        placed.repartition(count, "batch")
        .sortWithinPartitions("batch")
        .mapInArrow(lambda it: _ask(it, ranges, pair_bits), _REQUEST)
    )
    answers = settle(
        asked.repartition(ranges, "range").sortWithinPartitions("range").mapInArrow(_answer, _ANSWER)
    )
    sums = ("n_kept", "n_all", "v_kept", "v_all")
    totals = {k: v or 0 for k, v in answers.agg(*(F.sum(s).alias(s) for s in sums)).first().asDict().items()}

    def meet(texts: DataFrame, answers: DataFrame) -> DataFrame:
        """Answers and texts of each batch, one after the other."""
        empty = [F.lit(None).cast("binary").alias(c) for c in _COUNTS]
        left = texts.select(
            "batch", F.lit(None).cast("int").alias("range"), *empty, "doc_id", "text", "role"
        )
        right = answers.select(
            "batch", "range", *_COUNTS, F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"),
            F.lit(None).cast("string").alias("text"), F.lit(None).cast("int").alias("role"),
        )
        return left.unionByName(right).repartition(count, "batch").sortWithinPartitions("batch")

    items = meet(placed.where("role = 2"), answers.where(F.col("batch") >= count)).mapInArrow(
        lambda it: _held_out(it, pair_bits), "pair long, context long, word long, n long"
    )
    mix = learn_mixture(items, totals)
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = meet(placed, answers).mapInArrow(
        lambda it: _score(it, totals, mix, pair_bits),
        f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double",
    )
    return scored.select(
        "doc_id",
        F.coalesce(remainder("doc_id", 10) == 0, F.lit(False)).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(totals["n_all"]).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
