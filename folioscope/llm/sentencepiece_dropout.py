"""SentencePiece byte-pair encoding with seeded merge-dropout, and lossless decoding."""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.text_arrays import in_small_batches, mix64, slices, string_bytes

#: What SentencePiece writes for a space.
MARK = "▁"
#: Words with more symbols are merged one by one with a heap.
LONG_WORD = 64
#: Bytes of text encoded at once, each some 120 bytes of work; pieces decoded at once.
#: One longer text is worked on whole.
_ENCODE_BYTES = 125_000
_DECODE_PIECES = 50_000

_U = np.uint64
_MASK = (1 << 64) - 1
_NONE = np.int64(2**62)
_START, _MIDDLE, _END = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9


@dataclass(frozen=True)
class Pairs:
    """`get` of a dictionary from (left, right) to the piece they make, by hash table."""

    size: int
    slots: np.ndarray
    merged: np.ndarray
    factor: int

    def get(self, pair: tuple[int, int]) -> int | None:
        left, right = int(pair[0]), int(pair[1])
        if left < 0 or right < 0:
            return None
        last = len(self.slots) - 1
        key = left * self.size + right
        at = (key * self.factor & _MASK) >> (64 - last.bit_length())
        while (found := self.slots.item(at)) >= 0:
            if found == key:
                return self.merged.item(at)
            at = (at + 1) & last
        return None


@dataclass(frozen=True)
class Vocabulary:
    """A SentencePiece byte-pair model as arrays.

    `char_id`: piece of each code point, -1 if its bytes are used. `slots` and
    `merged`: hash table of pair (left * size + right) to the piece they make.
    `priority`: place of a piece in merge order. `bytes_of`/`start`: decoded bytes.
    """

    size: int
    char_id: np.ndarray
    slots: np.ndarray
    merged: np.ndarray
    factor: int
    priority: np.ndarray
    first_byte: int
    data: np.ndarray
    start: np.ndarray

    @property
    def pairs(self) -> Pairs:
        """The piece of single pairs; a dictionary would take more than all else here."""
        return Pairs(self.size, self.slots, self.merged, self.factor)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, or -1."""
        key = left * self.size + right
        bits = len(self.slots).bit_length() - 1
        at = ((key.astype(np.uint64) * _U(self.factor)) >> _U(64 - bits)).astype(np.int64)
        found = self.slots[at]
        out = np.where(found == key, self.merged[at], -1)
        # Few keys meet another one in their slot and look on.
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.slots) - 1)
            found, wanted = self.slots[at[open_]], key[open_]
            hit = found == wanted
            out[open_[hit]] = self.merged[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


@functools.lru_cache(maxsize=2)
def load(model_file: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    size = model.get_piece_size()
    special = {
        i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)
    }
    text = [model.id_to_piece(i) for i in range(size)]
    pieces = {p: i for i, p in enumerate(text) if i not in special}
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("a piece spans words")
    char_id = np.full(0x110000, -1, dtype=np.int64)
    for p, i in pieces.items():
        if len(p) == 1:
            char_id[ord(p)] = i
    if any(char_id[ord(c)] < 0 for p in pieces for c in p):
        raise ValueError("a character of a piece is no piece")
    pairs = {
        (pieces[p[:k]], pieces[p[k:]]): i
        for p, i in pieces.items()
        for k in range(1, len(p))
        if p[:k] in pieces and p[k:] in pieces
    }
    # Higher scores merge first.
    order = sorted(range(size), key=lambda i: (-model.get_score(i), i))
    priority = np.zeros(size, dtype=np.int64)
    priority[order] = np.arange(size)
    bits = max(4, (4 * len(pairs)).bit_length())
    slots, merged = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
    factor = 0x9E3779B97F4A7C15
    for (a, b), i in pairs.items():
        at = ((a * size + b) * factor & _MASK) >> (64 - bits)
        while slots[at] >= 0:
            at = (at + 1) & ((1 << bits) - 1)
        slots[at], merged[at] = a * size + b, i
    first_byte = model.piece_to_id("<0x00>")
    decoded = [
        b""
        if model.is_control(i) or model.is_unknown(i)
        else bytes([i - first_byte])
        if model.is_byte(i)
        else p.replace(MARK, " ").encode()
        for i, p in enumerate(text)
    ]
    start = np.concatenate([[0], np.cumsum([len(d) for d in decoded])]).astype(np.int64)
    data = np.frombuffer(b"".join(decoded), dtype=np.uint8)
    return Vocabulary(
        size, char_id, slots, merged, factor, priority, first_byte, data, start
    )


def _skipped(key: np.ndarray, start, middle, end, limit: int) -> np.ndarray:
    """Whether a candidate merge is skipped: a hash of its word and its span decides."""
    if not limit:
        return np.zeros(len(key), dtype=bool)
    span = start.astype(np.uint64) * _U(_START) + middle.astype(np.uint64) * _U(_MIDDLE)
    return mix64(key ^ (span + end.astype(np.uint64) * _U(_END))) < _U(limit)


def _merge_long(v: Vocabulary, symbols: list[int], key: int, limit: int) -> list[int]:
    """The agenda of one word, with a heap: best score first, then leftmost."""
    n, pairs = len(symbols), v.pairs
    after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
    agenda: list[tuple[int, int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        made = pairs.get((symbols[i], symbols[j])) if i >= 0 and j < n else None
        if made is None:
            return
        spot = [np.array([x]) for x in (i, j, after[j])]
        if not _skipped(np.array([key], dtype=np.uint64), *spot, limit)[0]:
            heapq.heappush(agenda, (int(v.priority[made]), i, j, after[j], made))

    for i in range(n - 1):
        offer(i)
    while agenda:
        _, i, j, end, made = heapq.heappop(agenda)
        if symbols[i] < 0 or symbols[j] < 0 or after[i] != j or after[j] != end:
            continue
        symbols[i], symbols[j] = made, -1
        after[i] = end
        if end < n:
            before[end] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return symbols


def _merge(
    v: Vocabulary, symbols: np.ndarray, starts: np.ndarray, keys: np.ndarray, limit: int
) -> np.ndarray:
    """Merge all words at once, each its best candidate a turn; dead symbols become -1.

    Word w holds the symbols from `starts[w]` on. A candidate's key is its priority and
    then its place, so the least key of a word is what its agenda would give next. The
    skipping hash depends on the word and the span alone, so a candidate can be skipped
    when it arises rather than when its turn comes.
    """
    n = len(symbols)
    ends = np.append(starts[1:], n)
    length = ends - starts
    symbols = np.append(symbols, -1)
    for w in np.flatnonzero(length > LONG_WORD):
        word = slice(starts[w], ends[w])
        symbols[word] = _merge_long(v, symbols[word].tolist(), int(keys[w]), limit)
    after = np.arange(1, n + 2)
    before = np.arange(-1, n)
    word_of = np.repeat(np.arange(len(starts)), length)
    best = np.full(n + 1, _NONE)
    made = np.full(n + 1, -1, dtype=np.int64)

    def offer(left: np.ndarray, word: np.ndarray) -> None:
        right = after[left]
        piece = v.lookup(symbols[left], symbols[right])
        hit = np.flatnonzero(piece >= 0)
        best[left] = _NONE
        left, right, word, piece = left[hit], right[hit], word[hit], piece[hit]
        base = starts[word]
        skip = _skipped(keys[word], left - base, right - base, after[right] - base, limit)
        best[left] = np.where(skip, _NONE, (v.priority[piece] << 32) | left)
        made[left] = piece

    short = np.flatnonzero((length <= LONG_WORD) & (length > 1))
    if not len(short):
        return symbols[:-1]
    inner = (length[word_of] <= LONG_WORD) & (np.arange(n) + 1 < ends[word_of])
    left = np.flatnonzero(inner)
    offer(left, word_of[left])
    active, spots, cuts = short, None, None
    while len(active):
        if spots is None:
            size = length[active]
            cuts = np.concatenate([[0], np.cumsum(size)[:-1]])
            spots = np.arange(size.sum()) + np.repeat(starts[active] - cuts, size)
        least = np.minimum.reduceat(best[spots], cuts)
        live = least < _NONE
        if not live.any():
            break
        word = active[live]
        i = least[live] & 0xFFFFFFFF
        j = after[i]
        symbols[i] = made[i]
        symbols[j] = -1
        best[j] = _NONE
        end = after[j]
        after[i] = end
        inside = end < ends[word]
        before[end[inside]] = i[inside]
        best[i] = _NONE
        offer(i[inside], word[inside])
        first = i > starts[word]
        offer(before[i[first]], word[first])
        if live.sum() < 0.7 * len(active):
            active, spots = word, None
    return symbols[:-1]


def _code_points(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)


def _utf8(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    return np.frombuffer(data, dtype=np.uint8), width.astype(np.int64)


def encode_texts(
    v: Vocabulary, column: pa.Array, doc_keys: np.ndarray, limit: int
) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts, and the n + 1 places where texts begin in them."""
    data, _ = string_bytes(column)
    points = _code_points(data)
    chars = np.asarray(pc.utf8_length(column.fill_null("")).cast(pa.int64()))
    begin = np.concatenate([[0], np.cumsum(chars)])
    full = np.flatnonzero(chars)
    # A text that isn't empty gets a mark in front.
    points = np.insert(points, begin[full], np.uint32(0x20))
    begin = begin + np.concatenate([[0], np.cumsum(chars > 0)])
    n = len(points)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(len(column) + 1, dtype=np.int64)
    space = points == 0x20
    symbols = v.char_id[points]
    symbols[points == ord(MARK)] = -1  # as bytes, or it would come back as a space
    symbols[space] = v.char_id[ord(MARK)]
    raw = symbols < 0
    edge = np.zeros(n, dtype=bool)
    edge[begin[:-1][chars > 0]] = True
    edge[1:] |= (space[1:] & ~space[:-1]) | raw[1:] | raw[:-1]
    starts = np.flatnonzero(edge)
    doc = np.searchsorted(begin, starts, side="right") - 1
    keys = mix64(doc_keys[doc] ^ ((starts - begin[doc]).astype(np.uint64) * _U(_START)))
    kept = _merge(v, symbols, starts, keys, limit)
    out_width = (kept >= 0).astype(np.int64)
    bytes_, width = _utf8(points[raw])
    out_width[raw] = width
    place = np.concatenate([[0], np.cumsum(out_width)])
    ids = np.empty(place[-1], dtype=np.int64)
    ids[place[:-1][kept >= 0]] = kept[kept >= 0]
    if len(bytes_):
        at = np.repeat(place[:-1][raw], width)
        inner = np.arange(len(bytes_)) - np.repeat(np.cumsum(width) - width, width)
        ids[at + inner] = v.first_byte + bytes_
    return ids, place[begin]


def decode_ids(v: Vocabulary, ids: np.ndarray, begin: np.ndarray) -> pa.Array:
    """Texts of runs of piece ids: their bytes, without the mark in front."""
    width = v.start[ids + 1] - v.start[ids]
    place = np.concatenate([[0], np.cumsum(width)])
    index = np.arange(place[-1]) + np.repeat(v.start[ids] - place[:-1], width)
    data = v.data[index]
    starts = place[begin]
    lead = starts[:-1][np.diff(starts) > 0]
    keep = np.ones(len(data), dtype=bool)
    keep[lead] = data[lead] != 0x20
    offsets = np.concatenate([[0], np.cumsum(keep)])[starts]
    return pa.LargeStringArray.from_buffers(
        len(begin) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[keep])
    )


def _encode(batches: Iterator[pa.RecordBatch], model_file: str, limit: int):
    v = load(model_file)
    for whole in batches:
        for batch in slices(whole, "text", _ENCODE_BYTES):
            keys = np.asarray(batch.column("_key")).view(np.uint64)
            ids, begin = encode_texts(v, batch.column("text"), mix64(keys), limit)
            pieces = pa.ListArray.from_arrays(
                pa.array(begin, pa.int32()), pa.array(ids, pa.int32())
            )
            rest = [batch.column(c) for c in batch.schema.names if c != "_key"]
            names = [c for c in batch.schema.names if c != "_key"]
            yield pa.RecordBatch.from_arrays([*rest, pieces], [*names, "pieces"])


def _decode(batches: Iterator[pa.RecordBatch], model_file: str, column: str):
    v = load(model_file)
    for whole in batches:
        offsets = np.asarray(whole.column("pieces").offsets)
        first = 0
        while first < whole.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + _DECODE_PIECES, side="right")) - 1
            last = max(first + 1, last)
            batch = whole.slice(first, last - first)
            lists = batch.column("pieces")
            begin = np.asarray(lists.offsets).astype(np.int64)
            ids = np.asarray(lists.values)[begin[0] : begin[-1]].astype(np.int64)
            text = decode_ids(v, ids, begin - begin[0]).cast(pa.string())
            yield batch.append_column(column, text)
            first = last


def encode(
    docs: DataFrame, model_file: str, dropout: float = 0.1, seed: int = 0
) -> DataFrame:
    """`docs` with `pieces` (array of int): the piece ids of `text`.

    Merges follow the model's agenda: best score first, then leftmost. Each candidate
    merge is skipped with probability `dropout` by a hash of the seed, `doc_id`, the
    word's place in the text and the candidate's span, so reruns agree and the
    occurrences of a word differ; 0 gives the library's own encoding. A null or empty
    text has no pieces. A mark character inside a text is written as bytes, so that it
    isn't taken for a space. Repeated rows get equal pieces.
    """
    if not 0 <= dropout < 1:
        raise ValueError("dropout must be in [0, 1)")
    limit = int(dropout * 2**64)
    keyed = in_small_batches(docs).drop("pieces").withColumn("_key", F.xxhash64(F.lit(seed), "doc_id"))
    schema = f"{_ddl(docs.drop('pieces'))}, pieces array<int>"
    return keyed.mapInArrow(lambda it: _encode(it, model_file, limit), schema)


def decode(encoded: DataFrame, model_file: str, column: str = "decoded") -> DataFrame:
    """`encoded` with the text of `pieces` in `column`; no pieces give an empty text."""
    schema = f"{_ddl(encoded)}, {column} string"
    return in_small_batches(encoded).mapInArrow(lambda it: _decode(it, model_file, column), schema)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
