"""Words of many texts at once, as numpy arrays over an Arrow batch's bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of text worked on at once; one longer text is a slice of its own.
SLICE_BYTES = 500_000
#: Bytes that Spark hands to Python at once.
_BATCH_BYTES = 4 << 20

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def in_small_batches(df: DataFrame) -> DataFrame:
    """`df`, whose session hands Python at most 4 MB at once from here on.

    Rows hold whole texts; Spark's own bound of 64 MB, held by the JVM and by Python, is
    much for an executor of a few GB. A smaller setting of the session is kept. Also,
    shuffle files go when their query has ended: what is read again is a written table.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    now = conf.get(key).rstrip("bB")
    if not now.isdigit() or int(now) <= 0 or int(now) > _BATCH_BYTES:
        conf.set(key, f"{_BATCH_BYTES}b")
    return df


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER)
_CODES[_SPACES] = 0


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values and, in 32 bits, the place of each value among them.

    As `np.unique` with the inverse, in about half its memory.
    """
    order = np.argsort(values)
    ordered = values[order]
    fresh = np.ones(len(values), dtype=bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    found = ordered[fresh]
    del ordered
    at = np.empty(len(values), dtype=np.int32)
    at[order] = np.cumsum(fresh, dtype=np.int32) - np.int32(1)
    return found, at


def powers(n: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.multiply.accumulate(out)


@dataclass
class Words:
    """`hashes` of all words, in order; text i has words `first[i]` to `first[i + 1]` - 1.

    `start` and `end` are byte places in `data`.
    """

    hashes: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[
        column.offset : column.offset + len(column) + 1
    ]
    if buffers[2] is None or not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most `limit` bytes of text, or one row."""
    _, offsets = string_bytes(batch.column(text))
    begin = 0
    while begin < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1
        end = max(begin + 1, min(end, batch.num_rows))
        yield batch.slice(begin, end - begin)
        begin = end


def words_of(column: pa.Array, lower: bool = True) -> Words:
    """Words `[^\\x20\\x09-\\x0D]+`, with A-Z lower-cased if `lower`, as 64-bit hashes."""
    data, offsets = string_bytes(column)
    if lower:
        data = _LOWER[data]
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return Words(none.astype(np.uint64), np.zeros(len(column) + 1, np.int64), none, none, data)
    space = _SPACES[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = True
    before[1:] = space[:-1]
    start = np.flatnonzero(~space & (before | edge[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1] = True
    after[:-1] = space[1:]
    end = np.flatnonzero(~space & (after | edge[1:])) + 1
    first = np.searchsorted(start, offsets)
    if not len(start):
        return Words(np.zeros(0, np.uint64), first, start, end, data)
    length = end - start
    # Place of every byte in its word; spaces have code 0 and add nothing.
    gap = np.diff(start, append=n)
    place = np.arange(start[0], n) - np.repeat(start, gap)
    longest = int(length.max())
    np.minimum(place, longest, out=place)
    values = _CODES[data[start[0] :]] * powers(longest + 1)[place]
    sums = np.add.reduceat(values, start - start[0])
    return Words(mix64(sums + length.astype(np.uint64)), first, start, end, data)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` words, over the whole array."""
    if len(words) < size:
        return np.zeros(0, dtype=np.uint64)
    factors = powers(size, 0xA0761D6478BD642F)
    total = np.zeros(len(words) - size + 1, dtype=np.uint64)
    for k in range(size):
        total += words[k : len(words) - size + 1 + k] * factors[k]
    return mix64(total)
