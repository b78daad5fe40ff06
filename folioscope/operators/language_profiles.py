"""Languages by profiles of letter trigrams, learnt from labelled texts.

A profile gives each hashed trigram a whole number of thousandths of a nat, so a text's
score for a language is an exact sum, the same in any order and in SQL.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Trigrams share this many slots (a prime) by a sum of multiples of their code points.
SLOTS = 16_381
FACTORS = (7_919, 10_477, 12_553)
_SLICE = 1 << 20


@dataclass(frozen=True)
class Profiles:
    """`weights[i, slot]`: thousandths by which a trigram speaks for `labels[i]`.

    Weights are log shares less their mean over the languages.
    """

    labels: tuple[str, ...]
    weights: np.ndarray


def _texts(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) in runs of about a million letters, or one text."""
    begin, run, size = 0, [], 0
    for row, text in enumerate(column.to_pylist()):
        if run and size + len(text or "") > _SLICE:
            yield begin, run
            begin, run, size = row, [], 0
        run.append(text or "")
        size += len(run[-1])
    if run:
        yield begin, run


def _slots(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The slot of each trigram of each text, and the text it is of."""
    lengths = np.array([len(t) for t in texts])
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    row = np.repeat(np.arange(len(texts)), lengths)
    if len(points) < 3:
        return np.zeros(0, dtype=np.int64), row[:0]
    p = points.astype(np.int64)
    slot = (p[:-2] * FACTORS[0] + p[1:-1] * FACTORS[1] + p[2:] * FACTORS[2]) % SLOTS
    inside = row[:-2] == row[2:]
    return slot[inside], row[:-2][inside]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        labels = np.array(batch.column("label").to_pylist(), dtype=object)
        for begin, texts in _texts(batch.column("text")):
            slot, row = _slots(texts)
            of = labels[begin : begin + len(texts)]
            for label in sorted(set(of)):
                counts = np.bincount(slot[of[row] == label], minlength=SLOTS)
                total[label] = total.get(label, 0) + counts
    for label, counts in total.items():
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([label] * len(used), pa.string()), pa.array(used), pa.array(counts[used])],
            ["label", "slot", "n"],
        )


def learn_profiles(
    labelled: DataFrame, text: str = "text", label: str = "label", smoothing: float = 0.5
) -> Profiles:
    """Profiles of the languages in `label`, from all rows that have both columns.

    Each task sums its texts to one row a language and slot; these are added up, and the
    driver gets at most `SLOTS` rows a language. No rows give no languages.
    """
    rows = labelled.select(F.lower(text).alias("text"), F.col(label).alias("label")).dropna()
    counted = rows.mapInArrow(_counts, "label string, slot long, n long")
    found = counted.groupBy("label", "slot").agg(F.sum("n").alias("n")).collect()
    labels = tuple(sorted({r.label for r in found}))
    counts = np.zeros((len(labels), SLOTS))
    for r in found:
        counts[labels.index(r.label), r.slot] = r.n
    if not labels:
        return Profiles((), np.zeros((0, SLOTS), dtype=np.int64))
    shares = np.log((counts + smoothing) / (counts.sum(axis=1, keepdims=True) + smoothing * SLOTS))
    return Profiles(labels, np.floor(1000 * (shares - shares.mean(axis=0)) + 0.5).astype(np.int64))


def _labelled(batches: Iterator[pa.RecordBatch], shared, default: str) -> Iterator[pa.RecordBatch]:
    profiles: Profiles = shared.value
    names = np.array([*profiles.labels, default], dtype=object)
    for batch in batches:
        best, lead = [], []
        for _, texts in _texts(batch.column("_lowered")):
            slot, row = _slots(texts)
            seen = np.bincount(row, minlength=len(texts)) > 0
            if not len(profiles.labels):
                best += [default] * len(texts)
                lead += [0] * len(texts)
                continue
            # Whole numbers, which doubles add exactly.
            sums = np.array(
                [np.bincount(row, w[slot], len(texts)) for w in profiles.weights], dtype=np.int64
            )
            top = np.where(seen, sums.argmax(axis=0), len(profiles.labels))
            ranked = np.sort(sums, axis=0)
            margin = ranked[-1] - ranked[-2] if len(sums) > 1 else ranked[-1]
            best += names[top].tolist()
            lead += np.where(seen, margin, 0).tolist()
        rest = [c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name != "_lowered"]
        kept = [name for name in batch.schema.names if name != "_lowered"]
        yield pa.RecordBatch.from_arrays(
            [*rest, pa.array(best, pa.string()), pa.array(lead, pa.int64())],
            [*kept, "language", "language_lead"],
        )


def label_languages(
    rows: DataFrame, profiles: Profiles, text: str = "text", default: str = "en"
) -> DataFrame:
    """`rows` with `language` and `language_lead`, its lead over the next in thousandths.

    The language whose profile gives the lowered text the largest sum; ties go to the
    first label in order. A text of fewer than three letters, or null, is `default`.
    Columns of these names are replaced. Nothing is shuffled; the profiles, of a size
    fixed by the languages, are broadcast.
    """
    rows = rows.drop("language", "language_lead")
    shared = rows.sparkSession.sparkContext.broadcast(profiles)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    lowered = rows.withColumn("_lowered", F.lower(text))
    return lowered.mapInArrow(
        lambda it: _labelled(it, shared, default), f"{fields}, language string, language_lead long"
    )
