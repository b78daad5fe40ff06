"""Quality of texts by a vote of their nearest labelled texts in a latent space."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.ordering import hash_sample
from folioscope.llm.text_arrays import in_small_batches, mix64, slices, string_bytes, words_of

#: Hashed byte trigrams of a text, and then counts of events of its words.
TRIGRAMS = 2_048
EVENTS = 6
#: Events count this many times as much as trigrams of the same share.
_EVENT_WEIGHT = 3.0
_WIDTH = TRIGRAMS + EVENTS
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[ord("0") : ord("9") + 1] = ord("0")


_LOWER = np.zeros(256, dtype=bool)
_LOWER[ord("a") : ord("z") + 1] = True
_LOWER[128:] = True
_ALNUM = _LOWER.copy()
_ALNUM[ord("A") : ord("Z") + 1] = True
_ALNUM[ord("0") : ord("9") + 1] = True


@dataclass(frozen=True)
class Neighbours:
    """A fitted model: term weights, the projection, labelled vectors and their labels.

    Its size is fixed by the sample bound and the latent dimensions, not by the corpus.
    """

    weights: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    balance: np.ndarray
    prior: float
    k: int


def text_terms(column: pa.Array) -> np.ndarray:
    """Term counts of each text (a row each): byte trigrams, digits alike, and events.

    Events: a word like the one before, like the one but one before, a word window of
    three that was in the text before, a word of punctuation alone, a word without a
    lower-case letter or byte beyond ASCII, and all words (which scale the others).
    """
    data, offsets = string_bytes(column)
    rows = len(column)
    out = np.zeros((rows, _WIDTH), dtype=np.float32)
    if len(data) >= 3:
        b = _FOLD[data]
        code = mix64(b[:-2] | (b[1:-1] << np.uint64(8)) | (b[2:] << np.uint64(16)))
        term = (code % np.uint64(TRIGRAMS)).astype(np.int64)
        row = np.repeat(np.arange(rows), np.diff(offsets))
        inside = row[:-2] == row[2:]
        counts = np.bincount(
            row[:-2][inside] * TRIGRAMS + term[inside], minlength=rows * TRIGRAMS
        )
        out[:, :TRIGRAMS] = counts.reshape(rows, TRIGRAMS)
    words = words_of(column, lower=False)
    h = words.hashes
    if len(h):
        row = np.repeat(np.arange(rows), np.diff(words.first))
        for event, back in enumerate((1, 2)):
            same = (h[back:] == h[:-back]) & (row[back:] == row[:-back])
            out[:, TRIGRAMS + event] = np.bincount(row[back:][same], minlength=rows)
        if len(h) >= 3:
            window = mix64(h[:-2] + mix64(h[1:-1] + mix64(h[2:])))
            inside = row[:-2] == row[2:]
            window, at = window[inside], row[:-2][inside]
            order = np.lexsort((window, at))
            w, a = window[order], at[order]
            again = (w[1:] == w[:-1]) & (a[1:] == a[:-1])
            out[:, TRIGRAMS + 2] = np.bincount(a[1:][again], minlength=rows)
        for event, plain in ((3, _ALNUM), (4, _LOWER)):
            has = np.add.reduceat(plain[words.data].astype(np.int32), words.start) > 0
            out[:, TRIGRAMS + event] = np.bincount(row[~has], minlength=rows)
        out[:, TRIGRAMS + 5] = np.diff(words.first)
    return out


def _shares(terms: np.ndarray) -> np.ndarray:
    """Square roots of the terms' shares, so that the length of a text drops out."""
    grams = terms[:, :TRIGRAMS]
    total = np.maximum(grams.sum(axis=1, keepdims=True), 1)
    words = np.maximum(terms[:, -1:], 1)
    events = terms[:, TRIGRAMS:-1] / words
    return np.hstack([np.sqrt(grams / total), _EVENT_WEIGHT * np.sqrt(events)])


def _latent(shares: np.ndarray, weights: np.ndarray, projection: np.ndarray) -> np.ndarray:
    x = (shares * weights) @ projection
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit_neighbours(
    terms: np.ndarray, labels: np.ndarray, share: float, dims: int = 64, k: int = 15
) -> Neighbours:
    """Latent-semantic vectors of labelled texts; `share` is that of label 1 among all."""
    used = (terms[:, :-1] > 0).sum(axis=0)
    weights = np.log((1 + len(terms)) / (1 + used)).astype(np.float32) + 1
    blocks = [slice(i, i + 256) for i in range(0, max(len(terms), 1), 256)]
    gram = np.zeros((len(weights), len(weights)))
    for block in blocks:
        x = _shares(terms[block]) * weights
        gram += x.T @ x
    projection = np.linalg.eigh(gram)[1][:, ::-1][:, :dims].astype(np.float32)
    vectors = [_latent(_shares(terms[block]), weights, projection) for block in blocks]
    sampled = labels.mean() if len(labels) else 0.5
    # With few texts of one label, its kinds of texts have fewer neighbours still.
    rarer = int(min((labels == 0).sum(), (labels == 1).sum()))
    balance = np.array(
        [(1 - share) / max(1 - sampled, 1e-9), share / max(sampled, 1e-9)], dtype=np.float32
    )
    return Neighbours(
        weights, projection, np.concatenate(vectors),
        labels.astype(np.int64), balance, share, min(k, len(labels), max(1, rarer // 3)),
    )


def vote(model: Neighbours, terms: np.ndarray) -> np.ndarray:
    """Share of label 1 among the nearest labelled texts, weighted by their cosine.

    All labelled vectors are compared. Votes are scaled from the sample's label shares
    to those of all labels. A text like none of them gets the overall share.
    """
    if not model.k:
        return np.full(len(terms), model.prior)
    cosine = _latent(_shares(terms), model.weights, model.projection) @ model.vectors.T
    near = np.argpartition(-cosine, model.k - 1, axis=1)[:, : model.k]
    weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64)
    label = model.labels[near]
    weight *= model.balance[label]
    total = weight.sum(axis=1)
    good = (weight * label).sum(axis=1)
    return np.where(total > 0, good / np.where(total > 0, total, 1), model.prior)


def _fit_rows(
    batches: Iterator[pa.RecordBatch], share: float, dims: int
) -> Iterator[pa.RecordBatch]:
    """One row: the model of all texts of the task, which the driver need not hold."""
    terms, labels = [np.zeros((0, _WIDTH), dtype=np.float32)], [np.zeros(0, dtype=np.int64)]
    for whole in batches:
        for batch in slices(whole, "text"):
            terms.append(text_terms(batch.column("text")))
            labels.append(np.asarray(batch.column("label")).astype(np.int64))
    if len(labels) > 1:
        model = fit_neighbours(np.concatenate(terms), np.concatenate(labels), share, dims)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])


def _score_rows(batches, shared) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for whole in batches:
        for batch in slices(whole, "text"):
            score = vote(model, text_terms(batch.column("text")))
            rest = [batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(score)], [*batch.schema.names, "score"]
            )


def remainder(key: str, of: int) -> Column:
    """CRC-32 of a key's text, modulo `of`; a null key has none."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % of


def learn(
    docs: DataFrame, labels: DataFrame, sample: int = 2_048, folds: int = 5, dims: int = 64
) -> Neighbours:
    """Fit on at most `sample` texts of each label, those first in a keyed hash order.

    Rows in fold 0 (`remainder` 0) and null labels are not learnt from. The label shares
    are those of all labels outside fold 0; without any, label 1 has a share of 0.5.
    """
    usable = labels.where(
        F.col("quality").isin(0, 1) & (remainder("doc_id", folds) != 0)
    ).select("doc_id", F.col("quality").cast("int").alias("label"))
    counts = dict(usable.groupBy("label").count().collect())  # two rows
    share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    chosen = [
        hash_sample(
            usable.where(F.col("label") == value), "doc_id", sample
        ).withColumn("label", F.lit(value))
        for value in (0, 1)
    ]
    # At most twice the sample, which bounds the broadcast and the task that fits.
    picked = F.broadcast(chosen[0].unionByName(chosen[1]))
    rows = (
        in_small_batches(docs)
        .select("doc_id", "text")
        .join(picked, "doc_id")
        .orderBy(F.xxhash64(F.lit(8_001), "doc_id"), "doc_id", "text")
        .limit(2 * sample)  # documents may repeat an id
        .select("label", "text")
        .coalesce(1)
        .mapInArrow(lambda it: _fit_rows(it, share, dims), "model binary")
        .collect()
    )
    if not rows:
        none = np.zeros((0, _WIDTH), dtype=np.float32)
        return fit_neighbours(none, np.zeros(0, dtype=np.int64), share, dims)
    return pickle.loads(bytes(rows[0]["model"]))


def score(docs: DataFrame, model: Neighbours) -> DataFrame:
    """`docs` with `score` (double, 0 to 1): how likely label 1 is by its neighbours.

    Only `text` decides. A null or empty text gets the overall share of label 1. An
    empty table gives no rows; a column `score` of `docs` is replaced.
    """
    docs = in_small_batches(docs).drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(lambda it: _score_rows(it, shared), f"{fields}, score double")
