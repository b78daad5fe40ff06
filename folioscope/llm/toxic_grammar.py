"""Toxicity by a weighted finite-state grammar over clauses.

Four small transducers read the word classes of a clause side by side: negation, reported
speech, target and threat. Their composition is one deterministic transducer whose states
are tuples of theirs; an insult leaves it with its weight times what the others make of
it. Weights of insults are learnt from labelled texts as stems: prefixes of words that
are far more frequent in toxic texts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.cluster import settle
from folioscope.llm.nearest_vote import remainder
from folioscope.llm.ordering import hash_sample
from folioscope.llm.text_arrays import in_small_batches, slices

#: Folds of the labels, and the one that is held out.
FOLDS, HELD_OUT = 3, 1
#: Labelled texts of each label that are learnt from.
SAMPLE = 4_096
#: Stems looked at one by one when the lexicon is chosen.
CANDIDATES = 4_096
#: Letters of the shortest and the longest stem.
SHORTEST, LONGEST = 3, 12

# Word classes.
WORD, NOT, TARGET, SAID, QUOTE, THREAT, INSULT = range(7)

#: Words of the grammar; English, German, French and Spanish.
CLASSES: dict[int, frozenset[str]] = {
    NOT: frozenset(
        "not no never neither nor without hardly nicht kein keine keinen nie niemals ohne "
        "pas jamais aucun aucune sans nunca jamás ningún ninguna sin tampoco".split()
    ),
    TARGET: frozenset(
        "you your yours yourself u ur thou they them their he him she her du dich dir dein "
        "deine ihr euch euer tu toi ton ta tes vous votre vos tú ti tus usted ustedes "
        "vosotros".split()
    ),
    SAID: frozenset(
        "said says say told called calls wrote writes claimed claims quoted quotes sagte "
        "sagt nannte nennt schrieb behauptet dit disait déclare appelle écrit dijo dice "
        "llamó llama escribió".split()
    ),
    THREAT: frozenset(
        "kill murder hurt destroy beat burn shoot stab strangle töten umbringen erschießen "
        "verprügeln tuer frapper détruire égorger matar golpear destruir apuñalar".split()
    ),
}
#: What becomes of a match: negated, reported, aimed at someone, a threat's weight.
NEGATED, REPORTED, AIMED, THREATENED = 0.25, 0.35, 1.25, 4.0
#: Words that a negation, a target or a threat reaches.
REACH = 3
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[\"“”„«»]|[.!?;:\n]")
_QUOTES = frozenset("\"“”„«»")
_BORDERS = frozenset(".!?;:\n")
#: Least and largest weight of a stem: the log ratio of its rates.
_LEAST, _MOST = 1.0, 8.0


def negation(state: int, word: int) -> tuple[int, float]:
    """After a negation, the next words up to `REACH` are negated."""
    if word == NOT:
        return REACH, 1.0
    return max(state - 1, 0), NEGATED if state else 1.0


def reported(state: int, word: int) -> tuple[int, float]:
    """After a verb of saying and inside quotation marks (state 2 on), speech is reported."""
    if word == QUOTE:
        return state ^ 2, 1.0
    if word == SAID:
        return state | 1, 1.0
    return state, REPORTED if state else 1.0


def target(state: int, word: int) -> tuple[int, float]:
    """After a word for someone, the next words up to `REACH` are aimed at them."""
    if word == TARGET:
        return REACH, 1.0
    return max(state - 1, 0), AIMED if state else 1.0


def threat(state: int, word: int) -> tuple[int, float]:
    """A verb of violence that meets a target within `REACH` words is a threat."""
    if word == THREAT:
        return REACH, 1.0
    if word == TARGET and state:
        return 0, THREATENED
    return max(state - 1, 0), 1.0


class Composition:
    """The four transducers as one, with its arcs worked out as they are first taken.

    An arc has the next state, the factor of an insult's weight, and the weight that is
    written for itself (a threat's, under the same negation and report).
    """

    def __init__(self) -> None:
        self.names: list[tuple[int, ...]] = [(0, 0, 0, 0)]
        self.numbers = {self.names[0]: 0}
        self.arcs: dict[tuple[int, int], tuple[int, float, float]] = {}

    def number(self, state: tuple[int, ...]) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.names)
            self.names.append(state)
        return self.numbers[state]

    def arc(self, state: int, word: int) -> tuple[int, float, float]:
        if (state, word) not in self.arcs:
            n, r, t, v = self.names[state]
            (n2, negated), (r2, said) = negation(n, word), reported(r, word)
            (t2, aimed), (v2, violent) = target(t, word), threat(v, word)
            factor = negated * said * aimed
            written = violent * negated * said if violent > 1 else 0.0
            self.arcs[state, word] = (self.number((n2, r2, t2, v2)), factor, written)
        return self.arcs[state, word]

    def border(self, state: int, line: bool) -> int:
        """A clause ends: all start again, but an open quotation goes on within its line."""
        return self.number((0, 0 if line else self.names[state][1] & 2, 0, 0))


@dataclass
class Grammar:
    """A learnt lexicon of stems and how clause weights become a score.

    Its size is bounded by `CANDIDATES`. `bias`, `slope` and `length` are those of a
    logistic regression on the logarithms of the weight and of the number of words.
    """

    stems: dict[str, float]
    bias: float
    slope: float = 0.0
    length: float = 0.0
    machine: Composition = field(default_factory=Composition)
    known: dict[str, tuple[int, float]] = field(default_factory=dict)

    def classify(self, token: str) -> tuple[int, float]:
        """Class and weight of a token in lower case."""
        if token in self.known:
            return self.known[token]
        found = self._classify(token)
        if len(self.known) >= 200_000:
            self.known.clear()
        if len(token) <= 100:
            self.known[token] = found
        return found

    def _classify(self, token: str) -> tuple[int, float]:
        if token in _QUOTES:
            return QUOTE, 0.0
        if token.endswith(("n't", "n’t")):
            return NOT, 0.0
        for word in (token, *re.split("['’]", token)):
            for end in range(min(LONGEST, len(word)), SHORTEST - 1, -1):
                if word[:end] in self.stems:
                    return INSULT, self.stems[word[:end]]
        for kind, words in CLASSES.items():
            if token in words:
                return kind, 0.0
        return WORD, 0.0

    def clauses(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of words, and (start, end, weight) of each clause with a match."""
        tokens = [t.lower() for t in _TOKEN.findall(text)]
        kinds = [self.classify(t)[0] if t not in _BORDERS else WORD for t in tokens]
        number = sum(t not in _BORDERS and t not in _QUOTES for t in tokens)
        if INSULT not in kinds and THREAT not in kinds:
            return number, []
        out = []
        state, weight, start, end = 0, 0.0, None, 0
        arcs, machine = self.machine.arcs, self.machine
        for match, token, kind in zip(_TOKEN.finditer(text), tokens, kinds, strict=True):
            if token in _BORDERS:
                if weight > 0:
                    out.append((start, end, weight))
                state, weight, start = machine.border(state, token == "\n"), 0.0, None
                continue
            start = match.start() if start is None else start
            end = match.end()
            to, factor, written = arcs.get((state, kind)) or machine.arc(state, kind)
            if kind == INSULT:
                weight += self.classify(token)[1] * factor
            weight += written
            state = to
        if weight > 0:
            out.append((start, end, weight))
        return number, out

    def score(self, number: np.ndarray, weight: np.ndarray) -> np.ndarray:
        z = self.bias + self.slope * np.log1p(weight) + self.length * np.log1p(number)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def choose_stems(
    counts: Mapping[str, tuple[int, int]], toxic: int, clean: int, features: int
) -> dict[str, float]:
    """Stems and weights out of the counts of prefixes in toxic and in clean texts.

    The prefix with the strongest likelihood ratio (ties: the longest, then the least) is
    taken, its occurrences are taken out of the shorter prefixes, and longer ones go with
    it; until none stands out of so many `features`. A weight is the log ratio of rates.
    """
    left = {stem: list(c) for stem, c in counts.items()}
    both = max(toxic + clean, 1)
    least = 2 * math.log(max(features, 1)) + 12

    def strength(a: int, b: int) -> float:
        expected = (a + b) * toxic / both
        if a < 3 or a <= expected:
            return 0.0
        out = a * math.log(a / expected)
        if b:
            out += b * math.log(b / ((a + b) * clean / both))
        return 2 * out

    # Many prefixes, few stems: kept in order of strength, those changed are put back.
    waiting = sorted(((-strength(*c), -len(s), s) for s, c in left.items()), reverse=True)
    chosen: dict[str, float] = {}
    while waiting:
        g, _, stem = waiting.pop()
        if -g < least:
            break
        if stem not in left or any(stem[:k] in chosen for k in range(SHORTEST, len(stem))):
            continue
        a, b = left.pop(stem)
        ratio = ((a + 0.5) / (toxic + 1)) / ((b + 0.5) / (clean + 1))
        chosen[stem] = min(math.log(ratio), _MOST)
        shorter = [stem[:k] for k in range(SHORTEST, len(stem)) if stem[:k] in left]
        for s in shorter:
            left[s][0] -= a
            left[s][1] -= b
        if shorter:
            waiting = [x for x in waiting if x[2] not in shorter]
            waiting += [(-strength(*left[s]), -len(s), s) for s in shorter]
            waiting.sort(reverse=True)
    return {s: w for s, w in chosen.items() if w >= _LEAST}


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - penalty @ w
        bend = (x * (p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(bend, slope)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _tokens_in_context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, label, context) of every word: what stands before and after it tells copies."""
    for whole in batches:
        for batch in slices(whole, "text"):
            words, labels, contexts = [], [], []
            pairs = zip(
                batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True
            )
            for text, label in pairs:
                found = [t.lower() for t in _TOKEN.findall(text or "")]
                found = [t for t in found if t not in _BORDERS and t not in _QUOTES]
                padded = ["", *found, ""]
                words += [t[:LONGEST] for t in found]
                labels += [label] * len(found)
                contexts += [" ".join(padded[k : k + 3]) for k in range(len(found))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array(labels, pa.int32()), pa.array(contexts, pa.string())],
                ["word", "label", "context"],
            )


def learn_grammar(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Grammar:
    """A grammar learnt from labelled texts outside the held-out fold.

    Up to `sample` documents of each label are used, those of the least hashes of their
    id. A word counts once for each pair of neighbours it has, so that copies of a text
    count once. Null labels and labels other than 0 and 1 are not used. With labels of one
    kind only, or none, no stem is learnt and every text scores the share of label 1
    (0.5 without any label).
    """
    usable = labels.where(
        F.col("toxic").isin(0, 1) & (remainder("doc_id", FOLDS) != HELD_OUT)
    ).select("doc_id", F.col("toxic").cast("int").alias("label"))
    kinds = dict(usable.groupBy("label").count().collect())  # two rows
    share = kinds.get(1, 0) / max(1, sum(kinds.values())) if kinds else 0.5
    if len(kinds) < 2:
        near = min(max(share, 1e-6), 1 - 1e-6)
        return Grammar({}, math.log(near / (1 - near)))
    picked = [
        hash_sample(usable.where(F.col("label") == k), "doc_id", sample).withColumn("label", F.lit(k))
        for k in (0, 1)
    ]
    # At most twice the sample, which bounds the broadcast and, as documents may repeat an
    # id, the texts.
    texts = settle(
        in_small_batches(docs)
        .select("doc_id", "text")
        .join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")
        .orderBy(F.xxhash64(F.lit(8_001), "doc_id"), "doc_id", "text")
        .limit(2 * sample)
        .select("label", "text")
        .repartition(64)
    )
    words = (
        texts.mapInArrow(_tokens_in_context, "word string, label int, context string")
        .distinct()
        .groupBy("word")
        .agg(
            F.sum("label").alias("toxic"),
            F.sum(1 - F.col("label")).alias("clean"),
        )
    )
    longest = F.least(F.length("word"), F.lit(LONGEST))
    lengths = F.when(longest >= SHORTEST, F.sequence(F.lit(SHORTEST), longest))
    prefixes = (
        words.select("word", "toxic", "clean", F.explode(lengths).alias("k"))
        .groupBy(F.substr("word", F.lit(1), F.col("k")).alias("stem"))
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )
    prefixes = settle(prefixes)
    totals = settle(words.agg(F.sum("toxic"), F.sum("clean"))).first()
    toxic, clean = (int(x or 0) for x in totals)
    rate = toxic / max(toxic + clean, 1)
    found = (
        prefixes.where("toxic >= 3")
        .withColumn("excess", F.col("toxic") - (F.col("toxic") + F.col("clean")) * F.lit(rate))
        .orderBy(F.desc("excess"), F.desc(F.length("stem")), "stem")
        .limit(CANDIDATES)
        .collect()
    )
    counts = {r.stem: (int(r.toxic), int(r.clean)) for r in found}
    grammar = Grammar(choose_stems(counts, toxic, clean, prefixes.count()), 0.0)
    weighed = weigh(texts, grammar).select("label", "n_tokens", "weight")
    rows = np.array(weighed.collect(), dtype=float).reshape(-1, 3)  # at most twice the sample
    y, number, weight = rows.T
    if len(rows) == 0 or y.min() == y.max():
        return Grammar({}, math.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    x = np.column_stack([np.ones(len(y)), np.log1p(weight), np.log1p(number)])
    bias, slope, length = _logistic(x, y)
    # The sample holds the labels in other shares than the table.
    sampled = y.mean()
    bias += math.log(share / (1 - share)) - math.log(sampled / (1 - sampled))
    return Grammar(grammar.stems, float(bias), float(slope), float(length))


def _weigh_rows(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    stems, bias, slope, length = shared.value
    grammar = Grammar(stems, bias, slope, length)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("weight", pa.float64())])
    for whole in batches:
        for batch in slices(whole, "text"):
            found = [grammar.clauses(t or "") for t in batch.column("text").to_pylist()]
            number = np.array([n for n, _ in found], dtype=np.int64)
            weight = np.array([math.fsum(w for _, _, w in c) for _, c in found])
            clauses = [
                [{"start": a, "end": b, "weight": w} for a, b, w in c] for _, c in found
            ]
            rest = [batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(
                [
                    *rest, pa.array(number), pa.array(clauses, pa.list_(span)), pa.array(weight),
                    pa.array(grammar.score(number, weight)),
                ],
                [*batch.schema.names, "n_tokens", "clauses", "weight", "score"],
            )


_ADDED = "n_tokens bigint, clauses array<struct<start:int,end:int,weight:double>>, weight double, score double"


def weigh(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """`docs` with `n_tokens`, `clauses`, `weight` and `score` of each `text`.

    `clauses` has the code points and the weight of each clause that matches the grammar,
    `weight` their sum and `score` (0 to 1) how likely the text is toxic. A null or empty
    text has no clause and scores as a text of no words. Repeated rows score alike; an
    empty table gives no rows; columns of these names are replaced, others stay.
    """
    docs = in_small_batches(docs).drop("n_tokens", "clauses", "weight", "score")
    model = (grammar.stems, grammar.bias, grammar.slope, grammar.length)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(lambda it: _weigh_rows(it, shared), f"{fields}, {_ADDED}")
