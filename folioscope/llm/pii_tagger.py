"""Personal data: rules, and a character-level bidirectional LSTM with CRF transitions."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.ordering import hash_sample
from folioscope.llm.text_arrays import in_small_batches, slices

#: Kinds of spans, in the order in which equal starts are listed.
KINDS = ("email", "ip", "card", "phone")

# An address is found from its at sign: what may stand before it, and the domain after.
_BEFORE = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# Groups of digits joined by dots, as long as they go; an address is four of them.
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Every span of these kinds holds a digit or an at sign.
_ANCHOR = re.compile(r"[0-9@]+")

#: Characters of a window, those shared by neighbouring windows, and around an anchor.
WINDOW = 96
OVERLAP = 48
MARGIN = 40
HIDDEN = 16
EMBED = 12
#: Tags: outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)

Span = tuple[int, int, str]


def _luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        d = int(c)
        if place % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, each character looked at a few times at most.

    Any match runs from the start of the characters before its at sign, or the end of
    the last match; so there is one place to try for each at sign.
    """
    if "@" not in text:
        return
    last = 0
    for m in _BEFORE.finditer(text):
        start, at = max(m.start(), last), m.end()
        if start < at and text.startswith("@", at):
            domain = _DOMAIN.match(text, at + 1)
            if domain:
                last = domain.end()
                yield start, last


def _dotted_quads(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping runs of four groups of digits with single dots between."""
    if "." not in text:
        return
    for m in _DOTTED.finditer(text):
        groups = m.group().split(".")
        at = m.start()
        for k in range(0, len(groups) - 3, 4):
            size = sum(map(len, groups[k : k + 4])) + 3
            yield at, at + size
            at += size + 1


def _small_parts(quad: str) -> bool:
    """All parts at most 255; long ones are over it whatever they are, leading zeros aside."""
    parts = [p.lstrip("0") for p in quad.split(".")]
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def base_spans(text: str) -> list[Span]:
    """Spans by rule, sorted by start and kind; matches of a kind don't overlap."""
    found: list[Span] = [(a, b, "email") for a, b in _emails(text)]
    for a, b in _dotted_quads(text):
        if _small_parts(text[a:b]):
            found.append((a, b, "ip"))
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and _luhn(digits):
            found.append((*m.span(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
                found.append((*m.span(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


# --- windows -------------------------------------------------------------------------


def windows(text: str) -> list[tuple[int, int]]:
    """Overlapping windows over all text within `MARGIN` of a digit or at sign.

    No span of any kind lies elsewhere, as each holds such a character; the rest of the
    text is outside by definition. A stretch longer than a window gets several, each
    sharing `OVERLAP` characters with the next.
    """
    stretches: list[list[int]] = []
    for m in _ANCHOR.finditer(text):
        begin, end = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if stretches and begin <= stretches[-1][1]:
            stretches[-1][1] = end
        else:
            stretches.append([begin, end])
    out = []
    for begin, end in stretches:
        at = begin
        while at + WINDOW < end:
            out.append((at, at + WINDOW))
            at += WINDOW - OVERLAP
        out.append((max(begin, min(at, end - WINDOW)), end))
    return out


def _codes() -> np.ndarray:
    """Classes of code points: ASCII is itself, the rest by what it is used as."""
    table = np.full(0x110000, 127, dtype=np.int16)
    table[:128] = np.arange(128)
    table[[0x2010, 0x2011, 0x2013]] = ord("-")
    table[[0xA0, 0x2007, 0x202F]] = ord(" ")
    for c in range(ord("0"), ord("9") + 1):
        table[c] = ord("0") + (c - ord("0")) // 5  # low or high digit
    table[0] = 1  # 0 is padding
    return table


_CODES = _codes()


def _encode_windows(text: str, spots: list[tuple[int, int]]) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    out = np.zeros((len(spots), WINDOW), dtype=np.int16)
    for row, (begin, end) in enumerate(spots):
        out[row, : end - begin] = _CODES[points[begin:end]]
    return out


# --- the tagger ----------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Tagger:
    """Weights of the network; a few thousand numbers."""

    w: dict[str, np.ndarray]

    @staticmethod
    def fresh(seed: int = 0) -> Tagger:
        r = np.random.default_rng(seed)

        def draw(*shape: int) -> np.ndarray:
            return (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        w = {"embed": draw(128, EMBED) * 3, "out": draw(2 * HIDDEN, TAGS)}
        for side in ("f", "b"):
            w[f"x{side}"] = draw(EMBED, 4 * HIDDEN)
            w[f"h{side}"] = draw(HIDDEN, 4 * HIDDEN)
            w[f"c{side}"] = np.zeros(4 * HIDDEN, dtype=np.float32)
            w[f"c{side}"][HIDDEN : 2 * HIDDEN] = 1  # remember at first
        w["bias"] = np.zeros(TAGS, dtype=np.float32)
        w["step"] = np.zeros((TAGS, TAGS), dtype=np.float32)
        return Tagger(w)

    def _pass(self, x: np.ndarray, side: str, mask: np.ndarray, keep: list | None):
        """Hidden states (time, rows, hidden) of one direction over inputs of that order."""
        w, steps, rows = self.w, x.shape[0], x.shape[1]
        h = np.zeros((rows, HIDDEN), dtype=np.float32)
        c = np.zeros_like(h)
        out = np.empty((steps, rows, HIDDEN), dtype=np.float32)
        inputs = x @ w[f"x{side}"] + w[f"c{side}"]
        for t in range(steps):
            z = inputs[t] + h @ w[f"h{side}"]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            new = f * c + i * g
            squashed = np.tanh(new)
            m = mask[t][:, None]
            if keep is not None:
                keep.append((h, c, i, f, o, g, squashed, m))
            # Padding leaves the state as it was.
            h = np.where(m, o * squashed, h)
            c = np.where(m, new, c)
            out[t] = h
        return out

    def emissions(self, codes: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Scores (time, rows, tags) of windows (rows, time)."""
        ids = codes.T
        mask = ids > 0
        x = self.w["embed"][ids]
        fwd: list | None = [] if keep is not None else None
        bwd: list | None = [] if keep is not None else None
        f = self._pass(x, "f", mask, fwd)
        b = self._pass(x[::-1], "b", mask[::-1], bwd)[::-1]
        hidden = np.concatenate([f, b], axis=2)
        if keep is not None:
            keep |= {"ids": ids, "mask": mask, "x": x, "fwd": fwd, "bwd": bwd, "hidden": hidden}
        return hidden @ self.w["out"] + self.w["bias"]

    def _back(self, side: str, x: np.ndarray, kept: list, d_out: np.ndarray, grad: dict):
        w, steps = self.w, x.shape[0]
        dh = np.zeros_like(d_out[0])
        dc = np.zeros_like(dh)
        dz_all = np.empty((*x.shape[:2], 4 * HIDDEN), dtype=np.float32)
        for t in range(steps - 1, -1, -1):
            h, c, i, f, o, g, squashed, m = kept[t]
            dh = dh + d_out[t]
            through = np.where(m, dh, 0)
            d_new = np.where(m, dc, 0) + through * o * (1 - squashed**2)
            dz = np.concatenate(
                [d_new * g * i * (1 - i), d_new * c * f * (1 - f),
                 through * squashed * o * (1 - o), d_new * i * (1 - g**2)], axis=1,
            )
            dz_all[t] = dz
            grad[f"h{side}"] += h.T @ dz
            dh = np.where(m, 0, dh) + dz @ w[f"h{side}"].T
            dc = np.where(m, d_new * f, dc)
        flat = dz_all.reshape(-1, 4 * HIDDEN)
        grad[f"x{side}"] += x.reshape(-1, EMBED).T @ flat
        grad[f"c{side}"] += flat.sum(axis=0)
        return dz_all @ w[f"x{side}"].T

    def learn(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of the tags, and its gradients."""
        keep: dict = {}
        e = self.emissions(codes, keep)
        step, mask = self.w["step"], keep["mask"]
        steps, rows = e.shape[:2]
        gold = tags.T
        alpha = np.empty_like(e)
        alpha[0] = e[0]
        for t in range(1, steps):
            z = alpha[t - 1][:, :, None] + step[None]
            top = z.max(axis=1)
            total = top + np.log(np.exp(z - top[:, None]).sum(axis=1)) + e[t]
            alpha[t] = np.where(mask[t][:, None], total, alpha[t - 1])
        top = alpha[-1].max(axis=1, keepdims=True)
        norm = (top + np.log(np.exp(alpha[-1] - top).sum(axis=1, keepdims=True)))[:, 0]
        beta = np.zeros_like(e[0])
        grad = {k: np.zeros_like(v) for k, v in self.w.items()}
        de = np.empty_like(e)
        line = np.arange(rows)
        score = np.zeros(rows)
        for t in range(steps - 1, -1, -1):
            de[t] = np.where(mask[t][:, None], np.exp(alpha[t] + beta - norm[:, None]), 0)
            score += np.where(mask[t], e[t, line, gold[t]], 0)
            de[t][line[mask[t]], gold[t][mask[t]]] -= 1
            if t:
                score += np.where(mask[t], step[gold[t - 1], gold[t]], 0)
                ahead = e[t] + beta
                both = alpha[t - 1][:, :, None] + step[None] + (ahead - norm[:, None])[:, None]
                grad["step"] += np.exp(both[mask[t]]).sum(axis=0)
                np.subtract.at(grad["step"], (gold[t - 1][mask[t]], gold[t][mask[t]]), 1)
                z = step[None] + ahead[:, None]
                top = z.max(axis=2)
                new = top + np.log(np.exp(z - top[:, :, None]).sum(axis=2))
                beta = np.where(mask[t][:, None], new, beta)
        hidden = keep["hidden"]
        grad["out"] += hidden.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, TAGS)
        grad["bias"] += de.sum(axis=(0, 1))
        d_hidden = de @ self.w["out"].T
        dx = self._back("f", keep["x"], keep["fwd"], d_hidden[:, :, :HIDDEN], grad)
        dx += self._back(
            "b", keep["x"][::-1], keep["bwd"], d_hidden[::-1, :, HIDDEN:], grad
        )[::-1]
        np.add.at(grad["embed"], keep["ids"].reshape(-1), dx.reshape(-1, EMBED))
        return float((norm - score).mean()), {k: g / rows for k, g in grad.items()}

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Best tags (rows, time) by Viterbi; inside follows only its own kind."""
        e = self.emissions(codes)
        step = self.w["step"] + _ALLOWED
        steps, rows = e.shape[:2]
        best = e[0] + _FIRST
        back = np.empty((steps, rows, TAGS), dtype=np.int8)
        mask = codes.T > 0
        for t in range(1, steps):
            z = best[:, :, None] + step[None]
            back[t] = z.argmax(axis=1)
            best = np.where(mask[t][:, None], z.max(axis=1) + e[t], best)
            back[t][~mask[t]] = np.arange(TAGS)
        tags = np.empty((steps, rows), dtype=np.int8)
        tags[-1] = best.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            tags[t - 1] = back[t][np.arange(rows), tags[t]]
        tags[~mask] = 0
        return tags.T


def _rules() -> tuple[np.ndarray, np.ndarray]:
    allowed = np.zeros((TAGS, TAGS), dtype=np.float32)
    for kind in range(len(KINDS)):
        inside = 2 + 2 * kind
        allowed[:, inside] = -1e4
        allowed[[inside - 1, inside], inside] = 0
    first = np.zeros(TAGS, dtype=np.float32)
    first[2::2] = -1e4
    return allowed, first


_ALLOWED, _FIRST = _rules()


def _tags(size: int, offset: int, spans: list[Span]) -> np.ndarray:
    out = np.zeros(size, dtype=np.int8)
    for start, end, kind in spans:
        first = 1 + 2 * KINDS.index(kind)
        a, b = max(0, start - offset), min(size, end - offset)
        if a < b and start >= offset and end <= offset + size:
            out[a] = first
            out[a + 1 : b] = first + 1
    return out


def train(
    examples: list[tuple[str, list[Span]]], passes: int = 12, seed: int = 3, size: int = 32,
    steps: int = 600,
) -> Tagger:
    """A tagger from texts and their labelled spans, by Adam on shuffled windows.

    Few windows get more than `passes` passes, as many as make `steps` steps.
    Windows that cut a span are left out; a span is whole in another one.
    """
    codes, tags = [], []
    for text, spans in examples:
        spots = windows(text)
        for row, (begin, end) in zip(_encode_windows(text, spots), spots, strict=True):
            if any(s < begin < e or s < end < e for s, e, _ in spans):
                continue
            codes.append(row)
            tags.append(np.pad(_tags(end - begin, begin, spans), (0, WINDOW - (end - begin))))
    model = Tagger.fresh(seed)
    if not codes:
        return model
    x, y = np.stack(codes), np.stack(tags)
    passes = max(passes, -(-steps // -(-len(x) // size)))
    r = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    turn = 0
    for number in range(passes):
        rate = 0.02 * (1 - number / passes) + 0.001
        order = r.permutation(len(x))
        for begin in range(0, len(order), size):
            some = order[begin : begin + size]
            _, grad = model.learn(x[some], y[some])
            turn += 1
            norm = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
            for k, g in grad.items():
                g = g * min(1.0, 5 / max(norm, 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                fix = np.sqrt(1 - 0.99**turn) / (1 - 0.9**turn)
                model.w[k] = (
                    model.w[k] - rate * fix * first[k] / (np.sqrt(second[k]) + 1e-6)
                ).astype(np.float32)
    return model


def _window_spans(tags: np.ndarray, begin: int) -> list[Span]:
    out, at = [], 0
    while at < len(tags):
        tag = int(tags[at])
        stop = at + 1
        if tag % 2:
            while stop < len(tags) and tags[stop] == tag + 1:
                stop += 1
            out.append((begin + at, begin + stop, KINDS[tag // 2]))
        at = stop
    return out


def plausible(text: str, start: int, end: int, kind: str) -> tuple[int, int] | None:
    """The span without blanks at its ends, or None if it can't be of its kind.

    The tagger decides where a span is; this holds what a kind needs whatever surrounds
    it: no letter or digit touching it, and its count of digits, check sum or parts.
    """
    while start < end and text[start] == " ":
        start += 1
    while start < end and text[end - 1] == " ":
        end -= 1
    if start == end or text[start - 1 : start].isalnum() or text[end : end + 1].isalnum():
        return None
    body = text[start:end]
    digits = re.sub("[^0-9]", "", body)
    if any(c.isalpha() for c in body) and kind != "email":
        return None
    good = {
        "email": lambda: body.count("@") == 1 and "." in body.split("@")[1].strip("."),
        "ip": lambda: list(_dotted_quads(body)) == [(0, len(body))] and _small_parts(body),
        "card": lambda: 12 <= len(digits) <= 19 and _luhn(digits),
        "phone": lambda: 9 <= len(digits) <= 15,
    }
    return (start, end) if good[kind]() else None


def reconcile(text: str, spots: list[tuple[int, int]], found: list[list[Span]]) -> list[Span]:
    """Spans of all windows of a text as one list without overlaps.

    A span that touches an end of its window which isn't an end of the stretch may be
    cut, so the window that holds more around it decides: of overlapping spans, the one
    farthest from its window's ends stays, then the longer, then the leftmost. A span
    that can't be of its kind isn't one.
    """
    ranked = []
    for (begin, end), spans in zip(spots, found, strict=True):
        for s, e, kind in spans:
            left = s - begin if begin else WINDOW
            right = end - e if end < len(text) else WINDOW
            spot = plausible(text, s, e, kind)
            if spot:
                ranked.append((-min(left, right), spot[0] - spot[1], *spot, kind))
    taken: list[Span] = []
    for _, _, s, e, kind in sorted(set(ranked)):
        if all(e <= a or s >= b for a, b, _ in taken):
            taken.append((s, e, kind))
    return sorted(taken)


def added_spans(model: Tagger, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
    """What the tagger finds beyond the rules' spans, in texts of a slice at once."""
    spots = [windows(t) for t in texts]
    rows = [_encode_windows(t, s) for t, s in zip(texts, spots, strict=True)]
    flat = np.concatenate(rows) if rows else np.zeros((0, WINDOW), dtype=np.int16)
    decoded = [model.decode(flat[i : i + 256]) for i in range(0, len(flat), 256)]
    tags = np.concatenate(decoded) if decoded else np.zeros((0, WINDOW), dtype=np.int8)
    out, at = [], 0
    for text, own, known in zip(texts, spots, base, strict=True):
        found = [
            _window_spans(tags[at + k][: e - b], b) for k, (b, e) in enumerate(own)
        ]
        at += len(own)
        merged = reconcile(text, own, found)
        out.append(
            [x for x in merged if all(x[1] <= s or x[0] >= e for s, e, _ in known)]
        )
    return out


def _find(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for whole in batches:
        for batch in slices(whole, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            base = [base_spans(t) if _ANCHOR.search(t) else [] for t in texts]
            more = added_spans(model, texts, base)
            order = [
                sorted([*b, *m], key=lambda s: (s[0], KINDS.index(s[2])))
                for b, m in zip(base, more, strict=True)
            ]
            rest = [batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(
                [
                    *rest,
                    pa.array([joined(b) for b in base], pa.string()),
                    pa.array([joined(s) for s in order], pa.string()),
                ],
                [*batch.schema.names, "base_spans", "spans"],
            )


def _invented(count: int, seed: int) -> list[tuple[str, list[Span]]]:
    """Labelled texts with ways of writing that the rules don't cover."""
    r = np.random.default_rng(seed)

    def digits(n: int) -> str:
        return "".join(map(str, r.integers(0, 10, n)))

    def word() -> str:
        return "".join(chr(97 + c) for c in r.integers(0, 26, int(r.integers(2, 9))))

    makers = [
        ("phone", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}"),
        ("phone", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}"),
        ("phone", lambda: f"{digits(3)} {digits(3)} {digits(4)}"),
        (None, lambda: f"version {digits(1)}.{digits(1)}."),
        (None, lambda: f"{digits(4)}"),
        (None, lambda: f"{word()}={hashlib.md5(word().encode()).hexdigest()[:20]}"),
        (None, lambda: f'"{hashlib.sha1(word().encode()).hexdigest()}"'),
        (None, lambda: "AK" + hashlib.md5(word().encode()).hexdigest()[:18].upper()),
        (None, lambda: f"{digits(2)}.{digits(2)}"),
        (None, lambda: f"@{word()}"),
        (None, lambda: f"{digits(4)}-{digits(2)}-{digits(2)}"),
    ]
    out = []
    for k in range(count):
        kind, make = makers[k % len(makers)]
        before = " ".join(word() for _ in range(6)) + " "
        body = make()
        text = before + body + " " + " ".join(word() for _ in range(6))
        spans = [] if kind is None else [(len(before), len(before) + len(body), kind)]
        out.append((text, spans))
    return out


def learn_tagger(
    docs: DataFrame, sample: int = 400, invented: int = 165, chars: int = 2_000
) -> Tagger:
    """Train on at most `sample` texts that the rules label, and on `invented` ones.

    The sample holds distinct texts with a digit or at sign, those first in a keyed hash
    order; only what lies around these characters is brought to the driver, as many whole
    windows of a text as `chars` characters hold. Labels are the rules' spans.
    """
    usable = in_small_batches(docs).where(F.col("text").rlike("[0-9@]")).select("text")
    chosen = hash_sample(usable, "text", sample)
    rows = chosen.mapInArrow(lambda it: _around(it, chars), "text string").collect()
    examples = [(r["text"], base_spans(r["text"])) for r in rows]
    return train([*examples, *_invented(invented, 5)])


def training_text(text: str, chars: int) -> str:
    """The first whole windows of a text that `chars` characters hold, and one at least.

    Windows that meet are one piece. Where the last one ends inside a span of the rules,
    the piece ends before it.
    """
    pieces: list[list[int]] = []
    length = 0
    for b, e in windows(text):
        meets = bool(pieces) and b <= pieces[-1][1]
        more = e - pieces[-1][1] if meets else e - b + bool(pieces)
        if pieces and length + more > chars:
            break
        length += more
        if meets:
            pieces[-1][1] = e
        else:
            pieces.append([b, e])
    if pieces:
        end = pieces[-1][1]
        cut = [s for s, e, _ in base_spans(text) if s < end < e]
        pieces[-1][1] = max(pieces[-1][0], min(cut, default=end))
    return "\n".join(text[b:e] for b, e in pieces)


def _around(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [training_text(text, chars) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])


def find_spans(docs: DataFrame, model: Tagger) -> DataFrame:
    """`docs` with `base_spans` and `spans`, as `kind:start:end` joined by commas.

    Offsets are code points, ends exclusive, sorted by start and then kind. `spans` are
    the rules' and, where those leave room, the tagger's. A null or empty text has none;
    columns of these names are replaced; an empty table gives no rows.
    """
    docs = in_small_batches(docs).drop("base_spans", "spans")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(
        lambda it: _find(it, shared), f"{fields}, base_spans string, spans string"
    )


def count_kind(spans: str, kind: str) -> Column:
    starts = F.regexp_count(spans, F.lit(f"(^|,){kind}:"))
    return starts.cast("long")


def redact(found: DataFrame) -> DataFrame:
    """`found` with each span of `text` replaced by its kind in brackets.

    Of overlapping spans the first one's kind stands for all of them together. `n_chars`,
    if there, is that of the new text.
    """
    columns = [c for c in found.columns if c not in ("base_spans", "spans")]
    schema = found.select(*columns).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(
                batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True
            ):
                if spans:
                    pieces, at = [], 0
                    for item in spans.split(","):
                        kind, start, end = item.split(":")
                        if int(start) >= at:
                            pieces += [text[at : int(start)], f"[{kind}]"]
                        at = max(at, int(end))
                    text = "".join([*pieces, text[at:]])
                texts.append(text)
            arrays = [
                pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in columns
            ]
            yield pa.RecordBatch.from_arrays(arrays, columns)

    cleaned = in_small_batches(found).select(*columns, "spans").mapInArrow(run, schema)
    if "n_chars" in columns:
        kind = schema["n_chars"].dataType
        touched = F.when(F.col("text").isNotNull(), F.length("text").cast(kind))
        cleaned = cleaned.withColumn("n_chars", F.coalesce(touched, "n_chars"))
    return cleaned
