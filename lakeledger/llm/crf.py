"""Document quality from a linear-chain conditional random field over lines.

Every line with a word is good or bad. Node features describe the line itself (letters, capitals, symbols, digits,
repetition, ...) and its neighbours; edge weights reward staying good and staying bad. Forward-backward gives each
line's marginal, and the mean of the marginals weighted by line length is the document's raw quality, which a
logistic curve turns into the probability of label 1.

Labels exist for documents only. Lines start with the label of their document; then lines of bad documents that look
good to a plain logistic regression are called good (never all of them), and the field is fitted to that.

The field is fitted on the driver on a bounded sample: ``PER_CLASS`` documents of each class, of those with at most
``SAMPLE_LINES`` lines. Scoring covers every line of every text and stays on the map side.

Null and empty texts, and texts of white space, have no line that could be good: score 0. Every row is scored
by itself. With no usable labels of one of the classes every other text scores 0.5. An empty table gives an empty one. Columns other than those named are
not looked at, and ``keep_good`` carries them along. A very long text is a chunk of its own.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import learn
from .texts import BLANK, WORD, byte_table, chunks, documents_of, hash_spans, word_bounds

PER_CLASS = 3000
SAMPLE_LINES = 300
SCORE_CUT = 0.3

_UPPER = byte_table((0x41, 0x5A))
_LETTER = byte_table((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xFF))
_POINT = ~byte_table((0x80, 0xBF))
_CLASSES = {
    "letter": _LETTER,
    "upper": _UPPER,
    "latin": byte_table((0x41, 0x5A), (0x61, 0x7A)),
    "digit": byte_table((0x30, 0x39)),
    "symbol": byte_table(*[(b, b) for b in b"#*$%&|<>{}[]\\^~=+_@"]),
    "shout": byte_table((0x21, 0x21)),
    "punct": byte_table(*[(b, b) for b in b".,;:?'\"()-/"]),
    "bar": byte_table((0x7C, 0x7C)),
    "wide": byte_table((0xC0, 0xFF)),
    "solid": ~BLANK & _POINT,
}
# Features of the neighbouring lines: shares of capitals, symbols, shouts, bars, repeated words, and repeated lines.
_NEIGHBOURS = [2, 4, 5, 7, 9, 10]
N_FEATURES = 14


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, lengths in code points, first): lines with a word; those of text i are first[i]:first[i + 1]."""
    n_docs = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))[:len(starts)]

    def counted(table: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int32 if len(data) < 1 << 31 else np.int64)
        np.cumsum(table[data], out=sums[1:])
        return (sums[ends] - sums[starts]).astype(float)

    counts = {name: counted(table) for name, table in _CLASSES.items()}
    some = counts["solid"] > 0
    starts, ends = starts[some], ends[some]
    counts = {name: n[some] for name, n in counts.items()}
    doc = np.searchsorted(offsets, starts, side="right") - 1
    first = np.searchsorted(doc, np.arange(n_docs + 1))
    if not len(starts):
        return np.zeros((0, N_FEATURES), np.float32), np.zeros(0), first

    word_starts, word_ends, _ = word_bounds(data, offsets, WORD)
    line_of_word = np.searchsorted(starts, word_starts, side="right") - 1
    hashes = hash_spans(data, word_starts, word_ends)
    again = np.zeros(len(hashes), bool)
    for back in (1, 2, 3):
        again[back:] |= (hashes[back:] == hashes[:-back]) & (line_of_word[back:] == line_of_word[:-back])
    n_words = np.bincount(line_of_word, minlength=len(starts)).astype(float)
    n_again = np.bincount(line_of_word, again, minlength=len(starts))

    keys = np.stack([doc.astype(np.uint64), hash_spans(data, starts, ends)], axis=1)
    order = np.lexsort((np.arange(len(keys)), keys[:, 1], keys[:, 0]))
    copy = np.zeros(len(keys), bool)
    copy[order[1:]] = (keys[order[1:]] == keys[order[:-1]]).all(axis=1)

    count = counts.__getitem__
    solid, words = count("solid"), np.maximum(n_words, 1)
    last = data[np.maximum(np.minimum(ends, len(data)) - 1, 0)]
    before = data[np.maximum(ends - 2, starts)]
    last = np.where(last == 10, before, last)
    features = np.column_stack([
        np.log1p(solid), count("letter") / solid, count("upper") / np.maximum(count("latin"), 1), count("digit") / solid,
        count("symbol") / solid, count("shout") / solid, count("punct") / solid, count("bar") / words, solid / words,
        n_again / words, copy, np.isin(last, [0x2E, 0x3F, 0x21]), np.log1p(n_words), count("wide") / solid,
    ]).astype(np.float32)
    return features, solid, first


def with_neighbours(features: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Own features, those of the lines before and after (0 beyond the text), edge marks, and a constant."""
    n = len(features)
    own = features.astype(np.float64)
    near = own[:, _NEIGHBOURS]
    head, tail = np.zeros(n, bool), np.zeros(n, bool)
    nonempty = first[1:] > first[:-1]
    head[first[:-1][nonempty]] = True
    tail[first[1:][nonempty] - 1] = True
    before, after = np.zeros_like(near), np.zeros_like(near)
    before[1:] = near[:-1]
    after[:-1] = near[1:]
    before[head] = 0
    after[tail] = 0
    return np.column_stack([own, before, after, head, tail, np.ones(n)])


def chain(node: np.ndarray, first: np.ndarray, stay_good: float, stay_bad: float):
    """Forward-backward over all texts at once: (P(good), P(good, next good), P(bad, next bad)) per line.

    ``node`` are the log-odds of good without the chain. Step t handles the t-th line of every text that has one.
    """
    n = len(node)
    p = learn.sigmoid(node)
    gg, bb = np.exp(stay_good), np.exp(stay_bad)
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    begin, sizes = first[:-1][order], lengths[order]
    steps = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(steps), side="left")      # texts with more than t lines
    forward, backward = np.empty(n), np.empty(n)                         # share of good, normalised
    for t in range(steps):
        at = begin[:active[t]] + t
        if t:
            f = forward[at - 1]
            good, bad = (f * gg + (1 - f)) * p[at], ((1 - f) * bb + f) * (1 - p[at])
        else:
            good, bad = p[at], 1 - p[at]
        forward[at] = good / (good + bad)
    for t in range(steps - 1, -1, -1):
        at = begin[:active[t]] + t
        later = active[t + 1] if t + 1 < steps else 0
        backward[at[later:]] = 0.5
        if later:
            nxt = at[:later] + 1
            good, bad = backward[nxt] * p[nxt], (1 - backward[nxt]) * (1 - p[nxt])
            to_good, to_bad = gg * good + bad, bb * bad + good
            backward[at[:later]] = to_good / (to_good + to_bad)
    good, bad = forward * backward, (1 - forward) * (1 - backward)
    marginal = good / np.maximum(good + bad, 1e-300)
    both_good, both_bad = np.zeros(n), np.zeros(n)
    inner = np.ones(n, bool)
    inner[first[1:][lengths > 0] - 1] = False
    at = np.flatnonzero(inner)
    nxt = at + 1
    g1, b1 = backward[nxt] * p[nxt], (1 - backward[nxt]) * (1 - p[nxt])
    a, b = forward[at] * gg * g1, (1 - forward[at]) * bb * b1
    total = np.maximum(a + b + forward[at] * b1 + (1 - forward[at]) * g1, 1e-300)
    both_good[at], both_bad[at] = a / total, b / total
    return marginal, both_good, both_bad


@dataclass(frozen=True)
class Field:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    stay_good: float
    stay_bad: float
    slope: float
    offset: float

    def raw(self, features: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Length-weighted mean marginal per text, NaN without lines."""
        x = (with_neighbours(features, first) - self.mean) / self.scale
        marginal, _, _ = chain(x @ self.weights, first, self.stay_good, self.stay_bad)
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        mass = np.bincount(doc, lengths, minlength=len(first) - 1)
        return np.where(mass > 0, np.bincount(doc, lengths * marginal, minlength=len(first) - 1)
                        / np.maximum(mass, 1), np.nan)

    def score(self, features: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> np.ndarray:
        raw = self.raw(features, lengths, first)
        return np.where(np.isnan(raw), 0.0, learn.sigmoid(self.slope * _stretch(raw) + self.offset))


def _stretch(raw: np.ndarray) -> np.ndarray:
    return np.log((raw + 0.01) / (1.01 - raw))


def fit_field(features: np.ndarray, lengths: np.ndarray, first: np.ndarray, label: np.ndarray, prior: dict) -> Field | None:
    """A field from sampled documents; ``prior`` has the number of labelled documents of each class."""
    present = np.bincount(label, minlength=2)
    if not len(features) or not present.all():
        return None
    x = with_neighbours(features, first)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    mean[-1], scale[-1] = 0, 1
    x = (x - mean) / scale
    doc = np.repeat(np.arange(len(label)), np.diff(first))
    y = label[doc].astype(float)
    weight = np.sqrt(lengths) / np.array([np.sqrt(lengths)[y == c].sum() for c in (0, 1)])[y.astype(int)]
    looks = x @ learn.logistic(x, y, weight)
    # lines of bad documents that look good are good, but for the worst of each document
    worst = np.full(len(label), np.inf)
    np.minimum.at(worst, doc, looks)
    y = np.where((y == 0) & (looks > 0) & (looks > worst[doc]), 1.0, y)
    follows = np.zeros(len(y), bool)
    follows[:-1] = doc[1:] == doc[:-1]
    at = np.flatnonzero(follows)
    seen_good, seen_bad = (y[at] * y[at + 1]).sum(), ((1 - y[at]) * (1 - y[at + 1])).sum()
    n = len(y)

    def gradient(w: np.ndarray) -> np.ndarray:
        marginal, both_good, both_bad = chain(x @ w[:-2], first, w[-2], w[-1])
        return np.concatenate([x.T @ (y - marginal), [seen_good - both_good.sum(), seen_bad - both_bad.sum()]]) / n \
            - 1e-3 * w

    w = learn.ascend(gradient, np.zeros(x.shape[1] + 2), 120)
    plain = Field(mean, scale, w[:-2], w[-2], w[-1], 1.0, 0.0)
    raw = plain.raw(features, lengths, first)
    known = ~np.isnan(raw)
    z = np.column_stack([_stretch(raw[known]), np.ones(known.sum())])
    share = np.array([prior.get(c, 0) / present[c] for c in (0, 1)])[label[known]]
    slope, offset = learn.logistic(z, label[known].astype(float), share, steps=400, ridge=1e-6)
    return Field(mean, scale, w[:-2], w[-2], w[-1], max(slope, 1e-3), offset)


def _all_lines(batch: pa.RecordBatch, text: str):
    """Features of a batch, computed chunk by chunk."""
    data, offsets = documents_of(batch, text)
    features, lengths, firsts, n = [np.zeros((0, N_FEATURES), np.float32)], [np.zeros(0)], [np.zeros(1, np.int64)], 0
    for low, high in chunks(offsets):
        f, size, first = line_features(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
        features.append(f)
        lengths.append(size)
        firsts.append(first[1:] + n)
        n += len(f)
    return np.concatenate(features), np.concatenate(lengths), np.concatenate(firsts)


def _described(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        features, lengths, first = _all_lines(batch, "_text")
        spans = list(zip(first[:-1].tolist(), first[1:].tolist()))
        yield pa.RecordBatch.from_arrays([
            batch.column(batch.schema.names.index("_label")),
            pa.array([features[a:b].tobytes() for a, b in spans], pa.binary()),
            pa.array([lengths[a:b].astype(np.float32).tobytes() for a, b in spans], pa.binary()),
        ], ["label", "features", "lengths"])


def fit(docs: DataFrame, labels: DataFrame, usable: Column, key: str = "doc_id", text: str = "text",
        label: str = "quality", per_class: int = PER_CLASS, sample_lines: int = SAMPLE_LINES) -> Field | None:
    """The field learned from documents whose label row satisfies ``usable``; None without both classes."""
    sample, prior = learn.labelled_sample(labels, usable, per_class, key, label)
    texts = docs.select(F.col(key), F.coalesce(text, F.lit("")).alias("_text"))
    texts = texts.filter(F.size(F.split("_text", "\n")) <= sample_lines)
    chosen = texts.join(F.broadcast(sample), key).select("_label", "_text")
    rows = chosen.mapInArrow(_described, "label int, features binary, lengths binary").collect()
    rows.sort(key=lambda row: (row["label"], bytes(row["features"])))      # the same sums whatever the task order
    if not rows:
        return None
    features = np.concatenate([np.frombuffer(r["features"], np.float32) for r in rows]).reshape(-1, N_FEATURES)
    lengths = np.concatenate([np.frombuffer(r["lengths"], np.float32) for r in rows]).astype(float)
    first = np.concatenate([[0], np.cumsum([len(r["lengths"]) // 4 for r in rows])])
    return fit_field(features, lengths, first, np.array([r["label"] for r in rows]), prior)


def _scores(field: Field | None, batch: pa.RecordBatch, text: str) -> np.ndarray:
    features, lengths, first = _all_lines(batch, text)
    if field is None:
        return np.where(np.diff(first) > 0, 0.5, 0.0)
    return field.score(features, lengths, first)


def score(docs: DataFrame, field: Field | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) per row."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(field))

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = pickle.loads(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.names.index(key)), pa.array(_scores(field, batch, text))], [key, "score"])

    return docs.select(key, text).mapInArrow(scored, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, field: Field | None, cut: float = SCORE_CUT, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least ``cut``."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(field))

    def kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = pickle.loads(shared.value)
        for batch in batches:
            yield batch.filter(pa.array(_scores(field, batch, text) >= cut))

    return docs.mapInArrow(kept, docs.schema)
