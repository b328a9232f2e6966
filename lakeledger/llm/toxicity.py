"""Toxicity from gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a lexicon, hits near the second person, obfuscated hits, capitals, punctuation and
obfuscation rates. The lexicon is learned: words in a normal form (lower case, look-alike digits and signs undone,
doubled letters made single), and beginnings of words, whose document frequency differs most between toxic and
other sampled documents.

Everything is fitted on a bounded sample, ``PER_CLASS`` labelled documents of each class in hash order, cut by hash into a part for
the lexicon, one for the trees and one for the calibration. Document frequencies are counted by Spark; the few thousand feature
rows are fitted on the driver. Scoring covers every whole text and stays on the map side.

Null and empty texts score like a text without any word; every row is scored by itself. With no usable labels of one
of the classes every text scores the share of toxic labels (0 without labels). An empty table gives an empty one; columns other than those named are not looked
at. A very long text is a chunk of its own.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import learn
from .texts import LOWER, WORD, byte_table, chunks, documents_of, hash_spans, word_bounds

PER_CLASS = 4000
LEXICON = 400               # words at most
LEAST_DOCUMENTS = 3         # toxic sample documents that a lexicon word must occur in
NEAR = 5                    # words
STEMS = (4, 5)              # first bytes of longer words that may stand in the lexicon for all their forms
SCORE_CUT = 0.3
TREES, DEPTH, BINS = 60, 3, 32

# Second person, as text: English, German, French, Spanish.
SECOND_PERSON = "you your yours yourself du dich dir dein deine ihr euch tu te toi ton ta tes vous votre usted tú ti tus"

_LOOK_ALIKE = dict(zip(b"0134578@$!", b"oieastbasi"))
_FORM = LOWER.copy()
for _sign, _letter in _LOOK_ALIKE.items():
    _FORM[_sign] = _letter
_LETTER = byte_table((0x61, 0x7A), (0x80, 0xFF))
_PLAIN = byte_table((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_UPPER = byte_table((0x41, 0x5A))
N_FEATURES = 15


def word_forms(data: np.ndarray, offsets: np.ndarray):
    """(forms, whether a sign stands between letters, starts, ends, first) of all words.

    ``forms`` has a column for the normal form and one for its first bytes of every length in ``STEMS``: hashes, 0 for none.
    """
    starts, ends, first = word_bounds(data, offsets, WORD)
    plain = _PLAIN[data]
    # signs at the edge of a word are punctuation; between letters they stand for one
    letters = np.concatenate([[0], np.cumsum(plain, dtype=np.int64)])
    position = np.arange(len(data))
    word = np.cumsum(np.bincount(starts, minlength=len(data) + 1)[:len(data)]) - 1
    word = np.minimum(np.maximum(word, 0), max(len(starts) - 1, 0))
    if len(starts):
        inside = (letters[position] > letters[starts][word]) & (letters[ends][word] > letters[position + 1]) & WORD[data]
    else:
        inside = np.zeros(len(data), bool)
    shape = np.where(plain, LOWER[data], np.where(inside, _FORM[data], 0)).astype(np.uint8)
    kept = _LETTER[shape]
    kept[1:] &= (shape[1:] != shape[:-1]) | (shape[1:] >= 0x80) | ~WORD[data[:-1]]
    places = np.concatenate([[0], np.cumsum(kept, dtype=np.int64)])
    low, high, shape = places[starts], places[ends], shape[kept]
    forms = np.zeros((len(starts), 1 + len(STEMS)), np.uint64)
    forms[:, 0] = np.where(low < high, hash_spans(shape, low, high), np.uint64(0))
    for k, length in enumerate(STEMS, 1):
        long = high - low > length
        forms[long, k] = hash_spans(shape, low[long], low[long] + length, 1)
    signs = np.concatenate([[0], np.cumsum(inside & ~plain, dtype=np.int64)])
    return forms, signs[ends] > signs[starts], starts, ends, first


def form_hash(word: str) -> int:
    data = np.frombuffer(word.encode("utf-8"), np.uint8)
    return int(word_forms(data, np.array([0, len(data)]))[0][0, 0])


_SECOND = np.unique(np.array([form_hash(w) for w in SECOND_PERSON.split()], np.uint64))


def _member(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places in the sorted ``known``, -1 for none."""
    if not len(known):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, at, -1)


def features(data: np.ndarray, offsets: np.ndarray, words: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One row per text; ``words`` are the sorted hashes of the lexicon, ``weights`` their log-odds."""
    n_docs = len(offsets) - 1
    forms, signed, starts, ends, first = word_forms(data, offsets)
    hashes = forms[:, 0]
    doc = np.repeat(np.arange(n_docs), np.diff(first))

    def per_doc(values: np.ndarray) -> np.ndarray:
        return np.bincount(doc, values, minlength=n_docs)

    def bytes_of(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)

    at, weight = np.full(len(hashes), -1), np.zeros(len(hashes))
    for form in forms.T:
        found = _member(form, words)
        at = np.where(at < 0, found, at)
        if len(weights):
            weight = np.maximum(weight, np.where(found >= 0, weights[found], 0.0))
    hit = at >= 0
    second = _member(hashes, _SECOND) >= 0
    sums = np.concatenate([[0], np.cumsum(second)])
    index = np.arange(len(hashes))
    low = np.maximum(index - NEAR, first[:-1][doc]) if len(hashes) else index
    high = np.minimum(index + NEAR + 1, first[1:][doc]) if len(hashes) else index
    near = hit & (sums[high] > sums[low])
    n = np.diff(first).astype(float)
    per = np.maximum(n, 1)
    strongest = np.zeros(n_docs)
    np.maximum.at(strongest, doc, weight)
    kinds = np.bincount(np.unique(np.column_stack([doc[hit], at[hit]]), axis=0)[:, 0], minlength=n_docs) \
        if hit.any() else np.zeros(n_docs)
    uppers = np.concatenate([[0], np.cumsum(_UPPER[data], dtype=np.int64)])
    loud = (uppers[ends] - uppers[starts] >= np.maximum(2, (ends - starts) * 0.6))
    letters = np.maximum(bytes_of(_PLAIN), 1)
    return np.column_stack([
        np.log1p(n), np.log1p(per_doc(hit)), per_doc(hit) / per, per_doc(weight) / per, strongest, kinds,
        per_doc(near) / per, np.log1p(per_doc(near)), per_doc(hit & signed) / per, per_doc(signed) / per,
        bytes_of(_UPPER) / letters, per_doc(loud) / per, bytes_of(byte_table((0x21, 0x21))) / per,
        bytes_of(byte_table((0x3F, 0x3F))) / per, per_doc(second) / per,
    ])


@dataclass(frozen=True)
class Trees:
    """Additive trees of equal depth: feature and cut of each inner node in level order, and a value per leaf."""

    start: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - (2**DEPTH - 1)]
        return total


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES, rate: float = 0.15, ridge: float = 1.0) -> Trees:
    """Logistic boosting on histograms of quantile bins."""
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    bins = np.column_stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T)])
    share = np.clip((weight * y).sum() / weight.sum(), 1e-6, 1 - 1e-6)
    start = float(np.log(share / (1 - share)))
    total = np.full(len(y), start)
    inner, size = 2**DEPTH - 1, BINS + 1
    all_features, all_cuts, all_leaves = [], [], []
    for _ in range(trees):
        p = learn.sigmoid(total)
        gradient, curvature = weight * (y - p), weight * p * (1 - p)
        feature, cut, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            base, width = 2**level - 1, 2**level
            best = np.full(width, 1e-9)
            for f in range(x.shape[1]):
                slot = (node - base) * size + bins[:, f]
                g = np.bincount(slot, gradient, minlength=width * size).reshape(width, size).cumsum(axis=1)
                h = np.bincount(slot, curvature, minlength=width * size).reshape(width, size).cumsum(axis=1)
                gain = g**2 / (h + ridge) + (g[:, -1:] - g)**2 / (h[:, -1:] - h + ridge) - g[:, -1:]**2 / (h[:, -1:] + ridge)
                usable = gain[:, :len(cuts[f])]
                if not usable.shape[1]:
                    continue
                at = usable.argmax(axis=1)
                better = usable[np.arange(width), at] > best
                best = np.where(better, usable[np.arange(width), at], best)
                feature[base:base + width][better] = f
                cut[base:base + width][better] = cuts[f][at[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        node -= inner
        g = np.bincount(node, gradient, minlength=inner + 1)
        h = np.bincount(node, curvature, minlength=inner + 1)
        leaf = rate * g / (h + ridge)
        total += leaf[node]
        all_features.append(feature)
        all_cuts.append(cut)
        all_leaves.append(leaf)
    return Trees(start, np.array(all_features), np.array(all_cuts), np.array(all_leaves))


@dataclass(frozen=True)
class Model:
    words: np.ndarray
    weights: np.ndarray
    trees: Trees | None
    knots: np.ndarray
    values: np.ndarray

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(offsets) - 1, self.values[0])
        return np.interp(self.trees.raw(features(data, offsets, self.words, self.weights)), self.knots, self.values)


def _distinct_forms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = documents_of(batch, "_text")
        label = np.asarray(batch.column(batch.schema.names.index("_label")))
        for low, high in chunks(offsets):
            forms, _, _, _, first = word_forms(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
            doc = np.repeat(np.arange(low, high), np.diff(first)).astype(np.uint64)
            pairs = np.column_stack([np.tile(doc, forms.shape[1]), forms.T.ravel()])
            pairs = np.unique(pairs[pairs[:, 1] != 0], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 1].view(np.int64)), pa.array(label[pairs[:, 0].astype(np.int64)])],
                                             ["form", "label"])


def learn_lexicon(chosen: DataFrame, counts: dict, size: int = LEXICON) -> tuple[np.ndarray, np.ndarray]:
    """(sorted form hashes, log-odds) of the words whose share of toxic documents stands out most."""
    forms = chosen.mapInArrow(_distinct_forms, "form bigint, label int")
    seen = forms.groupBy("form").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("other"))
    toxic, other = max(counts.get(1, 0), 1), max(counts.get(0, 0), 1)
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("other") + 0.5) / (other + 1.0))
    spread = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("other") + 0.5))
    rows = (seen.filter(F.col("toxic") >= LEAST_DOCUMENTS).select("form", odds.alias("odds"), (odds / spread).alias("z"))
            .filter("z > 3").orderBy(F.desc("z"), "form").limit(size).collect())
    words = np.array([row["form"] for row in rows], np.int64).view(np.uint64)
    order = np.argsort(words)
    return words[order], np.array([row["odds"] for row in rows])[order]


def _described(words: np.ndarray, weights: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _apply(batch, "_text", lambda data, offsets: features(data, offsets, words, weights))
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays(
                [batch.column(names.index("_label")), batch.column(names.index("_part")),
                 pa.array([row.tobytes() for row in rows], pa.binary())], ["label", "part", "features"])

    return run


def _apply(batch: pa.RecordBatch, text: str, function) -> np.ndarray:
    data, offsets = documents_of(batch, text)
    parts = [function(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]) for a, b in chunks(offsets)]
    return np.concatenate(parts) if parts else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", label: str = "toxic",
        per_class: int = PER_CLASS) -> Model:
    """The model learned from documents whose label row satisfies ``usable``."""
    sample, prior = learn.labelled_sample(labels, usable, per_class, key, label)
    none = np.zeros(0)
    share = prior.get(1, 0) / max(1, sum(prior.values()))
    fallback = Model(none.astype(np.uint64), none, None, none, np.array([share]))
    if len(prior) < 2:
        return fallback
    part = F.pmod(F.xxhash64(F.col(key), F.lit("part")), F.lit(10))
    chosen = docs.select(F.col(key), F.coalesce(text, F.lit("")).alias("_text")).join(
        F.broadcast(sample.withColumn("_part", part)), key).select("_label", "_part", "_text")
    first = chosen.filter("_part < 3")
    counts = {r["_label"]: r["count"] for r in first.groupBy("_label").count().collect()}
    words, weights = learn_lexicon(first, counts)
    rows = chosen.filter("_part >= 3").mapInArrow(_described(words, weights), "label int, part bigint, features binary").collect()
    rows.sort(key=lambda r: (r["part"], r["label"], bytes(r["features"])))
    if not rows:
        return fallback
    x = np.frombuffer(b"".join(r["features"] for r in rows)).reshape(-1, N_FEATURES)
    y = np.array([r["label"] for r in rows], float)
    held = np.array([r["part"] for r in rows]) >= 7
    present = np.bincount(y.astype(int), minlength=2)
    if not present.all() or len(set(y[~held])) < 2:
        return fallback
    weight = np.array([prior[c] / present[c] for c in (0, 1)])[y.astype(int)]
    weight /= weight.mean()
    trees = boost(x[~held], y[~held], weight[~held])
    check = held if len(set(y[held])) == 2 else np.ones(len(y), bool)
    knots, values = learn.isotonic(trees.raw(x[check]), y[check], weight[check])
    return Model(words, weights, trees, knots, values)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) per row."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.names.index(key)), pa.array(_apply(batch, text, model.score), pa.float64())],
                [key, "score"])

    return docs.select(key, text).mapInArrow(scored, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double")
