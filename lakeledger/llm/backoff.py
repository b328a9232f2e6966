"""Language-model scores from a weighted backoff automaton.

The model is a smoothed n-gram model of the training documents, trigrams unless ``order`` says otherwise. A state is a history: up to
``order - 1`` words that training has in this sequence, or the start of a text with up to ``order - 2`` words; the root is the history of no word. A seen
n-gram is an arc of its history h with the interpolated probability ``m(h) * c(hw) / c(h) + (1 - m(h)) * p(w | h')``,
``m(h) = MIX * c(h) / (c(h) + PRIOR)`` (rare histories are trusted less), h' being h without its first word. Where a state has no arc for
a word, its failure arc leads to the state of h' at the cost of ``1 - m(h)``, from there to the next shorter one, and the root has an arc for
every word, ``p(w) = (c + 0.1) / (N + 0.1 (V + 1))``. The probabilities after any history sum to one.
A text is read from left to right: a state is carried, the logarithms add up. All texts of a block take their steps together, in lanes of ``STRIDE`` words.

No machine holds the automaton. Counts of n-grams are summed in shards of the hash space, as many as the texts' bytes ask for; each block of
documents (see ``blobs``) asks for the n-grams it contains, gets their counts in all training documents back, builds the part of the
automaton that its texts can reach, which is exactly what the whole one would do on them, and reads its texts.

Words are runs of non-blank bytes after lower-casing A-Z, known by 64-bit hashes; every text ends with an end token. Longer n-grams are
known by 48 bits, which halves what is sent; of 10^9 different ones about 1 in 500,000 shares its count with another.
A null text is an empty one, which consists of the end token. Repeated rows are learned from and scored each. An empty table gives an
empty one; only key, text and what ``learn`` names are looked at. A very long text is a block of its own.
``docs`` must read the same twice (a table, not a random sample).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .blobs import blocks, from_planes, from_steps, planes, shard_edges, steps
from .texts import LOWER, WORD, hash_spans, mix as spread, word_bounds

MIX = 0.5
PRIOR = 10.0
ADD = 0.1
ORDER = 3
GRAM_BITS = 48              # of the hash of an n-gram of two words or more
SHARD_BYTES = 8 << 20       # of text whose n-grams of one length a shard counts
STRIDE = 64                 # words that a lane reads
END = np.uint64(0x5D6D9B1F2E8C4A73)        # stands for the end of a text
START = np.uint64(0xA24BAED4963EE407)      # history of the first token; never a token itself


def token_stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): tokens of all texts, the end token after each text's words."""
    data = LOWER[data]
    starts, ends, first = word_bounds(data, offsets, WORD)
    n_docs = len(offsets) - 1
    tokens = np.empty(len(starts) + n_docs, np.uint64)
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    tokens[np.arange(len(starts)) + doc] = hash_spans(data, starts, ends)
    first = first + np.arange(n_docs + 1)
    tokens[first[1:] - 1] = END
    return tokens, first


def gram_hashes(tokens: np.ndarray, first: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per length up to ``order`` (hash of the n-gram that ends at each token, whether there is one). The start of a text counts as a word."""
    place = np.arange(len(tokens)) - np.repeat(first[:-1], np.diff(first))
    hashes, there = tokens, np.ones(len(tokens), bool)
    out = [(hashes, there)]
    for n in range(2, order + 1):
        before = np.empty_like(tokens)
        before[1:] = hashes[:-1]
        before[first[:-1]] = START
        hashes, there = spread(spread(before) + tokens), place >= n - 2
        out.append((hashes >> np.uint64(64 - GRAM_BITS), there))
    return out


def _edges(length: int, shards: int) -> np.ndarray:
    """Lower ends of the ranges of the hashes of n-grams of a length."""
    return shard_edges(shards) if length == 0 else np.array([(p << GRAM_BITS) // shards for p in range(shards)], np.uint64)


def _asked(batches: Iterable[pa.RecordBatch], shards: int, order: int) -> Iterator[pa.RecordBatch]:
    """Per block and shard the n-grams of the block and how often its training documents have each."""
    edges = [_edges(length, shards) for length in range(order)]
    for block, rows, data, offsets in blocks(batches, "_text"):
        tokens, first = token_stream(data, offsets)
        learn = np.asarray(rows.column(rows.schema.names.index("_learn")).fill_null(False))
        weight = np.repeat(learn, np.diff(first))
        out = []
        for length, (grams, there) in enumerate(gram_hashes(tokens, first, order)):
            kinds, place = np.unique(grams[there], return_inverse=True)
            counts = np.bincount(place, weight[there], minlength=len(kinds)).astype(np.uint32)
            cut = [*np.searchsorted(kinds, edges[length]).tolist(), len(kinds)]
            for p in range(shards):
                if cut[p] < cut[p + 1]:
                    out.append((length * shards + p, steps(kinds[cut[p]:cut[p + 1]], int(edges[length][p])), planes(counts[cut[p]:cut[p + 1]])))
        yield pa.RecordBatch.from_arrays(
            [pa.array([s for s, _, _ in out], pa.int32()), pa.array([block] * len(out), pa.int64()),
             pa.array([g for _, g, _ in out], pa.binary()), pa.array([c for _, _, c in out], pa.binary())],
            ["shard", "block", "grams", "counts"])


def _answers(shards: int):
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        base = int(_edges(shard // shards, shards)[shard % shards])
        grams = [from_steps(g, base) for g in table.column("grams").to_pylist()]
        counts = np.concatenate([from_planes(c, np.uint32) for c in table.column("counts").to_pylist()])
        kinds, place = np.unique(np.concatenate(grams), return_inverse=True)
        totals = np.bincount(place, counts)
        back = totals[place].astype(np.uint64)
        cut = np.cumsum([len(g) for g in grams])[:-1]
        # the last row, of no block, has the numbers of training tokens and of different ones
        known = totals > 0
        blocks_ = [*table.column("block").to_pylist(), None]
        return pa.table({
            "block": pa.array(blocks_, pa.int64()), "shard": pa.array([shard] * len(blocks_), pa.int32()),
            "counts": pa.array([*map(planes, np.split(back, cut)), None], pa.binary()),
            "tokens": pa.array([None] * len(grams) + [int(totals.sum())], pa.int64()),
            "kinds": pa.array([None] * len(grams) + [int(known.sum())], pa.int64())})

    return run


def _told(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block its keys, text lengths in tokens, sorted words, and every token as a number among them."""
    for block, rows, data, offsets in blocks(batches, "_text"):
        tokens, first = token_stream(data, offsets)
        words, place = np.unique(tokens, return_inverse=True)
        keys = rows.column(0)
        yield pa.RecordBatch.from_arrays([
            pa.array([block], pa.int64()),
            pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
            pa.array([planes(np.diff(first).astype(np.uint32))], pa.binary()),
            pa.array([steps(words, 0)], pa.binary()), pa.array([planes(place.astype(np.uint32))], pa.binary())],
            ["block", "keys", "lengths", "words", "places"])


class Automaton:
    """The part of the model that a block's texts can reach.

    States are numbers: the root, the start of a text, then known histories. ``arcs`` are sorted numbers state * width + word, with weights and
    targets; ``failure`` has the weight and target of every state's failure arc, ``root_arcs`` those of the root's arc for every word.
    """

    ROOT, START = 0, 1

    def __init__(self, stream: np.ndarray, first: np.ndarray, grams: list[tuple[np.ndarray, np.ndarray, np.ndarray]],
                 texts: int, tokens: int, kinds: int, mix: float, add: float):
        """``stream`` are the numbers of the words of all texts. Per length, ``grams`` are (number of the n-gram that ends at each place or -1, a
        place of each n-gram, its count in training); those of one word are the words. ``texts``: number of training texts."""
        order = self.order = len(grams)
        starts = np.zeros(len(stream), bool)
        starts[first[:-1]] = True
        ends = np.zeros(len(stream), bool)
        ends[first[1:] - 1] = True
        number, place, count = grams[0]
        self.width = len(count)
        p = (count + add) / (tokens + add * (kinds + 1))
        alive = count > 0                                 # an n-gram that ends its text is no history
        alive[stream[ends]] = False
        state = np.where(alive, np.cumsum(alive) + self.START, self.ROOT)
        n_states = self.START + 1 + int(alive.sum())
        self.root_arcs = np.log10(p), state if order > 1 else np.zeros(len(p), np.int64)
        share = mix * texts / (texts + PRIOR) if order > 1 else 0.0
        failure_weights, failure_to = [[0.0, np.log10(1 - share)]], [[self.ROOT, self.ROOT]]
        keys, weights, targets = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)]
        for length in range(2, order + 1):
            # histories of the length before: their failure arcs
            held = mix * count / (count + PRIOR)
            failure_weights.append(np.log10(1 - held[alive]))
            failure_to.append(np.full(int(alive.sum()), self.ROOT) if length == 2 else shorter[place[alive]])
            # their arcs
            longer, at, seen = grams[length - 1]
            arc = np.flatnonzero(seen > 0)
            where = at[arc]
            opening = starts[where]
            before = number[np.where(opening, where, where - 1)]
            history = np.where(opening, texts, count[before])
            own = np.where(opening, share, held[before])
            q = np.zeros(len(seen))
            q[arc] = own * seen[arc] / history + (1 - own) * p[number[where]]
            keys.append(np.where(opening, self.START, state[before]) * self.width + stream[where])
            weights.append(np.log10(q[arc]))
            shorter = state[number]                       # per place the state of the longest known history one word shorter
            if length < order:
                alive = (seen > 0) & ~ends[at]
                new = np.where(alive, n_states + np.cumsum(alive) - 1, shorter[at])
                n_states += int(alive.sum())
                targets.append(new[arc])
                number, place, count, p, state = np.maximum(longer, 0), at, seen, q, new
                # where a text is too young for an n-gram of this length, the history is the shorter one: no arc asks for it
            else:
                targets.append(shorter[where])
        arcs = np.concatenate(keys)
        by_key = np.argsort(arcs, kind="stable")
        self.arcs, self.weights, self.targets = arcs[by_key], np.concatenate(weights)[by_key], np.concatenate(targets)[by_key]
        self.failure_weights = np.concatenate(failure_weights)
        self.failure_to = np.concatenate(failure_to).astype(np.int64)

    def step(self, state: np.ndarray, word: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Reads a word from every state: adds the logarithms to ``total`` and returns the states reached."""
        reached = np.empty_like(state)
        open_, at = np.arange(len(state)), state
        while True:
            key = at * self.width + word[open_]
            arc = np.searchsorted(self.arcs, key)
            hit = self.arcs[np.minimum(arc, len(self.arcs) - 1)] == key if len(self.arcs) else np.zeros(len(key), bool)
            total[open_[hit]] += self.weights[arc[hit]]
            reached[open_[hit]] = self.targets[arc[hit]]
            open_, at = open_[~hit], at[~hit]
            end = at == self.ROOT
            done = open_[end]
            total[done] += self.root_arcs[0][word[done]]
            reached[done] = self.root_arcs[1][word[done]]
            open_, at = open_[~end], at[~end]
            if not len(open_):
                return reached
            total[open_] += self.failure_weights[at]
            at = self.failure_to[at]

    def read(self, stream: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 probability of every text.

        Texts are read in lanes of ``STRIDE`` words, all lanes together. A state remembers no more than the words of the longest history, so a lane
        that starts inside a text comes into its state by reading so many words before it, which do not count.
        """
        length = np.diff(first)
        lanes = -(-length // STRIDE)
        text = np.repeat(np.arange(len(length)), lanes)
        begin = first[text] + (np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * STRIDE
        stop = np.minimum(begin + STRIDE, first[text + 1])
        at = np.maximum(begin - (self.order - 1), first[text])
        by_length = np.argsort(at - stop, kind="stable")                  # the longest first: those that go on are a prefix
        at, begin, stop, text = (x[by_length] for x in (at, begin, stop, text))
        state = np.where(at == first[text], self.START, self.ROOT)
        total, unread = np.zeros(len(at)), np.zeros(len(at))
        steps_left = stop - at
        for t in range(int(steps_left[0]) if len(at) else 0):
            on = int(np.searchsorted(-steps_left, -t, side="left"))
            place = at[:on] + t
            unread[:on] = 0
            state[:on] = self.step(state[:on], stream[place], unread[:on])
            total[:on] += np.where(place >= begin[:on], unread[:on], 0)
        return np.bincount(text, total, minlength=len(length))


def numbered(hashes: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Per length (number of the n-gram at each place or -1, a place of each, how many)."""
    out = []
    for values, there in hashes:
        places = np.flatnonzero(there)
        _, one, back = np.unique(values[places], return_index=True, return_inverse=True)
        number = np.full(len(values), -1)
        number[places] = back
        out.append((number, places[one], len(one)))
    return out


def _read(shards: int, order: int, tokens: int, kinds: int, texts: int, mix: float, add: float):
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        if block.num_rows != 1 or not answers.num_rows:
            raise ValueError("the documents were not read in the same blocks twice")
        keys = block.column("keys").chunk(0).flatten()
        lengths = from_planes(block.column("lengths")[0].as_py(), np.uint32).astype(np.int64)
        words = from_steps(block.column("words")[0].as_py(), 0)
        stream = from_planes(block.column("places")[0].as_py(), np.uint32).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(lengths)])
        rows = sorted(zip(answers.column("shard").to_pylist(), answers.column("counts").to_pylist()))
        counts = [np.concatenate([np.zeros(0), *[from_planes(c, np.uint64) for s, c in rows if s // shards == length]]) for length in range(order)]
        grams = numbered(gram_hashes(words[stream], first, order))
        if any(n != len(c) for (_, _, n), c in zip(grams, counts)):
            raise ValueError("the documents were not read in the same blocks twice")
        machine = Automaton(stream, first, [(number, place, c) for (number, place, _), c in zip(grams, counts)], texts, tokens, kinds, mix, add)
        return pa.table({
            "key": keys, "n_tokens": lengths, "n_known": np.add.reduceat((counts[0] > 0)[stream].astype(np.int64), first[:-1]),
            "base_score": np.add.reduceat(machine.root_arcs[0][stream], first[:-1]), "score": machine.read(stream, first)})

    return run


def score(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", order: int = ORDER, mix: float = MIX,
          add: float = ADD) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) per row; the model learns from the rows where ``learn`` holds.

    ``base_score`` is the unigram log10 probability, ``score`` that of the automaton of n-grams up to ``order`` (1 or more).
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    texts = docs.select(F.col(key), F.col(text).alias("_text"), F.coalesce(learn, F.lit(False)).alias("_learn"))
    sizes = texts.agg(F.count_if("_learn").alias("texts"), F.coalesce(F.sum(F.octet_length("_text")), F.lit(0)).alias("bytes")).first()
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sizes["bytes"] // SHARD_BYTES))     # of every length
    asked = texts.mapInArrow(lambda batches: _asked(batches, shards, order), "shard int, block bigint, grams binary, counts binary")
    answers = cut_lineage(asked.groupBy("shard").applyInArrow(
        _answers(shards), "block bigint, shard int, counts binary, tokens bigint, kinds bigint"))
    sums = answers.filter(F.col("block").isNull() & (F.col("shard") < shards)).agg(
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("kinds"), F.lit(0)).alias("kinds")).first()
    told = texts.mapInArrow(_told, f"block bigint, keys array<{kind}>, lengths binary, words binary, places binary")
    back = answers.filter(F.col("block").isNotNull()).select("block", "shard", "counts")
    scored = told.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(
        _read(shards, order, sums["tokens"], sums["kinds"], sizes["texts"], mix, add),
        f"key {kind}, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select(F.col("key").alias(key), "n_tokens", "n_known", F.lit(sums["tokens"]).cast("bigint").alias("train_tokens"),
                         "base_score", "score")
