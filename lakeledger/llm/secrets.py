"""Secret scans with one deterministic automaton for all rules.

Every rule becomes a Thompson NFA over bytes, and by subset construction a DFA that searches: its states are lists of
NFA state sets ordered by where the attempt began, so that the leftmost attempt wins. The DFAs of all rules
run side by side as one product automaton, which is minimised and laid out as a flat transition array over byte
classes. A text is read once; a transition that ends a match of some rule says so. The start of a match is found by
reading the rule backwards from its end.

A rule is accepted when that one pass is enough: a match, once complete, may only grow byte by byte, and no attempt
that began earlier may still be open. Other rules raise ``ValueError`` when compiled.

Null and empty texts have no spans. Positions are code points, ends exclusive. Every row is scanned by itself, a repeated one too. An empty table gives
an empty one; ``redact`` carries all columns along. A very long text is read once like any other, in the memory of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds spans of ``kind``; those with fewer than ``least`` characters in ``group`` are dropped."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


# Base kinds, in the order in which spans that start together are listed. The repetition of hex digits carries its
# minimum itself (a run is matched whole or not at all), which keeps short runs from ending a match all the time.
BASE_RULES = (
    Rule("assign",
         r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|"
         r"[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", least=6, group=2),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}", least=24),
)
# Public token formats on top of the base kinds.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", least=39),
    Rule("private_key", r"-----BEGIN (RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES


class _Nfa:
    """Edges are (set of bytes as a 256-bit integer, target) or (None, target) for an empty step."""

    def __init__(self, pattern: str):
        self.edges: list[list[tuple[int | None, int]]] = []
        self.start = self._state()
        self.end = self._sequence(re._parser.parse(pattern), self.start)

    def _state(self) -> int:
        self.edges.append([])
        return len(self.edges) - 1

    def _sequence(self, items, at: int) -> int:
        for op, value in items:
            at = self._item(str(op), value, at)
        return at

    def _item(self, op: str, value, at: int) -> int:
        if op == "SUBPATTERN":
            return self._sequence(value[3], at)
        if op == "BRANCH":
            out = self._state()
            for option in value[1]:
                first = self._state()
                self.edges[at].append((None, first))
                self.edges[self._sequence(option, first)].append((None, out))
            return out
        if op == "MAX_REPEAT":
            low, high, body = value
            for _ in range(low):
                at = self._sequence(body, at)
            if high == re._constants.MAXREPEAT:
                loop = self._state()
                self.edges[at].append((None, loop))
                self.edges[self._sequence(body, loop)].append((None, loop))
                return loop
            out = self._state()
            for _ in range(high - low):
                self.edges[at].append((None, out))
                at = self._sequence(body, at)
            self.edges[at].append((None, out))
            return out
        target = self._state()
        self.edges[at].append((self._bytes(op, value), target))
        return target

    @staticmethod
    def _bytes(op: str, value) -> int:
        if op == "LITERAL" and value < 128:
            return 1 << value
        if op == "IN":
            found, negated = 0, False
            for kind, item in value:
                if str(kind) == "NEGATE":
                    negated = True
                elif str(kind) == "LITERAL" and item < 128:
                    found |= 1 << item
                elif str(kind) == "RANGE" and item[1] < 128:
                    found |= (1 << item[1] + 1) - (1 << item[0])
                else:
                    raise ValueError(f"not supported in a set: {kind} {item}")
            return (1 << 256) - 1 & ~found if negated else found
        raise ValueError(f"not supported in a rule: {op} {value}")

    def closure(self, states: Iterable[int]) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            for label, target in self.edges[todo.pop()]:
                if label is None and target not in found:
                    found.add(target)
                    todo.append(target)
        return frozenset(found)

    def step(self, states: frozenset[int], byte: int) -> frozenset[int]:
        return self.closure({t for s in states for label, t in self.edges[s] if label is not None and label >> byte & 1})

    def reversed(self) -> _Nfa:
        other = object.__new__(_Nfa)
        other.edges = [[] for _ in self.edges]
        for s, edges in enumerate(self.edges):
            for label, t in edges:
                other.edges[t].append((label, s))
        other.start, other.end = self.end, self.start
        return other


def _byte_groups(nfas: list[_Nfa]) -> tuple[np.ndarray, list[int]]:
    """Class of each byte, and one byte of each class: bytes that no rule tells apart share a class."""
    labels = sorted({label for nfa in nfas for edges in nfa.edges for label, _ in edges if label is not None})
    seen: dict[tuple, int] = {}
    classes = np.zeros(256, np.uint8)
    for byte in range(256):
        classes[byte] = seen.setdefault(tuple(label >> byte & 1 for label in labels), len(seen))
    return classes, [int(np.flatnonzero(classes == c)[0]) for c in range(len(seen))]


def _search_dfa(nfa: _Nfa, samples: list[int]) -> tuple[list[list[int]], list[list[bool]], list[bool]]:
    """(next state, whether a match ends before the byte) per state and byte class, and whether a state has a match."""
    opening = nfa.closure([nfa.start])
    if nfa.end in opening:
        raise ValueError("a rule must not match the empty text")

    def settle(sets: list[frozenset[int]]) -> tuple[frozenset[int], ...]:
        kept: list[frozenset[int]] = []
        taken: set[int] = set()
        for states in [*sets, opening]:
            own = states - taken
            if own:
                kept.append(frozenset(own))
                taken |= own
            if nfa.end in own:
                if len(kept) > 1:
                    raise ValueError("an attempt that began earlier is still open when the rule matches")
                return (frozenset(own),)
        return tuple(kept)

    first = settle([])
    numbers, order, table, ending = {first: 0}, [first], [], []
    for state in order:
        row, ends = [], []
        for byte in samples:
            sets = [nfa.step(states, byte) for states in state]
            if nfa.end in state[0]:
                ends.append(not sets[0])
                if sets[0] and nfa.end not in sets[0]:
                    raise ValueError("a complete match of the rule may only grow byte by byte")
                if not sets[0]:                            # the byte may begin the next match
                    sets = [nfa.step(opening, byte)]
            else:
                ends.append(False)
            after = settle(sets)
            if after not in numbers:
                numbers[after] = len(order)
                order.append(after)
            row.append(numbers[after])
        table.append(row)
        ending.append(ends)
    return table, ending, [nfa.end in state[0] for state in order]


class Automaton:
    """All rules compiled; ``spans`` reads a text once."""

    def __init__(self, rules: Iterable[Rule]):
        self.rules = list(rules)
        nfas = [_Nfa(rule.pattern) for rule in self.rules]
        self.checks = [re.compile(rule.pattern, re.ASCII) for rule in self.rules]
        classes, samples = _byte_groups(nfas)
        self.classes = classes.tobytes()
        parts = [_search_dfa(nfa, samples) for nfa in nfas]
        self.back = [nfa.reversed() for nfa in nfas]
        self.walks: list[dict[tuple[frozenset[int], int], frozenset[int]]] = [{} for _ in nfas]

        first = (0,) * len(parts)
        numbers, order = {first: 0}, [first]
        rows: list[list[int]] = []
        marks: list[list[int]] = []
        for state in order:
            row, mark = [], []
            for c in range(len(samples)):
                after = tuple(part[0][s][c] for part, s in zip(parts, state))
                if after not in numbers:
                    numbers[after] = len(order)
                    order.append(after)
                row.append(numbers[after])
                mark.append(sum(part[1][s][c] << k for k, (part, s) in enumerate(zip(parts, state))))
            rows.append(row)
            marks.append(mark)
        finals = [sum(part[2][s] << k for k, (part, s) in enumerate(zip(parts, state))) for state in order]
        self._lay_out(*self._minimised(np.array(rows), np.array(marks), np.array(finals)))

    @staticmethod
    def _minimised(rows: np.ndarray, marks: np.ndarray, finals: np.ndarray):
        """Blocks of states that no text tells apart, refined until they are stable."""
        _, block = np.unique(np.column_stack([finals, marks]), axis=0, return_inverse=True)
        count = block.max() + 1
        while True:
            _, finer = np.unique(np.column_stack([block, block[rows]]), axis=0, return_inverse=True)
            if finer.max() + 1 == count:
                break
            block, count = finer, finer.max() + 1
        _, shown = np.unique(block, return_index=True)
        shown = [int(np.flatnonzero(block == block[0])[0]), *(int(s) for s in shown if block[s] != block[0])]
        renumber = {int(block[s]): i for i, s in enumerate(shown)}
        new = np.array([[renumber[int(block[t])] for t in rows[s]] for s in shown])
        return new, marks[shown], finals[shown]

    def _lay_out(self, rows: np.ndarray, marks: np.ndarray, finals: np.ndarray) -> None:
        """Flat transition array; an entry below 0 stands for a transition with a mark."""
        width = rows.shape[1]
        self.states, self.width = rows.shape
        self.marked: list[tuple[int, int]] = []
        self.table: list[int] = []
        for row, mark in zip(rows.tolist(), marks.tolist()):
            for after, ended in zip(row, mark):
                if ended:
                    self.marked.append((after * width, ended))
                    self.table.append(-len(self.marked))
                else:
                    self.table.append(after * width)
        self.finals = finals.tolist()

    def _start(self, k: int, data: bytes, end: int, floor: int) -> int:
        """Leftmost start, not before ``floor``, of a match of rule k that ends at ``end``."""
        nfa, walks = self.back[k], self.walks[k]
        states = nfa.closure([nfa.start])
        best = at = end
        while at > floor and states:
            at -= 1
            key = (states, data[at])
            if key not in walks:
                walks[key] = nfa.step(states, data[at])
            states = walks[key]
            if nfa.end in states:
                best = at
        return best

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule number, end) in bytes, by start, then rule."""
        table, marked, state, ended = self.table, self.marked, 0, []
        for i, c in enumerate(data.translate(self.classes)):
            state = table[state + c]
            if state < 0:
                state, mark = marked[-state - 1]
                ended.append((i, mark))
        if final := self.finals[state // self.width]:
            ended.append((len(data), final))
        floors, found = [0] * len(self.rules), []
        for end, mark in ended:
            for k, rule in enumerate(self.rules):
                if mark >> k & 1:
                    start = self._start(k, data, end, floors[k])
                    floors[k] = end
                    value = data[start:end]
                    if rule.group:
                        value = self.checks[k].fullmatch(value.decode("ascii"))[rule.group]
                    if len(value) >= rule.least:
                        found.append((start, k, end))
        return sorted(found)


_READY: dict[tuple, Automaton] = {}


def automaton(rules: tuple[Rule, ...]) -> Automaton:
    if rules not in _READY:
        _READY[rules] = Automaton(rules)
    return _READY[rules]


def spans_of(machine: Automaton, text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points."""
    data = text.encode("utf-8", "replace")
    found = machine.spans(data)
    if len(data) == len(text):
        return [(machine.rules[k].kind, start, end) for start, k, end in found]
    out, at, points = [], 0, 0
    for start, k, end in found:
        points += len(data[at:start].decode("utf-8"))
        at = start
        out.append((machine.rules[k].kind, points, points + end - start))    # matches are ASCII
    return out


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scanned(batches: Iterable[pa.RecordBatch], rules: tuple[Rule, ...], key: str, text: str) -> Iterator[pa.RecordBatch]:
    machine = automaton(rules)
    for batch in batches:
        names = batch.schema.names
        rows = [[{"kind": k, "start": a, "end": b} for k, a, b in spans_of(machine, x.as_py() or "")]
                for x in batch.column(names.index(text))]
        yield pa.RecordBatch.from_arrays([batch.column(names.index(key)), pa.array(rows, SPANS)], [key, "spans"])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans): the spans of every whole text by start, then by the order of the rules; map side only."""
    automaton(rules)                                     # a rule that can't be compiled fails here
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(
        lambda batches: _scanned(batches, rules, key, text),
        f"`{key}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redact_text(text: str, spans: Iterable[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, start, end in spans:
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """All columns of ``docs``, the spans in ``text`` replaced; null texts stay null."""
    automaton(rules)

    def rewritten(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(rules)
        for batch in batches:
            i = batch.schema.names.index(text)
            new = []
            for x in batch.column(i):
                x = x.as_py()
                found = spans_of(machine, x) if x else []
                new.append(redact_text(x, found) if found else x)
            yield batch.set_column(i, batch.schema.field(i), pa.array(new, batch.schema.field(i).type))

    return docs.mapInArrow(rewritten, docs.schema)
