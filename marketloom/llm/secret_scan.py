"""Secret scan: every rule in one pass over the bytes, by a combined deterministic automaton."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import read_table, text_bytes, tidy


@dataclass(frozen=True)
class Rule:
    """``pattern`` (ASCII) finds leftmost, longest, non-overlapping matches; one whose ``group`` is shorter than
    ``least`` bytes is dropped, after it has used up its text."""
    kind: str
    pattern: str
    ignore_case: bool = False
    group: int = 0
    least: int = 0


# Hex runs are maximal, so their least length can be part of the pattern; a counter in more than one rule would multiply
# the states of the product, so the others are measured once they are found.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", least=18),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES


class _Nfa:
    """Thompson automaton of one rule. Node: (bytes, next) or ('eps', nexts); node 0 accepts."""

    def __init__(self, pattern: str, ignore_case: bool):
        self.edges: list[tuple[frozenset[int], int] | None] = [None]
        self.eps: list[list[int]] = [[]]
        self.ignore_case = ignore_case
        self.start = self._chain(list(re._parser.parse(pattern)), 0)

    def _node(self, edge=None, eps=()) -> int:
        self.edges.append(edge)
        self.eps.append(list(eps))
        return len(self.edges) - 1

    def _bytes(self, codes) -> frozenset[int]:
        codes = set(codes)
        if max(codes) > 127:
            raise ValueError("rules are ASCII only")
        if self.ignore_case:
            codes |= {ord(x) for c in codes for x in (chr(c).lower(), chr(c).upper())}
        return frozenset(codes)

    def _chain(self, items, to: int) -> int:
        for op, arg in reversed(items):
            to = self._piece(str(op), arg, to)
        return to

    def _piece(self, op: str, arg, to: int) -> int:
        if op == "LITERAL":
            return self._node((self._bytes([arg]), to))
        if op == "IN":
            codes: set[int] = set()
            for kind, value in arg:
                if str(kind) == "LITERAL":
                    codes.add(value)
                elif str(kind) == "RANGE":
                    codes.update(range(value[0], value[1] + 1))
                else:
                    raise ValueError(f"not supported in a class: {kind}")
            return self._node((self._bytes(codes), to))
        if op == "SUBPATTERN":
            return self._chain(list(arg[3]), to)
        if op == "BRANCH":
            return self._node(eps=[self._chain(list(x), to) for x in arg[1]])
        if op == "MAX_REPEAT":
            least, most, body = arg
            if most == re._constants.MAXREPEAT:
                loop = self._node()
                self.eps[loop] = [self._chain(list(body), loop), to]
                to = loop
            else:
                for _ in range(most - least):
                    to = self._node(eps=[self._chain(list(body), to), to])
            for _ in range(least):
                to = self._chain(list(body), to)
            return to
        raise ValueError(f"not supported: {op}")

    def closed(self, nodes) -> frozenset[int]:
        seen, todo = set(), list(nodes)
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += self.eps[x]
        return frozenset(x for x in seen if x == 0 or self.edges[x])

    def step(self, nodes: frozenset[int], byte: int) -> frozenset[int]:
        return self.closed(self.edges[x][1] for x in nodes if self.edges[x] and byte in self.edges[x][0])


class _Search:
    """Leftmost-longest search of one rule as a deterministic machine.

    A state is the list of live attempts, oldest first. Once an attempt accepts, the younger ones are dropped and
    it runs on until a byte ends it; the machine reports the end and starts anew at that byte. Rules that would need
    to step back (a match goes on without accepting, or a younger attempt accepts while an older one is undecided) are refused.
    """

    def __init__(self, rule: Rule):
        self.nfa, self.kind = _Nfa(rule.pattern, rule.ignore_case), rule.kind
        self.first = self.nfa.closed([self.nfa.start])
        if 0 in self.first:
            raise ValueError(f"{rule.kind}: matches the empty text")
        self.initial: tuple[frozenset[int], ...] = ()

    @staticmethod
    def accepting(state) -> bool:
        return bool(state) and 0 in state[0]

    def next(self, state, byte: int):
        """(next state, whether a match ended before this byte)."""
        if self.accepting(state):
            on = self.nfa.step(state[0], byte)
            if 0 in on:
                return (on,), False
            if on:
                raise ValueError(f"{self.kind}: a match would need a step back")
            return self._advance((), byte), True
        return self._advance(state, byte), False

    def _advance(self, state, byte: int):
        out: list[frozenset[int]] = []
        seen: set[int] = set()
        for attempt in (*state, self.first):
            on = self.nfa.step(attempt, byte) - seen
            if not on:
                continue
            if 0 in on:
                if out:
                    raise ValueError(f"{self.kind}: a younger match would come first")
                return (on,)
            seen |= on
            out.append(on)
        return tuple(out)


class Automaton:
    """All rules as one minimal automaton: byte classes, a transition array and the match ends on its transitions."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        searches = [_Search(r) for r in rules]
        by_byte = [tuple(b in e[0] for s in searches for e in s.nfa.edges if e) for b in range(256)]
        kinds = {k: i for i, k in enumerate(dict.fromkeys(by_byte))}
        self.classes = bytes(kinds[k] for k in by_byte)
        sample = [self.classes.index(c) for c in range(len(kinds))]
        numbers = {tuple(s.initial for s in searches): 0}
        todo, rows, ended, live = list(numbers), [], [], []
        for state in todo:  # subset construction; the list grows while it is walked
            row, ends = [], []
            for byte in sample:
                steps = [s.next(x, byte) for s, x in zip(searches, state)]
                after = tuple(x for x, _ in steps)
                if after not in numbers:
                    numbers[after] = len(todo)
                    todo.append(after)
                row.append(numbers[after])
                ends.append(sum(1 << k for k, (_, e) in enumerate(steps) if e))
            rows.append(row)
            ended.append(ends)
            live.append(sum(1 << k for k, (s, x) in enumerate(zip(searches, state)) if s.accepting(x)))
        rows, ended, live = np.array(rows), np.array(ended), np.array(live)
        self.subsets = len(rows)
        _, part = np.unique(np.c_[live, ended], axis=0, return_inverse=True)
        part = part.ravel()
        while True:  # minimisation: split classes until equal states agree on every byte class
            _, finer = np.unique(np.c_[part, part[rows]], axis=0, return_inverse=True)
            if finer.max() == part.max():
                break
            part = finer.ravel()
        _, chosen = np.unique(part, return_index=True)
        width = len(sample)
        self.states, self.width = len(chosen), width
        self.limit = self.states * width
        ends = ended[chosen]
        self.table = (part[rows[chosen]] * width + np.where(ends > 0, self.limit, 0)).ravel().tolist()
        self.ends = ends.ravel().tolist()
        self.live = live[chosen].tolist()
        self.initial = int(part[0]) * width
        self.reverse = [_reversed(s.nfa) for s in searches]
        self.inner = [re.compile(r.pattern.encode(), re.IGNORECASE if r.ignore_case else 0) for r in rules]

    def match_ends(self, text: bytes) -> list[tuple[int, int]]:
        """(end, bit set of rules) of every match, from one pass over the bytes."""
        table, limit, state, found = self.table, self.limit, self.initial, []
        for at, c in enumerate(text.translate(self.classes)):
            to = table[state + c]
            if to >= limit:
                found.append((at, self.ends[state + c]))
                to -= limit
            state = to
        if self.live[state // self.width]:
            found.append((len(text), self.live[state // self.width]))
        return found

    def spans(self, text: bytes) -> list[tuple[int, int, int]]:
        """(start, rule number, end) in bytes, ordered."""
        out, before = [], [0] * len(self.rules)
        for end, mask in self.match_ends(text):
            for k, rule in enumerate(self.rules):
                if mask >> k & 1:
                    start = _longest_back(self.reverse[k], text, end, before[k])
                    before[k] = end
                    if rule.least:
                        m = self.inner[k].fullmatch(text[start:end])
                        if len(m[rule.group]) < rule.least:
                            continue
                    out.append((start, k, end))
        return sorted(out)


def _reversed(nfa: _Nfa):
    """Byte steps of the rule read backwards: (entry nodes, into[node] -> [(bytes, node before)], start nodes)."""
    into: dict[int, list[tuple[frozenset[int], int]]] = {}
    for x, edge in enumerate(nfa.edges):
        if edge:
            for y in nfa.closed([edge[1]]):
                into.setdefault(y, []).append((edge[0], x))
    return into, nfa.closed([nfa.start]), {}


def _longest_back(reverse, text: bytes, end: int, least: int) -> int:
    into, first, memo = reverse
    nodes, best = frozenset([0]), end
    for at in range(end - 1, least - 1, -1):
        key = (nodes, text[at])
        if (to := memo.get(key)) is None:
            to = memo[key] = frozenset(x for y in nodes for codes, x in into.get(y, ()) if text[at] in codes)
        if not to:
            break
        nodes = to
        if nodes & first:
            best = at
    return best


def _code_points(text: bytes, spans):
    """The spans with positions counted in characters."""
    if not spans or text.isascii():
        return spans
    count = np.r_[0, np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)]
    return [(int(count[s]), k, int(count[e])) for s, k, e in spans]


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) per row, spans by start, then rule order, in code points.

    Whole texts are scanned; null and empty texts have no spans; repeated rows each get a row; an empty table gives
    none; other columns are not read. One task holds one batch of texts and the transition array.
    """
    automaton = Automaton(rules)
    kinds = [r.kind for r in rules]
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for t in batch.column(1):
                text = t.as_py()
                found.append([{"kind": kinds[k], "start": s, "end": e} for s, k, e in _code_points(text, automaton.spans(text))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(item))], ["doc_id", "spans"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(
        run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span in ``text`` replaced by ``mark``; overlapping spans become one. All columns stay; a null text stays null."""
    automaton = Automaton(rules)
    at = docs.columns.index("text")
    new = mark.encode()

    def clean(text: bytes) -> bytes:
        out, done = [], 0
        for start, _, end in automaton.spans(text):
            if start >= done:
                out += [text[done:start], new]
            done = max(done, end)
        return b"".join(out) + text[done:] if out else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            texts = pa.array([None if (t := x.as_py()) is None else clean(t.encode()) for x in column], pa.binary())
            yield batch.set_column(at, batch.schema.field(at), texts.cast(column.type))
    return docs.mapInArrow(tidy(run), docs.schema)


def op8_secrets(spark, sf_dir: str) -> DataFrame:
    base = [r.kind for r in BASE_RULES]

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")

    def of(kinds):
        return lambda x: x.kind.isin(kinds)
    found = find_secrets(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[F.size(F.filter("spans", of([k]))).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(joined(F.filter("spans", of(base))).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"))
