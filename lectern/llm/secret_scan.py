"""Operator 9: secret scans by one combined deterministic automaton.

All rules are compiled together, twice, into transition arrays over byte classes: parsed to a nondeterministic automaton,
made deterministic by subset construction, and minimised by partition refinement.

1. *The scan* may begin a rule at any byte (the start is always live); its accepting state is absorbing and says that a
   rule's least occurrence has been read. One pass over the bytes steps many pieces of the texts side by side. Pieces end at reset bytes,
   those that lead every state back to the start; where there is none for long, they end anywhere and the state is carried on: a piece is
   stepped again if the one before it did not end in the state that it began in.
2. *The spans* come from the automaton of all whole rules, begun at one byte. Its states are tagged with the rules accepted there and with
   those still possible. In the stretches that the scan accepted, each place where some rule lives for four bytes is a start; from it the
   automaton runs until no rule that may begin there is possible, and the last accepting place of each rule ends its
   match: leftmost, longest, without overlap for each kind.

Kinds, in order: assign, access, hex (the base), then private_key, forge_token and chat_token.

Offsets are code points, ends exclusive. Defined results: a null text counts as empty and has no
spans; a null ``doc_id`` stays null; repeated rows each give a row; spans of the same start go by kind as listed; a very long text, or a
line without a reset byte, is cut into pieces like any other; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.textkernel import runs, splitmix

#: (kind, what has to occur for a span to be kept, the whole rule, least length, whether the length counts from the first accepting
#: place, i.e. of the value alone). (?i:...) ignores the case of A-Z. A match shorter than that is dropped, but nothing of its kind begins in it.
RULES = (
    ("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6}", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+", 6, True),
    ("access", r"AKIA[A-Z0-9]{16}", r"AKIA[A-Z0-9]+", 20, False),
    ("hex", r"[0-9a-f]{24}", r"[0-9a-f]+", 24, False),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1, False),
    ("forge_token", r"gh[opsu]_[A-Za-z0-9]{8}", r"gh[opsu]_[A-Za-z0-9]{36}", 40, False),
    ("chat_token", r"xox[abpr]-[0-9]{6}", r"xox[abpr]-[0-9]{6}[0-9]*(-[A-Za-z0-9]+)+", 16, False),
)
BASE = 3
KINDS = tuple(r[0] for r in RULES)
#: Bits of rules that are one run of a class: they begin where the byte before is none of it.
RUNS = 1 << KINDS.index("hex")
#: Bytes of a piece, up to the next reset byte; without one, of any piece that is carried on.
SEGMENT, LONGEST = 384, 1536
#: Bytes that every match that is kept, or that hides another one, has at least.
AHEAD = 4


class _Parser:
    """Expressions made of literals, escapes, classes, groups, |, ?, *, + and {n} as fragments of an automaton."""

    def __init__(self):
        self.step: list[dict[frozenset, list[int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.step.append({})
        self.free.append([])
        return len(self.step) - 1

    def parse(self, text: str) -> tuple[int, int]:
        self.text, self.at, self.fold = text, 0, False
        out = self.choice()
        if self.at != len(text):
            raise ValueError(f"unexpected {text[self.at]!r} in {text!r}")
        return out

    def choice(self) -> tuple[int, int]:
        ways = [self.sequence()]
        while self.at < len(self.text) and self.text[self.at] == "|":
            self.at += 1
            ways.append(self.sequence())
        if len(ways) == 1:
            return ways[0]
        a, b = self.state(), self.state()
        for x, y in ways:
            self.free[a].append(x)
            self.free[y].append(b)
        return a, b

    def sequence(self) -> tuple[int, int]:
        a = end = self.state()
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            begin = self.at
            x, y = self.atom()
            low, high = self.times()
            after = self.at
            for k in range(max(low, 1) if high is None else high):
                if k:
                    self.at = begin
                    x, y = self.atom()
                    self.at = after
                if k >= low:
                    self.free[x].append(y)
                if high is None and k == max(low, 1) - 1:
                    self.free[y].append(x)
                self.free[end].append(x)
                end = y
        return a, end

    def times(self) -> tuple[int, int | None]:
        c = self.text[self.at : self.at + 1]
        if c and c in "?*+":
            self.at += 1
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
        if m := re.compile(r"\{(\d+)\}").match(self.text, self.at):
            self.at = m.end()
            return int(m[1]), int(m[1])
        return 1, 1

    def char(self) -> int:
        c = self.text[self.at]
        self.at += 1
        if c != "\\":
            return ord(c)
        c = self.text[self.at]
        self.at += 1
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return ord(c)

    def atom(self) -> tuple[int, int]:
        if self.text[self.at] == "(":
            self.at += 1
            fold = self.fold
            if self.text.startswith("?i:", self.at):
                self.at += 3
                self.fold = True
            out = self.choice()
            self.fold = fold
            self.at += 1
            return out
        if self.text[self.at] == "[":
            self.at += 1
            chars = set()
            while self.text[self.at] != "]":
                low = self.char()
                high = low
                if self.text[self.at] == "-" and self.text[self.at + 1] != "]":
                    self.at += 1
                    high = self.char()
                chars.update(range(low, high + 1))
            self.at += 1
        else:
            chars = {self.char()}
        if self.fold:
            chars |= {c ^ 32 for c in chars if chr(c).isascii() and chr(c).isalpha()}
        a, b = self.state(), self.state()
        self.step[a][frozenset(chars)] = [b]
        return a, b


@cache
def compile_rules(expressions: tuple[str, ...], anywhere: bool) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """(class of each byte, transitions[state, class], start state, bits of the rules accepted in each state) of the minimal automaton.
    ``anywhere``: rules may begin at any byte, and acceptance is absorbing."""
    p = _Parser()
    ends = [p.parse(e) for e in expressions]
    tag = {b: 1 << k for k, (_, b) in enumerate(ends)}

    def reached(s: int) -> int:
        """The states that s is or leads to without a byte, as bits."""
        seen, todo = {s}, [s]
        while todo:
            for t in p.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return sum(1 << t for t in seen if p.step[t] or t in tag)

    closure = [reached(s) for s in range(len(p.free))]
    sets = list({c for s in p.step for c in s})
    signature = [tuple(b in c for c in sets) for b in range(256)]
    kinds = {s: i for i, s in enumerate(dict.fromkeys(signature))}
    member = {c: [i for s, i in kinds.items() if s[k]] for k, c in enumerate(sets)}
    moves = [[(k, closure[t]) for c, to in step.items() for k in member[c] for t in to] for step in p.step]
    start = 0
    for a, _ in ends:
        start |= closure[a]
    final = sum(1 << b for b in tag)
    index, rows, tags, todo = {start: 0}, [], [], [start]
    while todo:
        now = todo.pop(0)
        row = [start if anywhere else 0] * len(kinds)
        bits, seen = now, 0
        while bits:
            s = (bits & -bits).bit_length() - 1
            bits &= bits - 1
            seen |= tag.get(s, 0)
            for k, to in moves[s]:
                row[k] |= to
        if anywhere:
            row = [final if x & final else x for x in row]
            if now == final:
                row, seen = [final] * len(kinds), 1
        for x in row:
            if x not in index:
                index[x] = len(index)
                todo.append(x)
        rows.append([index[x] for x in row])
        tags.append(seen)
    table, tags = np.array(rows, dtype=np.intp), np.array(tags, dtype=np.int64)
    mark = lambda x: splitmix(x.astype(np.uint64) + np.uint64(1))
    group = np.unique(tags, return_inverse=True)[1].ravel()
    salt = mark(np.arange(1, len(kinds) + 1)) | np.uint64(1)
    while True:  # refine until no state of a group leads elsewhere than its fellows
        keys = mark(group) + (mark(group[table]) * salt).sum(axis=1, dtype=np.uint64)
        seen = np.unique(keys, return_inverse=True)[1].ravel()
        if seen.max() == group.max():
            break
        group = seen
    _, first, group = np.unique(group, return_index=True, return_inverse=True)
    return np.array([kinds[s] for s in signature], dtype=np.intp), group.ravel()[table[first]], int(group.ravel()[0]), tags[first]


class Scanner:
    def __init__(self, gates: tuple, whole: tuple, rules=RULES):
        self.least = [(r[3], r[4]) for r in rules]
        cls, table, self.start, tags = gates
        self.width = table.shape[1]
        accept = int(np.flatnonzero(tags)[0])
        self.begin, self.accept = self.start * self.width, accept * self.width
        self.next = (table * self.width).ravel().astype(np.int32)
        self.next_list = self.next.tolist()
        resets = np.array([all(t == self.start for s, t in enumerate(table[:, c]) if s != accept) for c in range(self.width)])
        self.reset = resets[cls]
        self.cls32 = cls.astype(np.int32)
        self.whole_cls, self.whole, self.whole_start, self.tags = whole
        possible = self.tags.copy()  # bits of the rules that may still be accepted from each state
        while True:
            more = possible | np.bitwise_or.reduce(possible[self.whole], axis=1)
            if (more == possible).all():
                break
            possible = more
        self.possible = possible
        self.rows, self.tag_list, self.possible_list = self.whole.tolist(), self.tags.tolist(), possible.tolist()

    def pieces(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces begin, with the end of the data last; and which ones carry on the one before."""
        cuts = np.flatnonzero(self.reset[data])
        at = np.searchsorted(cuts, np.arange(SEGMENT, len(data), SEGMENT))
        whole = np.unique(np.concatenate([off, cuts[at[at < len(cuts)]]]))
        extra = np.maximum(-(-np.diff(whole) // LONGEST) - 1, 0)
        if not extra.any():
            return whole, np.zeros(len(whole) - 1, dtype=bool)
        rank = np.arange(int(extra.sum())) - np.repeat(np.cumsum(extra) - extra, extra) + 1
        inner = np.repeat(whole[:-1], extra) + rank * LONGEST
        bounds = np.union1d(whole, inner)
        return bounds, np.isin(bounds[:-1], inner)

    def run(self, byte: np.ndarray, bounds: np.ndarray, which: np.ndarray, state: np.ndarray) -> np.ndarray:
        """The states in which these pieces end that begin in ``state``."""
        size = bounds[which + 1] - bounds[which]
        order = np.argsort(-size, kind="stable")
        size, where = size[order], bounds[which][order].copy()
        now = state[order].astype(np.int32)
        for n in np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left"):
            step = now[:n]
            step += byte[where[:n]]
            now[:n] = self.next[step]
            where[:n] += 1
        out = np.empty(len(which), dtype=np.int32)
        out[order] = now
        return out

    def accepted(self, data: np.ndarray, bounds: np.ndarray, carried: np.ndarray) -> list[tuple[int, int]]:
        """The stretches, from reset to reset, in which a rule's least occurrence was read."""
        byte = self.cls32[data]
        begins = np.full(len(carried), self.begin, dtype=np.int32)
        ends = self.run(byte, bounds, np.arange(len(carried)), begins)
        if carried.any():
            owed = np.where(carried, np.concatenate([[self.begin], ends[:-1]]), self.begin)
            again = np.flatnonzero(owed != begins)
            begins[again] = owed[again]
            ends[again] = self.run(byte, bounds, again, owed[again])
            # a piece that did not forget how it began, as white space behind a cue does not, is stepped on its own
            for k in np.flatnonzero(carried).tolist():
                if ends[k - 1] != begins[k]:
                    state = int(ends[k - 1])
                    for b in byte[bounds[k] : bounds[k + 1]].tolist():
                        state = self.next_list[state + b]
                    begins[k], ends[k] = ends[k - 1], state
        first = np.flatnonzero(~carried)
        hit = np.maximum.reduceat(ends == self.accept, first) if len(first) else np.zeros(0, dtype=bool)
        edge = bounds[np.append(first, len(carried))]
        return [(int(edge[k]), int(edge[k + 1])) for k in np.flatnonzero(hit)]

    def matches(self, raw: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(start, rule, end) of the matches in a stretch that are long enough."""
        cls = self.whole_cls[raw]
        n = len(cls)
        if n < AHEAD:
            return
        state = np.full(n - AHEAD + 1, self.whole_start)
        for k in range(AHEAD):
            state = self.whole[state, cls[k : n - AHEAD + 1 + k]]
        alive = self.possible[state]
        in_run = self.possible[self.whole[self.whole_start, cls]] & RUNS
        inner = np.concatenate([[0], in_run[:-1]])[: len(alive)]
        starts = np.flatnonzero(alive & ~(inner & RUNS))
        done, line = [0] * len(self.least), cls.tolist()
        for at in starts.tolist():
            wanted = sum(1 << r for r, d in enumerate(done) if d <= at)
            state, here, first, last = self.whole_start, at, {}, {}
            while here < n:
                state = self.rows[state][line[here]]
                here += 1
                if not self.possible_list[state] & wanted:
                    break
                if tag := self.tag_list[state] & wanted:
                    for r in range(len(done)):
                        if tag >> r & 1:
                            first.setdefault(r, here)
                            last[r] = here
            for r, end in last.items():
                done[r] = end
                least, value = self.least[r]
                if end - (first[r] - 1 if value else at) >= least:
                    yield at, r, end

    def spans(self, data: np.ndarray, off: np.ndarray) -> dict[int, list[tuple[str, int, int]]]:
        """Spans by row, in code points, by start and then kind."""
        out: dict[int, list] = {}
        for a, b in self.accepted(data, *self.pieces(data, off)):
            row = int(np.searchsorted(off, a, side="right")) - 1
            begin = a - int(off[row])
            for start, k, end in self.matches(data[a:b]):
                out.setdefault(row, []).append((begin + start, k, begin + end))
        for row, found in out.items():
            before = np.concatenate([[0], np.cumsum((data[off[row] : off[row + 1]] & 0xC0) != 0x80)])
            out[row] = [(KINDS[k], int(before[a]), int(before[b])) for a, k, b in sorted(found)]
        return out


def compiled() -> tuple[tuple, tuple]:
    """The scan's and the spans' automata; made once in a process."""
    return compile_rules(tuple(r[1] for r in RULES), True), compile_rules(tuple(r[2] for r in RULES), False)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and ``spans``, an array of (kind, start, end)."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    shared = docs.sparkSession.sparkContext.broadcast(compiled())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(*shared.value)
        for batch in batches:
            rows: list[list] = [[] for _ in range(batch.num_rows)]
            for first, _, data, off in runs(batch):
                for row, spans in scanner.spans(data, off).items():
                    rows[first + row] = [{"kind": k, "start": a, "end": b} for k, a, b in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, type=span)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:BASE]))
    return found.select("doc_id", *(count(k) for k in KINDS[:BASE]), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
