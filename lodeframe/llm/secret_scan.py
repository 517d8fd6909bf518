"""Secret scanning with one deterministic automaton for all rules.

Every rule is a regular expression over bytes.  Its automaton of position sets is made
deterministic by subset construction in a way that keeps the order of starting points, so
that a state knows the earliest start that can still match.  The product of all rules is
built from its reachable states only, minimised by partition refinement, and laid out as
one array of transitions per state.  A text is then read once, byte by byte, for all rules
together; a state whose number is above a limit says that matches ended before the byte
just read.  Where a match began is read off a second automaton, of the reversed rule, run back
from the end of the match, never further than the end of the rule's match before it.

Matches of one rule are leftmost and do not overlap.  A match whose last part is shorter than
the rule asks for is dropped, after it has used up its text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.frames import mapped
from lodeframe.llm.words import encoded_blocks

#: A byte that no UTF-8 text holds; it ends every text of a block.
END = 0xFF
#: Bytes of text scanned as one block.
TEXT_BYTES = 1 << 19


@dataclass(frozen=True)
class Rule:
    """``head`` and then ``tail``, of which ``least`` bytes at least; neither matches the empty text together."""

    kind: str
    head: str
    tail: str
    least: int = 1


#: The base rules.
BASE_RULES = (
    Rule("assign", r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?", r"[A-Za-z0-9+/_.=\-]+", 6),
    Rule("access", r"AKIA", r"[A-Z0-9]+", 16),
    # shorter runs can hold no match, so the count is left to the automaton
    Rule("hex", r"", r"[0-9a-f]{24,}", 24),
)
#: Further rules: private key headers, tokens of code hosts and chat services.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r""),
    Rule("host", r"gh[oprsu]_", r"[A-Za-z0-9]+", 36),
    Rule("chat", r"xox[abprs]-", r"[A-Za-z0-9\-]+", 10),
)


# --- regular expressions to automata of position sets -------------------------------


class _Parser:
    """Literals, escapes, classes, groups, ``|`` and the repetitions ``? * + {n} {n,} {n,m}``, into a tree of tuples."""

    def __init__(self, pattern: str):
        self.text, self.at = pattern, 0

    def parse(self) -> tuple:
        tree = self._either()
        if self.at != len(self.text):
            raise ValueError(f"unexpected {self.text[self.at]!r} at {self.at} in {self.text!r}")
        return tree

    def _peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def _next(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def _either(self) -> tuple:
        parts = [self._sequence()]
        while self._peek() == "|":
            self.at += 1
            parts.append(self._sequence())
        return parts[0] if len(parts) == 1 else ("or", *parts)

    def _sequence(self) -> tuple:
        parts = []
        while self._peek() and self._peek() not in "|)":
            parts.append(self._repeated())
        return ("then", *parts)

    def _repeated(self) -> tuple:
        item = self._item()
        while self._peek() and self._peek() in "?*+{":
            sign = self._next()
            if sign == "{":
                low, _, high = self.text[self.at : (end := self.text.index("}", self.at))].partition(",")
                self.at, exact = end + 1, "," not in self.text[self.at : end]
                item = ("times", item, int(low), int(low) if exact else int(high) if high else None)
            else:
                item = ("times", item, int(sign == "+"), 1 if sign == "?" else None)
        return item

    def _item(self) -> tuple:
        c = self._next()
        if c == "(":
            tree = self._either()
            if self._peek() != ")":
                raise ValueError(f"unclosed group in {self.text!r}")
            self.at += 1
            return tree
        if c == "[":
            return ("bytes", self._class())
        if c == ".":
            return ("bytes", frozenset(range(END)) - {10})
        return ("bytes", frozenset([self._escaped() if c == "\\" else ord(c)]))

    def _escaped(self) -> int:
        c = self._next()
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return ord(c)

    def _class(self) -> frozenset:
        negated = self._peek() == "^"
        self.at += negated
        out: set[int] = set()
        while (c := self._next()) != "]":
            low = self._escaped() if c == "\\" else ord(c)
            high = low
            if self._peek() == "-" and self.text[self.at + 1] != "]":
                self.at += 1
                high = self._escaped() if (c := self._next()) == "\\" else ord(c)
            out.update(range(low, high + 1))
        return frozenset(range(END)) - out if negated else frozenset(out)


def _reversed(tree: tuple) -> tuple:
    if tree[0] == "bytes":
        return tree
    if tree[0] == "times":
        return ("times", _reversed(tree[1]), *tree[2:])
    parts = tuple(map(_reversed, tree[1:]))
    return (tree[0], *(parts[::-1] if tree[0] == "then" else parts))


class Positions:
    """Automaton without empty moves: every byte class of the tree is a position, one of which is entered on each byte."""

    def __init__(self, tree: tuple):
        self.sets: list[frozenset] = []
        self.follow: dict[int, set[int]] = defaultdict(set)
        self.empty, first, last = self._add(tree)
        self.first, self.last = frozenset(first), frozenset(last)

    def _add(self, tree: tuple) -> tuple[bool, set, set]:
        """(whether it matches nothing, first positions, last positions), as positions are added."""
        kind = tree[0]
        if kind == "bytes":
            self.sets.append(tree[1])
            return False, {len(self.sets) - 1}, {len(self.sets) - 1}
        if kind == "or":
            parts = [self._add(t) for t in tree[1:]]
            return any(p[0] for p in parts), set().union(*(p[1] for p in parts)), set().union(*(p[2] for p in parts))
        if kind == "then":
            empty, first, last = True, set(), set()
            for t in tree[1:]:
                e, f, l = self._add(t)  # noqa: E741
                for p in last:
                    self.follow[p] |= f
                first |= f if empty else set()
                last = l | (last if e else set())
                empty &= e
            return empty, first, last
        _, item, least, most = tree
        if most is None:
            parts = [item] * max(0, least - 1)
            e, f, l = self._add(("then", *parts)) if parts else (True, set(), set())  # noqa: E741
            e2, f2, l2 = self._add(item)
            for p in l2:
                self.follow[p] |= f2
            for p in l:
                self.follow[p] |= f2
            loop_empty = e2 or least == 0
            return e and loop_empty, f | (f2 if e else set()), l2 | (l if loop_empty else set())
        optional: tuple = ("then",)
        for _ in range(most - least):
            optional = ("or", ("then", item, optional), ("then",))
        return self._add(("then", *[item] * least, optional))

    def step(self, states: frozenset, byte: int) -> frozenset:
        """Positions entered on a byte from any of ``states``; -1 stands for the start."""
        out = set()
        for s in states:
            out.update(p for p in (self.first if s == -1 else self.follow[s]) if byte in self.sets[p])
        return frozenset(out)


def _classes(rules: list[Positions]) -> tuple[list[int], list[int]]:
    """(class of each byte, one byte of each class): bytes that no rule tells apart; the end byte is a class."""
    kinds: dict[tuple, int] = {}
    of = []
    for b in range(256):
        key = (b == END, *(b in s for r in rules for s in r.sets))
        of.append(kinds.setdefault(key, len(kinds)))
    return of, [of.index(c) for c in range(len(kinds))]


class _Leftmost:
    """The deterministic automaton of one rule searched anywhere: a state is (sets of positions by start, earliest first; whether a match ended)."""

    START = ((), False)

    def __init__(self, rule: Positions, name: str):
        if rule.empty:
            raise ValueError(f"rule {name!r} matches the empty text")
        self.rule, self.name = rule, name
        self.known: dict[tuple, tuple] = {}

    def step(self, state: tuple, byte: int) -> tuple:
        if (state, byte) not in self.known:
            self.known[state, byte] = self._step(state[0], byte)
        return self.known[state, byte]

    def _step(self, groups: tuple, byte: int) -> tuple:
        matching = len(groups) == 1 and bool(groups[0] & self.rule.last)
        if matching:
            further = self.rule.step(groups[0], byte)
            if further:
                if not further & self.rule.last:
                    raise ValueError(f"rule {self.name!r} may go on after a match without one")
                return ((further,), False)
            groups = ()
        out: list[frozenset] = []
        seen: set[int] = set()
        for g in (*groups, frozenset([-1])):
            # a later start in the same position has the same future
            entered = self.rule.step(g, byte) - seen
            if entered:
                out.append(entered)
                seen |= entered
        accepting = [i for i, g in enumerate(out) if g & self.rule.last]
        if accepting:
            if accepting[0]:
                raise ValueError(f"rule {self.name!r}: a later start matches while an earlier one is undecided")
            out = out[:1]
        return (tuple(out), matching)


def _minimal(table: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Class of each state: states are alike while their marks and the classes that they lead to are."""
    _, classes = np.unique(marks, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack((classes, classes[table])), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == classes.max():
            return finer
        classes = finer


@dataclass
class Automaton:
    """All rules as one table of transitions; states from ``limit`` on say which rules' matches ended before the last byte."""

    rules: tuple[Rule, ...]
    #: class of each byte, and the next state by state and class
    class_of: bytes
    table: np.ndarray
    start: int
    limit: int
    #: bits of the rules whose matches ended, by state less ``limit``
    ended: list[int]
    #: by rule: transitions of the reversed rule (-1: no match any more), and which of its states are starts of matches
    back: list[tuple[list[list[int]], list[bool]]]
    #: by rule: the same of the head alone, read forward; None where it has none
    head: list[tuple[list[list[int]], list[bool]] | None]

    @cached_property
    def rows(self) -> list[list[int]]:
        return self.table.tolist()


def _anchored(rule: Positions) -> tuple[list[list[int]], list[bool]]:
    """Deterministic automaton of a rule from a fixed place: transitions by byte, and accepting states."""
    numbers, todo, table = {frozenset([-1]): 0}, [frozenset([-1])], []
    for state in todo:
        row = []
        for b in range(256):
            to = rule.step(state, b)
            if to and to not in numbers:
                numbers[to] = len(numbers)
                todo.append(to)
            row.append(numbers[to] if to else -1)
        table.append(row)
    return table, [bool(s & rule.last) or (s == frozenset([-1]) and rule.empty) for s in todo]


@cache
def compiled(rules: tuple[Rule, ...]) -> Automaton:
    """The minimal automaton of all rules."""
    trees = [_Parser(r.head + r.tail).parse() for r in rules]
    single = [_Leftmost(Positions(t), r.kind) for t, r in zip(trees, rules, strict=True)]
    of_byte, sample = _classes([s.rule for s in single])
    first = tuple(s.START for s in single)
    numbers, todo, table = {first: 0}, [first], []
    for state in todo:
        row = []
        for byte in sample:
            to = tuple(s.step(x, byte) for s, x in zip(single, state, strict=True))
            if to not in numbers:
                numbers[to] = len(numbers)
                todo.append(to)
            row.append(numbers[to])
        table.append(row)
    marks = np.array([sum(x[1] << i for i, x in enumerate(state)) for state in todo])
    classes = _minimal(np.array(table), marks)
    # states that report come last
    one_of = np.unique(classes, return_index=True)[1]
    order = np.argsort(marks[one_of] != 0, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    small = place[classes[np.array(table)[one_of[order]]]]
    limit = int(np.count_nonzero(marks[one_of] == 0))
    back = [_anchored(Positions(_reversed(t))) for t in trees]
    head = [_anchored(Positions(_Parser(r.head).parse())) if r.least > 1 and r.head else None for r in rules]
    return Automaton(rules, bytes(of_byte), small.astype(np.int32), int(place[classes[0]]), limit, marks[one_of[order]][limit:].tolist(), back, head)


# --- scanning ---------------------------------------------------------------------


def scan(automaton: Automaton, data: bytes) -> list[tuple[int, int, int]]:
    """(rule, start, end) of all matches in ``data``, of which every text ends in the byte ``END``, by end."""
    rows, state, limit, ended = automaton.rows, automaton.start, automaton.limit, automaton.ended
    used = [0] * len(automaton.rules)
    out = []
    for at, kind in enumerate(data.translate(automaton.class_of)):
        state = rows[state][kind]
        if state >= limit:
            bits = ended[state - limit]
            for rule in range(len(used)):
                if bits >> rule & 1:
                    start = _began(automaton.back[rule], data, at, used[rule])
                    used[rule] = at
                    if _long_enough(automaton, rule, data, start, at):
                        out.append((rule, start, at))
    return out


def _began(back: tuple[list[list[int]], list[bool]], data: bytes, end: int, least: int) -> int:
    """The leftmost start, not before ``least``, of a match that ends at ``end``."""
    table, accepts = back
    state, found = 0, end
    for at in range(end - 1, least - 1, -1):
        state = table[state][data[at]]
        if state < 0:
            break
        if accepts[state]:
            found = at
    return found


def _long_enough(automaton: Automaton, rule: int, data: bytes, start: int, end: int) -> bool:
    """Whether the tail of a match, what follows its longest head, has the rule's length."""
    at = start
    if automaton.head[rule]:
        table, accepts = automaton.head[rule]
        state = 0
        for i in range(start, end):
            state = table[state][data[i]]
            if state < 0:
                break
            if accepts[state]:
                at = i + 1
    return end - at >= automaton.rules[rule].least


def _spans(automaton: Automaton):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for first, texts in encoded_blocks(batch.column("text"), TEXT_BYTES):
                data = bytes([END]).join([*texts, b""])
                bounds = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
                found: list[list[dict]] = [[] for _ in texts]
                if matches := scan(automaton, data):
                    rule, start, end = (np.array(x) for x in zip(*matches, strict=True))
                    doc = np.searchsorted(bounds, start, "right") - 1
                    # code points: bytes that do not go on with a character
                    points = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80, dtype=np.int64)))
                    base = points[bounds[doc]]
                    order = np.lexsort((rule, start))
                    for r, a, b, d in zip(rule[order].tolist(), (points[start] - base)[order].tolist(), (points[end] - base)[order].tolist(), doc[order].tolist(), strict=True):
                        found[d].append({"kind": automaton.rules[r].kind, "from": a, "to": b})
                spans = pa.array(found, pa.list_(pa.struct([("kind", pa.string()), ("from", pa.int64()), ("to", pa.int64())])))
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(texts)), spans], names=["doc_id", "spans"])

    return run


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = (*BASE_RULES, *MORE_RULES), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, spans``, an array of ``(kind, from, to)`` in code points, ``to`` exclusive.

    Spans are ordered by start, then by the order of ``rules``; those of one rule are
    leftmost and do not overlap, those of different rules may.  Null and empty texts have no
    spans.  Rows that share an id or have none are scanned row by row; other columns are
    ignored; an empty table gives no rows.  No row moves, and a task holds one block of
    text.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return mapped(docs, _spans(compiled(tuple(rules))), "doc_id long, spans array<struct<kind string, from long, to long>>")


def joined(spans: str = "spans", kinds: tuple[str, ...] | None = None) -> F.Column:
    """``kind:from:to`` of the spans (of some kinds), comma-joined."""
    kept = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else F.col(spans)
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["from"].cast("string"), s["to"].cast("string"))), ",")
