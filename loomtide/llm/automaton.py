"""Regular expressions over bytes as minimal deterministic automata in transition arrays.

compile_rules takes patterns in a small syntax (literals, escapes, classes, groups, |, ?, *, +,
{m}, {m,}, {m,n}), builds one nondeterministic automaton for all of them, determinises it by
subset construction over classes of equivalent bytes and minimises it by partition refinement.
scan runs such an automaton over a whole buffer in one byte pass: the buffer is cut into lanes
that step together, each from a guessed state, and lanes whose guess was wrong are stepped again
until they meet the states they already have. longest walks an anchored automaton over one match.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np

ANY = frozenset(range(256))


class _Parser:
    """Patterns to trees: ('set', bytes), ('cat', parts), ('alt', parts), ('rep', part, low, high)."""

    def __init__(self, pattern: str):
        self.text, self.at = pattern, 0

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def next(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def alternatives(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.next()
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            part = self.atom()
            while self.peek() and self.peek() in "?*+{":
                part = ("rep", part, *self.bounds())
            parts.append(part)
        return ("cat", parts)

    def bounds(self) -> tuple[int, int | None]:
        c = self.next()
        if c != "{":
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
        end = self.text.index("}", self.at)
        low, comma, high = self.text[self.at : end].partition(",")
        self.at = end + 1
        return int(low), (int(high) if high else None) if comma else int(low)

    def atom(self):
        c = self.next()
        if c == "(":
            inner = self.alternatives()
            if self.next() != ")":
                raise ValueError(f"unclosed group in {self.text!r}")
            return inner
        if c == "[":
            return ("set", self.charset())
        if c == ".":
            return ("set", ANY - {10})
        return ("set", frozenset({ord(self.escaped() if c == "\\" else c)}))

    def escaped(self) -> str:
        c = self.next()
        if c == "x":
            self.at += 2
            return chr(int(self.text[self.at - 2 : self.at], 16))
        if c.isalnum():
            raise ValueError(f"unknown escape \\{c}")
        return c

    def charset(self) -> frozenset[int]:
        negate = self.peek() == "^"
        if negate:
            self.next()
        found: set[int] = set()
        while (c := self.next()) != "]":
            low = ord(self.escaped() if c == "\\" else c)
            if self.peek() == "-" and self.text[self.at + 1] != "]":
                self.next()
                c = self.next()
                found.update(range(low, ord(self.escaped() if c == "\\" else c) + 1))
            else:
                found.add(low)
        return ANY - found if negate else frozenset(found)


def parse(pattern: str, ignore_case: bool = False):
    parser = _Parser(pattern)
    tree = parser.alternatives()
    if parser.at != len(pattern):
        raise ValueError(f"unexpected {parser.peek()!r} in {pattern!r}")
    return _both_cases(tree) if ignore_case else tree


def _both_cases(tree):
    if tree[0] == "set":
        letters = {b for b in tree[1] if chr(b).isalpha() and b < 128}
        return ("set", tree[1] | {b ^ 32 for b in letters})
    if tree[0] == "rep":
        return ("rep", _both_cases(tree[1]), *tree[2:])
    return (tree[0], [_both_cases(t) for t in tree[1]])


def reverse(tree):
    """The tree of the reversed strings."""
    if tree[0] == "set":
        return tree
    if tree[0] == "rep":
        return ("rep", reverse(tree[1]), *tree[2:])
    parts = [reverse(t) for t in tree[1]]
    return (tree[0], parts[::-1] if tree[0] == "cat" else parts)


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.edges: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.edges.append(None)
        return len(self.empty) - 1

    def add(self, tree, start: int) -> int:
        """Adds the tree from start and returns its end state."""
        kind = tree[0]
        if kind == "set":
            before, end = self.state(), self.state()
            self.empty[start].append(before)
            self.edges[before] = (tree[1], end)
            return end
        if kind == "cat":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        end = self.state()
        if kind == "alt":
            for part in tree[1]:
                self.empty[self.add(part, start)].append(end)
            return end
        _, part, low, high = tree
        for _ in range(low):
            start = self.add(part, start)
        if high is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.add(part, loop)].append(loop)
            self.empty[loop].append(end)
            return end
        for _ in range(high - low):
            self.empty[start].append(end)
            start = self.add(part, start)
        self.empty[start].append(end)
        return end


@dataclass(frozen=True)
class Automaton:
    """table[state * n_classes + class] is the next state; accepts[state] has a bit for each rule.

    Accepting states come last, from first_accepting on.
    """

    classes: np.ndarray
    n_classes: int
    table: np.ndarray
    accepts: tuple[int, ...]
    first_accepting: int
    start: int

    @property
    def n_states(self) -> int:
        return len(self.accepts)

    @functools.cached_property
    def _plain(self) -> tuple[list[list[int]], bytes]:
        """The table by rows and the classes as Python objects, which single steps read faster."""
        return self.table.reshape(-1, self.n_classes).tolist(), self.classes.tobytes()

    @functools.cached_property
    def live(self) -> list[int]:
        """For each state a bit for each rule that it or a state after it accepts."""
        rows = self.table.reshape(-1, self.n_classes)
        masks = np.array(self.accepts, dtype=object)
        while True:
            more = np.bitwise_or.reduce(masks[rows], axis=1) | masks
            if (more == masks).all():
                return masks.tolist()
            masks = more

    def longest(self, data: bytes, at: int, rule: int = 0) -> int | None:
        """Where the longest match of a rule that begins at data[at] ends; None without one."""
        (rows, classes), state, bit, live, accepts = self._plain, self.start, 1 << rule, self.live, self.accepts
        found = at if accepts[state] & bit else None
        for at in range(at, len(data)):
            state = rows[state][classes[data[at]]]
            if not live[state] & bit:
                break
            if accepts[state] & bit:
                found = at + 1
        return found


def compile_rules(trees: list, anchored: bool = False) -> Automaton:
    """One minimal automaton for all trees; unless anchored, matches may begin anywhere."""
    nfa = _Nfa()
    start = nfa.state()
    ends = []
    for tree in trees:
        first = nfa.state()
        nfa.empty[start].append(first)
        ends.append(nfa.add(tree, first))
    rule_of = {end: k for k, end in enumerate(ends)}

    signature: dict[int, list[int]] = {b: [] for b in range(256)}
    for k, edge in enumerate(nfa.edges):
        for b in edge[0] if edge else ():
            signature[b].append(k)
    numbers: dict[tuple, int] = {}
    classes = np.array([numbers.setdefault(tuple(signature[b]), len(numbers)) for b in range(256)], dtype=np.uint8)
    n_classes = len(numbers)
    sample = [int(np.argmax(classes == c)) for c in range(n_classes)]

    def closure(states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in nfa.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(x for x in seen if nfa.edges[x] or x in rule_of)

    restart = closure([start])
    ids, order, rows = {restart: 0}, [restart], []
    for now in order:  # grows while new subsets turn up
        row = []
        for c in range(n_classes):
            goes = closure([nfa.edges[x][1] for x in now if nfa.edges[x] and sample[c] in nfa.edges[x][0]])
            if not anchored:
                goes |= restart
            if goes not in ids:
                ids[goes] = len(order)
                order.append(goes)
            row.append(ids[goes])
        rows.append(row)
    accepts = [sum(1 << rule_of[x] for x in states if x in rule_of) for states in order]
    return _minimal(np.array(rows, dtype=np.int64), accepts, classes, n_classes)


def _minimal(table: np.ndarray, accepts: list[int], classes: np.ndarray, n_classes: int) -> Automaton:
    """Partition refinement: states stay together while their accepts and successors' parts agree."""
    _, part = np.unique(np.array([str(a) for a in accepts]), return_inverse=True)
    while True:
        key = np.column_stack([part, part[table]])
        _, finer = np.unique(key, axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == part.max():
            break
        part = finer
    n = int(part.max()) + 1
    one = [int(np.argmax(part == p)) for p in range(n)]
    order = sorted(range(n), key=lambda p: (accepts[one[p]] != 0, p != part[0], p))
    rank = {p: k for k, p in enumerate(order)}
    new = np.array([[rank[int(part[t])] for t in table[one[p]]] for p in order])
    marks = tuple(accepts[one[p]] for p in order)
    first = next((k for k, a in enumerate(marks) if a), n)
    return Automaton(classes, n_classes, new.astype(np.int32).reshape(-1), marks, first, rank[int(part[0])])


def scan(a: Automaton, data: np.ndarray, lane: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """(positions, states): each place of data (uint8) after which the automaton is in an accepting state."""
    size = len(data)
    if not size:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    n = a.n_classes
    wide = np.uint16 if a.n_states * n < 1 << 16 else np.int32
    jump = (a.table.astype(np.int64) * n).astype(wide)  # states are kept multiplied by n
    count = -(-size // lane)
    coded = np.zeros(count * lane, dtype=wide)
    coded[:size] = a.classes[data]
    coded = np.ascontiguousarray(coded.reshape(count, lane).T)
    states = np.empty((lane, count), dtype=wide)
    now = np.full(count, a.start * n, dtype=wide)
    for i in range(lane):
        now = np.take(jump, now + coded[i])
        states[i] = now
    begun = np.full(count, a.start * n, dtype=wide)
    while True:
        true = np.concatenate([begun[:1], states[-1, :-1]])
        wrong = np.nonzero(true != begun)[0]
        if not len(wrong):
            break
        begun = true
        now = true[wrong]
        for i in range(lane):
            now = np.take(jump, now + coded[i, wrong])
            differ = now != states[i, wrong]
            wrong, now = wrong[differ], now[differ]
            if not len(wrong):
                break
            states[i, wrong] = now
    step, row = np.nonzero(states >= a.first_accepting * n)
    at = row * lane + step
    keep = at < size
    at, found = at[keep], states[step[keep], row[keep]].astype(np.int64) // n
    order = np.argsort(at, kind="stable")
    return at[order], found[order]
