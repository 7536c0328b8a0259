"""Regular expressions over bytes as one minimal deterministic automaton.

The syntax is that of the rules: literals, ``\\xhh`` and escaped characters, classes with
ranges and ``^``, groups, ``|``, and the repeats ``? * + {n} {n,} {n,m}``.
"""

from __future__ import annotations

import numpy as np

# A node is ("set", frozenset of bytes) | ("cat", [nodes]) | ("alt", [nodes]) | ("rep", node, least, most or None)


class _Parser:
    """held: group 2 must be a repeated class, of which so many bytes at least are asked for."""

    def __init__(self, pattern: str, ignore_case: bool, held: int = 0):
        self.p, self.i, self.fold, self.groups, self.held = pattern, 0, ignore_case, 0, held

    def set_of(self, chars) -> tuple:
        out = {ord(c) for c in chars}
        if self.fold:
            out |= {ord(chr(b).swapcase()) for b in out if chr(b).isalpha()}
        return ("set", frozenset(out))

    def peek(self) -> str:
        return self.p[self.i : self.i + 1]

    def char(self) -> str:
        c = self.p[self.i]
        self.i += 1
        if c != "\\":
            return c
        e = self.p[self.i]
        self.i += 1
        if e == "x":
            self.i += 2
            return chr(int(self.p[self.i - 2 : self.i], 16))
        return {"n": "\n", "t": "\t", "r": "\r"}.get(e, e)

    def klass(self) -> tuple:
        negate = self.peek() == "^"
        self.i += negate
        chars: set[str] = set()
        while self.peek() != "]":
            a = self.char()
            if self.peek() == "-" and self.p[self.i + 1] != "]":
                self.i += 1
                chars |= set(map(chr, range(ord(a), ord(self.char()) + 1)))
            else:
                chars.add(a)
        self.i += 1
        node = self.set_of(chars)
        return ("set", frozenset(range(256)) - node[1]) if negate else node

    def alternatives(self) -> tuple:
        options = [self.sequence()]
        while self.peek() == "|":
            self.i += 1
            options.append(self.sequence())
        return ("alt", options) if len(options) > 1 else options[0]

    def sequence(self) -> tuple:
        items = []
        while self.peek() not in ("", "|", ")"):
            if self.peek() == "(":
                named = not self.p.startswith("(?:", self.i)
                self.i += 1 if named else 3
                self.groups += named
                k = self.groups
                node = self.alternatives()
                if named and k == 2 and self.held:
                    node = _longer(node, self.held)
                self.i += 1
            elif self.peek() == "[":
                self.i += 1
                node = self.klass()
            else:
                node = self.set_of(self.char())
            q = self.peek()
            if q and q in "?*+":
                self.i += 1
                node = ("rep", node, int(q == "+"), 1 if q == "?" else None)
            elif q == "{":
                end = self.p.index("}", self.i)
                least, _, most = self.p[self.i + 1 : end].partition(",")
                node = ("rep", node, int(least), int(most) if most else None if "," in self.p[self.i : end] else int(least))
                self.i = end + 1
            items.append(node)
        return ("cat", items)


def _longer(node: tuple, least: int) -> tuple:
    """A repeated class with more repeats at least."""
    while node[0] == "cat" and len(node[1]) == 1:
        node = node[1][0]
    if node[0] != "rep" or node[1][0] != "set":
        raise ValueError("group 2 is not a repeated class")
    return ("rep", node[1], max(least, node[2]), node[3])


def parse(pattern: str, ignore_case: bool = False, held: int = 0) -> tuple:
    return _Parser(pattern, ignore_case, held).alternatives()


def mirrored(node: tuple) -> tuple:
    """The expression of the reversed strings."""
    if node[0] == "set":
        return node
    if node[0] == "rep":
        return ("rep", mirrored(node[1]), *node[2:])
    parts = [mirrored(x) for x in node[1]]
    return (node[0], parts[::-1] if node[0] == "cat" else parts)


class _Nfa:
    """States with moves (byte set, state) and empty moves."""

    def __init__(self):
        self.moves: list[list[tuple[frozenset, int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def add(self, node: tuple, a: int) -> int:
        """Build node from state a; the state where it ends."""
        kind = node[0]
        if kind == "set":
            b = self.state()
            self.moves[a].append((node[1], b))
            return b
        if kind == "cat":
            for x in node[1]:
                a = self.add(x, a)
            return a
        if kind == "alt":
            b = self.state()
            for x in node[1]:
                s = self.state()
                self.empty[a].append(s)
                self.empty[self.add(x, s)].append(b)
            return b
        _, inner, least, most = node
        for _ in range(least):
            a = self.add(inner, a)
        if most is None:
            s = self.state()
            self.empty[a].append(s)
            e = self.add(inner, s)
            b = self.state()
            self.empty[e] += [s, b]
            self.empty[s].append(b)
            return b
        b = self.state()
        self.empty[a].append(b)
        for _ in range(most - least):
            a = self.add(inner, a)
            self.empty[a].append(b)
        return b


class Automaton:
    """All rules in one table: `step[state * width + kind[byte]]` is the next state, times width.

    In search mode every position may begin a match, and the separator byte 255, which is in no
    rule, leads back to the root; else it ends all matches. States that end a match of some rule
    have the highest numbers, from `first_hit` on; `rule[state]` are their rules' bits. From the
    state `dead` no match ends.
    """

    def __init__(self, nodes: list[tuple], search: bool = True):
        nfa = _Nfa()
        root = nfa.state()
        if search:
            nfa.moves[root].append((frozenset(range(256)) - {255}, root))
        ends = {}
        for k, node in enumerate(nodes):
            s = nfa.state()
            nfa.empty[root].append(s)
            ends[nfa.add(node, s)] = 1 << k
        # bytes that no set tells apart
        sets = sorted({m[0] for x in nfa.moves for m in x}, key=sorted)
        marks: dict[tuple, int] = {}
        kind = np.array([marks.setdefault(tuple(b in s for s in sets), len(marks)) for b in range(256)], np.uint8)
        sample = [int(np.flatnonzero(kind == k)[0]) for k in range(len(marks))]
        closed: dict[int, frozenset] = {}

        def closure(s: int) -> frozenset:
            if s not in closed:
                seen, todo = {s}, [s]
                while todo:
                    for x in nfa.empty[todo.pop()]:
                        if x not in seen:
                            seen.add(x)
                            todo.append(x)
                closed[s] = frozenset(x for x in seen if nfa.moves[x] or x in ends)
            return closed[s]

        by_kind = [[[t for s, t in m if b in s] for b in sample] for m in nfa.moves]
        start = closure(root)
        number, order, rows = {start: 0}, [start], []
        for subset in order:
            row = []
            for k, b in enumerate(sample):
                to = frozenset().union(*(closure(t) for s in subset for t in by_kind[s][k])) if b != 255 or not search else start
                if to not in number:
                    number[to] = len(order)
                    order.append(to)
                row.append(number[to])
            rows.append(row)
        table = np.array(rows, np.int64)
        rule = np.array([sum({ends[s] for s in subset if s in ends}) for subset in order], np.int64)
        table, rule, first = self._minimal(table, rule)
        # hits last
        rank = np.argsort(rule > 0, kind="stable")
        place = np.empty(len(rank), np.int64)
        place[rank] = np.arange(len(rank))
        self.table, self.rule, self.start = place[table[rank]], rule[rank], int(place[first])
        self.kind, self.width = kind.tobytes(), len(sample)
        self.step = (self.table * self.width).ravel().tolist()
        self.first_hit = int((rule == 0).sum()) * self.width
        stuck = np.flatnonzero((self.table == np.arange(len(self.table))[:, None]).all(axis=1) & (self.rule == 0))
        self.dead = int(stuck[0]) * self.width if len(stuck) else -1

    @staticmethod
    def _minimal(table: np.ndarray, rule: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Merge states that no input tells apart (partition refinement)."""
        group = np.unique(rule, return_inverse=True)[1]
        while True:
            finer = np.unique(np.column_stack((group, group[table])), axis=0, return_inverse=True)[1].ravel()
            if finer.max() == group.max():
                break
            group = finer
        _, at = np.unique(group, return_index=True)
        return group[table[at]], rule[at], int(group[0])

    def backward(self, data: bytes) -> list[tuple[int, int]]:
        """One pass from the last byte to the first: (position, rules' bits) of all hits."""
        step, first_hit, width, rule = self.step, self.first_hit, self.width, self.rule
        s, hits, i = self.start * width, [], len(data)
        for c in data.translate(self.kind)[::-1]:
            i -= 1
            s = step[s + c]
            if s >= first_hit:
                hits.append((i, int(rule[s // width])))
        return hits[::-1]

    def ends(self, kinds: bytes, at: int) -> dict[int, tuple[int, int]]:
        """Of the matches that begin at `at`, by rule: the last position where one ends, and the
        bits of all rules that a match ends there for. kinds: the data, translated by `kind`."""
        step, first_hit, width, rule, dead = self.step, self.first_hit, self.width, self.rule, self.dead
        s, i, found = self.start * width, at, []
        for c in _from(kinds, at):
            s = step[s + c]
            if s == dead:
                break
            i += 1
            if s >= first_hit:
                found.append((i, s))
        out: dict[int, tuple[int, int]] = {}
        for i, s in reversed(found):
            bits = int(rule[s // width])
            for k in range(bits.bit_length()):
                if bits >> k & 1 and k not in out:
                    out[k] = (i, bits)
        return out


def _from(data: bytes, at: int, size: int = 256):
    """The bytes from `at` on, a few at a time."""
    while at < len(data):
        yield from data[at : at + size]
        at += size
