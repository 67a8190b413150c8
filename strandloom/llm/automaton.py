"""Deterministic automata over bytes: regular expressions by subset construction and minimisation into a transition table."""

from collections.abc import Sequence
from dataclasses import dataclass

Set = int  # 256 bits, one for each byte
ANY: Set = (1 << 256) - 1


def _bits(data: bytes) -> Set:
    return sum(1 << b for b in set(data))


class _Parser:
    """Expressions of bytes: literals, \\xHH, escapes, [classes], groups, |, ?, *, +, {m}, {m,} and {m,n}.

    Nodes: ("set", bits), ("cat", nodes), ("alt", nodes), ("rep", node, least, most or None).
    """

    def __init__(self, pattern: str):
        self.p, self.i = pattern, 0

    def peek(self) -> str:
        return self.p[self.i : self.i + 1]

    def take(self) -> str:
        self.i += 1
        return self.p[self.i - 1]

    def alternatives(self) -> tuple:
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return ("alt", options) if len(options) > 1 else options[0]

    def sequence(self) -> tuple:
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeated())
        return ("cat", parts)

    def repeated(self) -> tuple:
        node = self.atom()
        while (c := self.peek()) and c in "?*+{":
            self.take()
            if c == "{":
                bounds = ""
                while self.peek() != "}":
                    bounds += self.take()
                self.take()
                least, comma, most = bounds.partition(",")
                node = ("rep", node, int(least), int(most) if most else None if comma else int(least))
            else:
                node = ("rep", node, int(c == "+"), 1 if c == "?" else None)
        return node

    def byte(self) -> int:
        c = self.take()
        if c != "\\":
            return ord(c)
        c = self.take()
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))

    def atom(self) -> tuple:
        if self.peek() == "(":
            self.take()
            if self.p[self.i : self.i + 2] == "?:":
                self.i += 2
            node = self.alternatives()
            self.take()
            return node
        if self.peek() != "[":
            return ("set", 1 << self.byte())
        self.take()
        negate = self.peek() == "^"
        self.i += negate
        bits = 0
        while self.peek() != "]":
            low = high = self.byte()
            if self.peek() == "-" and self.p[self.i + 1 : self.i + 2] != "]":
                self.take()
                high = self.byte()
            bits |= (1 << high + 1) - (1 << low)
        self.take()
        return ("set", ANY & ~bits if negate else bits)


def parse(pattern: str, fold: str = "") -> tuple:
    """The tree of an expression; letters in fold stand for either case."""
    parser = _Parser(pattern)
    node = parser.alternatives()
    if parser.i < len(pattern):
        raise ValueError(f"can't read {pattern!r} from {parser.i}")
    return _fold(node) if fold else node


def _fold(node: tuple) -> tuple:
    if node[0] == "set":
        bits = node[1]
        for k in range(26):
            pair = (1 << 65 + k) | (1 << 97 + k)
            if bits & pair:
                bits |= pair
        return ("set", bits)
    if node[0] == "rep":
        return ("rep", _fold(node[1]), *node[2:])
    return (node[0], [_fold(x) for x in node[1]])


def reverse(node: tuple) -> tuple:
    if node[0] == "set":
        return node
    if node[0] == "rep":
        return ("rep", reverse(node[1]), *node[2:])
    return (node[0], [reverse(x) for x in (reversed(node[1]) if node[0] == "cat" else node[1])])


class _Nfa:
    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[tuple[Set, int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.empty) - 1

    def add(self, node: tuple, start: int) -> int:
        """The state in which a path from start has read the node."""
        kind = node[0]
        if kind == "set":
            a, b = self.state(), self.state()
            self.empty[start].append(a)
            self.moves[a] = (node[1], b)
            return b
        if kind == "cat":
            for x in node[1]:
                start = self.add(x, start)
            return start
        if kind == "alt":
            out = self.state()
            for x in node[1]:
                self.empty[self.add(x, start)].append(out)
            return out
        _, inner, least, most = node
        for _ in range(least):
            start = self.add(inner, start)
        if most is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.add(inner, loop)].append(loop)
            out = self.state()
            self.empty[loop].append(out)
            return out
        out = self.state()
        self.empty[start].append(out)
        for _ in range(most - least):
            start = self.add(inner, start)
            self.empty[start].append(out)
        return out

    def closure(self, states: Sequence[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


@dataclass(frozen=True)
class Automaton:
    """table[state + byte] is the next state, a multiple of 256. From first_accepting on, states accept rules[state >> 8].

    dead is the state from which nothing can be accepted, -1 if there is none.
    """

    table: list[int]
    start: int
    first_accepting: int
    rules: list[tuple[int, ...]]
    dead: int


def build(trees: Sequence[tuple], anywhere: bool) -> Automaton:
    """One automaton for all trees. anywhere: a match may start at any byte; else at the first only."""
    nfa = _Nfa()
    root = nfa.state()
    ends = {}
    for k, tree in enumerate(trees):
        first = nfa.state()
        nfa.empty[root].append(first)
        ends[nfa.add(tree, first)] = k
    # bytes that no set tells apart share a class
    kinds: dict[tuple, list[int]] = {}
    sets = sorted({m[0] for m in nfa.moves if m})
    for b in range(256):
        kinds.setdefault(tuple(s >> b & 1 for s in sets), []).append(b)
    classes = [bytes_[0] for bytes_ in kinds.values()]
    begin = nfa.closure([root])
    number, order, rows = {begin: 0}, [begin], []
    for states in order:
        row = []
        for b in classes:
            reached = nfa.closure([m[1] for s in states if (m := nfa.moves[s]) and m[0] >> b & 1])
            if anywhere:
                reached |= begin
            if reached not in number:
                number[reached] = len(order)
                order.append(reached)
            row.append(number[reached])
        rows.append(row)
    accepts = [tuple(sorted(ends[s] for s in states if s in ends)) for states in order]
    # minimisation: split blocks by what they accept, then by the blocks their moves lead to, until none splits
    names: dict = {}
    block = [names.setdefault(a, len(names)) for a in accepts]
    while True:
        names = {}
        split = [names.setdefault((block[s], *[block[t] for t in rows[s]]), len(names)) for s in range(len(rows))]
        if len(names) == len(set(block)):
            break
        block = split
    of_block = {block[s]: s for s in range(len(rows) - 1, -1, -1)}
    ranked = sorted(of_block, key=lambda b: (accepts[of_block[b]] != (), b))
    place = {b: k << 8 for k, b in enumerate(ranked)}
    table = [0] * (256 * len(ranked))
    for b in ranked:
        for k, members in enumerate(kinds.values()):
            to = place[block[rows[of_block[b]][k]]]
            for byte in members:
                table[place[b] + byte] = to
    rules = [accepts[of_block[b]] for b in ranked]
    dead = next((place[b] for b in ranked if not rules[place[b] >> 8] and set(table[place[b] : place[b] + 256]) == {place[b]}), -1)
    return Automaton(table, place[block[0]], next((k << 8 for k, r in enumerate(rules) if r), len(rules) << 8), rules, dead)
