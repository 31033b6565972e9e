"""Rule regexes compiled to one deterministic automaton over bytes.

A small regex parser gives a Thompson automaton per rule. Subset construction keeps the threads
in priority order, so that one forward pass follows the leftmost match of each rule with greedy
repetition; the rules' automata run side by side as one product, whose states are then minimised
by partition refinement. The result is a pair of transition arrays over byte classes: the next
state, and the set of rules whose match has ended just before the byte.

A rule must stay matched from its first possible end to its last (it ends in a fixed string or a
repeated class): then no byte is read twice. compile_rules() checks that.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# ---- parsing: nodes are ("set", frozenset of bytes), ("cat", a, b), ("alt", a, b), ("rep", a, least, most), ("empty",)


class _Parser:
    def __init__(self, pattern: str, ignore_case: bool) -> None:
        self.p, self.i, self.ci = pattern, 0, ignore_case

    def more(self) -> str:
        return self.p[self.i : self.i + 1]

    def take(self) -> str:
        self.i += 1
        return self.p[self.i - 1]

    def alternatives(self):
        node = self.sequence()
        while self.more() == "|":
            self.take()
            node = ("alt", node, self.sequence())
        return node

    def sequence(self):
        node = ("empty",)
        while self.more() and self.more() not in "|)":
            part = self.repeated()
            node = part if node == ("empty",) else ("cat", node, part)
        return node

    def repeated(self):
        node = self.atom()
        while self.more() and self.more() in "?*+{":
            c = self.take()
            if c == "{":
                body, self.i = self.p[self.i : self.p.index("}", self.i)], self.p.index("}", self.i) + 1
                low, _, high = body.partition(",")
                least, most = int(low), (int(high) if high else None) if "," in body else int(low)
            else:
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            node = ("rep", node, least, most)
        return node

    def atom(self):
        c = self.take()
        if c == "(":
            node = self.alternatives()
            self.take()
            return node
        if c == "[":
            return ("set", self.charset())
        return ("set", self.fold({self.escaped() if c == "\\" else ord(c)}))

    def escaped(self) -> int:
        c = self.take()
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return ord({"n": "\n", "t": "\t"}.get(c, c))

    def charset(self) -> frozenset:
        out: set[int] = set()
        while self.more() != "]":
            c = self.take()
            low = self.escaped() if c == "\\" else ord(c)
            if self.more() == "-" and self.p[self.i + 1] != "]":
                self.take()
                c = self.take()
                out |= set(range(low, (self.escaped() if c == "\\" else ord(c)) + 1))
            else:
                out.add(low)
        self.take()
        return self.fold(out)

    def fold(self, chars: set[int]) -> frozenset:
        if self.ci:
            chars = chars | {ord(chr(c).swapcase()) for c in chars if c < 128}
        return frozenset(chars)


def parse(pattern: str, ignore_case: bool = False):
    return _Parser(pattern, ignore_case).alternatives()


def reverse(node):
    if node[0] == "cat":
        return ("cat", reverse(node[2]), reverse(node[1]))
    if node[0] == "alt":
        return ("alt", reverse(node[1]), reverse(node[2]))
    if node[0] == "rep":
        return ("rep", reverse(node[1]), *node[2:])
    return node


# ---- Thompson automaton


class Nfa:
    """Nodes: ("set", bytes, next), ("split", first, second) or ("match",)."""

    def __init__(self, tree) -> None:
        self.nodes: list = [("match",)]
        self.start = self._add(tree, 0)

    def _new(self, node) -> int:
        self.nodes.append(node)
        return len(self.nodes) - 1

    def _add(self, t, then: int) -> int:
        if t[0] == "empty":
            return then
        if t[0] == "set":
            return self._new(("set", t[1], then))
        if t[0] == "cat":
            return self._add(t[1], self._add(t[2], then))
        if t[0] == "alt":
            return self._new(("split", self._add(t[1], then), self._add(t[2], then)))
        _, body, least, most = t
        if most is None:
            loop = self._new(None)
            self.nodes[loop] = ("split", self._add(body, loop), then)
            at = loop
        else:
            at = then
            for _ in range(most - least):
                at = self._new(("split", self._add(body, at), then))
        for _ in range(least):
            at = self._add(body, at)
        return at

    def closure(self, starts) -> tuple[int, ...]:
        """Consuming and match nodes reachable without input, in priority order."""
        seen, out, stack = set(), [], list(reversed(list(starts)))
        while stack:
            n = stack.pop()
            if n in seen:
                continue
            seen.add(n)
            node = self.nodes[n]
            if node[0] == "split":
                stack += [node[2], node[1]]
            else:
                out.append(n)
        return tuple(out)

    def step(self, threads: tuple[int, ...], byte: int) -> tuple[int, ...]:
        return self.closure(self.nodes[n][2] for n in threads if self.nodes[n][0] == "set" and byte in self.nodes[n][1])


class _Search:
    """One rule's leftmost search: states are thread lists in priority order; dead ends restart."""

    def __init__(self, nfa: Nfa) -> None:
        self.nfa, self.fresh, self.memo = nfa, nfa.closure([nfa.start]), {}

    def _cut(self, threads: tuple[int, ...]) -> tuple[int, ...]:
        return threads[: threads.index(0) + 1] if 0 in threads else threads

    def step(self, state: tuple[int, ...], byte: int) -> tuple[tuple[int, ...], bool]:
        """(next state, whether a match ended before the byte)."""
        if (state, byte) not in self.memo:
            held = 0 in state
            live = self.nfa.step(state, byte)
            if held and not live:
                self.memo[state, byte] = (*self.step(self.fresh, byte)[:1], True)
            elif held:
                if 0 not in live:
                    raise ValueError("a rule must stay matched up to its end")
                self.memo[state, byte] = (self._cut(live), False)
            else:
                live = self._cut(live)
                self.memo[state, byte] = (live if 0 in live else self.nfa.closure([*live, self.nfa.start]), False)
        return self.memo[state, byte]


# ---- deterministic tables


def minimise(following: np.ndarray, output: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge states that no input tells apart; state 0 stays 0."""
    _, block = np.unique(output, axis=0, return_inverse=True)
    block, n = block.ravel(), 0
    while block.max() + 1 > n:
        n = block.max() + 1
        _, block = np.unique(np.column_stack([block, block[following]]), axis=0, return_inverse=True)
        block = block.ravel()
    order = np.unique(block, return_index=True)[1]
    rank = np.empty(len(order), np.int64)
    rank[np.argsort(order)] = np.arange(len(order))
    block, order = rank[block], np.sort(order)
    return block[following[order]], output[order]


def byte_classes(trees) -> tuple[np.ndarray, list[int]]:
    """Class of each byte, and a byte of each class: bytes that every set of the trees treats alike."""
    sets: list[frozenset] = []

    def walk(t) -> None:
        if t[0] == "set":
            sets.append(t[1])
        for x in t[1:]:
            if isinstance(x, tuple):
                walk(x)

    for t in trees:
        walk(t)
    keys: dict[tuple, int] = {}
    of = np.array([keys.setdefault(tuple(b in s for s in sets), len(keys)) for b in range(256)], np.uint8)
    return of, [int(np.argmax(of == k)) for k in range(len(keys))]


@dataclass(frozen=True)
class Backward:
    """Anchored automaton of a reversed rule; finds the longest match that ends at a given byte."""

    classes: bytes
    following: list[list[int]]
    accepts: list[bool]

    def start_of(self, data: bytes, end: int, least: int) -> int:
        state, at, found = 0, end, end
        while at > least:
            at -= 1
            state = self.following[state][self.classes[data[at]]]
            if state < 0:
                break
            if self.accepts[state]:
                found = at
        return found


def backward(tree) -> Backward:
    tree = reverse(tree)
    nfa = Nfa(tree)
    of, members = byte_classes([tree])
    first = tuple(sorted(nfa.closure([nfa.start])))
    ids, todo, rows = {first: 0}, [first], []
    while todo:
        s = todo.pop(0)
        rows.append([ids.setdefault(t, len(ids)) if (t := tuple(sorted(nfa.step(s, b)))) not in ids else ids[t] for b in members])
        known = len(rows) + len(todo)
        todo += [t for t, k in ids.items() if k >= known]
    output = np.array([[0 in s, not s] for s in ids])
    following, output = minimise(np.array(rows), output)
    dead = [i for i, o in enumerate(output) if o[1]]
    return Backward(of.tobytes(), [[-1 if x in dead else int(x) for x in r] for r in following], [bool(o[0]) for o in output])


@dataclass(frozen=True)
class Automaton:
    classes: bytes  # of the 256 bytes
    following: np.ndarray  # flat, state * width + class -> next state * width
    ended: np.ndarray  # flat -> bits of the rules whose match ended before the byte
    width: int
    states: int
    resets: bytes  # 1 for bytes after which every state is the first state


def compile_rules(trees: list) -> Automaton:
    of, members = byte_classes(trees)
    rules = [_Search(Nfa(t)) for t in trees]
    first = tuple(r.fresh for r in rules)
    ids, todo, rows, outs = {first: 0}, [first], [], []
    while todo:
        state = todo.pop()
        row, out = [], []
        for b in members:
            steps = [r.step(s, b) for r, s in zip(rules, state, strict=True)]
            to = tuple(s for s, _ in steps)
            if to not in ids:
                ids[to] = len(ids)
                todo.append(to)
            row.append(ids[to])
            out.append(sum(1 << k for k, (_, e) in enumerate(steps) if e))
        rows.append((ids[state], row, out))
    rows.sort()
    following, output = minimise(np.array([r for _, r, _ in rows]), np.array([o for _, _, o in rows]))
    width = len(members)
    back = np.array([(following[:, k] == 0).all() for k in range(width)])
    return Automaton(of.tobytes(), (following * width).ravel().astype(np.int32), output.ravel().astype(np.int32), width, len(following), back[of].astype(np.uint8).tobytes())
