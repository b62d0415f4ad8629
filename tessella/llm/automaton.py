"""Regular expressions to one minimal deterministic automaton over bytes.

A small dialect: literals, escapes (\\xHH, \\. and the like), classes with ranges, groups, |, ?, *, + and {m}, {m,}, {m,n}.
Expressions become a nondeterministic automaton, subset construction makes it deterministic, partition refinement
makes it minimal. Transitions are arrays [state, byte class].
"""

from __future__ import annotations

import numpy as np


class _Parser:
    def __init__(self, pattern: str, ignore_case: bool = False):
        self.p, self.i, self.ignore_case = pattern, 0, ignore_case

    def parse(self):
        node = self._choice()
        if self.i != len(self.p):
            raise ValueError(f"unexpected {self.p[self.i]!r} at {self.i} in {self.p!r}")
        return node

    def _choice(self):
        options = [self._sequence()]
        while self.p[self.i : self.i + 1] == "|":
            self.i += 1
            options.append(self._sequence())
        return options[0] if len(options) == 1 else ("or", options)

    def _sequence(self):
        parts = []
        while self.i < len(self.p) and self.p[self.i] not in "|)":
            parts.append(self._repeat(self._atom()))
        return ("seq", parts)

    def _repeat(self, node):
        while self.i < len(self.p) and self.p[self.i] in "?*+{":
            c = self.p[self.i]
            self.i += 1
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(c, (0, 0))
            if c == "{":
                end = self.p.index("}", self.i)
                a, comma, b = self.p[self.i : end].partition(",")
                low, high = int(a), (int(b) if b else None) if comma else int(a)
                self.i = end + 1
            node = ("rep", node, low, high)
        return node

    def _set(self, codes) -> tuple:
        codes = set(codes)
        if self.ignore_case:
            codes |= {c ^ 32 for c in codes if 65 <= c & ~32 <= 90}
        return ("set", frozenset(codes))

    def _atom(self):
        c = self.p[self.i]
        self.i += 1
        if c == "(":
            if self.p[self.i : self.i + 2] == "?:":
                self.i += 2
            node = self._choice()
            if self.p[self.i : self.i + 1] != ")":
                raise ValueError(f"missing ) in {self.p!r}")
            self.i += 1
            return node
        if c == "[":
            return self._class()
        return self._set(self._escape() if c == "\\" else {ord(c)} if c != "." else set(range(256)) - {10})

    def _escape(self) -> set[int]:
        c = self.p[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return {int(self.p[self.i - 2 : self.i], 16)}
        if c == "d":
            return set(range(48, 58))
        return {ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))}

    def _class(self):
        negated = self.p[self.i] == "^"
        self.i += negated
        codes: set[int] = set()
        while self.p[self.i] != "]":
            c = self.p[self.i]
            self.i += 1
            low = self._escape() if c == "\\" else {ord(c)}
            if self.p[self.i] == "-" and self.p[self.i + 1] != "]":
                self.i += 1
                c = self.p[self.i]
                self.i += 1
                high = self._escape() if c == "\\" else {ord(c)}
                codes |= set(range(min(low), max(high) + 1))
            else:
                codes |= low
        self.i += 1
        return self._set(set(range(256)) - codes if negated else codes)


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.edges: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.edges.append([])
        return len(self.empty) - 1

    def add(self, node, at: int) -> int:
        """Build node from state `at`; its end."""
        if node[0] == "set":
            end = self.state()
            self.edges[at].append((node[1], end))
            return end
        if node[0] == "seq":
            for part in node[1]:
                at = self.add(part, at)
            return at
        if node[0] == "or":
            end = self.state()
            for option in node[1]:
                self.empty[self.add(option, self._fork(at))].append(end)
            return end
        _, inner, low, high = node
        for _ in range(low):
            at = self.add(inner, at)
        if high is None:
            loop = self._fork(at)
            self.empty[self.add(inner, loop)].append(loop)
            return self._fork(loop)
        end = self.state()
        self.empty[at].append(end)
        for _ in range(high - low):
            at = self.add(inner, at)
            self.empty[at].append(end)
        return end

    def _fork(self, at: int) -> int:
        new = self.state()
        self.empty[at].append(new)
        return new

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


def _backwards(node):
    """The node that matches the same texts read from their end."""
    if node[0] == "set":
        return node
    if node[0] == "rep":
        return ("rep", _backwards(node[1]), *node[2:])
    parts = [_backwards(x) for x in node[1]]
    return (node[0], parts[::-1] if node[0] == "seq" else parts)


class Dfa:
    """next[state * classes + kind[byte]]; state 0 is the start; accepts[state] has the bits of the rules that end there."""

    def __init__(self, patterns: list[tuple[str, bool]], *, search: bool, backwards: bool = False):
        """patterns: (expression, ignore case). search: a match may begin anywhere; else at the start only.

        backwards: bytes are read from the end, so that a rule ends where one of its matches begins.
        """
        nfa = _Nfa()
        start = nfa.state()
        nodes = [_Parser(p, i).parse() for p, i in patterns]
        final = [nfa.add(_backwards(x) if backwards else x, nfa._fork(start)) for x in nodes]
        sets = {s for edges in nfa.edges for s, _ in edges}
        kinds: dict[tuple, int] = {}
        kind = [kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)]
        sample = [kind.index(k) for k in range(len(kinds))]
        begin = nfa.closure([start])
        names, order, rows = {begin: 0}, [begin], []
        for states in order:
            row = []
            for b in sample:
                to = {x for s in states for codes, x in nfa.edges[s] if b in codes}
                target = nfa.closure(to | ({start} if search else set()))
                if target not in names:
                    names[target] = len(order)
                    order.append(target)
                row.append(names[target])
            rows.append(row)
        accept = np.array([sum(1 << k for k, f in enumerate(final) if f in states) for states in order], np.int64)
        table = np.array(rows, np.int64)
        table, accept = _minimal(table, accept)
        self.kind = np.array(kind, np.uint8)
        self.classes = len(kinds)
        self.next = table
        self.accepts = accept
        dead = (table == np.arange(len(table))[:, None]).all(1) & (accept == 0)
        self.dead = int(np.flatnonzero(dead)[0]) if dead.any() else -1


def _minimal(table: np.ndarray, accept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Refine the partition by acceptance until no block is split; the start stays state 0."""
    _, block = np.unique(accept, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack((block, block[table])), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == block.max():
            break
        block = finer
    first = np.full(block.max() + 1, len(block))
    np.minimum.at(first, block, np.arange(len(block)))
    order = np.argsort(first)  # the start's block first
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    return rank[block[table[first[order]]]], accept[first[order]]


def run_states(dfa: Dfa, data: np.ndarray, lanes: int = 2048, rounds: int = 4) -> np.ndarray:
    """The state after each byte, by all lanes at once: the bytes are cut into lanes that start in the start state;
    a lane whose true first state is another one is run again, until all agree with the lane before. What a few
    rounds leave open (a state that outlasts whole lanes) is walked once from left to right: time stays linear."""
    n = len(data)
    lanes = max(1, min(lanes, n // 64))
    width = -(-n // lanes)
    kinds = np.zeros(lanes * width, np.uint8)
    kinds[:n] = dfa.kind[data]
    kinds = np.ascontiguousarray(kinds.reshape(lanes, width).T).astype(np.int32)
    flat = dfa.next.astype(np.int32).ravel() * dfa.classes  # states are kept times the number of classes
    out = np.empty((width, lanes), np.int32)

    def go(which: np.ndarray, state: np.ndarray) -> None:
        every = len(which) == lanes
        for t in range(width):
            state = flat[state + (kinds[t] if every else kinds[t, which])]
            if every:
                out[t] = state
            else:
                same = out[t, which] == state
                out[t, which] = state
                if same.all():  # from here on nothing changes
                    break

    first = np.zeros(lanes, np.int32)
    go(np.arange(lanes), first)
    for _ in range(rounds):
        true = np.concatenate(([0], out[-1, :-1]))
        wrong = np.flatnonzero(true != first)
        if not len(wrong):
            break
        first[wrong] = true[wrong]
        go(wrong, first[wrong])
    else:
        table = flat.tolist()
        for lane in range(1, lanes):
            state = int(out[-1, lane - 1])
            if state == first[lane]:
                continue
            walked = []
            for kind, old in zip(kinds[:, lane].tolist(), out[:, lane].tolist(), strict=True):
                state = table[state + kind]
                if state == old:
                    break
                walked.append(state)
            out[: len(walked), lane] = walked
    return out.T.reshape(-1)[:n] // dfa.classes
