"""Several regular expressions as one minimal deterministic automaton over bytes."""

from __future__ import annotations

from operator import length_hint

import numpy as np

ALL = (1 << 256) - 1
_CLASSES = {"d": "0-9", "w": "A-Za-z0-9_", "s": " \t\n\r\f\v"}


def _mask(chars: str) -> int:
    out, i = 0, 0
    while i < len(chars):
        lo = ord(chars[i])
        if i + 2 < len(chars) and chars[i + 1] == "-":
            hi, i = ord(chars[i + 2]), i + 3
        else:
            hi, i = lo, i + 1
        out |= ((1 << (hi + 1)) - 1) ^ ((1 << lo) - 1)
    return out


class _Nfa:
    """Thompson fragments. States are numbered; ``step[s]`` is (mask, target) or None, ``free[s]`` the empty moves."""

    def __init__(self, backward: bool = False):
        self.step: list[tuple[int, int] | None] = []
        self.free: list[list[int]] = []
        self.backward = backward

    def state(self) -> int:
        self.step.append(None), self.free.append([])
        return len(self.step) - 1

    def add(self, pattern: str, fold: bool) -> tuple[int, int]:
        self.text, self.at, self.fold = pattern, 0, fold
        tree = self._either()
        if self.at != len(pattern):
            raise ValueError(f"unexpected {pattern[self.at]!r} at {self.at} of {pattern!r}")
        return self._build(tree)

    # A tree is ("set", mask), ("cat", trees), ("or", trees) or ("rep", tree, least, most or None).
    def _either(self):
        found = [self._sequence()]
        while self._peek() == "|":
            self.at += 1
            found.append(self._sequence())
        return found[0] if len(found) == 1 else ("or", found)

    def _peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def _sequence(self):
        items = []
        while self._peek() and self._peek() not in "|)":
            items.append(self._repeated(self._atom()))
        return ("cat", items)

    def _repeated(self, tree):
        c = self._peek()
        if c and c in "?*+":
            self.at += 1
            return ("rep", tree, *{"?": (0, 1), "*": (0, None), "+": (1, None)}[c])
        if c == "{":
            end = self.text.index("}", self.at)
            lo, comma, hi = self.text[self.at + 1 : end].partition(",")
            self.at = end + 1
            return ("rep", tree, int(lo), int(hi) if hi else None if comma else int(lo))
        return tree

    def _escape(self) -> int:
        c = self.text[self.at + 1]
        if c == "x":
            self.at += 4
            return 1 << int(self.text[self.at - 2 : self.at], 16)
        self.at += 2
        return _mask(_CLASSES[c]) if c in _CLASSES else 1 << ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))

    def _atom(self):
        c = self._peek()
        if c == "(":
            self.at += 3 if self.text.startswith("(?:", self.at) else 1
            tree = self._either()
            if self._peek() != ")":
                raise ValueError(f"open group in {self.text!r}")
            self.at += 1
            return tree
        if c == "[":
            return ("set", self._cased(self._set()))
        if c == "\\":
            return ("set", self._cased(self._escape()))
        self.at += 1
        return ("set", ALL ^ (1 << 10) if c == "." else self._cased(1 << ord(c)))

    def _set(self) -> int:
        self.at += 1
        negated = self._peek() == "^"
        self.at += negated
        out, first = 0, True
        while first or self._peek() != "]":
            first = False
            if self._peek() == "\\":
                out |= self._escape()
            elif self.text[self.at + 1 : self.at + 2] == "-" and self.text[self.at + 2 : self.at + 3] != "]":
                out |= _mask(self.text[self.at : self.at + 3])
                self.at += 3
            else:
                out |= 1 << ord(self._peek())
                self.at += 1
        self.at += 1
        return ALL ^ out if negated else out

    def _cased(self, mask: int) -> int:
        if self.fold:
            for c in range(65, 91):
                if mask >> c & 1 or mask >> (c + 32) & 1:
                    mask |= 1 << c | 1 << (c + 32)
        return mask

    def _build(self, tree) -> tuple[int, int]:
        a, b = self.state(), self.state()
        if tree[0] == "set":
            self.step[a] = (tree[1], b)
        elif tree[0] == "or":
            for x in tree[1]:
                p, q = self._build(x)
                self.free[a].append(p), self.free[q].append(b)
        elif tree[0] == "cat":
            end = a
            for x in reversed(tree[1]) if self.backward else tree[1]:
                p, q = self._build(x)
                self.free[end].append(p)
                end = q
            self.free[end].append(b)
        else:
            _, x, least, most = tree
            end = a
            for _ in range(least):
                p, q = self._build(x)
                self.free[end].append(p)
                end = q
            if most is None:
                p, q = self._build(x)
                self.free[end].append(p), self.free[q].append(p), self.free[q].append(b)
            for _ in range((most or least) - least):
                p, q = self._build(x)
                self.free[end] += [p, b]
                end = q
            self.free[end].append(b)
        return a, b


class Automaton:
    """Transition array of the minimal automaton for "some rule's match ends here".

    ``classes`` maps a byte to its class; ``moves[state, class]`` is the next state; ``rules[state]`` is the bit set of
    the rules that accept there. For the scan, a state is the list of the states that follow it, and a state where a
    rule accepts is its number: looking into that number fails, so the loop pays for matches only when there are any.
    """

    def __init__(self, classes: bytes, moves: np.ndarray, rules: np.ndarray, start: int):
        self.classes, self.moves, self.rules, self.start = classes, moves, rules, start
        self._rows: list[list] | None = None
        self.table, self.accepts = moves.tolist(), [bool(r) for r in rules.tolist()]
        self.dead = next((i for i, row in enumerate(self.table) if not self.accepts[i] and set(row) == {i}), -1)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_rows": None}

    @property
    def states(self) -> int:
        return len(self.moves)

    def _linked(self) -> list[list]:
        rows: list[list] = [[] for _ in range(len(self.moves))]
        ends = [i if r else rows[i] for i, r in enumerate(self.rules.tolist())]
        for row, after in zip(rows, self.moves.tolist()):
            row.extend(ends[i] for i in after)
        return rows

    def ends(self, data: bytes) -> list[tuple[int, int]]:
        """(end, bit set of rules) of every byte of ``data`` at which a match ends: one pass, one array look-up a byte."""
        if self._rows is None:
            self._rows = self._linked()
        rows, rules, size, found = self._rows, self.rules, len(data), []
        row = rows[self.start]
        left = iter(data.translate(self.classes))
        while True:
            try:
                for c in left:
                    row = row[c]
                break
            except TypeError:  # row was the number of an accepting state, c is what follows it
                found.append((size - length_hint(left) - 1, int(rules[row])))
                row = rows[row][c]
        if isinstance(row, int):
            found.append((size, int(rules[row])))
        return found

    def longest(self, data: bytes, end: int, least: int) -> int | None:
        """Where the longest match that ends at ``end`` begins, not before ``least``; of an automaton that reads backward."""
        state, found = self.start, None
        for at in range(end - 1, least - 1, -1):
            state = self.table[state][self.classes[data[at]]]
            if state == self.dead:
                break
            if self.accepts[state]:
                found = at
        return found


def compile_rules(patterns: list[tuple[str, bool]], backward: bool = False) -> Automaton:
    """Subset construction over all ``(pattern, ignore ASCII case)`` at once, then minimisation by refinement.

    Forward, a match can begin at any byte; ``backward``, the patterns are reversed and a match begins at the first.
    """
    nfa, starts, ends = _Nfa(backward), [], {}
    for i, (pattern, fold) in enumerate(patterns):
        a, b = nfa.add(pattern, fold)
        starts.append(a)
        ends[b] = 1 << i
    close: dict[int, frozenset[int]] = {}

    def closure(s: int) -> frozenset[int]:
        if s not in close:
            seen, todo = {s}, [s]
            while todo:
                for t in nfa.free[todo.pop()]:
                    if t not in seen:
                        seen.add(t), todo.append(t)
            close[s] = frozenset(x for x in seen if nfa.step[x] or x in ends)
        return close[s]

    masks = {m for x in nfa.step if x for m in [x[0]]}
    byte_class = np.unique([[m >> b & 1 for m in sorted(masks)] for b in range(256)], axis=0, return_inverse=True)[1].ravel()
    width = int(byte_class.max()) + 1
    sample = [int(np.argmax(byte_class == c)) for c in range(width)]
    origin = frozenset().union(*(closure(s) for s in starts))
    index, todo, rows = {origin: 0}, [origin], []
    while todo:
        for now in todo.copy():
            todo.remove(now)
            row = []
            for b in sample:
                after = set() if backward else set(origin)
                for s in now:
                    if (x := nfa.step[s]) and x[0] >> b & 1:
                        after |= closure(x[1])
                after = frozenset(after)
                if after not in index:
                    index[after] = len(index)
                    todo.append(after)
                row.append(index[after])
            rows.append((index[now], row))
    table = np.array([row for _, row in sorted(rows)])
    accepts = np.zeros(len(table), np.int64)
    for states, i in index.items():
        for s in states:
            accepts[i] |= ends.get(s, 0)
    label = np.unique(accepts, return_inverse=True)[1].ravel()
    while True:
        finer = np.unique(np.column_stack([label, label[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == label.max():
            break
        label = finer
    n = int(label.max()) + 1
    pick = np.array([int(np.argmax(label == i)) for i in range(n)])
    return Automaton(bytes(byte_class.astype(np.uint8)), label[table[pick]].astype(np.int32), accepts[pick], int(label[0]))
