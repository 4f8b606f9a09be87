"""An error-correcting Earley parser: weighted productions for the mistakes, and in the chart the cheapest way to each item."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

#: What an item is worth: its least cost and, of the ways that cost it, the audit that is first in ASCII order.
Value = tuple[int, str]
#: A rule, how far its right side has been read, and the column where it began.
Item = tuple[int, int, int]


@dataclass(frozen=True)
class Row:
    """A row as the parser sees it: the letter of its role, whether it must go, and what keeping or changing it costs more."""

    letter: str
    must_go: bool = False
    more: int = 0


@dataclass(frozen=True)
class Grammar:
    """Rules of a grammar whose terminals are letters, and the prices of its error productions.

    ``rules`` are (left, right side); a symbol that stands on no left side is a terminal, and ``end`` is the one that
    stands behind the last row. A terminal is read by keeping a row of that letter (K), by changing the role of any row
    (R) or by putting in an empty row (I), the last two only for the letters of ``makes``; before any terminal a row
    may be left out (D). No two of these audits that cost the same can be one another's beginning: what they differ in
    would be insertions, which cost. So the better of two ways to an item stays the better, whatever follows, and one
    value for each item is enough.
    """

    rules: tuple[tuple[str, tuple[str, ...]], ...]
    makes: frozenset[str]
    start: str = "G"
    end: str = "$"
    delete: int = 4
    rerole: int = 3
    insert: int = 3
    #: For grammars whose items all begin in column 0: what it costs at most to go on from any item as from any other.
    #: An item that is dearer than the cheapest by more than this is on no cheapest way.
    slack: int | None = None

    @cached_property
    def left_sides(self) -> dict[str, list[int]]:
        out: dict[str, list[int]] = {}
        for i, (left, _) in enumerate(self.rules):
            out.setdefault(left, []).append(i)
        return out

    def after(self, item: Item) -> str | None:
        right = self.rules[item[0]][1]
        return right[item[1]] if item[1] < len(right) else None


#: ``(s?(ua)+)?``: T is what ends with an assistant, O what waits for one. Every rule begins with what came before it
#: (the grammar is left-linear), so all items begin in column 0 and a column has the same few items however long a
#: conversation is. At most 7: behind a user, to go on as if nothing had been kept, an assistant is put in and a system
#: row is left out.
ROLES = Grammar((("G", ("E", "$")), ("G", ("T", "$")), ("E", ()), ("T", ("O", "a")), ("O", ("u",)), ("O", ("S", "u")), ("O", ("T", "u")), ("S", ("s",))), frozenset("ua"), slack=7)


class Chart:
    """Columns of items; ``read`` makes the next one of a row. Only columns where an item of the last one began are kept."""

    def __init__(self, grammar: Grammar):
        self.grammar, self.at = grammar, 0
        self.columns: dict[int, dict[Item, Value]] = {0: {}}
        self._close({(i, 0, 0): (0, "") for i in grammar.left_sides[grammar.start]})

    def read(self, row: Row) -> None:
        g, nxt = self.grammar, {}
        for item, (cost, audit) in self.columns[self.at].items():
            letter = g.after(item)
            if letter is None or letter in g.left_sides:
                continue
            rule, dot, origin = item
            _better(nxt, item, (cost + g.delete, audit + "D"))
            if not row.must_go and letter != g.end:
                if letter == row.letter:
                    _better(nxt, (rule, dot + 1, origin), (cost + row.more, audit + "K"))
                if letter in g.makes:
                    _better(nxt, (rule, dot + 1, origin), (cost + g.rerole + row.more, audit + "R"))
        self.at += 1
        self.columns[self.at] = {}
        self._close(nxt)
        if g.slack is not None:
            most = min(v[0] for i, v in self.columns[self.at].items() if self._goes_on(i)) + g.slack
            self.columns[self.at] = {i: v for i, v in self.columns[self.at].items() if v[0] <= most}
        live = {o for _, _, o in self.columns[self.at]} | {self.at}
        self.columns = {k: c for k, c in self.columns.items() if k in live}

    def _close(self, new: dict[Item, Value]) -> None:
        """Predictions, completions and insertions of the last column, until no item gets better."""
        g, column = self.grammar, self.columns[self.at]
        todo = []
        for item, value in new.items():
            if _better(column, item, value):
                todo.append(item)
        while todo:
            item = todo.pop()
            value, symbol = column[item], g.after(item)
            made: list[tuple[Item, Value]] = []
            if symbol is None:
                left, origin = g.rules[item[0]][0], item[2]
                for waiting, (cost, audit) in list(self.columns[origin].items()):
                    if g.after(waiting) == left:
                        made.append(((waiting[0], waiting[1] + 1, waiting[2]), (cost + value[0], audit + value[1])))
            elif symbol in g.left_sides:
                made += [((rule, 0, self.at), (0, "")) for rule in g.left_sides[symbol]]
                for done, (cost, audit) in list(column.items()):  # what was completed here before it was waited for
                    if done[2] == self.at and g.after(done) is None and g.rules[done[0]][0] == symbol:
                        made.append(((item[0], item[1] + 1, item[2]), (value[0] + cost, value[1] + audit)))
            elif symbol in g.makes:
                made.append(((item[0], item[1] + 1, item[2]), (value[0] + g.insert, value[1] + "I")))
            for other, worth in made:
                if _better(column, other, worth):
                    todo.append(other)

    def decided(self) -> str:
        """Takes the edits off the audits with which all ways to the last column begin, and returns them. For grammars
        whose items all begin in column 0."""
        column = {i: v for i, v in self.columns[self.at].items() if self._goes_on(i)}
        audits = [a for _, a in column.values()]
        low, high = min(audits), max(audits)
        n = next((k for k, (x, y) in enumerate(zip(low, high)) if x != y), min(len(low), len(high)))
        if n and self.at:
            self.columns[self.at] = {i: (c, a[n:]) for i, (c, a) in column.items()}
        return low[:n] if self.at else ""

    def _goes_on(self, item: Item) -> bool:
        """Whether a later column can come of an item: it waits for a terminal."""
        symbol = self.grammar.after(item)
        return symbol is not None and symbol not in self.grammar.left_sides

    def result(self) -> Value:
        """The cheapest way through all rows: of the start's rules whose last symbol, the end, comes next."""
        g = self.grammar
        return min(v for i, v in self.columns[self.at].items() if g.rules[i[0]][0] == g.start and i[2] == 0 and g.after(i) == g.end)


def _better(column: dict[Item, Value], item: Item, value: Value) -> bool:
    if item in column and column[item] <= value:
        return False
    column[item] = value
    return True


def parse(rows: list[Row], grammar: Grammar = ROLES) -> Value:
    """(cost, audit) of the cheapest repair of all rows at once."""
    chart = Chart(grammar)
    for row in rows:
        chart.read(row)
    return chart.result()
