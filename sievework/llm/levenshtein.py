"""Levenshtein automata intersected with a trie of terms, as one automaton whose states are made when a text first needs them.

A state is a set of (trie node, errors so far). Reading a character follows an edge, or spends an error on a substitution, an insertion
or, before reading, on a skipped term character. Terms shorter than `exact_below` allow no error, longer ones one, and from `two_from` on two. A term may be
a stem: what reaches its end without an error matches whatever follows.
"""

from __future__ import annotations


class Lexicon:
    def __init__(self, terms: dict[str, float], stems: dict[str, float], exact_below: int = 5, two_from: int = 9, budgets: dict[str, int] | None = None, plain: frozenset[str] = frozenset()):
        """Terms and stems with the weight of each. `budgets` lowers the errors of single terms; words in `plain` are met without an error only."""
        self.plain = plain
        self.children: list[dict[str, int]] = [{}]
        self.word: list[float | None] = [None]
        self.stem: list[float | None] = [None]
        self.most = [0]  # errors that some term at or below the node allows
        self.allowed: list[int] = [0]
        for group, weights in ((self.word, terms), (self.stem, stems)):
            for term, weight in sorted(weights.items()):
                budget = 0 if group is self.stem or len(term) < exact_below else 1 if len(term) < two_from else 2
                budget = min(budget, (budgets or {}).get(term, budget))
                node = 0
                self.most[0] = max(self.most[0], budget)
                for c in term:
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        for column, empty in ((self.children, {}), (self.word, None), (self.stem, None), (self.most, 0), (self.allowed, 0)):
                            column.append(dict(empty) if empty == {} else empty)
                    node = self.children[node][c]
                    self.most[node] = max(self.most[node], budget)
                group[node] = max(weight, group[node] or weight)
                if group is self.word:
                    self.allowed[node] = budget
        self.names = {}
        for term in terms:
            node = 0
            for c in term:
                node = self.children[node][c]
            self.names[node] = term
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.step: list[dict[str, int]] = []
        self.exact: list[tuple[float, int] | None] = []  # of the best whole term that ends here: weight, errors
        self.begun: list[float | None] = []  # weight of the best stem that ends here
        self.start = self._state({(0, 0)})

    def _state(self, nodes: set[tuple[int, int]]) -> int:
        todo = list(nodes)
        while todo:  # skipped term characters
            node, e = todo.pop()
            for child in self.children[node].values():
                if e + 1 <= self.most[child] and (child, e + 1) not in nodes:
                    nodes.add((child, e + 1))
                    todo.append((child, e + 1))
        least: dict[int, int] = {}
        for node, e in nodes:
            least[node] = min(e, least.get(node, e))
        key = frozenset(least.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.step.append({})
            ends = [(e, -self.word[n]) for n, e in key if self.word[n] is not None and e <= self.allowed[n]]
            self.exact.append((-min(ends)[1], min(ends)[0]) if ends else None)
            stems = [self.stem[n] for n, e in key if e == 0 and self.stem[n] is not None]
            self.begun.append(max(stems) if stems else None)
        return self.ids[key]

    def _read(self, state: int, c: str) -> int:
        out: set[tuple[int, int]] = set()
        for node, e in self.sets[state]:
            for edge, child in self.children[node].items():
                if edge == c:
                    out.add((child, e))
                elif e + 1 <= self.most[child]:
                    out.add((child, e + 1))
            if e + 1 <= self.most[node]:
                out.add((node, e + 1))
        to = self._state(out) if out else -1
        self.step[state][c] = to
        return to

    def match(self, word: str, stems: bool = True) -> tuple[float, int] | None:
        """Weight and errors of the best term; fewest errors first, then the greatest weight. A stem counts as no error."""
        if len(self.sets) > 50_000:
            self._reset()
        state, stem = self.start, None
        for c in word:
            state = self.step[state][c] if c in self.step[state] else self._read(state, c)
            if state < 0:
                return (stem, 0) if stem is not None else None
            if stems and self.begun[state] is not None:
                stem = max(self.begun[state], stem if stem is not None else self.begun[state])
        found = self.exact[state]
        if found is not None and found[1] and word in self.plain:
            found = None
        if stem is not None and (found is None or found[1] > 0 or found[0] < stem):
            return stem, 0
        return found

    def near(self, word: str) -> list[tuple[str, int]]:
        """Every term that allows the errors with which it reads as word, and how many these are."""
        if len(self.sets) > 50_000:
            self._reset()
        state = self.start
        for c in word:
            state = self.step[state][c] if c in self.step[state] else self._read(state, c)
            if state < 0:
                return []
        return [(self.names[n], e) for n, e in self.sets[state] if n in self.names and e <= self.allowed[n]]
