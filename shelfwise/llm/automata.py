"""Probabilistic automata inferred from example strings by merging prefix-tree states.

The states of a prefix tree with visit counts are merged when their termination and transition
frequencies agree within a Hoeffding bound, recursively, so that the tree folds into an automaton
that gives every string a probability. Symbols are classes of characters.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterable

CONFIDENCE = 0.05
FLOOR = 1e-6
END = ""


def symbol(char: str) -> str:
    """Character class: a-f and digits are apart from other letters; punctuation is itself."""
    if "0" <= char <= "9":
        return "0"
    if "a" <= char <= "f":
        return "a"
    if "g" <= char <= "z":
        return "g"
    if "A" <= char <= "F":
        return "A"
    if "G" <= char <= "Z":
        return "G"
    return char


class Automaton:
    """Counts of a deterministic automaton: visits, endings and transitions of each state."""

    def __init__(self, examples: Iterable[str] = ()):
        self.visits, self.ends = [0], [0]
        self.next: list[dict[str, int]] = [{}]
        self.taken: list[dict[str, int]] = [{}]
        for example in examples:
            state = 0
            self.visits[0] += 1
            for char in example:
                key = symbol(char)
                self.taken[state][key] = self.taken[state].get(key, 0) + 1
                if key not in self.next[state]:
                    self.next[state][key] = len(self.visits)
                    self.visits.append(0)
                    self.ends.append(0)
                    self.next.append({})
                    self.taken.append({})
                state = self.next[state][key]
                self.visits[state] += 1
            self.ends[state] += 1

    def _differ(self, f1: int, n1: int, f2: int, n2: int, confidence: float) -> bool:
        if not n1 or not n2:
            return False
        bound = math.sqrt(0.5 * math.log(2 / confidence)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))
        return abs(f1 / n1 - f2 / n2) > bound

    def compatible(self, a: int, b: int, confidence: float) -> bool:
        pairs = deque([(a, b)])
        while pairs:
            x, y = pairs.popleft()
            n1, n2 = self.visits[x], self.visits[y]
            if self._differ(self.ends[x], n1, self.ends[y], n2, confidence):
                return False
            for key in self.taken[x].keys() | self.taken[y].keys():
                if self._differ(self.taken[x].get(key, 0), n1, self.taken[y].get(key, 0), n2, confidence):
                    return False
                if key in self.next[x] and key in self.next[y]:
                    pairs.append((self.next[x][key], self.next[y][key]))
        return True

    def _fold(self, into: int, tree: int) -> None:
        """Add the counts of a subtree to the automaton, state by state."""
        pairs = deque([(into, tree)])
        while pairs:
            x, y = pairs.popleft()
            self.visits[x] += self.visits[y]
            self.ends[x] += self.ends[y]
            for key, count in self.taken[y].items():
                self.taken[x][key] = self.taken[x].get(key, 0) + count
                if key in self.next[x]:
                    pairs.append((self.next[x][key], self.next[y][key]))
                else:
                    self.next[x][key] = self.next[y][key]

    def merged(self, confidence: float = CONFIDENCE) -> "Automaton":
        """Merge border states into settled ones, first found first, until none is left."""
        settled = [0]
        while True:
            border = [
                (state, key, target)
                for state in settled
                for key, target in sorted(self.next[state].items())
                if target not in settled
            ]
            if not border:
                return self
            # The most visited border state has the most evidence.
            state, key, target = max(border, key=lambda x: (self.visits[x[2]], -x[2]))
            for candidate in settled:
                if self.compatible(candidate, target, confidence):
                    self.next[state][key] = candidate
                    self._fold(candidate, target)
                    break
            else:
                settled.append(target)

    def table(self) -> list[dict[str, tuple[float, int]]]:
        """Per state: log2 probability and next state of each symbol; END ends the string."""
        index, order = {0: 0}, [0]
        for state in order:
            for target in self.next[state].values():
                if target not in index:
                    index[target] = len(index)
                    order.append(target)
        rows = []
        for state in order:
            total = max(1, self.visits[state])
            row = {k: (math.log2(c / total), index[self.next[state][k]]) for k, c in self.taken[state].items()}
            if self.ends[state]:
                row[END] = (math.log2(self.ends[state] / total), 0)
            rows.append(row)
        return rows


def log_likelihood(table: list[dict[str, tuple[float, int]]], text: str) -> float:
    """Mean log2 probability per step of ``text``; steps the automaton lacks cost the floor."""
    floor = math.log2(FLOOR)
    state, total = 0, 0.0
    for i, char in enumerate(text):
        step = table[state].get(symbol(char))
        if step is None:
            return (total + floor * (len(text) + 1 - i)) / (len(text) + 1)
        total += step[0]
        state = step[1]
    return (total + table[state].get(END, (floor, 0))[0]) / (len(text) + 1)
