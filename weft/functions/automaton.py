"""An automaton that finds all names of a dictionary in texts at once."""

from __future__ import annotations

from collections import deque

import numpy as np

#: Characters of a text that are walked through side by side with those of others.
SEGMENT = 2048
#: Segments walked through at once.
ROWS = 512


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Automaton:
    """States of the names' prefixes with goto, failure and output arrays.

    goto is sparse: the sorted keys state * width + character class, and the states they lead
    to. name is the number of the name that ends in a state, or -1; shorter leads to the
    longest proper suffix of the state in which another name ends, 0 if there is none.
    """

    def __init__(self, names: list[str]):
        self.names = names
        self.longest = max(map(len, names), default=0)
        self.alphabet = np.unique(np.concatenate([np.zeros(0, dtype=np.uint32), *map(codes, names)]))
        self.width = len(self.alphabet) + 1
        children: list[dict[int, int]] = [{}]
        name = [-1]
        for k, text in enumerate(names):
            state = 0
            for c in (np.searchsorted(self.alphabet, codes(text)) + 1).tolist():
                if c not in children[state]:
                    children[state][c] = len(children)
                    children.append({})
                    name.append(-1)
                state = children[state][c]
            if state:
                name[state] = k
        failure, shorter = [0] * len(children), [0] * len(children)
        queue = deque(children[0].values())
        while queue:
            state = queue.popleft()
            for c, child in children[state].items():
                back = failure[state]
                while back and c not in children[back]:
                    back = failure[back]
                failure[child] = children[back].get(c, 0)
                shorter[child] = failure[child] if name[failure[child]] >= 0 else shorter[failure[child]]
                queue.append(child)
        edges = sorted((s * self.width + c, t) for s, below in enumerate(children) for c, t in below.items())
        self.key, self.to = np.array([e[0] for e in edges], dtype=np.int64), np.array([e[1] for e in edges], dtype=np.int64)
        self.failure, self.name, self.shorter = (np.array(x, dtype=np.int64) for x in (failure, name, shorter))
        self.size = np.array([len(n) for n in names], dtype=np.int64)
        self.ends = (self.name >= 0) | (self.shorter > 0)

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The states after one more character each."""
        state, out = state.copy(), np.zeros(len(state), dtype=np.int64)
        open_ = np.flatnonzero(c)  # class 0 is no character of any name
        while len(open_):
            key = state[open_] * self.width + c[open_]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            hit = self.key[at] == key
            out[open_[hit]] = self.to[at[hit]]
            open_ = open_[~hit & (state[open_] > 0)]
            state[open_] = self.failure[state[open_]]
        return out

    def occurrences(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, start and name number of every occurrence, overlapping ones too."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        reach = SEGMENT + max(self.longest - 1, 0)
        pieces = [(i, low) for i, t in enumerate(texts) for low in range(0, len(t), SEGMENT)] if len(self.key) else []
        for first in range(0, len(pieces), ROWS):
            some = pieces[first : first + ROWS]
            grid = np.zeros((len(some), reach), dtype=np.int64)
            for r, (i, low) in enumerate(some):
                x = codes(texts[i][low : low + reach])
                at = np.minimum(np.searchsorted(self.alphabet, x), len(self.alphabet) - 1)
                grid[r, : len(x)] = np.where(self.alphabet[at] == x, at + 1, 0)
            of, base = (np.array(x, dtype=np.int64) for x in zip(*some, strict=True))
            state = np.zeros(len(some), dtype=np.int64)
            for j in range(reach):
                state = self.step(state, grid[:, j])
                row = np.flatnonzero(self.ends[state])
                now = state[row]
                while len(row):
                    real = self.name[now] >= 0
                    start = j + 1 - self.size[self.name[now[real]]]
                    own = start < SEGMENT  # later ones belong to the next segment
                    found.append((of[row[real]][own], base[row[real]][own] + start[own], self.name[now[real]][own]))
                    now = self.shorter[now]
                    row, now = row[now > 0], now[now > 0]
        if not found:
            return tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def present(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Text and name number of the names that occur, each once a text."""
        of, _, name = self.occurrences(texts)
        pairs = np.unique(of * max(1, len(self.names)) + name)
        return np.divmod(pairs, max(1, len(self.names)))

    def leftmost_longest(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """Text, start and name number of occurrences that do not overlap: at each place the longest."""
        of, start, name = self.occurrences(texts)
        out, text, end = [], -1, 0
        for k in np.lexsort((-self.size[name] if len(name) else name, start, of)).tolist():
            if of[k] != text:
                text, end = int(of[k]), 0
            if start[k] >= end:
                out.append((text, int(start[k]), int(name[k])))
                end = int(start[k] + self.size[name[k]])
        return out
