"""A suffix automaton over sequences of words that grows document by document.

State s stands for the words that end alike; ``length[s]`` is its longest string. Streaming a sequence through the
automaton gives its matching statistics: at each place the longest match that ends there.
"""

from __future__ import annotations

from collections.abc import Hashable, Sequence


class SuffixAutomaton:
    def __init__(self) -> None:
        self.next: list[dict[Hashable, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.last = 0

    def __len__(self) -> int:
        return len(self.next)

    def _state(self, length: int, transitions: dict, link: int) -> int:
        self.next.append(transitions)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, word: Hashable, q: int) -> int:
        """The state for the strings of q that p's longest reaches by the word."""
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: Sequence[Hashable]) -> None:
        """Take in one more sequence; matches never run from one sequence into another."""
        last = 0
        for word in words:
            p, q = last, self.next[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
                continue
            new = self._state(self.length[last] + 1, {}, 0)
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
            last = new

    def statistics(self, words: Sequence[Hashable]) -> list[int]:
        """For each place of a sequence, the length of the longest string of the automaton that ends there."""
        state = size = 0
        out = []
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.next[state]:
                state, size = self.next[state][word], size + 1
            else:
                size = 0
            out.append(size)
        return out


def spans(statistics: Sequence[int], least: int) -> list[tuple[int, int]]:
    """The maximal runs of places that matches of ``least`` words and more cover, as (first, end)."""
    out: list[tuple[int, int]] = []
    for end, size in enumerate(statistics, 1):
        if size >= least:
            if out and out[-1][1] >= end - size:
                out[-1] = min(out[-1][0], end - size), end
            else:
                out.append((end - size, end))
    return out
