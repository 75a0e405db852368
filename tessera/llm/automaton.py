"""Generalised suffix automata over word sequences, with the least document of every state.

The strings of a state end at the same places, so one document number says
where any of them is found first. ``matching`` gives the matching statistics of
a text, bounded by the window: at each word the longest string that ends there
and stands in the reference, cut back to the window's length, and the least
document that holds it.

Defined results: an automaton of nothing matches nothing; repeated strings
count once, under their least document; a text shorter than the window has no
match; strings of any length cost time in proportion to their length.
"""

from __future__ import annotations

import numpy as np

#: Above every document number.
NOWHERE = 2**63 - 1


class SuffixAutomaton:
    """States are numbers: ``steps[v]`` maps a symbol to the next state, ``link[v]`` is the state of the longest suffix elsewhere."""

    def __init__(self) -> None:
        self.steps: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.least = [NOWHERE]

    def add(self, symbols: list[int], document: int) -> None:
        """Take in one string; call ``close`` after the last."""
        steps, link, length, least = self.steps, self.link, self.length, self.least
        last = 0
        for c in symbols:
            known = steps[last].get(c)
            if known is not None:  # an earlier string holds this prefix
                last = known if length[known] == length[last] + 1 else self._clone(last, c, known)
                if document < least[last]:
                    least[last] = document
                continue
            new = len(steps)
            steps.append({})
            link.append(0)
            length.append(length[last] + 1)
            least.append(document)
            v = last
            while v >= 0:
                there = steps[v]
                if c in there:
                    break
                there[c] = new
                v = link[v]
            if v >= 0:
                known = steps[v][c]
                link[new] = known if length[known] == length[v] + 1 else self._clone(v, c, known)
            last = new

    def _clone(self, v: int, c: int, known: int) -> int:
        """Part the strings of ``known`` that are no longer than v's own and ``c`` from the rest."""
        steps, link = self.steps, self.link
        copy = len(steps)
        steps.append(steps[known].copy())
        link.append(link[known])
        self.length.append(self.length[v] + 1)
        self.least.append(self.least[known])
        link[known] = copy
        while v >= 0 and steps[v].get(c) == known:
            steps[v][c] = copy
            v = link[v]
        return copy

    def close(self) -> None:
        """Hand each state's least document on to the states of its suffixes, longest first."""
        length, link = np.array(self.length), np.array(self.link)
        least = np.array(self.least, dtype=np.int64)
        order = np.argsort(-length, kind="stable")
        order = order[length[order] > 0]
        cuts = np.flatnonzero(np.append(True, np.diff(length[order]) != 0)) if len(order) else []
        for part in np.split(order, cuts[1:]) if len(order) else []:
            np.minimum.at(least, link[part], least[part])
        self.least = least.tolist()

    def matching(self, symbols: list[int | None], window: int) -> list[int]:
        """For each word: the least document with the window that ends there, ``NOWHERE`` if it has none."""
        steps, link, length, least = self.steps, self.link, self.length, self.least
        out, v, run = [NOWHERE] * len(symbols), 0, 0
        for i, c in enumerate(symbols):
            to = steps[v].get(c)
            while to is None and v:  # shorten the match until it can be extended
                v = link[v]
                run = length[v]
                to = steps[v].get(c)
            if to is None:
                run = 0
                continue
            v, run = to, run + 1
            if run >= window:
                while length[link[v]] >= window:
                    v = link[v]
                run = window
                out[i] = least[v]
        return out
