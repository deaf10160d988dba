"""A suffix automaton over words, for matching statistics of a window's length."""

from __future__ import annotations

from collections.abc import Sequence


class SuffixAutomaton:
    """All substrings of the strings added, each with the least rank of a string that holds it.

    State s stands for substrings of up to ``size[s]`` symbols that end at the same places;
    ``link[s]`` stands for their next shorter suffixes.  ``least[s]`` holds after `close`.
    """

    def __init__(self):
        self.step: list[dict] = [{}]
        self.link = [-1]
        self.size = [0]
        self.least: list[int] = [1 << 63]

    def _split(self, p: int, symbol, q: int) -> int:
        """The part of q whose substrings are no longer than size[p] + 1, as a state of its own."""
        step, link, size = self.step, self.link, self.size
        part = len(size)
        step.append(step[q].copy())
        link.append(link[q])
        size.append(size[p] + 1)
        self.least.append(self.least[q])
        link[q] = part
        while p >= 0 and step[p].get(symbol) == q:
            step[p][symbol] = part
            p = link[p]
        return part

    def add(self, string: Sequence, rank: int) -> None:
        step, link, size, least = self.step, self.link, self.size, self.least
        last = 0
        for symbol in string:
            q = step[last].get(symbol)
            if q is not None:  # another string begins alike
                last = q if size[q] == size[last] + 1 else self._split(last, symbol, q)
            else:
                new, p = len(size), last
                step.append({})
                size.append(size[last] + 1)
                link.append(0)
                least.append(rank)
                while p >= 0 and symbol not in step[p]:
                    step[p][symbol] = new
                    p = link[p]
                if p >= 0:
                    q = step[p][symbol]
                    link[new] = q if size[q] == size[p] + 1 else self._split(p, symbol, q)
                last = new
            if rank < least[last]:
                least[last] = rank

    def close(self) -> SuffixAutomaton:
        """Carries the least ranks to all suffixes; to be called after the last `add`."""
        least, link = self.least, self.link
        for s in sorted(range(1, len(link)), key=self.size.__getitem__, reverse=True):
            if least[s] < least[link[s]]:
                least[link[s]] = least[s]
        return self

    def statistics(self, string: Sequence, window: int) -> list[int | None]:
        """For each symbol of the stream: where the longest match that ends there has ``window``
        symbols or more, the least rank of the strings holding its last ``window``; else None."""
        step, link, size, least = self.step, self.link, self.size, self.least
        s, length, out = 0, 0, []
        for symbol in string:
            to = step[s].get(symbol)
            while to is None and s:
                s = link[s]
                length = size[s]
                to = step[s].get(symbol)
            if to is None:
                out.append(None)
                continue
            s, length = to, length + 1
            while size[link[s]] >= window:  # only the last window counts
                s = link[s]
                length = size[s]
            out.append(least[s] if length >= window else None)
        return out
