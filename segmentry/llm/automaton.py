"""Suffix automata over sequences of word hashes."""

from __future__ import annotations


class SuffixAutomaton:
    """Of several sequences: recognises exactly their common stock of substrings."""

    __slots__ = ("length", "link", "next")

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, sequence: list[int]) -> None:
        """Takes in one more sequence (no substring runs from one sequence into another)."""
        following, link, length = self.next, self.link, self.length
        last = 0
        for c in sequence:
            to = following[last].get(c)
            if to is not None and length[to] == length[last] + 1:
                last = to
                continue
            if to is None:
                new = len(following)
                following.append({})
                length.append(length[last] + 1)
                link.append(0)
                p = last
                while p >= 0 and c not in following[p]:
                    following[p][c] = new
                    p = link[p]
                last = new
                if p < 0:
                    continue
                q = following[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                    continue
                owner = new
            else:
                p, q, owner = last, to, -1
            copy = len(following)
            following.append(dict(following[q]))
            length.append(length[p] + 1)
            link.append(link[q])
            link[q] = copy
            if owner >= 0:
                link[owner] = copy
            else:
                last = copy
            while p >= 0 and following[p].get(c) == q:
                following[p][c] = copy
                p = link[p]

    def matching(self, sequence: list[int]) -> list[int]:
        """For each place, the length of the longest substring of the stock that ends there."""
        following, link, length = self.next, self.link, self.length
        state = size = 0
        out = []
        for c in sequence:
            while state and c not in following[state]:
                state = link[state]
                size = length[state]
            to = following[state].get(c)
            if to is None:
                state = size = 0
            else:
                state = to
                size += 1
            out.append(size)
        return out
