"""Byte-pair encoding of single words, for use inside Arrow-batched workers."""

from __future__ import annotations

import heapq
from collections.abc import Iterable


class BpeCoder:
    """Splits words with ranked merge rules.

    ``merges`` yields ``(rank, left, right)``; the lowest rank is applied first, leftmost first.
    A word is given in the byte alphabet. An empty word has no symbols.
    """

    def __init__(self, merges: Iterable[tuple[int, str, str]]):
        self.rank: dict[tuple[str, str], int] = {}
        for rank, left, right in merges:
            self.rank.setdefault((left, right), rank)

    def split(self, word: str) -> list[str]:
        """The symbols of ``word`` after all applicable merges."""
        n = len(word)
        if n < 2:
            return [word] if n else []
        if n <= 24:
            return self._split_short(list(word))
        return self._split_long(list(word))

    def _split_short(self, parts: list[str]) -> list[str]:
        rank, none = self.rank, 1 << 60
        ranks = [rank.get(pair, none) for pair in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = rank.get((parts[i], parts[i + 1]), none)
        return parts

    def _split_long(self, parts: list[str]) -> list[str]:
        """Linked list and heap, so that a word of n bytes takes n log n steps."""
        rank, n = self.rank, len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        alive = [True] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j] = a + b, False
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (r := rank.get((parts[left], parts[right]))) is not None:
                    heapq.heappush(heap, (r, left, parts[left], parts[right]))
        return [p for p, ok in zip(parts, alive) if ok]

    def length(self, word: str) -> int:
        """Number of symbols of ``word``."""
        return len(self.split(word))
