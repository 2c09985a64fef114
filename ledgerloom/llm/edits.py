"""Edit distance and look-up of words within an edit distance."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable


def osa(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance (a swap of neighbours is one edit), or most + 1 if it is larger."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most and min(last) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def deletions(word: str, most: int) -> set[str]:
    """The word and all words left by deleting at most ``most`` of its letters."""
    found = level = {word}
    for _ in range(most):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        found = found | level
    return found


class NearWords:
    """Vocabulary words within an edit distance, found by meeting in their deletions (no comparison with every word)."""

    def __init__(self, words: Iterable[str], allowed) -> None:
        self.allowed = allowed
        self.by_rest: dict[str, list[str]] = defaultdict(list)
        for w in words:
            for rest in deletions(w, allowed(len(w))):
                self.by_rest[rest].append(w)

    def near(self, word: str) -> dict[str, int]:
        """Words within the distance their own length allows, and that distance."""
        found: dict[str, int] = {}
        for rest in deletions(word, self.allowed(len(word) + 1)):
            for w in self.by_rest.get(rest, ()):
                if w not in found:
                    found[w] = osa(word, w, self.allowed(len(w)))
        return {w: d for w, d in found.items() if d <= self.allowed(len(w))}


def abbreviates(short: str, word: str) -> bool:
    """``short`` begins as ``word`` does and leaves letters out of it, in order (Bldg, Cmps, Indl, Op)."""
    if not 2 <= len(short) < len(word) or short[0] != word[0]:
        return False
    rest = iter(word)
    return all(c in rest for c in short)
