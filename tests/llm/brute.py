"""Plain-Python versions of operators for small tables."""

import re
from collections import defaultdict


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lower) if w]


def shingles(text, size=5):
    found = words(text)
    if not found:
        return frozenset()
    size = min(size, len(found))
    return frozenset(tuple(found[k:k + size]) for k in range(len(found) - size + 1))


class Union:
    def __init__(self):
        self.up = {}

    def root(self, x):
        while self.up.get(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def near_components(rows, percent=75):
    """{doc_id: component} of (doc_id, text) rows with distinct ids."""
    sets = {i: shingles(t) for i, t in rows}
    holders = defaultdict(list)
    union = Union()
    for i, own in sets.items():
        seen = defaultdict(int)
        for s in own:
            for j in holders[s]:
                seen[j] += 1
            holders[s].append(i)
        for j, common in seen.items():
            if 100 * common >= percent * (len(own) + len(sets[j]) - common):
                union.join(i, j)
    return {i: union.root(i) for i in sets}, {i: len(s) for i, s in sets.items()}
