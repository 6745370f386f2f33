"""Plain Python versions of what the corpus operators compute."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None, size: int = 5) -> frozenset:
    words = WORD.findall((text or "").translate(ASCII))
    if not words:
        return frozenset()
    k = min(size, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


class Union(dict):
    def root(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self[max(a, b)] = min(a, b)


def near_components(rows: list[tuple[int, str | None]], percent: int) -> dict[int, int]:
    """doc_id -> least doc_id that links reach, over all pairs that share a shingle."""
    sets = {d: shingles(t) for d, t in rows}
    holders: dict = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    u, seen = Union(), set()
    for d in sets:
        u.root(d)
    by_set: dict = {}
    for d, s in sets.items():
        if s and by_set.setdefault(s, d) != d:
            u.join(by_set[s], d)
    first = set(by_set.values())
    for ds in holders.values():
        ds = [d for d in ds if d in first]
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    common = len(sets[a] & sets[b])
                    if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                        u.join(a, b)
    return {d: u.root(d) for d in sets}
