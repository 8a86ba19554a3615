"""Plain Python versions that the operators are held against."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def shingles(text: str | None, k: int) -> frozenset:
    w = WORD.findall((text or "").translate(FOLD))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def jaccard_components(rows: list[tuple[int, str | None]], k: int, percent: int) -> dict[int, tuple[int, int]]:
    """doc_id: (n_shingles, component_id), all pairs that share a shingle compared."""
    sets = {i: shingles(t, k) for i, t in rows}
    classes: dict[frozenset, list[int]] = {}
    for i, s in sets.items():
        classes.setdefault(s, []).append(i)
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(i, j):
        i, j = sorted((root(i), root(j)))
        up[j] = i

    reps = []
    for s, ids in classes.items():
        if s:
            reps.append((min(ids), s))
            for i in ids:
                join(ids[0], i)
    holders: dict[tuple, list[int]] = {}
    for n, (_, s) in enumerate(reps):
        for x in s:
            holders.setdefault(x, []).append(n)
    for n, (i, s) in enumerate(reps):
        shared: dict[int, int] = {}
        for x in s:
            if len(holders[x]) > 1:
                for o in holders[x]:
                    if o > n:
                        shared[o] = shared.get(o, 0) + 1
        for o, both in shared.items():
            j, t = reps[o]
            if 100 * both >= percent * (len(s) + len(t) - both):
                join(i, j)
    return {i: (len(s), root(i)) for i, s in sets.items()}
