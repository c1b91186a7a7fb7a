"""Plain Python versions of the operators, for comparison on small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict


def split(text: str | None) -> list[bytes]:
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def shingles(text: str | None, k: int = 5) -> set:
    w = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), x) for x in split(text)]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def near_duplicates(rows: list[tuple], percent: int) -> dict:
    """doc_id -> (set size, smallest doc_id reachable)."""
    sets = {i: shingles(t) for i, t in rows}
    where, pairs, parent = defaultdict(list), Counter(), {i: i for i in sets}
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    for ids in where.values():
        for a in range(len(ids)):
            for b in range(a):
                pairs[ids[b], ids[a]] += 1

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), both in pairs.items():
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def without_repeats(rows: list[tuple], window: int) -> list[tuple]:
    """(words, removed, kept text) of each row."""
    counts = Counter(tuple(w[i : i + window]) for _, t in rows for w in [split(t)] for i in range(len(w) - window + 1))
    out = []
    for _, t in rows:
        w = split(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if counts[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def least_edits(pattern: str, text: str) -> int:
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        new = [i + 1]
        for j, x in enumerate(text):
            new.append(min(row[j] + (c != x), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def smallest_capacity(sizes: list[int], shards: int) -> int:
    def fits(capacity):
        used, room = 1, capacity
        for s in sizes:
            if s > room:
                used, room = used + 1, capacity
            room -= s
        return used <= shards

    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


def digest(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()
