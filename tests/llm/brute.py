"""Plain-Python answers to hold the operators against."""

from __future__ import annotations

from collections import defaultdict


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, k=5):
    w = words(text)
    return {b" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def near_duplicates(rows, least=75):
    """{doc_id: component} of (doc_id, text) rows; all pairs that share a shingle."""
    sets = [(i, shingles(t)) for i, t in rows]
    holders = defaultdict(list)
    for at, (_, s) in enumerate(sets):
        for x in s:
            holders[x].append(at)
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for at, (i, s) in enumerate(sets):
        if i is None:
            continue
        near = {b for x in s for b in holders[x] if b > at}
        for b in near:
            j, t = sets[b]
            if j is None:
                continue
            both = len(s & t)
            if 100 * both >= least * len(s | t):
                lo, hi = sorted((root(i), root(j)))
                parent[hi] = lo
    return {i: root(i) for i in parent}


def line_key(line):
    low = line.strip(" \t\n\x0b\x0c\r")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in low)


def contaminated(docs, items, least=0.75):
    """Documents that hold the share of an item's five-word windows, in any case."""
    import re

    def windows(text):
        w = re.findall(r"[^\W\d_]+|\d+", text.lower())
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    parts = [(i, windows(t)) for i, t in items]
    out = set()
    for i, t in docs:
        own = windows(t)
        if any(w and len(w & own) >= least * len(w) for _, w in parts):
            out.add(i)
    return out


def crc(key):
    import zlib

    return zlib.crc32(str(key).encode())
