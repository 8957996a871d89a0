"""Small tables and plain-Python versions that the operators must agree with."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

SPACE = "\x20\x09-\x0D"
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Extra columns clash with names that the operators use inside.
SCHEMA = "doc_id long, text string, n long, node string, kept boolean, score double, `a.b` string"


def documents(spark, rows):
    """A table of (doc_id, text) with extra columns; dots and inner names among them."""
    return spark.createDataFrame([(i, t, 7, "x", None, 0.5, "dot") for i, t in rows], SCHEMA)


def words(text: str | None) -> list[str]:
    return re.findall(f"[^{SPACE}]+", (text or "").translate(ASCII_LOWER))


def remainder(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode()) % 5


def shingles(text: str | None, k: int = 5) -> set[tuple[str, ...]]:
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(pairs, nodes) -> dict:
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_duplicates(rows, percent: int = 85) -> dict:
    """doc_id -> (n_shingles, component)."""
    sets = {i: shingles(t) for i, t in rows}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    both = Counter()
    for ids in holders.values():
        ids = sorted(ids)
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                both[a, b] += 1
    links = [(a, b) for (a, b), n in both.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    comp = components(links, sets)
    return {i: (len(s), comp[i]) for i, s in sets.items()}


def item_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))


def contamination(docs, items, window: int = 10):
    """doc_id -> (n_words, hit positions, item ids)."""
    patterns = defaultdict(set)
    for i, t in items:
        w = item_words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if n else ():
            patterns[tuple(w[k : k + n])].add(i)
    out = {}
    sizes = {len(p) for p in patterns}
    for i, t in docs:
        w, hit, found = item_words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (p := tuple(w[k : k + n])) in patterns:
                    hit |= set(range(k, k + n))
                    found |= patterns[p]
        out[i] = (len(w), hit, found)
    return out
