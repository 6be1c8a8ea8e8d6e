"""Plain versions of the operators, one document or pair at a time."""

import re
import zlib
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode()) % 4


def shingles(text, n=5) -> frozenset:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if not words:
        return frozenset()
    if len(words) < n:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def near_duplicates(rows, percent=85) -> dict:
    """doc_id -> (n_shingles, component); the ids are distinct."""
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
            common = len(x & y)
            if 100 * common >= percent * (len(x) + len(y) - common):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {d: (len(sets[d]), root(d)) for d in sets}
