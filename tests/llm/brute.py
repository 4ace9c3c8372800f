"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def unique(rows):
    """Rows that repeat doc_id and text count once."""
    return sorted({(i, t or "") for i, t, *_ in rows})


def later_windows(rows, window):
    """(doc_id, n_words, n_removed, kept_sha256); with repeats counted once."""
    seen, out = set(), {}
    for i, text in unique(rows):
        words, gone = WORD.findall(text), set()
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                gone.update(range(s, s + window))
            seen.add(key)
        kept = " ".join(w for j, w in enumerate(words) if j not in gone)
        out[i] = (len(words), len(gone), sha(kept.encode()))
    return out


def repeated_bytes(rows, length):
    """(n_bytes, n_removed, n_spans, kept_sha256) by doc_id; every row counts."""
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    counts = Counter(b[s : s + length] for _, b in texts for s in range(len(b) - length + 1))
    out = {}
    for i, b in texts:
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            if counts[b[s : s + length]] > 1:
                gone[s : s + length] = [True] * length
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def shingle_sets(rows, size=5):
    out = {}
    for i, text, *_ in rows:
        words = WORD.findall((text or "").translate(LOWER))
        runs = {tuple(words[s : s + size]) for s in range(len(words) - size + 1)}
        out[i] = runs or ({tuple(words)} if words else set())
    return out


def near_components(rows, percent=75):
    sets = shingle_sets(rows)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            holders[x].add(i)
    for i, s in sets.items():
        for j in set().union(*(holders[x] for x in s)) if s else ():
            both = len(s & sets[j])
            if j > i and 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}
