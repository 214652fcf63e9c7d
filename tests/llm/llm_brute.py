"""Plain versions of the operators for small inputs."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def words(t):
    return WORD.findall(t) if t else []


def shingles(t, size=5):
    w = words(lower(t or ""))
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[k:k + size]) for k in range(len(w) - size + 1)}


def roots(nodes, pairs):
    up = {i: i for i in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in nodes}


def jaccard_classes(rows, size=5, num=75, den=100):
    """{id: (shingles, smallest id reachable)} of (id, text) rows."""
    sets = {i: shingles(t, size) for i, t in rows}
    ids = sorted(sets)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if sets[a] and sets[b]
             and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    top = roots(ids, pairs)
    return {i: (len(sets[i]), top[i]) for i in ids}


def without_repeats(rows, size=50):
    """{id: (words, removed, kept text)} of (id, text) rows."""
    first, all_words = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = all_words[i] = words(t)
        for k in range(len(w) - size + 1):
            first.setdefault(tuple(w[k:k + size]), i)
    out = {}
    for i, w in all_words.items():
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k:k + size])] < i:
                gone[k:k + size] = [True] * size
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def sha(data):
    return hashlib.sha256(data).hexdigest()


def periodic_runs(w, min_len=24, min_periods=3):
    """(start, length, period) of all runs of a list of words, by comparing at every period."""
    out = {}
    for p in range(1, len(w) // min_periods + 1):
        i = 0
        while i < len(w) - p:
            j = i
            while j < len(w) - p and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(min_len, min_periods * p):
                out.setdefault((i, j + p - i), p)
            i = max(j, i + 1)
    return sorted((s, n, p) for (s, n), p in out.items())


def collapse(w, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)
