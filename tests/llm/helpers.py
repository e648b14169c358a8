"""Brute-force versions of the similarity operators."""

from __future__ import annotations

import re

import numpy as np

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def roots(ids, edges):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingle_set(text, n):
    w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(zip(*[w[i:] for i in range(n)], strict=False)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def jaccard_classes(rows, n, num):
    sets = {d: shingle_set(t, n) for d, t in rows}
    ids = sorted(sets)
    edges = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    of = roots(ids, edges)
    return {d: (len(sets[d]), of[d]) for d in ids}


def cosine_classes(rows, threshold):
    ok = {i: np.array(v, float) for i, v, label in rows if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    label = {i: lab for i, _, lab in rows}
    ids, edges = sorted(label), []
    for a in ok:
        for b in ok:
            if a < b and label[a] == label[b] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= threshold:
                edges.append((a, b))
    of = roots(ids, edges)
    return {i: (sum(i in e for e in edges), of[i]) for i in ids}


def cut_by_brute_force(texts, least):
    """Lines of every common run with any earlier document, all pairs of places compared."""
    out = []
    for i, text in enumerate(texts):
        a, cut = [x.strip(" ") for x in text.split("\n")], set()
        for other in texts[:i]:
            b = [x.strip(" ") for x in other.split("\n")]
            for p in range(len(a)):
                for q in range(len(b)):
                    n = 0
                    while p + n < len(a) and q + n < len(b) and a[p + n] and a[p + n] == b[q + n]:
                        n += 1
                    if sum(len(x.split(" ")) for x in a[p : p + n]) >= least:
                        cut |= set(range(p, p + n))
        out.append("\n".join(x for p, x in enumerate(text.split("\n")) if p not in cut))
    return out
