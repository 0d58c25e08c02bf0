"""Plain versions of the operators, for small tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def roots(n, links):
    par = list(range(n))

    def find(x):
        while par[x] != x:
            par[x] = par[par[x]]
            x = par[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        par[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingle_sets(texts, width):
    out = []
    for t in texts:
        w = words(t)
        out.append(frozenset(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset())
    return out


def near_duplicates(rows, width=2, percent=80):
    """rows: (doc_id, text) -> (doc_id, n_shingles, component_id, kept) per row."""
    sets = shingle_sets([t for _, t in rows], width)
    links = [(i, j) for i in range(len(rows)) for j in range(i)
             if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    root = roots(len(rows), links)
    least = {}
    for r, (d, _) in zip(root, rows):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return [(d, len(s), least.get(r, None), d is not None and d == least.get(r)) for (d, _), s, r in zip(rows, sets, root)]


def repeated_bytes(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i:i + length] for d in raw for i in range(len(d) - length + 1))
    out = []
    for d in raw:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i:i + length] = True
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()) if len(d) else 0
        out.append((len(d), int(gone.sum()), runs, bytes(b for b, g in zip(d, gone) if not g)))
    return out


def embedding_links(rows, cosine=0.98):
    """rows: (vec_id, vector, label) -> (vec_id, n_links, component_id) per row."""
    def ok(v, label):
        if label is None or v is None or not len(v) or any(x is None or not math.isfinite(x) for x in v):
            return None
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v] if n else None

    unit = [ok(v, label) for _, v, label in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if unit[i] and unit[j] and rows[i][2] == rows[j][2]
             and len(unit[i]) == len(unit[j]) and sum(a * b for a, b in zip(unit[i], unit[j])) >= cosine]
    count = collections.Counter(x for pair in links for x in pair)
    root = roots(len(rows), links)
    least = {}
    for r, (d, _, _) in zip(root, rows):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return [(d, count[i], least.get(root[i])) for i, (d, _, _) in enumerate(rows)]


def base_scores(rows):
    toks = [words(t) + [None] for _, t in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    c = collections.Counter(w for t, h in zip(toks, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    return [(d, h, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
            for (d, _), t, h in zip(rows, toks, held)]


def sha(b):
    return hashlib.sha256(b).hexdigest()
