"""Plain Python versions of what the operators compute, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return _WORD.findall(text or "")


def shingles(text, k):
    found = words(lower(text))
    return {tuple(found[i : i + k]) for i in range(len(found) - k + 1)} if len(found) >= k else {tuple(found)} if found else set()


def components(sets: dict, percent: int) -> dict:
    of = {i: i for i in sets}

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                low, high = sorted((root(a), root(b)))
                of[high] = low
    return {i: root(i) for i in ids}


def kept_words(texts: list, size: int) -> list:
    """(words, removed, kept text) of each text, windows that start more than once removed."""
    split = [words(t) for t in texts]
    count = Counter(tuple(w[i : i + size]) for w in split for i in range(len(w) - size + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - size + 1):
            if count[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def digest(*parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values) -> str:
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def manifest(rows: list, fan: int = 3) -> list:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of rows (doc_id, source, lang, n_chars, text)."""

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([digest(*out[-1][i : i + fan]) for i in range(0, len(out[-1]), fan)])
        return out

    def proof(tree, i):
        out = []
        for level in tree[:-1]:
            run = range(i // fan * fan, min(i // fan * fan + fan, len(level)))
            out.append(([level[j] for j in run if j < i], [level[j] for j in run if j > i]))
            i //= fan
        return out

    by = defaultdict(list)
    for row in rows:
        by[row[1]].append(row)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([leaf(r) for r in sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))]) for s in names}
    top = levels([trees[s][-1][0] for s in names]) if names else []
    out = []
    for k, s in enumerate(names):
        for i, row in enumerate(sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))):
            steps = proof(trees[s], i) + proof(top, k)
            text = row[4]
            if text is not None and zlib.crc32(("" if row[0] is None else str(row[0])).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = leaf((*row[:4], text))
            for left, right in steps:
                folded = digest(*left, folded, *right)
            root = top[-1][0]
            out.append((row[0], leaf(row), trees[s][-1][0], root, digest(*(d for a, b in steps for d in a + b)), folded, folded == root))
    return out


def runs(codes: list, least: int = 6, times: int = 4) -> list:
    """(start, length, period) of every run, by trying every period."""
    found, n = {}, len(codes)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and codes[i] == codes[i + q]:
                i += 1
            if i > start and i - start + q >= max(least, times * q):
                found.setdefault((start, i - start + q), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in found.items())


def periodic(doc_id, text) -> tuple:
    """A row of the periodic runs query."""
    found = words(text)
    n, h = len(found), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        found = [found[i] if i < a else found[a + (i - a) % p] for i in range(n)]
    own, gone = runs(found), set()
    for start, length, q in own:
        gone.update(range(start + q, start + length))
    best = min(own, key=lambda r: (-r[1], r[0], r[2])) if own else (None,) * 3
    return (
        doc_id, len(own), *best, 1000 * best[1] // best[2] if own else None,
        digest("".join(f"{a},{b},{c}\n" for a, b, c in own)), digest(" ".join(w for i, w in enumerate(found) if i not in gone)),
    )


def linked(rows: list, cosine: float = 0.93) -> list:
    """(id, links, component, kept) of rows (id, vector, label), all pairs of a label compared."""
    n = len(rows)
    good = [
        label is not None and x is not None and len(x) > 0 and all(v is not None and math.isfinite(v) for v in x) and any(v != 0 for v in x)
        for _, x, label in rows
    ]
    degree, of = [0] * n, list(range(n))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    groups = defaultdict(list)
    for i, (_, x, label) in enumerate(rows):
        if good[i]:
            groups[label, len(x)].append(i)
    for own in groups.values():
        x = np.array([rows[i][1] for i in own], dtype=np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= cosine, 1)), strict=True):
            i, j = own[a], own[b]
            degree[i] += 1
            degree[j] += 1
            low, high = sorted((root(i), root(j)))
            of[high] = low
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[root(i)] = min(least.get(root(i), rows[i][0]), rows[i][0])
    found = [least.get(root(i)) if good[i] else rows[i][0] for i in range(n)]
    return [(r[0], d, c, r[0] == c) for r, d, c in zip(rows, degree, found, strict=True)]
