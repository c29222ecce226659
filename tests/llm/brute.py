"""Plain versions of the operators that SQL cannot express, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash


def substring(rows: list[tuple], window: int = 35) -> list[tuple]:
    """rows (id, text) -> (id, n_words, n_removed, kept_sha256)."""
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[k : k + window]) for _, w in docs for k in range(len(w) - window + 1))
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        left = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(left)).hexdigest()))
    return out


def fingerprint(text: str | None, shingle: int = 3) -> int:
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(n: int, links: list[tuple[int, int]]) -> list[int]:
    up = list(range(n))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        up[top(a)] = top(b)
    return [top(i) for i in range(n)]


def simhash(rows: list[tuple], radius: int = 3) -> list[tuple]:
    """rows (id, text) -> (id, fingerprint, component_id)."""
    fp = np.array([fingerprint(t) for _, t in rows], np.uint64)
    links = []
    for i in range(len(fp)):
        links += [(i, int(j)) for j in np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= radius)]
    part = grouped(len(fp), links)
    least = defaultdict(list)
    for p, (i, _) in zip(part, rows, strict=True):
        least[p].append(i)
    name = {p: min((i for i in v if i is not None), default=None) for p, v in least.items()}
    return [(i, f"{int(f):016x}", name[p]) for (i, _), f, p in zip(rows, fp, part, strict=True)]


def cosine(rows: list[tuple], threshold: float = 0.95) -> list[tuple]:
    """rows (id, vector) -> (id, n_links, component_id)."""
    def sound(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)

    ok = [k for k, (_, v) in enumerate(rows) if sound(v)]
    unit = {k: np.array(rows[k][1], np.float64) / np.linalg.norm(np.array(rows[k][1], np.float64)) for k in ok}
    links = [(a, b) for a in ok for b in ok if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold]
    part = grouped(len(rows), links)
    least = defaultdict(list)
    for p, (i, _) in zip(part, rows, strict=True):
        least[p].append(i)
    n = Counter(x for pair in links for x in pair)
    return [(i, n[k], min((x for x in least[part[k]] if x is not None), default=None)) for k, (i, _) in enumerate(rows)]


def periodic(rows: list[tuple], least: int = 12) -> list[tuple]:
    """rows (id, text) -> the columns of op12: every period of every stretch is tried."""
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        n = len(w)
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = []
        for q in range(1, n // 2 + 1):
            k = 0
            while k < n - q:
                s = k
                while k < n - q and w[k] == w[k + q]:
                    k += 1
                length = k - s + q
                if k > s and length >= max(least, 2 * q) and not any(w[s : s + length - p] == w[s + p : s + length] for p in range(1, q)):
                    runs.append((s, length, q))
                k += k == s
        runs.sort(key=lambda r: (r[0], r[2]))
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()
        out.append((i, len(runs), *top, None if not runs else 1000 * top[1] // top[2], sha(listed), sha(b" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants(rows: list[tuple], shortest: int = 6, least: int = 5, lose: int = 199, times: int = 5) -> list[tuple]:
    """rows (id, text) -> (word, form, root, n, n_near, form_n)."""
    n: Counter = Counter()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in rows:
        for w in re.findall("[A-Za-z\u00C0-\u00FF]+", t or ""):
            w = w.translate(low)
            h = zlib.crc32(f"{i}:{w}".encode())
            if i is not None and h % lose == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            n[w] += 1
    n = Counter({w: k for w, k in n.items() if len(w) >= shortest and k >= least})
    return forms(n, times)


def forms(n: Counter, times: int = 5) -> list[tuple]:
    """Counted words -> (word, form, root, n, n_near, form_n)."""
    by_size = defaultdict(list)
    for w in n:
        by_size[len(w)].append(w)
    near = {w: [v for k in (len(w) - 1, len(w), len(w) + 1) for v in by_size[k] if one_edit(w, v)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= times * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out
