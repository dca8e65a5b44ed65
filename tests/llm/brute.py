"""Plain Python versions of what the operators compute."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

SPACED = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (s or ""))


def fold(i, mod):
    return None if i is None else zlib.crc32(str(i).encode()) % mod


def without_repeats(texts, n=35):
    words = [SPACED.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone[i : i + n] = [True] * n
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def contamination(texts, items):
    windows = defaultdict(lambda: defaultdict(set))
    for i, t in items:
        w = ALNUM.findall(low(t))
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows[n][tuple(w[k : k + n])].add(str(i))
    out = []
    for t in texts:
        w = ALNUM.findall(low(t))
        hit, met = [0] * len(w), set()
        for n, known in windows.items():
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in known:
                    met |= known[tuple(w[k : k + n])]
                    hit[k : k + n] = [1] * n
        out.append((len(w), sum(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest()))
    return out


def fingerprint(text):
    import xxhash

    w = SPACED.findall(low(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, linked):
    """Smallest id reachable, for pairs of places that ``linked`` says are linked."""
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                parent[root(i)] = root(j)
    least = {}
    for i, x in enumerate(ids):
        least[root(i)] = min(least.get(root(i), x), x)
    return [least[root(i)] for i in range(len(ids))]
