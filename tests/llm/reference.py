"""Plain Python versions of the corpus operators, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def fingerprint(text):
    ws = [w for w in words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or [" ".join(ws)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def simhash(docs):
    fps = [(d, fingerprint(t)) for d, t in docs]
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i][1] ^ fps[j][1]).count("1") <= 2:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(fps):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted((d, f"{fp:016x}", least[root(i)]) for i, (d, fp) in enumerate(fps))


def quality_counts(text):
    ws = words(text)
    wins = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    twice = Counter(wins)
    hit = set()
    for i, w in enumerate(wins):
        if twice[w] > 1:
            hit.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if words(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(ws), sum(map(len, ws)), symbols, len(lines) - len(set(lines)), len(hit), len(ws) < 20 or 100 * len(hit) > 30 * len(ws)


def exact(docs):
    groups = defaultdict(list)
    for d, t in docs:
        groups[t or ""].append(d)
    out = []
    for t, ids in groups.items():
        for d in ids:
            out.append((d, max(ids), len(ids), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out)


def repeats(docs):
    first = {}
    for d, t in docs:
        ws = words(t)
        for i in range(len(ws) - 12):
            w = tuple(ws[i : i + 13])
            first[w] = min(d, first.get(w, d))
    out = []
    for d, t in docs:
        ws = words(t)
        gone = set()
        for i in range(len(ws) - 12):
            if first[tuple(ws[i : i + 13])] < d:
                gone.update(range(i, i + 13))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((d, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def targets(sizes):
    """sizes: {source or None: words}"""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, left = sum(sizes.values()), set(order)
    target = dict.fromkeys(order, 0.0)
    rest = float(total)
    while left:
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        full = [s for s in left if share[s] > 3 * sizes[s]]
        if not full:
            target.update(share)
            break
        for s in full:
            target[s] = 3.0 * sizes[s]
            rest -= target[s]
            left.discard(s)
    return target


def crc(data):
    return zlib.crc32(data)
