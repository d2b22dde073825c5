"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall((t or "").translate(UP))


def near(rows, percent=75):
    """{row number: (set size, component as row numbers)}."""
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= percent * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    return [(len(sets[i]), groups[find(i)]) for i in range(len(rows))]


def repeats(rows, width=400):
    c = Counter()
    for _, t in rows:
        b = (t or "").encode()
        c.update(b[i : i + width] for i in range(len(b) - width + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if c[b[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def unigram(rows, held):
    tokens = [[*words(t), None] for _, t in rows]
    c = Counter(x for w, h in zip(tokens, held, strict=True) if not h for x in w)
    n, v = sum(c.values()), len(c)
    return [(len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) for w in tokens]


def mod5(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5
