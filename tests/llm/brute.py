"""Plain forms of the operators' contracts, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def near(rows, width, percent=80):
    """{row number: (n_shingles, component_id)}; rows: (doc_id, text)."""
    sets = []
    for _, text in rows:
        w = WORD.findall(lower(text or ""))
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))) if w else frozenset())
    groups = defaultdict(list)
    for i, s in enumerate(sets):
        groups[s].append(i)
    distinct = [s for s in groups if s]
    top = {s: s for s in distinct}

    def find(x):
        while top[x] is not x:
            x = top[x]
        return x

    post = defaultdict(list)
    for k, s in enumerate(distinct):
        for x in s:
            post[x].append(k)
    for k, s in enumerate(distinct):
        counts = Counter(o for x in s for o in post[x] if o < k)
        for o, n in counts.items():
            if 100 * n >= percent * (len(s) + len(distinct[o]) - n):
                top[find(s)] = find(distinct[o])
    least = {}
    for s in distinct:
        r = find(s)
        least[r] = min([least.get(r, float("inf")), *(rows[i][0] for i in groups[s])])
    return {i: (len(s), least[find(s)] if s else rows[i][0]) for i, s in enumerate(sets)}


def byte_repeats(rows, length):
    """A list of (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    texts = [(d, (t or "").encode()) for d, t in rows]
    n = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if n[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        rest = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return out


def word_repeats(rows, length):
    """A list of (doc_id, n_words, n_removed, kept_sha256)."""
    texts = [(d, WORD.findall(t or "")) for d, t in rows]
    order = lambda d: float("inf") if d is None else d
    first = {}
    for d, w in texts:
        for i in range(len(w) - length + 1):
            k = tuple(w[i : i + length])
            first[k] = min(first.get(k, float("inf")), order(d))
    out = []
    for d, w in texts:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < order(d):
                gone[i : i + length] = [True] * length
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((d, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out
