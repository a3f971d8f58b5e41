"""Repeated strings of a block of texts, by bounded interval expansion on its Burrows-Wheeler transform.

The block's suffixes are sorted by their first `length` bytes (by doubling), which gives the transform. Intervals of suffixes with a common prefix
are then extended backwards by a byte at a time, breadth first: the intervals of one round have prefixes of one length, and mark
the borders between suffixes whose common prefix has that length. After `length` rounds, suffixes without a border between them
share `length` bytes at least. All bytes are compared, none hashed.

README.md has what it costs on large tables, where suffix_dedup.py finds the same strings in another way; tests hold that against this.
"""

from __future__ import annotations

import numpy as np

END = np.uint16(0)  # after each text; a text's byte b is b + 1


def joined(texts: list[bytes]) -> np.ndarray:
    out = np.zeros(sum(map(len, texts)) + len(texts), np.uint16)
    at = 0
    for t in texts:
        out[at : at + len(t)] = np.frombuffer(t, np.uint8).astype(np.uint16) + 1
        at += len(t) + 1
    return out


def suffixes(symbols: np.ndarray, length: int) -> np.ndarray:
    """The suffixes in the order of their first `length` symbols at least; ends are told apart by their places."""
    n = len(symbols)
    rank = symbols.astype(np.int64) + n
    rank[symbols == END] = np.arange((symbols == END).sum())
    order = np.argsort(rank, kind="stable")
    width = 1
    while True:
        ranked = rank[order]
        new = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        rank[order] = new
        if width >= length or new[-1] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:] + 1
        rank = rank * (n + 1) + after
        order = np.argsort(rank, kind="stable")
        width *= 2


#: Suffixes of an interval that are looked at one by one; larger intervals ask for each byte.
FEW = 24


def borders(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether a suffix shares fewer than `length` symbols with the one before it in the order."""
    n = len(symbols)
    before = symbols[order - 1]  # the transform; the first symbol follows the last
    by_byte = np.argsort(before, kind="stable")
    step = np.empty(n, np.int64)
    step[by_byte] = np.arange(n)  # where a suffix stands when the byte before it is put in front
    counts = np.bincount(before, minlength=258)
    first = np.concatenate([[0], np.cumsum(counts)])
    places = {c: by_byte[first[c] : first[c + 1]] for c in np.flatnonzero(counts).tolist() if c != END}
    marked = np.zeros(n + 1, bool)
    ends = int(counts[END])
    marked[: ends + 1] = marked[n] = True  # ends are unlike each other and all bytes
    low, high = np.array([0]), np.array([n])
    for k in range(length):
        lows, highs = [], []

        def found(a: np.ndarray, z: np.ndarray) -> None:
            fresh = ~marked[z]
            lows.append(a[fresh])
            highs.append(z[fresh])

        size = high - low
        one = low[(size == 1) & (before[low] != END)]
        found(step[one], step[one] + 1)
        few = (size > 1) & (size <= FEW)
        if few.any():
            sizes = size[few]
            stop = np.cumsum(sizes)
            at = np.repeat(low[few] - (stop - sizes), sizes) + np.arange(stop[-1])
            group = np.repeat(np.arange(len(sizes)), sizes) * 258 + before[at]
            keep = before[at] != END
            at, group = at[keep], group[keep]
            if len(at):
                # Suffixes of one byte keep their order, so that each group is an interval.
                ordered = np.argsort(group, kind="stable")
                new = np.flatnonzero(np.concatenate([[True], np.diff(group[ordered]) != 0]))
                a = step[at[ordered[new]]]
                found(a, a + np.diff(np.append(new, len(at))))
        many = size > FEW
        if many.any():
            for c, at in places.items():
                a, z = np.searchsorted(at, low[many]) + first[c], np.searchsorted(at, high[many]) + first[c]
                found(a[a < z], z[a < z])
        if k == 0:
            lows.append(np.arange(ends))
            highs.append(np.arange(1, ends + 1))
        low, high = np.concatenate(lows), np.concatenate(highs)
        marked[high] = True
        if not len(low):
            break
    return marked[:n]


def repeated(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, the places where a string of `length` bytes begins that begins elsewhere too."""
    symbols = joined(texts)
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    if not len(symbols):
        return [np.zeros(0, np.int64) for _ in texts]
    order = suffixes(symbols, length)
    edge = borders(symbols, order, length)
    alone = edge & np.append(edge[1:], True)
    hit = np.zeros(len(symbols), bool)
    hit[order[~alone]] = True
    at = np.flatnonzero(hit)
    return [at[(at >= s) & (at < e)] - s for s, e in zip(starts[:-1], starts[1:], strict=True)]
