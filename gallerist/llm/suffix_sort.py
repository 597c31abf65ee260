"""Two-stage suffix sorting of bytes, and common prefixes of neighbours, to a bounded depth.

Stage one sorts directly only the suffixes that are smaller than their successors. Stage two induces the others by one
scan over the buckets of first bytes in rising order: a suffix that is larger than its successor stands in its bucket
before those of stage one, in the order in which the scan meets its successor. With numpy a whole bucket is scanned at
a time; only suffixes that start with a run of the bucket's own byte need another step.
"""

from __future__ import annotations

import numpy as np


def smaller_than_successor(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last suffix, of one symbol, is larger than the empty one."""
    n = len(s)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(s[1:].astype(np.int16) - s[:-1].astype(np.int16))
    step[-1:] = -1
    # a run of equal symbols takes the answer of its last place
    known = np.where(step != 0, np.arange(n), n)
    following = np.minimum.accumulate(known[::-1])[::-1]
    return step[np.minimum(following, n - 1)] > 0


def _sorted_directly(s: np.ndarray, first: np.ndarray, depth: int) -> np.ndarray:
    """The places in first by the depth symbols from each on: by eight symbols at once, then within each group of equals.

    So only one group's strings are held at a time.
    """
    scale = 2 if s.max(initial=0) > 255 else 1  # bytes 0 to 254 fit one byte each when raised by one
    data = s.astype(">u2").tobytes() if scale == 2 else s.astype(np.uint8).tobytes()
    ahead = 8 // scale
    padded = np.concatenate([s, np.zeros(ahead, s.dtype)]).astype(np.uint64)
    key = np.zeros(len(first), np.uint64)
    for k in range(ahead):
        key = key << np.uint64(8 * scale) | padded[first + k]
    order = np.argsort(key, kind="stable")
    first, key = first[order], key[order]
    cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(key))
    out = first.copy()
    for x, y in zip(cuts[ends - cuts > 1].tolist(), ends[ends - cuts > 1].tolist(), strict=True):
        at = (first[x:y] * scale).tolist()
        strings = [data[i : i + depth * scale] for i in at]
        out[x:y] = first[x:y][sorted(range(y - x), key=strings.__getitem__)]
    return out


def two_stage_suffix_array(parts: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, symbols): the parts, each closed by a symbol below all bytes, and their suffixes sorted by depth symbols.

    Suffixes that agree on depth symbols stand together.
    """
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    s = np.zeros(int(lengths.sum()) + len(parts), np.uint16)
    closed = np.zeros(len(s), bool)
    closed[np.cumsum(lengths + 1) - 1] = True
    s[~closed] = (np.concatenate(parts) if parts else s[:0]).astype(np.uint16) + 1
    small = smaller_than_successor(s)
    first = np.flatnonzero(small)
    direct = _sorted_directly(s, first, depth)

    top = int(s.max(initial=0)) + 1
    heads = s[direct]
    cuts = np.searchsorted(heads, np.arange(top + 1))
    larger: list[list[np.ndarray]] = [[] for _ in range(top)]
    larger[s[-1]].append(np.array([len(s) - 1]))  # the successor of the last suffix is the empty one
    out = []

    def induce(scanned: np.ndarray, c: int) -> np.ndarray:
        """Deals the predecessors out to their buckets; returns those of bucket c itself."""
        before = scanned[scanned > 0] - 1
        before = before[~small[before]]
        symbols = s[before]
        own = before[symbols == c]
        before, symbols = before[symbols > c], symbols[symbols > c]
        if len(before):
            by = np.argsort(symbols, kind="stable")
            before, symbols = before[by], symbols[by]
            at = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1]))
            for x, y in zip(at.tolist(), [*at[1:].tolist(), len(before)], strict=True):
                larger[symbols[x]].append(before[x:y])
        return own

    for c in range(top):
        scanned = np.concatenate(larger[c]) if larger[c] else np.zeros(0, np.int64)
        while len(scanned):
            out.append(scanned)
            scanned = induce(scanned, c)
        mine = direct[cuts[c] : cuts[c + 1]]
        if len(mine):
            out.append(mine)
            induce(mine, c)
    return np.concatenate(out) if out else np.zeros(0, np.int64), s


def common_prefixes(s: np.ndarray, left: np.ndarray, right: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at left and right, at most depth."""
    padded = np.concatenate([s.astype(np.uint16), np.full(8, 0xFFFF, np.uint16)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 4)
    words = np.ascontiguousarray(words).view(np.uint64).ravel()  # four symbols from each place on
    out = np.zeros(len(left), np.int64)
    open_ = np.arange(len(left))
    at = 0
    while len(open_) and at < depth:
        i, j = left[open_] + at, right[open_] + at
        inside = np.maximum(i, j) < len(s)
        i, j, open_ = i[inside], j[inside], open_[inside]
        equal = words[i] == words[j]
        i, j, parted = i[~equal], j[~equal], open_[~equal]
        for k in range(3):
            step = padded[i + k] == padded[j + k]
            step &= np.maximum(i, j) + k < len(s)
            i, j, parted = i[step], j[step], parted[step]
            out[parted] += 1
        open_ = open_[equal]
        at += 4
        out[open_] = at
    return np.minimum(out, depth)
