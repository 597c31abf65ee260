"""Word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers = np.ones(0, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.full(max(n, 4096), _STEP, np.uint64))
    return _powers[:n]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word and the place of its first byte; words are parted by blank and tab to carriage return."""
    a = np.frombuffer(data, np.uint8)
    word = ~_GAP[a]
    edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    lengths = ends - starts
    inside = np.flatnonzero(word)
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(inside)) - np.repeat(first, lengths)
    value = _BYTE[a[inside]] * _power(int(lengths.max()))[place]
    return mix(np.add.reduceat(value, first) + lengths.astype(np.uint64)), starts


def word_places(data: bytes, size: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """word_hashes() of a long text, worked on in parts of about size bytes that end in gaps."""
    if len(data) <= size:
        return word_hashes(data)
    hashes, places, at = [], [], 0
    while at < len(data):
        end = at + size
        while end < len(data) and not _GAP[data[end]]:
            end += 1
        h, p = word_hashes(data[at:end])
        hashes.append(h)
        places.append(p + at)
        at = end
    return np.concatenate(hashes), np.concatenate(places)


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of all texts, one text after the other, and how many each text has.

    A text of fewer words than width has one shingle, its whole sequence; without words it has none.
    """
    words, starts = word_hashes(b"\n".join(texts))
    bounds = np.cumsum([0, *(len(x) + 1 for x in texts)])
    owner = np.searchsorted(bounds, starts, side="right") - 1
    counts = np.bincount(owner, minlength=len(texts))
    parts, owners = [], []
    full = len(words) - width + 1
    if full > 0:
        h = np.zeros(full, np.uint64)
        for k in range(width):
            h += words[k : k + full] * _PLACE[k]
        same = owner[:full] == owner[width - 1 :]
        parts.append(mix(h[same]))
        owners.append(owner[:full][same])
    at = np.cumsum(counts) - counts
    for i in np.flatnonzero((counts > 0) & (counts < width)).tolist():
        ws = words[at[i] : at[i] + counts[i]]
        parts.append(mix((ws * _PLACE[: len(ws)]).sum(keepdims=True) + np.uint64(len(ws))))
        owners.append(np.array([i]))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    h, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.bincount(owner[new], minlength=len(texts))


def lowered(text: str | None) -> bytes:
    """UTF-8 with A-Z in lower case, no other letters."""
    return (text or "").encode("utf-8", "surrogatepass").lower()
