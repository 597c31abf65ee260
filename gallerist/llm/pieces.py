"""Encoding of whole texts by distinct pre-tokens: every distinct match of the pattern is encoded once for each batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np


class _Numbered(dict):
    """Gives each new key the next number."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class PieceCoder:
    """Ids of texts, from a function that encodes a list of distinct pieces into (ids, lengths).

    Memory is bounded: the pieces seen so far are forgotten once there are more than max_pieces of them.
    """

    def __init__(self, pattern: str, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], max_pieces: int = 300_000):
        import regex

        self.find = regex.compile(pattern).findall
        self.encode, self.max_pieces = encode, max_pieces
        self._forget()

    def _forget(self) -> None:
        self.number = _Numbered()
        self.flat = np.zeros(0, np.int64)
        self.starts = self.lengths = np.zeros(0, np.int64)

    def encode_texts(self, texts: list[str]) -> Iterator[np.ndarray]:
        """One array of ids for each text, in order."""
        if len(self.number) > self.max_pieces:
            self._forget()
        known, number = len(self.number), self.number.__getitem__
        coded = [np.fromiter(map(number, found := self.find(x)), np.int32, len(found)) for x in texts]
        if len(self.number) > known:
            fresh = list(self.number)[known:]
            ids, lengths = self.encode(fresh)
            starts = len(self.flat) + np.cumsum(lengths) - lengths
            self.flat = np.concatenate([self.flat, ids])
            self.starts = np.concatenate([self.starts, starts])
            self.lengths = np.concatenate([self.lengths, lengths])
        for pieces in coded:
            lengths = self.lengths[pieces]
            ends = np.cumsum(lengths)
            total = int(ends[-1]) if len(ends) else 0
            yield self.flat[np.repeat(self.starts[pieces] - ends + lengths, lengths) + np.arange(total)]


def chunks(texts: list[str], limit: int = 16_000_000) -> Iterator[slice]:
    """Slices of texts of about limit characters each."""
    start = size = 0
    for i, x in enumerate(texts):
        size += len(x)
        if size >= limit:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))
