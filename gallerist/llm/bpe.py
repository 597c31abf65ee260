"""Byte-level BPE by a rank queue under a hierarchical bitmap.

Positions of a linked list of tokens wait in one bucket for each merge rank. A three-level bitmap of 64-bit words marks
the buckets that hold something; find-first-set on each level gives the lowest rank. A position that was merged away,
or whose pair has another rank by now, is stale and skipped when its bucket is opened. A merge can create a pair of a
lower rank than its own, so the bitmap is asked anew after every step.

Two drivers share the queue. encode_many() lays many short pre-tokens side by side and opens a bucket for all of them
at once with numpy: in each pre-token only the leftmost position of the bucket is merged at a time, so every pre-token
sees the order of merges that it would see alone. encode_long() runs one very long pre-token, n log n in its length.

Null and empty texts have no tokens. Repeated texts give equal rows, whatever their ids; a row without id has a null id in
the result; an empty table gives an empty result. Of pairs of one rank the leftmost is merged first. Only the id and the
text are read, so other columns may have any names. A text is encoded whole: its pre-tokens and ids are in memory at once.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import PieceCoder, chunks

NONE = 1 << 18  # one more than the highest rank the three levels hold
LONG_PIECE = 4096


class RankBitmap:
    """A set of ranks below 64**3 with find-first-set."""

    def __init__(self) -> None:
        self.top, self.mid, self.low = 0, [0] * 64, [0] * 4096

    def add(self, rank: int) -> None:
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def discard(self, rank: int) -> None:
        w = rank >> 6
        self.low[w] &= ~(1 << (rank & 63))
        if not self.low[w]:
            self.mid[w >> 6] &= ~(1 << (w & 63))
            if not self.mid[w >> 6]:
                self.top &= ~(1 << (w >> 6))

    def first(self) -> int:
        """The lowest rank, or -1."""
        if not self.top:
            return -1
        a = (self.top & -self.top).bit_length() - 1
        word = self.mid[a]
        b = a << 6 | (word & -word).bit_length() - 1
        word = self.low[b]
        return b << 6 | (word & -word).bit_length() - 1


class ByteBPE:
    """ranks: the bytes of each token and its rank, which is its id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.vocab: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.vocab[rank] = token
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.base = len(self.vocab)
        pairs = {
            ranks[t[:i]] * self.base + ranks[t[i:]]: rank
            for t, rank in ranks.items()
            for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks
        }
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)

    @classmethod
    def from_file(cls, path: str) -> ByteBPE:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.base + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NONE)

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after the other, and how many each piece has."""
        out: list = [None] * len(pieces)
        many: list[int] = []
        raw = [x.encode("utf-8", "surrogatepass") for x in pieces]
        for i, b in enumerate(raw):
            whole = self.ranks.get(b)
            if whole is not None:
                out[i] = (whole,)
            elif len(b) > LONG_PIECE:
                out[i] = self.encode_long(b)
            else:
                many.append(i)
        start = size = 0
        for k, i in enumerate(many):
            size += len(raw[i])
            if size > 2_000_000 or k == len(many) - 1:
                group = many[start : k + 1]
                ids, lengths = self.encode_many([raw[j] for j in group])
                ends = np.cumsum(lengths).tolist()
                ids = ids.tolist()
                for j, s, e in zip(group, [0, *ends], ends, strict=False):
                    out[j] = ids[s:e]
                start, size = k + 1, 0
        lengths = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter((i for ids in out for i in ids), np.int64, int(lengths.sum())), lengths

    def encode_many(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        n = len(data)
        owner = np.repeat(np.arange(len(raw)), sizes)
        # n is the place behind the last token; it owns no piece, so no pair crosses a border
        owner = np.append(owner, -1)
        token = np.append(self.byte_ids[data], 0)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        rank = np.full(n + 1, NONE)
        same = np.flatnonzero(owner[:-1] == owner[1:])
        rank[same] = self._rank_of(token[same], token[same + 1])
        alive = np.ones(n + 1, bool)
        marks, waiting = RankBitmap(), {}

        def enqueue(places: np.ndarray) -> None:
            places = places[rank[places] != NONE]
            if not len(places):
                return
            order = np.argsort(rank[places], kind="stable")
            places, ranks = places[order], rank[places][order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            heads = ranks[np.append(0, cuts)].tolist()
            for r, s, e in zip(heads, [0, *cuts.tolist()], [*cuts.tolist(), len(places)], strict=True):
                if r in waiting:
                    waiting[r].append(places[s:e])
                else:
                    waiting[r] = [places[s:e]]
                    marks.add(r)

        enqueue(same)
        while (r := marks.first()) >= 0:
            held = waiting.pop(r)
            marks.discard(r)
            places = held[0] if len(held) == 1 else np.concatenate(held)
            places = places[(rank[places] == r) & alive[places]]
            if not len(places):
                continue
            if len(places) > 1:
                places = np.unique(places)
                first = np.append(True, owner[places[1:]] != owner[places[:-1]])
                if not first.all():
                    waiting[r] = [places[~first]]
                    marks.add(r)
                    places = places[first]
            gone = after[places]
            beyond = after[gone]
            token[places] = r
            alive[gone] = False
            rank[gone] = NONE
            after[places] = beyond
            before[beyond] = places
            right = owner[beyond] == owner[places]
            rank[places] = NONE
            p, q = places[right], beyond[right]
            rank[p] = self._rank_of(token[p], token[q])
            left = before[places]
            has_left = (left >= 0) & (owner[left] == owner[places])
            q, left = places[has_left], left[has_left]
            rank[left] = self._rank_of(token[left], token[q])
            enqueue(np.concatenate([p, left]))
        kept = alive[:-1]
        return token[:-1][kept], np.bincount(owner[:-1][kept], minlength=len(raw))

    def encode_long(self, data: bytes) -> list[int]:
        token = self.byte_ids[np.frombuffer(data, np.uint8)].tolist()
        n, base, find = len(token), self.base, self.pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = [find(a * base + b, NONE) for a, b in zip(token, token[1:], strict=False)] + [NONE]
        waiting: dict[int, list[int]] = {}
        marks = RankBitmap()

        def enqueue(place: int, r: int) -> None:
            rank[place] = r
            if r != NONE:
                if r not in waiting:
                    waiting[r] = []
                    marks.add(r)
                heapq.heappush(waiting[r], place)

        for i, r in enumerate(rank):
            enqueue(i, r)
        while (r := marks.first()) >= 0:
            bucket = waiting[r]
            place = heapq.heappop(bucket)
            if not bucket:
                del waiting[r]
                marks.discard(r)
            if rank[place] != r:
                continue
            gone = after[place]
            token[place], rank[gone] = r, NONE
            token[gone] = -1
            after[place] = beyond = after[gone]
            rank[place] = NONE
            if beyond < n:
                before[beyond] = place
                enqueue(place, find(r * base + token[beyond], NONE))
            if (left := before[place]) >= 0:
                enqueue(left, find(token[left] * base + r, NONE))
        return [t for t in token if t >= 0]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids.tolist()))


_coders: dict[tuple, tuple[ByteBPE, PieceCoder]] = {}


def coder(path: str, pattern: str) -> tuple[ByteBPE, PieceCoder]:
    """One for each Python worker."""
    if (path, pattern) not in _coders:
        bpe = ByteBPE.from_file(path)
        _coders[path, pattern] = bpe, PieceCoder(pattern, bpe.encode_pieces)
    return _coders[path, pattern]


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """(id_col, n_tokens, ids, ids_sha256, decoded_sha256): ids is null unless with_ids."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        bpe, pieces = coder(vocabulary, pattern)
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            count, ids_out, hashed, decoded = [], [], [], []
            for part in chunks(texts):
                for ids in pieces.encode_texts(texts[part]):
                    count.append(len(ids))
                    ids_out.append(ids.astype(np.int32) if with_ids else None)
                    hashed.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(count, pa.int64()), pa.array(ids_out, pa.list_(pa.int32())), pa.array(hashed, pa.string()), pa.array(decoded, pa.string())],
                names=["id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"],
            )

    source = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    out = source.mapInArrow(run, f"id {kind}, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
