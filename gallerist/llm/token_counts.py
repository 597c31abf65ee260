"""Token counts under a unigram vocabulary, by dynamic programming over a trie of pre-tokens.

The distinct pre-tokens of a batch go into one trie. The forward score of a node is that of the best segmentation of its
prefix into pieces of the vocabulary, so it is computed once for all pre-tokens that share the prefix; the number of
pieces at a pre-token's last node is its count. Nodes of one depth are computed together: for each length, the last
bytes of all nodes are looked up by a rolling hash. Of equally good segmentations the one whose last piece is longest
counts. A pre-token of more than LONG bytes is segmented alone, in time linear in its length.

Null and empty texts have no tokens; repeated texts give equal rows, whatever their ids; a row without id has a null id in
the result; an empty table gives an empty result. Only the id and the text are read, so other columns may have any names.
A text is worked on whole, its pre-tokens in memory at once.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import PieceCoder, chunks
from .shingles import _BYTE, _STEP, mix

LONG = 256
SCALE = 1_000_000
_LOWEST = -(1 << 60)


def zipf_scores(ranks: dict[bytes, int]) -> dict[bytes, int]:
    """A unigram model from an order of frequency: log probabilities by Zipf's law, in millionths, so that sums are exact."""
    norm = math.log(sum(1.0 / (r + 1) for r in ranks.values()))
    return {t: round(SCALE * (-math.log(r + 1) - norm)) for t, r in ranks.items()}


class UnigramTrie:
    """scores: the pieces and their log probabilities as integers; every single byte should be among them."""

    def __init__(self, scores: dict[bytes, int]):
        self.scores = scores
        self.longest = max(map(len, scores))
        self.keys, self.values, self.bits = {}, {}, {}
        by_size: dict[int, list[bytes]] = {}
        for t in scores:
            by_size.setdefault(len(t), []).append(t)
        for size, pieces in by_size.items():
            a = np.frombuffer(b"".join(pieces), np.uint8).reshape(-1, size)
            h = np.zeros(len(pieces), np.uint64)
            for k in range(size):
                h = h * _STEP + _BYTE[a[:, k]]
            h = mix(h)
            by = np.argsort(h)
            self.keys[size] = h[by]
            self.values[size] = np.array([scores[pieces[i]] for i in by.tolist()], np.int64)
            self.bits[size] = np.zeros(1 << 18, bool)
            self.bits[size][(h >> np.uint64(46)).astype(np.int64)] = True
        self.sizes = sorted(self.keys, reverse=True)

    def one(self, raw: bytes) -> tuple[int, int]:
        """(score, count) of the best segmentation of one string."""
        best, count, get = [0], [0], self.scores.get
        for end in range(1, len(raw) + 1):
            top, n = _LOWEST, 0
            for size in self.sizes:
                if size <= end and (s := get(raw[end - size : end])) is not None and best[end - size] + s > top:
                    top, n = best[end - size] + s, count[end - size] + 1
            best.append(top)
            count.append(n)
        return best[-1], count[-1]

    def many(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(scores, counts) of the best segmentations of distinct strings."""
        score, count = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
        order = sorted(range(len(raw)), key=raw.__getitem__)
        for i in order:
            if len(raw[i]) > LONG:
                score[i], count[i] = self.one(raw[i])
        place = np.array([i for i in order if 0 < len(raw[i]) <= LONG], np.int64)
        if not len(place):
            return score, count
        sizes = np.fromiter((len(raw[i]) for i in place.tolist()), np.int64, len(place))
        data = np.frombuffer(b"".join(raw[i] for i in place.tolist()), np.uint8)
        offset = np.cumsum(sizes) - sizes
        node = np.zeros(len(place), np.int64)  # of each string at the depth so far, within that depth
        bests, counts = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        # of each node of a depth: the hash of its last bytes, and the node that stands before them, by length from 0
        hashes, starts = [np.zeros(1, np.uint64)], [np.zeros(1, np.int64)]
        active = np.arange(len(place))
        depth = 0
        while len(active):
            byte = data[offset[active] + depth]
            parent = node[active]
            new = np.append(True, (parent[1:] != parent[:-1]) | (byte[1:] != byte[:-1]))
            at = np.cumsum(new) - 1
            up, symbol = parent[new], byte[new]
            depth += 1
            reach = min(depth, self.longest)
            value = _BYTE[symbol]
            fresh_hashes, fresh_starts = [np.zeros(len(up), np.uint64)], [np.arange(len(up))]
            for size in range(1, reach + 1):  # the string of size bytes is its first size - 1, before the new one
                fresh_hashes.append(hashes[size - 1][up] * _STEP + value)
                fresh_starts.append(starts[size - 1][up])
            best, n = np.full(len(up), _LOWEST), np.zeros(len(up), np.int64)
            for size in range(reach, 0, -1):
                if size not in self.keys:
                    continue
                h = mix(fresh_hashes[size])
                hit = np.flatnonzero(self.bits[size][(h >> np.uint64(46)).astype(np.int64)])
                if not len(hit):
                    continue
                keys = self.keys[size]
                found = np.minimum(np.searchsorted(keys, h[hit]), len(keys) - 1)
                ok = keys[found] == h[hit]
                hit, found = hit[ok], found[ok]
                source = fresh_starts[size][hit]
                total = bests[depth - size][source] + self.values[size][found]
                better = total > best[hit]
                hit, source = hit[better], source[better]
                best[hit], n[hit] = total[better], counts[depth - size][source] + 1
            bests.append(best)
            counts.append(n)
            if depth >= self.longest:
                bests[depth - self.longest] = counts[depth - self.longest] = None
            hashes, starts = fresh_hashes, fresh_starts
            node[active] = at
            done = sizes[active] == depth
            last = active[done]
            score[place[last]], count[place[last]] = best[at[done]], n[at[done]]
            active = active[~done]
        return score, count


_tries: dict[str, UnigramTrie] = {}


def count_tokens(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, n_pretokens, n_tokens, log_score) for every row of docs; vocabulary: a file of byte strings and ranks."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        if vocabulary not in _tries:
            with open(vocabulary, "rb") as f:
                _tries[vocabulary] = UnigramTrie(zipf_scores({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}))
        trie = _tries[vocabulary]

        def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
            # two values for each piece: its count and the size of its score, which is never positive
            score, count = trie.many([p.encode("utf-8", "surrogatepass") for p in pieces])
            return np.stack([count, -score], axis=1).ravel(), np.full(len(pieces), 2)

        coder = PieceCoder(pattern, encode)
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            pieces, tokens, score = [], [], []
            for part in chunks(texts):
                for pair in coder.encode_texts(texts[part]):
                    pair = pair.astype(np.int64).reshape(-1, 2)
                    pieces.append(len(pair))
                    tokens.append(int(pair[:, 0].sum()))
                    score.append(-int(pair[:, 1].sum()) / SCALE)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(pieces, pa.int64()), pa.array(tokens, pa.int64()), pa.array(score, pa.float64())], names=["id", "n_pretokens", "n_tokens", "log_score"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, n_pretokens long, n_tokens long, log_score double").withColumnRenamed("id", id_col)
