"""Best-fit-decreasing packing of token pieces into sequences, certified by dual feasible functions.

Pieces are dealt into partitions of bounded size. Each is packed by best fit decreasing, and a lower bound from dual
feasible functions tells how many sequences its pieces need at least. A partition that meets its bound keeps its
sequences, but for the least full one; one with a gap keeps only its full ones. What was not kept is exchanged: dealt
anew into fewer partitions and packed again, until one partition holds the rest, a round has nothing to exchange, or an
exchange among the largest partitions allowed gains nothing more. So no task ever holds more than MOST_DEALT pieces.

Null and empty texts have one piece, the end token. Repeated rows, also those of one id with different texts, are
separate pieces, and rows with a null id have pieces with a null id; an empty table gives an empty result. Pieces of one
length are alike to the packing, so ties change no count of sequences. Other columns are not carried. A text is encoded
whole, in one task; only its pieces go on.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import written

#: Pieces that one partition packs at a time, about: at first, and at most once exchange stalls (some 100 MB).
DEALT, MOST_DEALT = 100_000, 1_600_000
PIECE = "id long, piece int, start long, length long, ids_crc32 long"


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Sequences that pieces of these lengths need at least, over two families of dual feasible functions."""
    counts = np.bincount(lengths, minlength=capacity + 1)
    x = np.arange(capacity + 1)
    best = -(-int((counts * x).sum()) // capacity)
    above, mass = np.cumsum(counts[::-1])[::-1], np.concatenate([[0], np.cumsum(counts * x)])
    for low in range(1, capacity // 2 + 1):  # pieces over capacity - low count as whole, those under low as nothing
        whole = int(above[capacity - low + 1])
        part = int(mass[capacity - low + 1] - mass[low])
        best = max(best, whole + -(-part // capacity))
    for k in range(1, 64):  # pieces count as the multiples of 1 / k that they exceed
        q, r = np.divmod((k + 1) * x, capacity)
        value = np.where(r == 0, x * k, q * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each piece, the number of its sequence and its place in it."""
    bins = np.zeros(len(lengths), np.int64)
    places = np.zeros(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    marks = opened = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = marks >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            held = room[left]
            b = held.pop()
            if not held:
                marks &= ~(1 << left)
        else:
            left, b = capacity, opened
            opened += 1
        bins[i], places[i] = b, capacity - left
        left -= n
        if left:
            room[left].append(b)
            marks |= 1 << left
    return bins, places


def added_tokens(path: str) -> dict[str, int]:
    """The tokens that a tokenizer's JSON file adds to its vocabulary: they are found in running text before it is split."""
    import json

    with open(path, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    odd = [t["content"] for t in added if t["lstrip"] or t["rstrip"] or t["single_word"]]
    if odd:
        raise ValueError(f"added tokens that take in their surroundings: {odd}")
    return {t["content"]: t["id"] for t in added}


def token_pieces(docs: DataFrame, vocabulary: str, pattern: str, end_id: int, capacity: int, id_col: str = "doc_id", text: str = "text", added: dict[str, int] | None = None) -> DataFrame:
    """PIECE rows: a document's ids and the end token, cut into pieces of capacity tokens of which the first may be shorter.

    added: strings that are one token wherever they stand in a text.
    """

    def run(batches) -> Iterator:
        import pyarrow as pa
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added or {}).encode_to_numpy
        end = np.array([end_id], "<u4")
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for key, text_ in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(encode(text_, allowed_special="all", disallowed_special=()).astype("<u4"), end) if text_ else end
                first = (len(ids) - 1) % capacity + 1
                for k, stop in enumerate(range(first, len(ids) + 1, capacity)):
                    start = max(0, stop - capacity) if k else 0
                    for column, value in zip(rows, (key, k, start, stop - start, zlib.crc32(ids[start:stop].tobytes())), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, PIECE)


def _round(pieces: DataFrame, capacity: int, number: int, last: bool) -> DataFrame:
    def run(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        held = list(batches)
        t = pa.Table.from_batches(held) if held else None
        if t is None or not t.num_rows:
            return
        lengths = t["length"].to_numpy()
        bins, places = best_fit_decreasing(lengths, capacity)
        count = int(bins.max()) + 1
        fill = np.bincount(bins, weights=lengths, minlength=count).astype(np.int64)
        kept = np.ones(count, bool)
        if not last:
            if count > lower_bound(lengths, capacity):
                kept = fill == capacity
            elif fill.min() < capacity:
                kept[int(fill.argmin())] = False
        mark = (number << 52) | (TaskContext.get().partitionId() << 32)
        t = t.append_column("sequence_id", pa.array(bins + mark)).append_column("offset", pa.array(places)).append_column("kept", pa.array(kept[bins]))
        yield from t.combine_chunks().to_batches()

    return pieces.mapInArrow(run, f"{PIECE}, sequence_id long, offset long, kept boolean")


def pack(pieces: DataFrame, capacity: int, dealt: int = DEALT, max_rounds: int = 12) -> DataFrame:
    """PIECE rows with sequence_id (any numbers, unique over all sequences) and offset."""
    names = [f.split()[0] for f in PIECE.split(", ")]
    full = pieces.where(F.col("length") == capacity).select(*names, F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    full = full.withColumn("sequence_id", -1 - F.col("sequence_id"))
    rest, done = pieces.where(F.col("length") < capacity), [full]
    count, stalled = rest.count(), False
    for number in range(max_rounds):
        parts = max(1, -(-count // dealt))
        last = parts == 1 or stalled or number == max_rounds - 1
        dealt_out = rest.repartition(parts, F.xxhash64("id", "piece", F.lit(number))) if parts > 1 else rest.coalesce(1)
        packed = written(_round(dealt_out, capacity, number, last), "packed")
        done.append(packed.where("kept").select(*names, "sequence_id", "offset"))
        if last:
            break
        rest = packed.where("NOT kept").select(*names)
        left = rest.count()
        if not left:
            break
        if left > 0.9 * count:  # an exchange among as many partitions would not help: let fewer meet more
            stalled = dealt >= MOST_DEALT
            dealt = min(dealt * 4, max(dealt, MOST_DEALT))
        count = left
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out


def pack_documents(
    docs: DataFrame, vocabulary: str, pattern: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text: str = "text", added: dict[str, int] | None = None
) -> DataFrame:
    pieces = written(token_pieces(docs, vocabulary, pattern, end_id, capacity, id_col, text, added), "pieces")
    return pack(pieces, capacity).withColumnRenamed("id", id_col)
