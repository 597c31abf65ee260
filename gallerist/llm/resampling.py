"""Importance resampling of documents towards a target distribution, by hashed features of 1 to WIDTH words.

Words are runs of letters, digits and characters beyond ASCII, A-Z in lower case. Every run of 1 to WIDTH consecutive words,
joined by one blank, falls into the bucket of its crc32. A document's buckets are written as a packed stream of 16-bit
numbers, many documents in a row with the offsets at which each begins (`streams`). For the counts each task sorts its
streams and run-length encodes them, so that at most BUCKETS rows a task are summed. Weights are gathered from the table
of gains, one number a bucket, and summed from offset to offset by np.add.reduceat. The text is read once; the second pass
reads the streams.

The draw is without replacement: the score of a document is its weight plus Gumbel noise from a hash of its id, and the
highest scores are drawn. Ranks come from one sort by range with an offset a partition, so no task holds all rows.

Edge cases: a text that is null or has no word has no features, and its weight is 0. Texts are cut at blanks into spans of
SPAN bytes while words are hashed, the last words of a span carried over, so a very long text needs memory for itself and its
stream. Equal scores: the smaller id first, null ids last, then the document with fewer features; repeated rows are drawn
one by one. A row without id has the noise of `seed:null`. Empty tables give empty results, an empty target gains as if it
had no counts. More columns don't matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gallerist.storage import in_order

from ._common import fresh, written

WIDTH = 3
BUCKETS = 10_000
#: Features in a row of streams, about; a longer document is a row of its own.
BLOCK = 1 << 16
SPAN = 1 << 20
#: Each byte as it counts in a word: a blank ends one.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _spans(text: str) -> Iterator[list[bytes]]:
    """The words of a text, a bounded number at a time."""
    data = text.encode().translate(PLAIN)
    at = 0
    while at < len(data):
        end = len(data) if len(data) - at <= SPAN else data.find(b" ", at + SPAN)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def buckets(text: str | None, width: int = WIDTH, size: int = BUCKETS) -> tuple[np.ndarray, int]:
    """(the buckets of a text's features as 16-bit numbers, its number of words)."""
    found, n_words, tail = [], 0, []
    for words in _spans(text or ""):
        n_words += len(words)
        new, words = len(words), [*tail, *words]
        longer = [b" " + w for w in words]
        crcs = list(map(crc32, words))
        for n in range(1, width + 1):
            # runs of n words that end in this span; those that end in the words carried over were counted before
            here = crcs[max(0, len(crcs) - new) :]
            found.append((np.array(here, np.uint32) % size).astype(np.uint16))
            if n < width:
                crcs = list(map(crc32, longer[n:], crcs))
        tail = words[len(words) - min(len(words), width - 1) :]
    return np.concatenate(found) if found else np.empty(0, np.uint16), n_words


def streams(texts: DataFrame, id_col: str | None, text_col: str = "text", width: int = WIDTH, size: int = BUCKETS) -> DataFrame:
    """(ids, n_words, offsets, stream): rows of about BLOCK features, written."""
    kind = texts.schema[id_col].dataType.simpleString() if id_col else "long"
    rows = texts.select((F.col(id_col) if id_col else F.lit(None).cast("long")).alias("id"), F.col(text_col).alias("text"))

    def run(batches) -> Iterator:
        import pyarrow as pa

        ids, words, offsets, parts, held, of = [], [], [], [], 0, None

        def row():
            packed = np.concatenate(parts).astype("<u2").tobytes()
            lists = [pa.array([x], pa.list_(k)) for x, k in ((ids, of), (words, pa.int64()), (offsets, pa.int64()))]
            return pa.RecordBatch.from_arrays([*lists, pa.array([packed], pa.binary())], names=["ids", "n_words", "offsets", "stream"])

        for batch in batches:
            of = batch.schema.field("id").type
            for i, t in zip(batch["id"], batch["text"], strict=True):
                found, n = buckets(t.as_py(), width, size)
                ids.append(i.as_py())
                words.append(n)
                offsets.append(held)
                parts.append(found)
                held += len(found)
                if held >= BLOCK or len(ids) >= 1 << 16:
                    yield row()
                    ids, words, offsets, parts, held = [], [], [], [], 0
        if ids:
            yield row()

    out = rows.mapInArrow(run, f"ids array<{kind}>, n_words array<long>, offsets array<long>, stream binary")
    return written(out, "streams")


def counts(stored: DataFrame, size: int = BUCKETS) -> np.ndarray:
    """How many features each bucket holds: sorted and run-length encoded in each task, then summed."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        total = np.zeros(size, np.int64)
        for batch in batches:
            for s in batch["stream"]:
                x = np.sort(np.frombuffer(s.as_buffer(), "<u2"), kind="stable")
                if len(x):
                    starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
                    total[x[starts]] += np.diff(np.r_[starts, len(x)])
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    out = np.zeros(size, np.int64)
    for r in stored.select("stream").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket at most
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's share in the target over that in the source, one added to each count."""
    s, t, n = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log(float(b + 1) * float(s + n) / (float(a + 1) * float(t + n)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(name: str) -> int:
    """floor(1000 g) for a Gumbel variate g from the hash of a name."""
    h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weights(stored: DataFrame, gain: np.ndarray, seed: int = 42) -> DataFrame:
    """(id, n_words, n_features, weight, score) of every document of the streams."""
    kind = stored.schema["ids"].dataType.elementType.simpleString()

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for row in range(batch.num_rows):
                ids, n_words, offsets = batch["ids"][row].values, batch["n_words"][row].values, np.array(batch["offsets"][row].as_py(), np.int64)
                x = gain[np.frombuffer(batch["stream"][row].as_buffer(), "<u2")]
                lengths = np.diff(np.r_[offsets, len(x)])
                total = np.zeros(len(offsets), np.int64)
                some = np.flatnonzero(lengths)
                if len(some):
                    total[some] = np.add.reduceat(x, offsets[some])
                extra = np.array([noise(f"{seed}:{'null' if i is None else i}") for i in ids.to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([ids, n_words, pa.array(lengths), pa.array(total), pa.array(total + extra)], names=["id", "n_words", "n_features", "weight", "score"])

    return stored.mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(id, n_features, weight, score, rank) of every document; rank is null for those not drawn.

    Of the documents of least_words words or more, percent in a hundred are drawn, rounded down.
    """
    stored = streams(docs, id_col, text_col)
    gain = gains(counts(stored), counts(streams(target, None, target_col)))
    scored = written(weights(stored, gain, seed), "weights")
    fit = scored.where(F.col("n_words") >= least_words)
    draw = percent * fit.count() // 100
    placed = in_order(fit, [F.desc("score"), F.asc_nulls_last("id"), F.asc("n_features")], "before", label="ranked")
    rank = F.when(F.col("before") < draw, F.col("before") + 1).cast("long").alias("rank")
    columns = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    rest = scored.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank"))
    return placed.select(*columns, rank).unionByName(rest)


def drawn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs whose id was drawn, in all their columns."""
    key = fresh("drawn_id", docs.columns)
    ids = resample(docs, target, id_col=id_col, **options).where("rank IS NOT NULL").select(F.col(id_col).alias(key)).distinct()
    return docs.join(ids, docs[id_col].eqNullSafe(F.col(key)), "left_semi")
