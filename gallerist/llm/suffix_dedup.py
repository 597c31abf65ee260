"""Removal of passages that start in two places or more, by suffix sorting in content-chosen buckets.

A window is a string of `length` symbols: bytes, or words by their 64-bit hashes. Its bucket is the least hash among the
`anchor` symbols long strings in it, so equal windows share a bucket wherever they stand, and a run of neighbouring
windows with one bucket is one segment. Windows of bytes and of words go through the same steps together; the last bit
of a bucket's key tells them apart.
1. Anchors are counted over all documents. One that occurs once has no repeated window: most text ends here.
2. The segments of the other anchors are counted by content. A content that occurs twice or more is repeated whole.
3. Of buckets with different contents, one copy of each is sorted by the two-stage suffix sort; neighbours with a
   common prefix of `length` symbols are repeated windows.
4. In buckets with more than HOT contents, such as a passage a little too short in countless contexts, the windows of one
   copy of each content are dealt by a hash of the whole window instead and counted after partial aggregation, so that
   no task holds such a bucket.
Steps 2 to 4 find windows from the input alone; what they cover is removed together at the end.

remove_repeats() removes bytes covered by repeated windows of bytes, and counts the words covered by repeated windows of
words. strip_passages() removes both, so passages of over 50 words that are shorter than a window of bytes go too.

Null and empty texts have nothing removed; texts shorter than a window neither. Repeated rows are places of their own:
their windows count twice. A row is known by its id and a hash of its text, so ids that repeat with different texts, and
rows with a null id, are each treated by their own text. An empty table gives an empty result. Long texts are worked on
in overlapping blocks, a text with the same window many times has all of them removed. Only the id and the text are read;
strip_repeats() and strip_passages() hand on the other columns, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import drop_written, fresh, written
from .shingles import _BYTE, mix, word_places
from .suffix_sort import common_prefixes, two_stage_suffix_array

LENGTH, ANCHOR = 400, 200
WORDS = 51  # of a passage
HOT = 4096
BLOCK = 1 << 17
_BASE = 0x9E3779B97F4A7C15
_NO_ID = -(1 << 63)


@dataclass(frozen=True)
class Kind:
    """What windows are made of."""

    words: bool
    length: int
    anchor: int

    def symbols(self, text: bytes) -> np.ndarray:
        return word_places(text)[0] if self.words else np.frombuffer(text, np.uint8)

    def stored(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, np.uint64 if self.words else np.uint8)

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes & ~np.uint64(1) | np.uint64(self.words)).view(np.int64)


def kinds_of(length: int = LENGTH, anchor: int = ANCHOR, words: int = 0) -> tuple[Kind, ...]:
    """Windows of length bytes (none if 0) and of words words (none if 0)."""
    return tuple(([Kind(False, length, anchor)] if length else []) + ([Kind(True, words, max(1, words // 2))] if words else []))


def rolling(data: np.ndarray, width: int, base: int = _BASE) -> np.ndarray:
    """A hash of the width symbols from each place on, by doubling."""
    level, size, power = _BYTE[data] if data.dtype == np.uint8 else data, 1, base
    out, done = None, 0
    while True:
        if width & size:
            if out is None:
                out, done = level, size
            else:  # the bits taken so far stand before this level
                n = len(data) - done - size + 1
                out = out[:n] * np.uint64(power) + level[done : done + n]
                done += size
        if size * 2 > width:
            return out
        n = len(level) - size
        level = level[:n] * np.uint64(power) + level[size:]
        power = power * power % (1 << 64)
        size *= 2


def _extreme(x: np.ndarray, width: int, f) -> np.ndarray:
    """f (minimum or maximum) over the width values from each place on."""
    size = 1
    while size * 2 <= width:
        x = f(x[: len(x) - size], x[size:])
        size *= 2
    rest = width - size
    return f(x[: len(x) - rest], x[rest:]) if rest else x


class Windows:
    """The windows of a block of texts: at[i] and owner of each valid window, and the bucket of each."""

    def __init__(self, texts: list[np.ndarray], length: int, anchor: int):
        data = np.concatenate(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.cumsum(sizes) - sizes
        span = length - anchor + 1
        self.hashes = mix(rolling(data, anchor))
        least = _extreme(self.hashes, span, np.minimum)
        left = self.starts[np.searchsorted(self.starts, np.arange(len(least)), side="right") - 1] if len(texts) > 1 else None
        if left is None:
            self.valid = np.ones(len(least), bool)
            self.owner = np.zeros(len(least), np.int64)
        else:
            self.owner = np.searchsorted(self.starts, np.arange(len(least)), side="right") - 1
            self.valid = np.arange(len(least)) + length <= self.starts[self.owner] + sizes[self.owner]
        self.bucket = np.where(self.valid, least, np.uint64(0))
        self.span, self.length = span, length

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(owner, bucket, places) of every bucket of every text: at how many places its anchor stands."""
        pad = np.zeros(self.span - 1, np.uint64)
        top = _extreme(np.concatenate([pad, self.bucket, pad]), self.span, np.maximum)
        place = np.flatnonzero(top == self.hashes)
        owner = np.searchsorted(self.starts, place, side="right") - 1
        key = self.hashes[place]
        order = np.lexsort((key, owner))
        owner, key = owner[order], key[order]
        new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]))) if len(key) else place
        return owner[new], key[new], np.diff(np.append(new, len(key)))

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(owner, bucket, first window, count of windows) of each run of windows with one bucket; places are in the block."""
        b = self.bucket
        if not len(b):
            return (np.zeros(0, np.int64),) * 4
        cut = np.flatnonzero(np.append(True, (b[1:] != b[:-1]) | (self.owner[1:] != self.owner[:-1])))
        count = np.diff(np.append(cut, len(b)))
        keep = self.valid[cut]
        return self.owner[cut][keep], b[cut][keep], cut[keep], count[keep]


def blocks(texts: list[np.ndarray], length: int) -> Iterator[tuple[list[int], int, list[np.ndarray]]]:
    """(numbers of texts, place of the first symbol in its text, texts): short ones together, long ones in overlapping parts."""
    group, size = [], 0
    for i, t in enumerate(texts):
        if len(t) < length:
            continue
        if len(t) > BLOCK:
            for s in range(0, len(t) - length + 1, BLOCK):
                yield [i], s, [t[s : s + BLOCK + length - 1]]
            continue
        group.append(i)
        size += len(t)
        if size >= BLOCK:
            yield group, 0, [texts[j] for j in group]
            group, size = [], 0
    if group:
        yield group, 0, [texts[j] for j in group]


def _utf8(texts) -> list[bytes]:
    return [x if isinstance(x, bytes) else (x or "").encode("utf-8", "surrogatepass") for x in texts]


def _rows(columns: dict, rows: list[tuple]):
    """A batch of rows of tuples; columns: names and Arrow types."""
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), columns.values(), strict=True)], names=list(columns))


def _anchor_rows(kinds: tuple[Kind, ...]):
    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts, ids, marks = _utf8(batch.column("text").to_pylist()), batch.column("id"), batch.column("mark")
            for kind in kinds:
                for numbers, _, part in blocks([kind.symbols(t) for t in texts], kind.length):
                    owner, key, places = Windows(part, kind.length, kind.anchor).anchors()
                    who = pa.array(np.array(numbers)[owner])
                    yield pa.RecordBatch.from_arrays([ids.take(who), marks.take(who), pa.array(kind.keys(key)), pa.array(places.astype(np.int32))], names=["id", "mark", "key", "places"])

    return run


def _chosen(batch, kinds: tuple[Kind, ...]) -> Iterator:
    """(number of the text, its symbols, first window, count of windows, bucket, length) of the segments whose bucket the row names."""
    texts = _utf8(batch.column("text").to_pylist())
    wanted = [np.unique(np.array(k, np.int64)) if k else np.zeros(0, np.int64) for k in batch.column("keys").to_pylist()]
    for kind in kinds:
        mine_too = [w[(w & 1) == kind.words] for w in wanted]
        symbols = [kind.symbols(t) if len(w) else np.zeros(0, np.uint8) for t, w in zip(texts, mine_too, strict=True)]
        for numbers, shift, part in blocks(symbols, kind.length):
            w = Windows(part, kind.length, kind.anchor)
            owner, key, first, count = w.segments()
            key = kind.keys(key)
            mine = np.zeros(len(key), bool)
            cuts = np.searchsorted(owner, np.arange(len(numbers) + 1))
            for k, i in enumerate(numbers):
                mine[cuts[k] : cuts[k + 1]] = np.isin(key[cuts[k] : cuts[k + 1]], mine_too[i])
            place = first - w.starts[owner] + shift
            for o, p, n, b in zip(owner[mine].tolist(), place[mine].tolist(), count[mine].tolist(), key[mine].tolist(), strict=True):
                yield numbers[o], symbols[numbers[o]], p, n, b, kind.length


def _digest(symbols: np.ndarray, place: int, count: int, length: int) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(symbols[place : place + count + length - 1].tobytes())


def _segment_rows(kinds: tuple[Kind, ...]):
    def run(batches) -> Iterator:
        import pyarrow as pa

        columns = {"id": pa.int64(), "mark": pa.int64(), "place": pa.int64(), "windows": pa.int64(), "key": pa.int64(), "content": pa.binary()}
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                who = list(zip(batch.column("id").to_pylist(), batch.column("mark").to_pylist(), strict=True))
                rows = [(*who[i], p, n, b, _digest(t, p, n, size)) for i, t, p, n, b, size in _chosen(batch, kinds)]
                if rows:
                    yield _rows(columns, rows)

    return run


def _content_rows(kinds: tuple[Kind, ...]):
    """One copy of each content that a row asks for."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        columns = {"key": pa.int64(), "content": pa.binary(), "bytes": pa.binary()}
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                asked = [{(r["key"], r["content"]) for r in w} for w in batch.column("asked").to_pylist()]
                keys = pa.array([[k for k, _ in w] for w in asked], pa.list_(pa.int64()))
                named = pa.RecordBatch.from_arrays([batch.column("text"), keys], names=["text", "keys"])
                rows = []
                for i, t, p, n, b, size in _chosen(named, kinds):
                    c = _digest(t, p, n, size)
                    if (b, c) in asked[i]:
                        asked[i].discard((b, c))
                        rows.append((b, c, t[p : p + n + size - 1].tobytes()))
                if rows:
                    yield _rows(columns, rows)

    return run


def _digits(parts: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """(parts of numbers as parts of bytes, bytes for each): the digits of each number's rank, so that the sort scans 256 buckets."""
    every, ranks = np.unique(np.concatenate(parts), return_inverse=True)
    wide = max(1, -(-(len(every) - 1).bit_length() // 8))
    digits = ranks.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 4 - wide :].ravel()
    return np.split(digits, np.cumsum([wide * len(p) for p in parts])[:-1]), wide


def repeated_windows(parts: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For each part, of bytes or of numbers, the places of its windows that start anywhere else in the parts."""
    wide = 1
    if parts[0].dtype != np.uint8:
        parts, wide = _digits(parts)
    length *= wide
    order, s = two_stage_suffix_array(parts, length)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.cumsum(lengths + 1) - lengths - 1
    owner = np.repeat(np.arange(len(parts)), lengths + 1)
    place = np.arange(len(s)) - starts[owner]
    window = (place + length <= lengths[owner]) & (place % wide == 0)
    order = order[window[order]]
    met = common_prefixes(s, order[:-1], order[1:], length) >= length if len(order) > 1 else np.zeros(0, bool)
    found = np.zeros(len(s), bool)
    found[order[:-1][met]] = True
    found[order[1:][met]] = True
    at = np.flatnonzero(found)
    cuts = np.searchsorted(owner[at], np.arange(len(parts) + 1))
    return [(at[x:y] - starts[i]) // wide for i, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]


def runs_of(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive places."""
    if not len(places):
        return places, places
    cut = np.flatnonzero(np.diff(places) != 1)
    return places[np.append(0, cut + 1)], places[np.append(cut, len(places) - 1)]


def _sorted_rows(kinds: tuple[Kind, ...], chunk: int = 1 << 20):
    """Suffix-sorts whole buckets of one kind together, about chunk bytes at a time; rows come sorted by kind and bucket."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        columns = {"key": pa.int64(), "content": pa.binary(), "first": pa.int64(), "last": pa.int64()}
        by_bit = {int(k.words): k for k in kinds}
        keys, contents, parts = [], [], []

        def flush():
            kind, rows = by_bit[keys[0] & 1], []
            for k, c, places in zip(keys, contents, repeated_windows([kind.stored(p) for p in parts], kind.length), strict=True):
                first, last = runs_of(places)
                rows += [(k, c, x, y) for x, y in zip(first.tolist(), last.tolist(), strict=True)]
            for held in (keys, contents, parts):
                held.clear()
            if rows:
                yield _rows(columns, rows)

        size = 0
        for batch in batches:
            for k, c, p in zip(*(batch.column(n).to_pylist() for n in ("key", "content", "bytes")), strict=True):
                if keys and (keys[-1] & 1 != k & 1 or size >= chunk and keys[-1] != k):
                    yield from flush()
                    size = 0
                keys.append(k)
                contents.append(c)
                parts.append(p)
                size += len(p)
        if keys:
            yield from flush()

    return run


def _window_rows(kinds: tuple[Kind, ...]):
    """A 128-bit hash of each window of each content."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        by_bit = {int(k.words): k for k in kinds}
        for batch in batches:
            for key, content, data in zip(batch.column("key"), batch.column("content"), batch.column("bytes"), strict=True):
                kind = by_bit[key.as_py() & 1]
                part = kind.stored(data.as_buffer())
                h1, h2 = mix(rolling(part, kind.length)), mix(rolling(part, kind.length, 0xD6E8FEB86659FD93))
                n = len(h1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, key.as_py())), pa.array([content.as_py()] * n, pa.binary()), pa.array(np.arange(n)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))],
                    names=["key", "content", "place", "h1", "h2"],
                )

    return run


def covered(first: np.ndarray, last: np.ndarray, length: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal byte runs that windows from first to last cover."""
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.minimum(np.maximum.accumulate(last[order] + length), size)
    new = np.append(True, first[1:] > end[:-1]) if len(first) else np.zeros(0, bool)
    return first[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(first) - 1)] if len(first) else end


def _spans(found, kind: Kind, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of symbols that a row's windows of one kind cover."""
    mine = [(r["first"], r["last"]) for r in found or () if r["words"] == kind.words]
    first, last = np.array(mine, np.int64).reshape(-1, 2).T
    return covered(first, last, kind.length, size)


def _result_rows(kinds: tuple[Kind, ...], strip: tuple[bool, ...], with_text: bool):
    """What is left of each row's text; strip: of which kinds what is covered is removed."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        columns = {"id": pa.int64(), "mark": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "n_passage_words": pa.int64(), "kept_sha256": pa.string(), "kept": pa.string()}
        for batch in batches:
            rows = []
            for i, mark, data, found in zip(batch.column("id").to_pylist(), batch.column("mark").to_pylist(), _utf8(batch.column("text").to_pylist()), batch.column("found").to_pylist(), strict=True):
                spans, passage_words = [], 0
                for kind, gone in zip(kinds, strip, strict=True):
                    if not kind.words:
                        spans += zip(*(x.tolist() for x in _spans(found, kind, len(data))), strict=True) if gone else []
                    elif any(r["words"] for r in found or ()):
                        places = word_places(data)[1]
                        begin, end = _spans(found, kind, len(places))
                        passage_words = int((end - begin).sum())
                        bounds = np.concatenate([[0], places[1:], [len(data)]])  # a word goes with the gap after it
                        spans += zip(bounds[begin].tolist(), bounds[end].tolist(), strict=True) if gone else []
                kept, at, runs = [], 0, 0
                for s, e in sorted(spans):
                    if e <= at:
                        continue
                    runs += s > at or not runs
                    kept.append(data[at : max(s, at)])
                    at = e
                kept.append(data[at:])
                rest = b"".join(kept)
                rows.append((i, mark, len(data), len(data) - len(rest), runs, passage_words, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore") if with_text else None))
            if rows:
                yield _rows(columns, rows)

    return run


_RESULT = "id long, mark long, n_bytes long, n_removed long, n_spans long, n_passage_words long, kept_sha256 string, kept string"


def _source(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, mark, text); a null id has a number of its own."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(body).alias("mark"), body.alias("text"))


def _repeated(source: DataFrame, kinds: tuple[Kind, ...], hot: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(the rows of source with the buckets they have in common, (id, mark, found): its repeated windows, written tables that found reads)."""
    row = ["id", "mark"]
    anchors = written(source.mapInArrow(_anchor_rows(kinds), "id long, mark long, key long, places int"), "anchors")
    shared = anchors.groupBy("key").agg(F.sum("places").alias("n")).where("n > 1").select("key")
    named = anchors.join(shared, "key").groupBy(*row).agg(F.collect_set("key").alias("keys"))
    texts = source.join(named, row, "left").select(
        *row, "keys", F.octet_length("text").cast("long").alias("n_bytes"),
        F.when(F.col("keys").isNull(), F.sha2(F.col("text").cast("binary"), 256)).alias("sha"),
        F.when(F.col("keys").isNotNull(), F.col("text")).alias("text"),
    )
    texts = written(texts, "texts")
    drop_written(anchors)
    some = texts.where("keys IS NOT NULL").select(*row, "text", "keys")

    segments = written(some.mapInArrow(_segment_rows(kinds), "id long, mark long, place long, windows long, key long, content binary"), "segments")
    contents = segments.groupBy("key", "content").agg(F.count("*").alias("copies"), F.min(F.struct(*row)).alias("holder"))
    contents = written(contents, "contents")
    buckets = contents.groupBy("key").agg(F.count("*").alias("different"), F.max("copies").alias("most"))
    buckets = written(buckets, "buckets")
    # one content, copied: repeated whole, nothing to sort
    sorting = buckets.where((F.col("different") <= hot) & ~((F.col("different") == 1) & (F.col("most") > 1))).select("key")

    def one_of_each(keys: DataFrame) -> DataFrame:
        asked = contents.join(keys, "key").groupBy("holder.id", "holder.mark").agg(F.collect_list(F.struct("key", "content")).alias("asked"))
        return asked.join(some.select(*row, "text"), row).mapInArrow(_content_rows(kinds), "key long, content binary, bytes binary")

    runs = "key long, content binary, first long, last long"
    held = [segments, contents, buckets]
    dealt = one_of_each(sorting).repartition("key").sortWithinPartitions(F.col("key").bitwiseAND(1), "key")
    found = written(dealt.mapInArrow(_sorted_rows(kinds), runs).distinct(), "found")
    held.append(found)
    hot_keys = buckets.where(F.col("different") > hot).select("key")
    if hot_keys.limit(1).count():
        windows = one_of_each(hot_keys).mapInArrow(_window_rows(kinds), "key long, content binary, place long, h1 long, h2 long").distinct()
        windows = written(windows, "windows")
        held.append(windows)
        twice = windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
        found = found.union(windows.join(twice, ["h1", "h2"]).select("key", "content", F.col("place").alias("first"), F.col("place").alias("last")))

    words: Column = F.col("key").bitwiseAND(1) == 1
    whole_copies = segments.join(contents.where("copies > 1").select("key", "content"), ["key", "content"])
    places = whole_copies.select(*row, words.alias("words"), F.col("place").alias("first"), (F.col("place") + F.col("windows") - 1).alias("last"))
    inside = segments.join(found, ["key", "content"])
    places = places.union(inside.select(*row, words.alias("words"), (F.col("place") + F.col("first")).alias("first"), (F.col("place") + F.col("last")).alias("last")))
    places = places.groupBy(*row).agg(F.collect_list(F.struct("words", "first", "last")).alias("found"))
    return texts, places, held


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR, words: int = WORDS, hot: int = HOT) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, n_passage_words, kept_sha256) for every row of docs.

    Bytes go that are covered by repeated windows of length bytes; n_passage_words tells how many words are covered by
    runs of words words that stand in two places, whatever the gaps between them.
    """
    kinds = kinds_of(length, anchor, words)
    texts, places, _ = _repeated(_source(docs, id_col, text), kinds, hot)
    some = texts.where("keys IS NOT NULL").select("id", "mark", "text")
    cut = some.join(places, ["id", "mark"], "left").mapInArrow(_result_rows(kinds, tuple(not k.words for k in kinds), False), _RESULT)
    none = F.lit(0).cast("long")
    whole = texts.where("keys IS NULL").select(
        "id", "mark", "n_bytes", none.alias("n_removed"), none.alias("n_spans"), none.alias("n_passage_words"), F.col("sha").alias("kept_sha256"), F.lit(None).cast("string").alias("kept")
    )
    out = cut.unionByName(whole).drop("mark", "kept")
    return out.withColumn("id", F.when(F.col("id") != _NO_ID, F.col("id"))).withColumnRenamed("id", id_col)


def _stripped(docs: DataFrame, kinds: tuple[Kind, ...], id_col: str, text: str, hot: int) -> DataFrame:
    """docs without what repeated windows cover; documents of which nothing is left are dropped."""
    texts, places, _ = _repeated(_source(docs, id_col, text), kinds, hot)
    some = texts.where("keys IS NOT NULL").select("id", "mark", "text").join(places, ["id", "mark"])
    name = fresh("left", docs.columns)
    left = some.mapInArrow(_result_rows(kinds, (True,) * len(kinds), True), _RESULT).where("n_removed > 0")
    left = left.select(F.col("id").alias(f"{name}_id"), F.col("mark").alias(f"{name}_mark"), F.col("kept").alias(f"{name}_kept")).dropDuplicates([f"{name}_id", f"{name}_mark"])
    kept = F.col(f"{name}_kept")
    mine = (F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NO_ID)) == F.col(f"{name}_id")) & (F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))) == F.col(f"{name}_mark"))
    joined = docs.join(left, mine, "left").where(kept.isNull() | (kept != ""))
    return joined.select(*[F.coalesce(kept, F.col(f"`{c}`")).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def strip_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """docs with its text stripped of repeated strings of length bytes; characters cut in part go whole."""
    return _stripped(docs, kinds_of(length, anchor), id_col, text, hot)


def strip_passages(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """docs as of strip_repeats(), stripped also of all runs of so many words that stand in two places or more, whatever the gaps between the words."""
    return _stripped(docs, kinds_of(length, anchor, words), id_col, text, hot)
