"""Near-duplicate documents by SetSketch registers.

A document's set of word shingles is summed up by m registers, each the exponentially spaced, truncated minimum of one
hash over the set. Registers are mergeable (maximum) and locality-sensitive: they are equal with a probability of about
the Jaccard similarity. Bands of registers give candidate buckets; the similarity of a candidate pair is estimated by
likelihood from how many registers are greater, smaller and equal, given both set sizes; every link is confirmed on the
full sets.

Whole results without pairs of whole groups:
* documents with equal sets are one class, found by an aggregation; only one text of a class goes on;
* each bucket first links its members to its smallest id. What those links join needs no further pair;
* members of a bucket that are still in different components are compared on their full sets over an inverted index,
  in blocks of bounded size, and only links that join components leave the block.

48 bands of 5 among 128 registers miss a pair of similarity 0.8 with a probability of about 5e-9.

Null, empty and wordless texts have empty sets and are linked with nothing; a null id has no component. One row comes
out for each row that goes in, repeated rows included. Ids must name one text each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gallerist.operators.graph import connected_components

from ._common import drop_written, fresh, join_counted, written
from .shingles import lowered, mix, shingle_sets


@dataclass(frozen=True)
class Sketch:
    registers: int = 128
    base: float = 1.02
    top: int = 2046  # registers hold 0 to top + 1
    bands: int = 48
    rows: int = 5
    seed: int = 11

    def _odd(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        a = rng.integers(0, 1 << 63, self.registers, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
        return a, rng.integers(0, 1 << 63, self.registers, dtype=np.uint64)

    def of_sets(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """(sets, registers) uint16; an empty set has zeros."""
        out = np.zeros((len(counts), self.registers), np.uint16)
        some = np.flatnonzero(counts)
        if not len(some):
            return out
        firsts = (np.cumsum(counts) - counts)[some]
        least = np.empty((self.registers, len(some)), np.uint64)
        for i, (a, b) in enumerate(zip(*self._odd(), strict=True)):
            h = hashes * a
            h += b
            h ^= h >> np.uint64(32)
            least[i] = np.minimum.reduceat(h, firsts)
        uniform = (least.astype(np.float64) + 1.0) / 2.0**64
        exponential = -np.log1p(-np.minimum(uniform, 1 - 1e-12))
        level = np.floor(1.0 - np.log(exponential) / np.log(self.base))
        out[some] = np.clip(level, 0, self.top + 1).T.astype(np.uint16)
        return out

    def band_keys(self, sketches: np.ndarray) -> np.ndarray:
        """(sets, bands) uint64: a hash of the registers each band names."""
        rng = np.random.default_rng(self.seed + 1)
        out = np.empty((len(sketches), self.bands), np.uint64)
        for j in range(self.bands):
            key = np.full(len(sketches), j + 1, np.uint64)
            for k in rng.choice(self.registers, self.rows, replace=False):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sketches[:, k])
            out[:, j] = key
        return out

    def likely_jaccard(self, more: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        """The similarity that is likeliest, if more registers of a are greater and less are smaller than b's."""
        u, equal = n_a / (n_a + n_b), self.registers - more - less
        v = 1.0 - u
        p = lambda x: -np.log1p(-np.clip(x, 1e-9, 1.0) * (self.base - 1) / self.base) / np.log(self.base)

        def likelihood(j: np.ndarray) -> np.ndarray:
            a, b = p(u - v * j), p(v - u * j)
            return more * np.log(a) + less * np.log(b) + equal * np.log(np.maximum(1.0 - a - b, 1e-12))

        low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
        for _ in range(40):  # golden section on a concave function
            third = (high - low) * 0.381966
            x, y = low + third, high - third
            worse = likelihood(x) < likelihood(y)
            low, high = np.where(worse, x, low), np.where(worse, high, y)
        return (low + high) / 2


def _sketch_rows(docs: DataFrame, id_col: str, text: str, width: int, sketch: Sketch) -> DataFrame:
    def run(batches) -> Iterator:
        import pyarrow as pa
        import xxhash

        for batch in batches:
            texts = [lowered(x) for x in batch.column("text").to_pylist()]
            start = 0
            while start < len(texts):
                end, size = start, 0
                while end < len(texts) and size < 1_500_000:
                    size += len(texts[end])
                    end += 1
                hashes, counts = shingle_sets(texts[start:end], width)
                rows = sketch.of_sets(hashes, counts)
                ends = np.cumsum(counts)
                digests = [xxhash.xxh3_128_digest(hashes[e - c : e].tobytes()) if c else None for c, e in zip(counts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(start, end - start), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array([r.tobytes() for r in rows], pa.binary())],
                    names=["id", "n_shingles", "class", "sketch"],
                )
                start = end

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    return source.mapInArrow(run, "id long, n_shingles long, class binary, sketch binary")


def _buckets(reps: DataFrame, sketch: Sketch) -> DataFrame:
    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            raw = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(-1, sketch.registers)
            keys = sketch.band_keys(raw).view(np.int64)
            offsets = pa.array(np.arange(0, keys.size + 1, sketch.bands, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))], names=["id", "keys"])

    return reps.select("id", "sketch").mapInArrow(run, "id long, keys array<long>").select("id", F.explode("keys").alias("key"))


def _likely(pairs: DataFrame, reps: DataFrame, sketch: Sketch, least: float) -> DataFrame:
    """The pairs (a, b) whose registers allow a similarity of least or more."""
    side = lambda s: reps.select(F.col("id").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(f"sketch_{s}").to_pylist()), np.uint16).reshape(-1, sketch.registers) for s in "ab")
            n = [batch.column(f"n_{s}").to_numpy().astype(float) for s in "ab"]
            found = sketch.likely_jaccard((x > y).sum(axis=1), (x < y).sum(axis=1), *n) >= least
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(found)), batch.column("b").filter(pa.array(found))], names=["a", "b"])

    return both.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked on their full sets."""
    side = lambda s: texts.select(F.col("id").alias(s), F.col("text").alias(f"text_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                sides = {}
                for s in "ab":
                    ids = batch.column(s).to_pylist()
                    once = dict(zip(ids, batch.column(f"text_{s}").to_pylist(), strict=True))
                    hashes, counts = shingle_sets([lowered(t) for t in once.values()], width)
                    ends = np.cumsum(counts)
                    sets = {k: hashes[e - c : e] for k, c, e in zip(once, counts.tolist(), ends.tolist(), strict=True)}
                    sides[s] = [sets[i] for i in ids]
                linked = []
                for x, y in zip(sides["a"], sides["b"], strict=True):
                    low, high = sorted((len(x), len(y)))
                    shared = 0
                    if low and low * 100 >= percent * high:
                        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                        shared = int((y[at] == x).sum())
                    linked.append(shared > 0 and 100 * shared >= percent * (len(x) + len(y) - shared))
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(linked)), batch.column("b").filter(pa.array(linked))], names=["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


BLOCK = 1024


def spanning_links(ids: np.ndarray, components: np.ndarray, hashes: np.ndarray, counts: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join the components as all links among the sets would; sets: hashes, counts of them for each id.

    The shared shingles of one set with all others are counted over an inverted index. Sets go in order of how common
    their shingles are, so the middle of a group comes first. One component is the main one from the start on: the
    largest, or of those as large the one met first. It only grows, and a set that is in it by its turn is passed over,
    as each set that is outside by its own turn meets all sets then.
    """
    owner = np.repeat(np.arange(len(ids)), counts)
    _, term, common = np.unique(hashes, return_inverse=True, return_counts=True)
    by_term = np.argsort(term, kind="stable")
    posting = owner[by_term]
    begin = np.cumsum(common) - common
    ends = np.cumsum(counts)
    popularity = np.add.reduceat(common[term], ends - counts) / counts
    _, group = np.unique(components, return_inverse=True)
    sizes = np.bincount(group)
    links, first = [], True
    turns = np.argsort(-popularity, kind="stable")
    main = group[turns[sizes[group[turns]].argmax()]]
    for k in turns.tolist():
        if sizes[main] == len(ids):
            break
        if not first and group[k] == main:
            continue
        first = False
        terms = term[ends[k] - counts[k] : ends[k]]
        n = common[terms]
        stop = np.cumsum(n)
        at = np.repeat(begin[terms] - stop + n, n) + np.arange(int(stop[-1]))
        shared = np.bincount(posting[at], minlength=len(ids))
        for o in np.flatnonzero((100 * shared >= percent * (counts + counts[k] - shared)) & (group != group[k])).tolist():
            if group[o] != group[k]:
                links.append((int(ids[k]), int(ids[o])))
                gone = group[o]
                main = group[k] if gone == main else main
                sizes[group[k]] += sizes[gone]
                sizes[gone] = 0
                group[group == gone] = group[k]
    return links


def _across(buckets: DataFrame, labels: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) that join the components within each bucket as all its links would.

    Buckets with the same members are looked at once. One of more than BLOCK members is dealt into blocks, and each two
    blocks are one piece of work.
    """
    tagged = buckets.join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    members = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(3), "id")).alias("x2")]
    open_keys = tagged.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), *members).where("x <> y")
    open_keys = open_keys.groupBy("n", "x1", "x2").agg(F.min("key").alias("key"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = tagged.join(open_keys.select("key", blocks.alias("blocks")), "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("own")))
    rows = rows.withColumn("other", F.explode(others))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "component")
    rows = rows.join(texts.select("id", "text"), "id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def links(t) -> list[tuple[int, int]]:
        hashes, counts = shingle_sets([lowered(x) for x in t["text"].to_pylist()], width)
        return spanning_links(t["id"].to_numpy(), t["component"].to_numpy(), hashes, counts, percent)

    def run(batches) -> Iterator:
        import pyarrow as pa

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            if held is not None:
                t = pa.concat_tables([held, t]).combine_chunks()
            mark = np.stack([t[c].to_numpy().astype(np.int64) for c in ("key", "i", "j")])
            cuts = [0, *(np.flatnonzero((mark[:, 1:] != mark[:, :-1]).any(axis=0)) + 1).tolist(), t.num_rows]
            found = [x for s, e in zip(cuts[:-2], cuts[1:-1], strict=True) for x in links(t.slice(s, e - s))]
            held = t.slice(cuts[-2])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])
        found = links(held) if held is not None else []
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, sketch: Sketch = Sketch()
) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row of docs."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    rows = written(_sketch_rows(docs, id_col, text, width, sketch), "sketches")
    classes = rows.where("class IS NOT NULL AND id IS NOT NULL").groupBy("class").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    classes = written(classes, "classes")
    reps = written(rows.where("class IS NOT NULL").join(classes.select(F.col("rep").alias("id"), "class"), ["id", "class"]).dropDuplicates(["id"]).select("id", "n_shingles", "sketch"), "reps")

    every = _buckets(reps, sketch)
    shared = every.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead <> last").select("key", "lead")
    buckets = written(every.join(shared, "key"), "buckets")
    needed = buckets.select("id").distinct()
    texts = written(source.join(needed, "id").dropDuplicates(["id"]), "texts")

    floor = percent / 100 - 6 * (percent / 100 * (1 - percent / 100) / sketch.registers) ** 0.5
    pairs = written(buckets.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    edges = written(_confirmed(_likely(pairs, reps, sketch, floor), texts, width, percent), "links")
    labels = connected_components(edges)
    more = written(_across(buckets.select("key", "id"), labels, texts, width, percent), "links")
    if more.limit(1).count():
        labels = connected_components(edges.union(more))
    members = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("class", "n", F.coalesce("component", "rep").alias("component"))
    known = F.col("class").isNotNull() & F.col("id").isNotNull()
    out = join_counted(rows.where(known), members, ["class"]).select("id", "n_shingles", "component")
    out = out.unionByName(rows.where(~known).select("id", "n_shingles", F.col("id").alias("component")))
    out = out.select(F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"))
    for df in (texts, buckets, pairs):
        drop_written(df)
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose id is the smallest of its component, with the columns of docs; a null id is kept."""
    name = fresh("gone", docs.columns)
    gone = near_duplicates(docs, id_col, text, width, percent).where("NOT kept").select(F.col(id_col).alias(name)).where(F.col(name).isNotNull()).distinct()
    return docs.join(gone, F.col(f"`{id_col}`").cast("long") == F.col(name), "left_anti")
