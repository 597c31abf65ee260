"""Cosine similarity joins and nearest neighbours over unit vectors.

All pairs are compared unless the caller asks for an approximation: vectors are dealt into blocks, each two blocks are one
piece of work in one task, done by matrix products of a bounded size, and only pairs that pass a threshold, or a row's best k
of a block, leave it. There are GRID blocks for as long as one is no more than HELD bytes, so up to GRID * HELD bytes of vectors
(some 400,000 of 64 components) what is shuffled grows with the table; the comparisons grow with its square, as all pairs must.
Products in single precision only rule pairs out, by a margin above their error; what they leave is computed in double, one
component after the other, so a similarity doesn't depend on how the vectors were dealt, and those of equal vectors are equal.

exact=False puts vectors into cells by the sides of random hyperplanes through their mean on which they lie, in TABLES
independent ways, with as many planes as bring a cell to some CELL vectors. Every vector is in the index, and looks in its own
cell and in those across its FLIPS nearest planes. Similarities are computed on the whole vectors, so a pair that is found is
right; a pair may be missed, the rarer the more alike it is (the README has what is known of it). A cell with more than a
block of vectors is split into blocks, and whoever looks into it is sent to each. Only the mean, one number a dimension,
reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import blocks_in_time

BLOCK = 2048
GRID, HELD = 12, 16 << 20
#: Rows and columns of a matrix product; pairs whose similarity is computed at once.
ROWS, COLUMNS, PAIRS = 1024, 8192, 1 << 16
TABLES, FLIPS, CELL = 3, 4, 512
SEED = 17


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalize(v: Column) -> Column:
    """The vector over its length in double; a zero vector stays."""
    return F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))))[0]


def cosine(a: Column, b: Column) -> Column:
    """Dot product of two unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _block_pairs(df: DataFrame, block: int) -> DataFrame:
    """Rows of (id, vector) dealt to pairs of blocks: (i, j, own, id, vector), i <= j. block: the least rows of a block."""
    df = df.where(F.col("vector").isNotNull())
    n, dims = df.agg(F.count("*"), F.max(F.size("vector"))).first()
    most = HELD // (8 * max(1, dims or 0))
    blocks = max(1, -(-n // max(block, min(-(-n // GRID), most))))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    rows = df.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "vector")
    # more partitions than pairs, so that few get several pairs
    return rows.repartition(min(3 * blocks * (blocks + 1) // 2, 20_000), "i", "j").sortWithinPartitions("i", "j")


def _work(batches, emit) -> Iterator:
    """emit(table) for the rows of each pair of blocks."""
    import pyarrow as pa

    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        mark = batch["i"].to_numpy().astype(np.int64) << 32 | batch["j"].to_numpy()
        cuts = [0, *(np.flatnonzero(mark[1:] != mark[:-1]) + 1).tolist(), batch.num_rows]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if held and key != mark[s]:
                yield from emit(pa.Table.from_batches(held))
                held = []
            key = mark[s]
            held.append(batch.slice(s, e - s))
    if held:
        yield from emit(pa.Table.from_batches(held))


def _matrix(vectors) -> np.ndarray:
    """An Arrow column of lists of equal length as rows of doubles."""
    parts = vectors.chunks if hasattr(vectors, "chunks") else [vectors]
    flat = np.concatenate([np.asarray(c.flatten().to_numpy(zero_copy_only=False), np.float64) for c in parts])
    return flat.reshape(len(vectors), len(flat) // max(1, len(vectors)))


def _sides(t):
    i, j = t["i"][0].as_py(), t["j"][0].as_py()
    own, ids = t["own"].to_numpy(), t["id"].to_numpy()
    m = _matrix(t["vector"])
    left, right = own == i, own == j
    return i == j, ids[left], m[left], ids[right], m[right]


def _margin(x: np.ndarray, y: np.ndarray) -> float:
    """More than a product in single precision can be off."""
    longest = [np.sqrt(np.nan_to_num(np.einsum("nd,nd->n", m, m), posinf=0.0).max(initial=0.0)) for m in (x, y)]
    return (x.shape[1] + 4) * 1.2e-7 * max(1.0, longest[0] * longest[1])


def _similarities(x: np.ndarray, y: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Dot products of rows at of x and to of y, summed up in order of components."""
    out = np.zeros(len(at))
    for s in range(0, len(at), PAIRS):
        left, right = x[at[s : s + PAIRS]], y[to[s : s + PAIRS]]
        left *= right
        for c in range(left.shape[1]):
            out[s : s + PAIRS] += left[:, c]
    return out


def _passing(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(mask)
    return np.divmod(at, mask.shape[1])


def _top(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray, k: int, least: float, others: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(id, neighbour, similarity) of the best k of b for each of a, of least or more; others: an id isn't its own neighbour."""
    margin, x32, y32 = _margin(x, y), x.astype(np.float32), y.astype(np.float32)
    for s in range(0, len(a), ROWS):
        ids, u = a[s : s + ROWS], x[s : s + ROWS]
        floor = np.full(len(ids), least)
        row, place, value = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        r, wide = 0, ROWS
        while r < len(b):
            p = x32[s : s + ROWS] @ y32[r : r + wide].T
            if others:
                p[ids[:, None] == b[None, r : r + wide]] = -np.inf
            if not r and p.shape[1] > k:  # what can't be among the best k of the first columns
                floor = np.maximum(floor, np.partition(p, p.shape[1] - k, axis=1)[:, p.shape[1] - k] - margin)
            at, to = _passing((p >= (floor - margin).astype(np.float32)[:, None]) & np.isfinite(p))
            if len(at):
                to = to + r
                row, place, value = np.concatenate([row, at]), np.concatenate([place, to]), np.concatenate([value, _similarities(u, y, at, to)])
                order = np.lexsort((b[place], -value, row))
                row, place, value = row[order], place[order], value[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                keep = (rank < k) & (value >= least)
                row, place, value, rank = row[keep], place[keep], value[keep], rank[keep]
                floor[row[rank == k - 1]] = value[rank == k - 1]
            r, wide = r + wide, min(2 * wide, COLUMNS)
        yield ids[row], b[place], value


def _mean(df: DataFrame) -> np.ndarray:
    """The mean vector: sums of each partition, then of these."""

    def sums(batches):
        import pyarrow as pa

        total, n = 0.0, 0
        for batch in batches:
            if batch.num_rows:
                total, n = total + _matrix(batch["vector"]).sum(axis=0), n + batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()]), pa.array([n])], names=["total", "n"])

    parts = df.select("vector").mapInArrow(sums, "total array<double>, n long")
    by_place = parts.select(F.posexplode("total").alias("at", "x"), "n").groupBy("at").agg((F.sum("x") / F.sum("n")).alias("x"))
    return np.array([r["x"] for r in by_place.orderBy("at").collect()])


def _visits(df: DataFrame, n: int, block: int) -> DataFrame:
    """Rows of (id, vector) dealt to blocks of cells: (cell, part, home, id, vector), those at home in a block first."""
    df = df.where(F.col("vector").isNotNull())
    mean = _mean(df)
    bits = min(40, max(1, (max(n, 1) // CELL).bit_length()))
    flips = min(FLIPS, bits)

    def cells(batches):
        import pyarrow as pa

        planes = np.random.default_rng(SEED).standard_normal((len(mean), TABLES * bits))
        weight = np.int64(1) << np.arange(bits, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            y = ((_matrix(batch["vector"]) - mean) @ planes).reshape(-1, TABLES, bits)
            for table in range(TABLES):
                side = y[:, table]
                own = (side > 0) @ weight
                near = weight[np.argsort(np.abs(side), axis=1)[:, :flips]]
                for across in range(1 << flips):
                    cell = own.copy()
                    for f in range(flips):
                        if across >> f & 1:
                            cell ^= near[:, f]
                    yield pa.RecordBatch.from_arrays([pa.array(cell * TABLES + table), pa.array(np.full(len(cell), across == 0)), batch["id"]], names=["cell", "home", "id"])

    seen = df.select("id", "vector").mapInArrow(cells, "cell long, home boolean, id long")
    sizes = seen.where("home").groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    own = F.array(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = seen.join(sizes, "cell").select("cell", "home", "id", F.explode(F.when(F.col("home"), own).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))).alias("part"))
    # members of a split cell look into its other blocks
    others = seen.where("home").join(sizes.where("parts > 1"), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    others = others.where(F.col("part") != own[0]).select("cell", F.lit(False).alias("home"), "id", "part")
    rows = dealt.unionByName(others).join(df.select("id", "vector"), "id").select("cell", "part", "home", "id", "vector")
    return rows.repartition("cell", "part").sortWithinPartitions("cell", "part", F.desc("home"))


def _look(batches, emit, step: int) -> Iterator:
    """emit(ids, vectors, member ids, member vectors) for all that look into a block, a bounded number at a time."""
    key, held = None, []

    def members():
        if len(held) > 1:
            held[:] = [(np.concatenate([i for i, _ in held]), np.concatenate([m for _, m in held]))]
        return held[0] if held else (np.empty(0, np.int64), np.empty((0, 0)))

    def all_of(ids, m):
        to = members()
        for s in range(0, len(ids) if len(to[0]) else 0, step):
            yield from emit(ids[s : s + step], m[s : s + step], *to)

    for batch in batches:
        if not batch.num_rows:
            continue
        cell, part, home, ids = (batch[c].to_numpy(zero_copy_only=False) for c in ("cell", "part", "home", "id"))
        m = _matrix(batch["vector"])
        cuts = [0, *(np.flatnonzero((cell[1:] != cell[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), len(ids)]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if (cell[s], part[s]) != key:
                yield from all_of(*members())
                key, held = (cell[s], part[s]), []
            at_home = home[s:e]
            if at_home.any():
                held.append((ids[s:e][at_home], m[s:e][at_home]))
            if not at_home.all():
                yield from all_of(ids[s:e][~at_home], m[s:e][~at_home])
    yield from all_of(*members())


def cosine_pairs(df: DataFrame, threshold: float, block: int = BLOCK, exact: bool = True) -> DataFrame:
    """(a, b, similarity) with a < b for unit vectors (id, vector) of a similarity of threshold or more."""

    def alike(a, x, b, y, once):
        import pyarrow as pa

        margin, x32, y32 = _margin(x, y), x.astype(np.float32), y.astype(np.float32)
        for s in range(0, len(a), ROWS):
            for r in range(s // COLUMNS * COLUMNS if once else 0, len(b), COLUMNS):
                at, to = _passing(x32[s : s + ROWS] @ y32[r : r + COLUMNS].T >= np.float32(threshold - margin))
                at, to = at + s, to + r
                keep = (a[at] != b[to]) & ((at < to) | (not once))
                at, to = at[keep], to[keep]
                similarity = _similarities(x, y, at, to)
                keep = similarity >= threshold
                first, second = a[at[keep]], b[to[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(first, second)), pa.array(np.maximum(first, second)), pa.array(similarity[keep])], names=["a", "b", "similarity"])

    def emit(t):
        same, a, x, b, y = _sides(t)
        if len(a) and len(b):
            yield from alike(a, x, b, y, same)

    form = "a long, b long, similarity double"
    if exact:
        return _block_pairs(df.select("id", "vector"), block).mapInArrow(lambda batches: _work(batches, emit), form)
    found = _visits(df, df.count(), block).mapInArrow(lambda batches: _look(batches, lambda a, x, b, y: alike(a, x, b, y, False), block), form)
    return found.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def knn(df: DataFrame, k: int, block: int = BLOCK, exact: bool = True, least: float = -np.inf) -> DataFrame:
    """(id, neighbour, similarity, rank) of each vector's k most similar others; of equals the smaller id comes first.

    least: neighbours less similar than that are left out.
    """

    def nearest(a, x, b, y, others):
        import pyarrow as pa

        for found in _top(a, x, b, y, k, least, others):
            yield pa.RecordBatch.from_arrays(list(map(pa.array, found)), names=["id", "neighbour", "similarity"])

    def emit(t):
        same, a, x, b, y = _sides(t)
        if len(a) and len(b):
            yield from nearest(a, x, b, y, same)
            if not same:
                yield from nearest(b, y, a, x, False)

    form = "id long, neighbour long, similarity double"
    if exact:
        found = _block_pairs(df.select("id", "vector"), block).mapInArrow(lambda batches: _work(batches, emit), form)
    else:
        found = _visits(df, df.count(), block).mapInArrow(lambda batches: _look(batches, lambda a, x, b, y: nearest(a, x, b, y, True), block), form)
        found = found.groupBy("id", "neighbour").agg(F.max("similarity").alias("similarity"))
    order = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def close_pairs(vectors: DataFrame, times: DataFrame, window: int, within: float, block: int = BLOCK) -> DataFrame:
    """(a, b) with a < b: vectors (id, vector) whose times (id, captured_at) are at most window apart and that are alike by within.

    Times are cut into blocks in their order and blocks within reach of each other compared by a matrix product, so what
    leaves a task are pairs that pass; no pair is made of rows that share an instant and nothing else.
    """
    vectors = vectors.where(F.col("vector").isNotNull())
    timed = times.where(F.col("captured_at").isNotNull()).join(vectors.select("id"), "id", "left_semi").select("id", "captured_at")
    rows = blocks_in_time(timed, "id", "captured_at", window, block).join(vectors.select("id", "vector"), "id")

    def emit(t) -> Iterator:
        import pyarrow as pa

        same, a, x, b, y = _sides(t)
        if not (len(a) and len(b)):
            return
        own, at = t["own"].to_numpy(), t["captured_at"].to_numpy()
        near = np.abs(at[own == t["i"][0].as_py()][:, None] - at[own == t["j"][0].as_py()][None, :]) <= window
        to, of = np.nonzero((x @ y.T >= within) & near)
        first, second = a[to], b[of]
        keep = first < second if same else first != second
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(first, second)[keep]), pa.array(np.maximum(first, second)[keep])], names=["a", "b"])

    dealt = rows.select("i", "j", "own", "id", "captured_at", "vector").repartition("i", "j").sortWithinPartitions("i", "j")
    return dealt.mapInArrow(lambda batches: _work(batches, emit), "a long, b long")


def similarity_edges(vectors: DataFrame, times: DataFrame, window: int, within: float, overall: float, k: int, exact: bool = True) -> DataFrame:
    """(a, b): pairs close in time and alike by within, and each vector's k nearest that are alike by overall."""
    near = knn(vectors, k, exact=exact, least=overall)
    return close_pairs(vectors, times, window, within).union(near.select(F.least("id", "neighbour"), F.greatest("id", "neighbour"))).distinct()
