"""Centroid clustering by Lloyd's rounds over integer vectors, distances screened by norms of segments.

A vector of doubles becomes floor(scale * x) in each component. It is stored with its compressed form: the norms of its
segments of SEGMENT components. For a vector x and a centroid c with segment norms X and C, Cauchy and Schwarz give, segment
by segment, x.c <= X.C, so |x - c|^2 >= |x|^2 + |c|^2 - 2 X.C. A round computes this bound for all centroids by one small
matrix product, the exact integer distance to the centroid of the smallest bound, and then exact distances only where the
bound, less a margin above any rounding of doubles, doesn't exceed the smallest distance found so far. So no centroid that
could be nearest, or as near with a smaller number, is screened out; the result is that of all distances.

Norms are taken about an origin, a whole vector near the mean of the centroids, as the bound is the tighter the more of a
vector's length is its own. Distances don't depend on it.

Each task sums its own vectors by cluster, so a round sends at most k rows a task; the driver holds k centroids.

Edge cases: rows whose vector is null, of another length, or holds a null or a value that isn't finite are left out. With
fewer than k vectors there are as many clusters; with none the result is empty. Rows of one id are rows like others; of equal
hashes the vector that is smaller component by component is a centroid first; a row without id has the hash of `seed:null`
and is returned with a null id. Equal vectors stay apart as centroids: the smaller number takes all that are as near, and the
other stays empty where it is. A component beyond +-2^26 after scaling is an error, as distances then don't fit into a long.
Other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import written

SEGMENT = 8
#: Distances of 2^10 components of this size fit into a long.
WIDEST = 1 << 26
#: Vectors looked at together: bounds for them and all centroids are in memory at once.
STEP = 4096


def _lists(column) -> np.ndarray:
    """A list column of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def segment_norms(m: np.ndarray, origin: np.ndarray) -> np.ndarray:
    """Norms of the segments of each row about an origin; a last segment may be shorter."""
    d = (m - origin).astype(np.float64)
    starts = np.arange(0, m.shape[1], SEGMENT)
    return np.sqrt(np.add.reduceat(d * d, starts, axis=1))


def nearest(m: np.ndarray, norms: np.ndarray, centroids: np.ndarray, origin: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, squared distance, how many exact distances it took) for rows of int64 vectors."""
    mine = segment_norms(centroids, origin)
    a, b = (norms * norms).sum(axis=1), (mine * mine).sum(axis=1)
    least = a[:, None] + b[None, :] - 2.0 * (norms @ mine.T)
    # above what sums and products of doubles can be off by
    least -= 1e-9 * (a[:, None] + b[None, :]) + 1e-6
    rows = np.arange(len(m))

    def exact(some: np.ndarray, to: np.ndarray) -> np.ndarray:
        d = m[some] - centroids[to]
        return np.einsum("ij,ij->i", d, d)

    best = least.argmin(axis=1)
    distance = exact(rows, best)
    first, made = best.copy(), len(m)
    for j in range(len(centroids)):
        some = np.flatnonzero((least[:, j] <= distance) & (first != j))
        if len(some):
            d, made = exact(some, np.full(len(some), j)), made + len(some)
            closer = (d < distance[some]) | ((d == distance[some]) & (j < best[some]))
            at = some[closer]
            best[at], distance[at] = j, d[closer]
    return best, distance, made


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = 64, scale: int = 64) -> DataFrame:
    """(id, vector) of the rows that hold size finite components, each floor(scale * x) as an int."""
    whole = vectors.where(F.size(vector_col) == size).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                m = _lists(batch["vector"]).astype(np.float64)  # nulls become nan
                fine = np.isfinite(m).all(axis=1)
                m = np.floor(m[fine] * scale)
                if m.size and np.abs(m).max() > WIDEST:
                    raise ValueError(f"a component beyond {WIDEST} after scaling: its distances don't fit into a long")
                flat, ends = pa.array(m.astype(np.int32).ravel()), np.arange(0, m.size + 1, size, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([batch["id"].filter(pa.array(fine)), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["id", "vector"])

    return whole.mapInArrow(run, f"id {vectors.schema[id_col].dataType.simpleString()}, vector array<int>")


def first_centroids(whole: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes; k rows reach the driver."""
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256)
    rows = whole.select(key.alias("key"), "vector").orderBy("key", "vector").limit(k).collect()
    return np.array([r["vector"] for r in rows], np.int64)


def compressed(whole: DataFrame, origin: np.ndarray) -> DataFrame:
    """(id, vector, norms), written once for all rounds."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                norms = segment_norms(_lists(batch["vector"]).astype(np.int64), origin)
                ends = np.arange(0, norms.size + 1, norms.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([batch["id"], batch["vector"], pa.ListArray.from_arrays(pa.array(ends), pa.array(norms.ravel()))], names=["id", "vector", "norms"])

    kind = whole.schema["id"].dataType.simpleString()
    return written(whole.mapInArrow(run, f"id {kind}, vector array<int>, norms array<double>"), "vectors")


def _steps(batches) -> Iterator:
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            part = batch.slice(at, STEP)
            yield part, _lists(part["vector"]).astype(np.int64), _lists(part["norms"])


def moved(stored: DataFrame, centroids: np.ndarray, origin: np.ndarray) -> np.ndarray:
    """The centroids after one round: the exact floor of each cluster's mean; those of empty clusters stay."""
    k, size = centroids.shape

    def run(batches) -> Iterator:
        import pyarrow as pa

        total, n = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for _, m, norms in _steps(batches):
            best = nearest(m, norms, centroids, origin)[0]
            order = np.argsort(best, kind="stable")
            found, starts = np.unique(best[order], return_index=True)
            total[found] += np.add.reduceat(m[order], starts, axis=0)
            n[found] += np.bincount(best, minlength=k)[found]
        used = np.flatnonzero(n)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    parts = stored.mapInArrow(run, "cluster long, n long, total array<long>")
    sums = parts.select("cluster", "n", F.posexplode("total").alias("at", "x")).groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in sums.collect():  # k times size numbers
        out[r["cluster"], r["at"]] = int(r["x"]) // r["n"]
    return out


def assigned(stored: DataFrame, centroids: np.ndarray, origin: np.ndarray) -> DataFrame:
    """(id, cluster, distance, n_exact) of every vector; n_exact: exact distances that its batch took, for a vector."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for part, m, norms in _steps(batches):
            best, distance, made = nearest(m, norms, centroids, origin)
            yield pa.RecordBatch.from_arrays([part["id"], pa.array(best.astype(np.int32)), pa.array(distance), pa.array(np.full(len(m), made / len(m)))], names=["id", "cluster", "distance", "n_exact"])

    kind = stored.schema["id"].dataType.simpleString()
    return stored.mapInArrow(run, f"id {kind}, cluster int, distance long, n_exact double")


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding", size: int = 64, scale: int = 64) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance, n_exact), final centroids): rounds of assigning and moving, then assigned once more."""
    whole = integer_vectors(vectors, id_col, vector_col, size, scale)
    centroids = first_centroids(whole, k, seed)
    if not len(centroids):
        kind = whole.schema["id"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"id {kind}, cluster int, distance long, n_exact double"), centroids
    origin = centroids.sum(axis=0) // len(centroids)
    stored = compressed(whole, origin)
    for _ in range(rounds):
        centroids = moved(stored, centroids, origin)
    return assigned(stored, centroids, origin), centroids


def digest(vectors: DataFrame, id_col: str = "vec_id", **options) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector."""
    found, centroids = cluster(vectors, id_col=id_col, **options)
    found = written(found.drop("n_exact"), "assigned")
    sums = {r["cluster"]: int(r["x"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("x")).collect()}  # k rows
    rows = [(j, sums.get(j, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(centroids)]
    by = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(by), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
