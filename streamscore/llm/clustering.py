"""Clustering of integer vectors around centroids, found by progressive Walsh-Hadamard search.

Vectors and centroids go through the same exact integer transform, whose coefficients are
in the order of sign changes, coarse to fine. Squared differences of coefficients add up
to 64 times the squared distance, so what has been added up so far never exceeds it. At
every level the centroid that leads is measured in full, and those whose sum is already
strictly larger fall away; the rest go on to twice as many coefficients. Whoever is left
after all 64 has its exact distance, so ties are decided by number.

The transformed vectors are written once. A round is one pass over them in Arrow batches:
a task sends one sum per cluster and component, so what meets on the driver has the size
of the centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamscore.sources.storage import stored

WIDTH = 64
SCALE = 256
CLUSTERS = 40
ROUNDS = 5
SEED = 2
#: Integer components stay below this, so that sums of 64 squared differences fit 64 bits.
LARGEST = 1 << 21
#: Vectors compared with all centroids at a time.
BLOCK = 4096
LEVELS = [(0, 1), (1, 2), (2, 4), (4, 8), (8, 16), (16, 32), (32, 64)]


def _sequency(width: int = WIDTH) -> np.ndarray:
    """Rows of the Hadamard matrix by their number of sign changes."""
    rows = np.arange(width)
    signs = np.array([[(a & b).bit_count() & 1 for b in range(width)] for a in range(width)])
    changes = (signs[:, 1:] != signs[:, :-1]).sum(axis=1)
    return rows[np.argsort(changes)]


ORDER = _sequency()


def transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of each row, coarse to fine; 64 times the energy."""
    out = x.astype(np.int64)
    half = 1
    while half < WIDTH:
        pairs = out.reshape(-1, WIDTH // (2 * half), 2, half)
        a, b = pairs[:, :, 0], pairs[:, :, 1]
        out = np.stack([a + b, a - b], axis=2).reshape(-1, WIDTH)
        half *= 2
    return out[:, ORDER]


def inverse(x: np.ndarray) -> np.ndarray:
    """The rows whose coefficients are `x`."""
    plain = np.empty_like(x)
    plain[:, ORDER] = x
    back = np.empty_like(x)
    back[:, ORDER] = transform(plain)
    return back // WIDTH


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and 64-fold squared distance of the nearest centroid, both sides transformed."""
    n, k = len(x), len(centroids)
    row, col = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    total, bound = np.zeros(n * k, np.int64), np.full(n, np.iinfo(np.int64).max)
    for low, high in LEVELS:
        apart = x[row, low:high] - centroids[col, low:high]
        total += np.einsum("ij,ij->i", apart, apart)
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        least = np.minimum.reduceat(total, starts)
        if high < WIDTH:
            ahead = np.flatnonzero(total == np.repeat(least, np.diff(np.r_[starts, len(row)])))
            ahead = ahead[np.unique(row[ahead], return_index=True)[1]]
            rest = x[row[ahead], high:] - centroids[col[ahead], high:]
            bound = np.minimum(bound, total[ahead] + np.einsum("ij,ij->i", rest, rest))
            alive = total <= bound[row]
            row, col, total = row[alive], col[alive], total[alive]
    best = np.flatnonzero(total == np.repeat(least, np.diff(np.r_[starts, len(row)])))
    best = best[np.unique(row[best], return_index=True)[1]]
    return col[best], total[best]


def _rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, WIDTH)


def _binary(x: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in np.ascontiguousarray(x, np.int64)], pa.binary())


def _prepared(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
        whole = np.floor(SCALE * values.astype(np.float64)).reshape(-1, WIDTH)
        if np.abs(whole).max() >= LARGEST:
            raise ValueError(f"components must be below {LARGEST // SCALE} in size")
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), _binary(transform(whole))], names=["vec_id", "coefficients"]
        )


def prepared(vectors: DataFrame) -> DataFrame:
    """vec_id and coefficients of the vectors with 64 components, none null or non-finite."""
    value = F.col("embedding")
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.filter((F.size(value) == WIDTH) & finite)
    kept = kept.select(F.col("vec_id").cast("long"), value.cast("array<double>").alias("embedding"))
    return kept.mapInArrow(_prepared, "vec_id long, coefficients binary")


def _blocks(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            yield batch.slice(start, BLOCK)


def _sums(batches, centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    sums = np.zeros(centroids.shape, np.int64)
    counts = np.zeros(len(centroids), np.int64)
    for batch in _blocks(batches):
        x = _rows(batch.column("coefficients"))
        cluster, _ = nearest(x, centroids)
        order = np.argsort(cluster, kind="stable")
        there, starts = np.unique(cluster[order], return_index=True)
        sums[there] += np.add.reduceat(x[order], starts, axis=0)
        counts += np.bincount(cluster, minlength=len(centroids))
    full = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.repeat(full, WIDTH)),
            pa.array(np.tile(np.arange(WIDTH), len(full))),
            pa.array(sums[full].ravel()),
            pa.array(np.repeat(counts[full], WIDTH)),
        ],
        names=["cluster", "place", "total", "n"],
    )


def _assigned(batches, centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in _blocks(batches):
        cluster, distance = nearest(_rows(batch.column("coefficients")), centroids)
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance // WIDTH)],
            names=["vec_id", "cluster", "distance"],
        )


def first_centroids(points: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """Coefficients of the points with the smallest hashes; points without an id come last."""
    by_hash = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = points.orderBy(by_hash.asc_nulls_last(), "coefficients").limit(clusters).collect()
    return np.frombuffer(b"".join(bytes(r.coefficients) for r in first), np.int64).reshape(-1, WIDTH)


def moved(points: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round; those without vectors stay."""
    parts = points.mapInArrow(
        partial(_sums, centroids=centroids), "cluster long, place long, total long, n long"
    )
    sums = parts.groupBy("cluster", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    totals, counts = np.zeros(centroids.shape, np.int64), np.ones(len(centroids), np.int64)
    for row in sums.collect():  # a row per centroid and component
        totals[row.cluster, row.place] = row.total
        counts[row.cluster] = row.n
    full = np.unique(np.flatnonzero(totals.any(axis=1) | (counts > 1)))
    centroids = centroids.copy()
    centroids[full] = transform(inverse(totals[full]) // counts[full, None])
    return centroids


def cluster(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector.

    Vectors that have not exactly 64 components or hold a null or non-finite one are left out. Equal
    ids and equal vectors are rows of their own; a null vec_id is never among the first centroids
    unless too few others are left. Fewer vectors than clusters give as many clusters as vectors, an
    empty table no rows. Other columns are ignored. Components of 8192 or more raise an error, as
    distances would not fit 64 bits.
    """
    spark = vectors.sparkSession
    points = stored(prepared(vectors), "vectors")
    centroids = first_centroids(points, clusters, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(points, centroids)
    found = stored(
        points.mapInArrow(
            partial(_assigned, centroids=centroids), "vec_id long, cluster int, distance long"
        ),
        "clusters",
    )
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in inverse(centroids).tolist()]
    names = spark.createDataFrame(list(enumerate(hashes)), "cluster int, centroid_sha256 string")
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = found.agg(F.sum("distance").alias("inertia"))
    # One row per centroid, at most `clusters`.
    stats = sums.join(F.broadcast(names), "cluster").crossJoin(F.broadcast(whole))
    return found.join(F.broadcast(stats), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
