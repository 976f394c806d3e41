"""Centroid clustering of integer vectors by scalar lookup tables (operator 11).

A component becomes floor(scale * x), an integer. For the integers that occur in a dimension and for
every centroid the squared difference is tabulated once; a vector's distances are then gathers from
these tables and sums, with no product left in the inner loop. Tables are made a bounded block of
vectors at a time, so they hold what occurs in the block, whatever the range of all values.

A round is one Spark job: tasks assign their vectors and emit exact sums a cluster and dimension,
which Spark adds up; the driver holds nothing but the centroids (k * dim integers).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a block's tables at most (vectors * dimensions * centroids).
BLOCK = 1 << 22
_LONG = (-(1 << 63), (1 << 63) - 1)


def kept(vec_col: str, dim: int):
    """Whether a row's vector has ``dim`` components, none null, NaN or infinite."""
    x = F.col(vec_col).cast("array<double>")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return F.coalesce(F.col(vec_col).isNotNull() & (F.size(x) == dim) & fine, F.lit(False))


def integers(batch: pa.RecordBatch, column: int, dim: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the batch whose vector is kept, and their components as 64-bit integers (cut to that range)."""
    col = batch.column(column).cast(pa.list_(pa.float64()))
    offs = np.asarray(col.offsets)
    rows = np.flatnonzero((offs[1:] - offs[:-1] == dim) & np.asarray(col.is_valid()))
    flat = np.asarray(col.values.fill_null(float("nan")), float)
    x = flat[offs[rows][:, None] + np.arange(dim)] if len(rows) else np.zeros((0, dim))
    fine = np.isfinite(x).all(1)
    with np.errstate(over="ignore"):
        v = np.floor(scale * x[fine])
    out = np.where(v >= 2.0**63, _LONG[1], np.where(v < -(2.0**63), _LONG[0], 0))
    inside = (v >= -(2.0**63)) & (v < 2.0**63)
    out[inside] = v[inside].astype(np.int64)
    return rows[fine], out


def tables(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared differences to every centroid for each dimension's occurring values, and each component's row in them."""
    n, dim = v.shape
    low, high = v.min(0), v.max(0)
    span = [int(b) - int(a) + 1 for a, b in zip(low.tolist(), high.tolist(), strict=True)]
    if sum(span) <= 4 * v.size + 1024:  # narrow ranges: mark what occurs
        start = np.concatenate([[0], np.cumsum(span)])
        at = v - low + start[:-1]
        occurs = np.zeros(start[-1], bool)
        occurs[at.ravel()] = True
        found = np.flatnonzero(occurs)
        dims = np.searchsorted(start, found, "right") - 1
        values = found - start[dims] + low[dims]
        at = (np.cumsum(occurs) - 1)[at]
    else:
        each = [np.unique(v[:, d], return_inverse=True) for d in range(dim)]
        start = np.concatenate([[0], np.cumsum([len(u) for u, _ in each])])
        values = np.concatenate([u for u, _ in each])
        dims = np.repeat(np.arange(dim), np.diff(start))
        at = np.stack([i.ravel() for _, i in each], 1) + start[:-1]
    largest = max(abs(int(x)) for x in (*low.tolist(), *high.tolist(), int(centroids.max()), int(centroids.min())))
    if (2 * largest) ** 2 * dim >= 1 << 63:  # beyond 64 bits: the same with Python integers
        values, centroids = values.astype(object), centroids.astype(object)
    return (values[:, None] - centroids.T[dims]) ** 2, at


def nearest(v: np.ndarray, centroids: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Block by block: its rows, each one's nearest centroid (ties: the smaller number) and squared distance."""
    k, dim = centroids.shape
    step = max(1, BLOCK // (k * max(dim, 1)))
    for i in range(0, len(v), step):
        part = v[i : i + step]
        table, at = tables(part, centroids)
        d = table[at[:, 0]]
        for j in range(1, dim):
            d += table[at[:, j]]
        best = np.argmin(d, 1) if d.dtype != object else np.array([min(range(k), key=row.__getitem__) for row in d.tolist()], np.int64)
        yield slice(i, i + len(part)), best, d[np.arange(len(part)), best]


def _sums(vectors: DataFrame, centroids: np.ndarray, vec_col: str, scale: float) -> dict[tuple[int, int], int]:
    """By (cluster, dimension) the exact sums of components; at dimension -1 the vectors, at -2 their distances."""
    k, dim = centroids.shape

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dim + 2), object)
        for b in batches:
            _, v = integers(b, 0, dim, scale)
            for rows, best, d in nearest(v, centroids):
                small = int(np.abs(v[rows]).max(initial=0)) < 1 << 40
                for c in np.unique(best).tolist():
                    mine = best == c
                    x = v[rows][mine]
                    total[c, :dim] += (x if small else x.astype(object)).sum(0).astype(object)
                    total[c, dim] += int(mine.sum())
                    total[c, dim + 1] += sum(d[mine].tolist())
        c, i = np.nonzero(total)
        named = np.where(i < dim, i, dim - 1 - i)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(named, pa.int32()), pa.array([str(total[a, b]) for a, b in zip(c, i, strict=True)], pa.string())], ["cluster", "dimension", "total"])

    parts = vectors.select(F.col(vec_col)).mapInArrow(partial, "cluster int, dimension int, total string")
    found = parts.groupBy("cluster", "dimension").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    return {(r["cluster"], r["dimension"]): int(r["total"]) for r in found}


def fit_centroids(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: float = 64, seed: int = 1, id_col: str = "vec_id", vec_col: str = "embedding") -> np.ndarray:
    """``k`` centroids after ``rounds`` rounds, as integers; fewer where there are fewer vectors.

    They start as the kept vectors of smallest sha256 of ``seed:id``, in that order (of rows that repeat
    an id the smaller vector goes first; rows without id start none). A round assigns every vector to
    its nearest centroid and replaces each centroid that has vectors by the floor of their mean.
    """
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)
    first = vectors.where(kept(vec_col, dim) & F.col(id_col).isNotNull()).select(key.alias("k"), F.col(vec_col).cast("array<double>").alias("v")).orderBy("k", "v").limit(k)
    start = pa.array([r["v"] for r in first.collect()], pa.list_(pa.float64()))
    _, centroids = integers(pa.RecordBatch.from_arrays([start], ["v"]), 0, dim, scale)
    for _ in range(rounds if len(centroids) else 0):
        found = _sums(vectors, centroids, vec_col, scale)
        for c in range(len(centroids)):
            if n := found.get((c, -1)):
                centroids[c] = [found.get((c, i), 0) // n for i in range(dim)]
    return centroids


def assign(vectors: DataFrame, centroids: np.ndarray, scale: float = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id, cluster, distance, cluster_inertia, inertia, centroid`` of every kept vector, the id under its own name.

    Inertia is the distance summed, exactly, over the cluster and over all. Distances and sums beyond 64
    bits are cut to its range. Rows that repeat an id are vectors of their own; other columns are ignored.
    """
    k, dim = centroids.shape
    kind = vectors.select(F.col(id_col)).schema[0].dataType
    schema = f"`{id_col}` {kind.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
    found = _sums(vectors, centroids, vec_col, scale) if k else {}
    own = [found.get((c, -2), 0) for c in range(k)]
    cap = lambda x: min(x, _LONG[1])
    inertia, whole = np.array([cap(x) for x in own], np.int64), cap(sum(own))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, v = integers(b, 1, dim, scale)
            ids = b.column(0).take(pa.array(rows))
            for at, best, d in nearest(v, centroids):
                far = pa.array([cap(x) for x in d.tolist()], pa.int64())
                centre = pa.array(centroids[best].tolist(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([ids[at.start : at.stop], pa.array(best, pa.int32()), far, pa.array(inertia[best]), pa.array(np.full(len(best), whole)), centre], [id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid"])

    rows = vectors.select(F.col(id_col), F.col(vec_col))
    return (rows if k else rows.limit(0)).mapInArrow(run, schema)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: float = 64, seed: int = 1, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Vectors with their cluster after ``rounds`` rounds and one more assignment; see ``fit_centroids`` and ``assign``.

    Vectors that are null, of another length, or hold null, NaN or infinite components take no part. An
    empty table, or one with no vector kept, gives no rows.
    """
    return assign(vectors, fit_centroids(vectors, k, rounds, dim, scale, seed, id_col, vec_col), scale, id_col, vec_col)


def centroid_hash(centroid: np.ndarray) -> str:
    """sha256 of a centroid's components as decimal integers joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()
