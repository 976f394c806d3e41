"""Exact top-k inner-product search by pivot-table elimination (operator 1).

Integer vectors are lifted by one coordinate so that the largest inner product is the smallest
Euclidean distance: |q - x|^2 + M - |x|^2 = |q|^2 + M - 2 q.x with M at least every |x|^2. A table
holds each candidate's distances to many pivots; max over pivots of |d(q, p) - d(x, p)| bounds
d(q, x) from below. A query evaluates candidates in the order of their bounds and stops as soon as
the next bound is beyond its k-th best distance.

Candidates are dealt to blocks by a hash of their id, and so are the queries. A task takes one
block of each, picks pivots from its candidates, and returns each query's k best of the block;
these meet in a window per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PIVOTS = 32
#: Rows of a candidate block and of a query block, the unit of work of a task.
CANDIDATES, QUERIES = 16384, 4096
#: Rows of a block from which its pivots are picked.
PIVOT_SAMPLE = 2048


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """``id, v, dim`` with components floor(scale * x); rows that are null or hold null, NaN or infinite components are left out."""
    x = F.col(vec_col).cast("array<double>")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).where(fine)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e * F.lit(float(scale)))).alias("v"), F.size(x).alias("dim"))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Far-apart rows of the sample: each pivot is the row farthest from those chosen before it."""
    n = min(n, len(sample))
    if not n:
        return sample
    far = ((sample - sample.mean(0)) ** 2).sum(1)
    chosen = []
    for _ in range(n):
        chosen.append(int(np.argmax(far)))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1)) if len(chosen) > 1 else ((sample - sample[chosen[-1]]) ** 2).sum(1)
    return sample[chosen]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0))


def _best(scores: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest scores and their rows, ties to the smaller row."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
        scores, rows = scores[some], rows[some]
    keep = np.lexsort((rows, -scores))[:k]
    return scores[keep], rows[keep]


def _best_big(x: np.ndarray, q: np.ndarray, rows: np.ndarray, k: int) -> tuple[list[int], list[int]]:
    """The same by Python integers, for products that floats cannot hold."""
    q = [int(v) for v in q.tolist()]
    found = sorted((-sum(int(a) * b for a, b in zip(x[r].tolist(), q, strict=True)), int(r)) for r in rows)[:k]
    return [-s for s, _ in found], [r for _, r in found]


def search_block(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, pivots: np.ndarray, k: int, batch: int = 32, step: int = 128) -> tuple[np.ndarray, np.ndarray, list[int], int]:
    """The k best candidates of each query (query row, candidate row, score), and how many candidates were evaluated.

    ``q``, ``x`` and ``pivots`` hold integers as floats. Each query evaluates candidates in the order
    of their bounds, ``step`` at first and twice as many each time, and stops once the next bound is
    beyond its k-th best. What a batch of queries evaluates at a time is one matrix product. Scores
    are exact. Ties go to the smaller id. Candidates of the query's id are left out.
    """
    order = np.argsort(xid, kind="stable")
    x, xid = np.ascontiguousarray(x[order]), xid[order]
    big = max(np.abs(q).max(initial=0), np.abs(x).max(initial=0), 1.0)
    exact = big * big * max(x.shape[1], 1) < 2.0**52
    norm = (x * x).sum(1)
    top = norm.max(initial=0)
    lifted = np.concatenate([x, np.sqrt(np.maximum(top - norm, 0))[:, None]], 1)
    p = np.concatenate([pivots, np.zeros((len(pivots), 1))], 1)
    table, own = _distances(lifted, p), _distances(np.concatenate([q, np.zeros((len(q), 1))], 1), p)
    square = (q * q).sum(1) + top
    # distances come from rounded sums and are held in 32 bits; a bound may be too high by this much
    largest = max(table.max(initial=0), own.max(initial=0), 1.0)
    slack = largest * 2.0**-21 + np.sqrt(max(top, square.max(initial=0), 1.0)) * 2.0**-21
    table = np.ascontiguousarray(table.T.astype(np.float32))
    own = own.astype(np.float32)
    rows, cols, scores, done, n = [], [], [], 0, len(x)
    for i in range(0, len(q), batch):
        qs = q[i : i + batch]
        bound = np.zeros((len(qs), n), np.float32)
        gap = np.empty_like(bound)
        for j in range(len(p)):
            np.subtract(table[j][None], own[i : i + batch, j][:, None], out=gap)
            np.abs(gap, out=gap)
            np.maximum(bound, gap, out=bound)
        bound[qid[i : i + batch][:, None] == xid[None]] = np.inf
        best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in qs]
        if exact:
            turn = np.argsort(bound, axis=1, kind="stable")
            bound = np.take_along_axis(bound, turn, 1)
            several = np.isfinite(bound).sum(1)
            at, take, active = 0, step, np.flatnonzero(several > 0)
            while len(active):
                stop = min(at + take, n)
                mine = turn[active, at:stop]
                union = np.unique(mine)
                if 2 * len(union) > n:
                    product, place = qs[active] @ x.T, mine
                else:
                    product, place = qs[active] @ x[union].T, np.searchsorted(union, mine)
                goes_on = []
                for r, a in enumerate(active.tolist()):
                    m = min(stop, several[a]) - at
                    done += m
                    best[a] = _best(np.concatenate([best[a][0], product[r, place[r, :m]]]), np.concatenate([best[a][1], mine[r, :m]]), k)
                    if stop < several[a]:
                        reach = np.sqrt(max(float(square[i + a]) - 2 * best[a][0][-1], 0)) + slack if len(best[a][0]) == k else np.inf
                        if bound[a, stop] <= reach:
                            goes_on.append(a)
                at, take, active = stop, 2 * take, np.array(goes_on, np.int64)
        for r in range(len(qs)):
            if exact:
                s, c = best[r][0].astype(np.int64).tolist(), best[r][1].tolist()
            else:
                left = np.flatnonzero(np.isfinite(bound[r]))
                done += len(left)
                s, c = _best_big(x, qs[r], left, k)
            rows += [i + r] * len(c)
            cols += order[c].tolist() if len(c) else []
            scores += s
    return np.array(rows, np.int64), np.array(cols, np.int64), scores, done


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256, pivots: int = PIVOTS, candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k largest inner products of each query over all other rows.

    Queries are the rows whose id is divisible by ``every``. Vectors of different length are not
    compared. Rows that repeat id and vector count once; rows that share only the id are separate
    candidates, and none of them is a candidate of its own id's queries. Rows without id take no part.
    Scores beyond 64 bits are cut to
    its range. Other columns are ignored, whatever their names.
    """
    base = integer_vectors(vectors, id_col, vec_col, scale)
    blocks = lambda n, size: F.greatest(F.ceil(n / F.lit(size)), F.lit(1)).cast("int")
    sizes = base.groupBy("dim").agg(F.count("*").alias("n"), F.count(F.when(F.col("id") % every == 0, 1)).alias("nq"))
    sized = base.join(sizes.select("dim", blocks(F.col("n"), candidates).alias("nx"), blocks(F.col("nq"), queries).alias("nq")), "dim")
    x = sized.withColumn("cb", F.pmod(F.xxhash64("id"), F.col("nx")).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))
    q = sized.where(F.col("id") % every == 0).withColumn("qb", F.pmod(F.xxhash64("id", F.lit(1)), F.col("nq")).cast("int")).withColumn("cb", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)))
    cells = ["dim", "cb", "qb"]

    def unique(pdf: pd.DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
        if not len(pdf):
            return np.zeros(0, np.int64), np.zeros((0, dim))
        v = np.array(pdf["v"].tolist(), float).reshape(len(pdf), dim)
        rows = pd.DataFrame(v).assign(_id=pdf["id"].to_numpy()).drop_duplicates().index.to_numpy()
        return pdf["id"].to_numpy()[rows], v[rows]

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        dim = int(key[0])
        qid, qv = unique(left, dim)
        xid, xv = unique(right, dim)
        if not len(qv):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        near = choose_pivots(xv[np.random.default_rng(1).permutation(len(xv))[:PIVOT_SAMPLE]], pivots)
        r, c, s, _ = search_block(qv, qid, xv, xid, near.reshape(len(near), dim), k)
        return pd.DataFrame({"query_id": qid[r], "vec_id": xid[c], "score": np.array([min(max(int(v), -(1 << 63)), (1 << 63) - 1) for v in s], np.int64)})

    side = lambda df: df.select(*(F.col(c).alias(c) for c in ("id", "v", *cells))).groupBy(*cells)
    best = side(q).cogroup(side(x)).applyInPandas(run, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
