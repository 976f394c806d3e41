"""Hard-negative mining with Kronecker-packed products (operator 13).

Scores of an anchor against several candidates come from one multiplication a component: the
candidates' components, made non-negative by a bias, are packed into separate fields of one wide
integer; the anchor's component, biased too, multiplies all fields at once; what the fields then hold
are the products' sums, wide enough never to run into the next one. Taking the biases' share away
leaves the exact inner products. Where a field is narrow the wide integer has 53 bits and is carried in
a double, whose sums of integers below 2^53 are exact; a wider field goes to Python integers of many
hundred bits.

Anchors and candidates are dealt to blocks by a hash of their id and a task takes one block of each,
so nothing but a block is ever held. The first pass meets candidates of the anchor's label only and
keeps the best positives; the second takes the windows their scores open to all other labels.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .topk import _best

#: Rows of a block of candidates and of anchors, the unit of work of a task.
CANDIDATES, ANCHORS = 16384, 16384
#: Scores held at once.
SCORES = 1 << 21
#: Fields of a wide Python integer.
WIDE_FIELDS = 256


def fields_of(a: np.ndarray, x: np.ndarray) -> int:
    """Bits of a field that holds any biased anchor's product with any biased candidate (rows of non-negative integers)."""
    top = x.max(0).astype(object)
    return max(1, max((int(v) for v in a.astype(object) @ top), default=0).bit_length()) if len(a) and a.shape[1] else 1


def _narrow(a: np.ndarray, x: np.ndarray, width: int) -> np.ndarray:
    """a @ x.T of non-negative integers with fields of at most 53 bits, several in each double."""
    m = 53 // width
    n = -(-len(x) // m)
    wide = np.zeros((n, x.shape[1]))
    for f in range(m):
        part = x[f * n : (f + 1) * n]
        wide[: len(part)] += part.astype(float) * 2.0 ** (width * f)
    product = (a.astype(float) @ wide.T).astype(np.int64)
    out = np.empty((len(a), m * n), np.int64)
    for f in range(m):
        out[:, f * n : (f + 1) * n] = (product >> (width * f)) & ((1 << width) - 1)
    return out[:, : len(x)]


def _wide(a: np.ndarray, x: np.ndarray, width: int) -> np.ndarray:
    """The same with fields of any width in long Python integers."""
    size = -(-width // 8)
    out = np.zeros((len(a), len(x)), object)
    for i in range(0, len(x), WIDE_FIELDS):
        part = x[i : i + WIDE_FIELDS]
        wide = [int.from_bytes(b"".join(int(v).to_bytes(size, "little") for v in part[:, d].tolist()), "little") for d in range(x.shape[1])]
        for r, row in enumerate(a.tolist()):
            held = sum(int(v) * w for v, w in zip(row, wide, strict=True)).to_bytes(size * len(part), "little")
            out[r, i : i + len(part)] = [int.from_bytes(held[j : j + size], "little") for j in range(0, len(held), size)]
    return out


def packed_scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of 64-bit integers, cut to 64 bits."""
    if not len(a) or not len(x) or not a.shape[1]:
        return np.zeros((len(a), len(x)), np.int64)
    big = max(int(np.abs(a).max()), int(np.abs(x).max()), -int(a.min()), -int(x.min()))
    if big >= 1 << 31:
        a, x = a.astype(object), x.astype(object)
    low_a, low_x = a.min(0), x.min(0)
    a1, x1 = a - low_a, x - low_x
    width = fields_of(a1, x1)
    held = _narrow(a1, x1, width) if width <= 53 else _wide(a1, x1, width)
    if 4 * big * big * a.shape[1] >= 1 << 63:
        held, a, x1, low_a, low_x = (v.astype(object) for v in (held, a, x1, low_a, low_x))
    out = held + (x1 @ low_a)[None] + (a @ low_x)[:, None]
    if out.dtype == object:
        out = np.array([[min(max(int(v), -(1 << 63)), (1 << 63) - 1) for v in row] for row in out.tolist()], np.int64)
    return out


def _side(pdf: pd.DataFrame, dim: int) -> tuple[pd.DataFrame, np.ndarray]:
    """Rows in the order of their ids, those that repeat another in all the operator reads once, and their vectors."""
    pdf = pdf.sort_values(["id", "key"], kind="stable").drop_duplicates(["id", "key"]).reset_index(drop=True)
    return pdf, np.array(pdf["v"].tolist(), np.int64).reshape(len(pdf), dim)


def best_positives(a: np.ndarray, aid: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int) -> tuple[list[int], list[int], list[int]]:
    """For each anchor its ``k`` candidates of highest score that are not of its id: anchor rows, candidate rows (in the order of ids), scores."""
    rows, cols, scores = [], [], []
    step = max(1, SCORES // max(len(x), 1))
    for i in range(0, len(a), step):
        s = packed_scores(a[i : i + step], x)
        for r in range(len(s)):
            mine = np.flatnonzero(xid != aid[i + r])
            best, at = _best(s[r, mine], mine, k)
            rows += [i + r] * len(at)
            cols += at.tolist()
            scores += best.tolist()
    return rows, cols, scores


def negatives_within(a: np.ndarray, aid: np.ndarray, alabel: np.ndarray, wants: list[list[tuple[int, int, int]]], x: np.ndarray, xid: np.ndarray, xlabel: np.ndarray, k: int, low: int, high: int) -> list[tuple[int, ...]]:
    """(anchor row, positive id, its key, its score, candidate row, score): for each wanted positive (id, key, score) the ``k`` best of other labels within its window."""
    out = []
    step = max(1, SCORES // max(len(x), 1))
    for i in range(0, len(a), step):
        s = packed_scores(a[i : i + step], x)
        for r in range(len(s)):
            windows = [(*want, -((-low * want[2]) // 100), (high * want[2]) // 100) for want in wants[i + r]]
            windows = [w for w in windows if w[3] <= w[4]]
            if not windows:
                continue
            row = s[r]
            some = np.flatnonzero((row >= min(w[3] for w in windows)) & (row <= max(w[4] for w in windows)) & (xlabel != alabel[i + r]) & (xid != aid[i + r]))
            for *want, lo, hi in windows:
                inside = some[(row[some] >= lo) & (row[some] <= hi)]
                best, at = _best(row[inside], inside, k)
                out += [(i + r, *want, c, v) for c, v in zip(at.tolist(), best.tolist(), strict=True)]
    return out


def _blocks(n: Column, size: int) -> Column:
    return F.greatest(F.ceil(n / F.lit(size)), F.lit(1)).cast("int")


def _dealt(rows: DataFrame, by: list[str], anchor: Column, candidates: int, anchors: int) -> tuple[DataFrame, DataFrame]:
    """Anchors and candidates by cell (``by``, ab, cb): every anchor meets every candidate of its ``by`` in one cell."""
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(anchor).alias("na")).select(*by, _blocks(F.col("n"), candidates).alias("nx"), _blocks(F.col("na"), anchors).alias("nq"))
    sized = rows.join(sizes, by)
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = sized.withColumn("cb", F.pmod(F.xxhash64("id"), F.col("nx")).cast("int")).withColumn("ab", all_of("nq")).drop("nx", "nq")
    a = sized.where(anchor).withColumn("ab", F.pmod(F.xxhash64("id", F.lit(1)), F.col("nq")).cast("int")).withColumn("cb", all_of("nx")).drop("nx", "nq")
    return a, x


def hard_negatives(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", candidates: int = CANDIDATES, anchors: int = ANCHORS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components become floor(scale * x); a score is the integer inner product with the anchor; higher
    scores come first, ties by the smaller id. Anchors are the rows whose id is divisible by ``every``.
    For each anchor and each of its first ``positives`` other rows of its label: the first ``negatives``
    rows of other labels whose score is ``low`` to ``high`` percent of the positive's.

    Rows with a null id, label or vector, or a component that is null, NaN or infinite, take no part.
    Vectors of different length are not compared. Rows that repeat id, label and vector count once; rows
    that share only the id are anchors and candidates of their own, and none of them meets an anchor of
    its id. Integers and scores beyond 64 bits are cut to its range. Labels are of any type with
    equality; other columns are ignored, whatever their names.
    """
    x = F.col(vec_col).cast("array<double>")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vec_col).isNotNull()).where(fine)
    label = F.to_json(F.struct(F.col(label_col)))
    v = F.transform(x, lambda e: F.floor(e * F.lit(float(scale))))
    base = rows.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), v.alias("v"), F.size(x).alias("dim")).withColumn("key", F.xxhash64("id", "label", "v"))
    anchor = F.col("id") % every == 0

    def first(cell: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, av = _side(left, int(cell[0]))
        c, cv = _side(right, int(cell[0]))
        r, k, s = best_positives(av, a["id"].to_numpy(), cv, c["id"].to_numpy(), positives)
        return pd.DataFrame({"key": a["key"].to_numpy()[r], "positive_id": c["id"].to_numpy()[k], "positive_key": c["key"].to_numpy()[k], "score": np.array(s, np.int64)})

    cols = ["id", "label", "v", "key"]
    a, c = _dealt(base, ["dim", "label"], anchor, candidates, anchors)
    cells = ["dim", "label", "ab", "cb"]
    side = lambda df, more=(): df.select(*[F.col(k).alias(k) for k in (*cols, *more, *(y for y in cells if y not in cols))]).groupBy(*cells)
    found = side(a).cogroup(side(c)).applyInPandas(first, "key long, positive_id long, positive_key long, score long")
    w = Window.partitionBy("key").orderBy(F.col("score").desc(), "positive_id", "positive_key")
    best = found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= positives)
    wants = best.groupBy("key").agg(F.collect_list(F.struct("positive_id", "positive_key", "score")).alias("wants"))

    def second(cell: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, av = _side(left, int(cell[0]))
        c, cv = _side(right, int(cell[0]))
        asked = [[(p["positive_id"], p["positive_key"], p["score"]) for p in w] for w in a["wants"]]
        label = {x: i for i, x in enumerate(pd.unique(pd.concat([a["label"], c["label"]])))}
        got = negatives_within(av, a["id"].to_numpy(), a["label"].map(label).to_numpy(), asked, cv, c["id"].to_numpy(), c["label"].map(label).to_numpy(), negatives, low, high)
        r, p, pk, ps, k, s = (np.array(z, np.int64) for z in (zip(*got, strict=True) if got else [[]] * 6))
        return pd.DataFrame({"anchor_id": a["id"].to_numpy()[r], "key": a["key"].to_numpy()[r], "positive_id": p, "positive_key": pk, "positive_score": ps, "negative_id": c["id"].to_numpy()[k], "negative_key": c["key"].to_numpy()[k], "negative_score": s})

    a, c = _dealt(base, ["dim"], anchor, candidates, anchors)
    cells = ["dim", "ab", "cb"]
    asked = a.join(wants, "key")
    met = side(asked, ["wants"]).cogroup(side(c)).applyInPandas(second, "anchor_id long, key long, positive_id long, positive_key long, positive_score long, negative_id long, negative_key long, negative_score long")
    w = Window.partitionBy("key", "positive_id", "positive_key").orderBy(F.col("negative_score").desc(), "negative_id", "negative_key")
    ranked = met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
