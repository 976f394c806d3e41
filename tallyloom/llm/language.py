"""Language identification by averaged hashed subword embeddings with a linear softmax (operator 7).

A text is the mean of the embeddings of its hashed subwords: byte n-grams that do not cross words,
with the word's edges as a mark. A linear layer and a softmax follow. Embeddings and layer are trained
together by stochastic gradient descent in numpy, on a bounded sample. A temperature fitted on
held-out sampled texts calibrates the scores, and a threshold found there rejects unsure texts.

After training, embedding and layer are folded into one table of a row a bucket and a column a
language, so that predicting is a sum of table rows over the whole text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textbuf import Chunk, chunks

SIZES = (2, 3, 4)
BUCKETS = 1 << 15
DIM = 16
#: Training texts at most, in all and of a language, and the longest of them in bytes.
SAMPLE_ROWS, SAMPLE_LANGUAGE, SAMPLE_BYTES = 3000, 600, 20_000
#: Training texts of each language at least, if it has them: of many languages there are more than SAMPLE_ROWS in all.
SAMPLE_LEAST = 16
#: Languages at most (those of most texts), and characters of training text at most: of very many texts only the beginnings are taken.
SAMPLE_LANGUAGES, SAMPLE_CHARACTERS = 2000, 60_000_000
#: Languages and positions that scoring sums at a time.
SCORE_LANGUAGES, SCORE_POSITIONS = 8, 1 << 18
#: Share of correct held-out texts that the rejection threshold may lose.
LOSS = 0.002

UNKNOWN = "und"

_WORD = np.array([(48 <= b <= 57) or (65 <= b <= 90) or (97 <= b <= 122) or b >= 128 for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def subwords(c: Chunk) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size, byte positions and buckets: n-grams of word bytes, where the first and last byte may be a word's edge."""
    body = _WORD[c.data]
    b = np.where(body, _LOWER[c.data], np.uint8(32)).astype(np.uint32)
    n = len(b)
    owner_end = np.repeat(c.offs[1:], np.diff(c.offs))
    for size in SIZES:
        if n < size:
            continue
        m = n - size + 1
        key = np.full(m, np.uint32(size * 2654435761 & 0xFFFFFFFF))
        for j in range(size):
            key = (key ^ b[j : j + m]) * np.uint32(16777619)
        ok = np.arange(m) + size <= owner_end[:m]
        for j in range(1, size - 1):
            ok &= body[j : j + m]
        if size == 2:
            ok &= body[:m] | body[1 : 1 + m]
        key ^= key >> np.uint32(15)
        at = np.flatnonzero(ok)
        yield at, (key[at] * np.uint32(2246822519) >> np.uint32(17)).astype(np.int32)


@dataclass
class LanguageModel:
    """``table[bucket, language]`` of summed logits, the languages, and what calibrates a score."""

    table: np.ndarray
    bias: np.ndarray
    languages: list[str]
    temperature: float
    threshold: float

    def probabilities(self, c: Chunk) -> np.ndarray:
        """Calibrated probabilities of each text of a chunk."""
        logits = np.zeros((c.n, len(self.languages)))
        count = np.zeros(c.n)
        for at, bucket in subwords(c):
            edge = np.searchsorted(at, c.offs)
            count += np.diff(edge)
            for i in range(0, len(at), SCORE_POSITIONS):
                part = bucket[i : i + SCORE_POSITIONS]
                mine = np.clip(edge - i, 0, len(part))
                first, last = np.searchsorted(mine, 0, "right") - 1, np.searchsorted(mine, len(part), "left")
                for k in range(0, len(self.languages), SCORE_LANGUAGES):
                    rows = self.table[:, k : k + SCORE_LANGUAGES][part]
                    s = np.zeros((len(part) + 1, rows.shape[1]))
                    np.cumsum(rows, 0, dtype=np.float64, out=s[1:])
                    logits[first:last, k : k + SCORE_LANGUAGES] += s[mine[first + 1 : last + 1]] - s[mine[first:last]]
        logits = (logits / np.maximum(count, 1)[:, None] + self.bias) / self.temperature
        return softmax(logits)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        ids = [bucket for _, bucket in subwords(Chunk(0, data, np.array([0, len(data)])))]
        u, n = np.unique(np.concatenate(ids) if ids else np.zeros(0, np.int32), return_counts=True)
        out.append((u, (n / max(n.sum(), 1)).astype(np.float32)))
    return out


def train(texts: list[str], labels: list[str], epochs: int = 12, rate: float = 8.0, seed: int = 5) -> LanguageModel:
    """A calibrated model from labelled texts; a fifth of them only calibrates."""
    languages = sorted(set(labels))
    if not texts:
        return LanguageModel(np.zeros((BUCKETS, 0), np.float32), np.zeros(0), [], 1.0, 0.0)
    y = np.array([languages.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    layer = rng.normal(0, 0.3, (DIM, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    bags = _bags(texts)
    order = rng.permutation(len(texts))
    held, fit = (order[: len(order) // 5], order[len(order) // 5 :]) if len(order) >= 20 else (order, order)
    seen = np.bincount(y[fit], minlength=len(languages))
    share = len(fit) / np.maximum(seen, 1) / max(1, (seen > 0).sum())  # rare languages count as much
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(fit):
            ids, w = bags[i]
            h = w @ emb[ids]
            g = softmax((h @ layer + bias)[None])[0].astype(np.float32)
            g[y[i]] -= 1
            g *= np.float32(step * min(share[y[i]], 4.0))
            down = layer @ g
            layer -= 0.1 * np.outer(h, g)
            bias -= 0.01 * g
            emb[ids] -= np.outer(w, down)
    table = emb @ layer
    logits = np.array([w @ table[ids] + bias for ids, w in (bags[i] for i in held)]).reshape(len(held), len(languages))
    best = (np.inf, 1.0)
    for t in np.geomspace(0.5, 20, 61):
        p = softmax(logits / t)[np.arange(len(held)), y[held]]
        best = min(best, (float(-np.log(np.maximum(p, 1e-12)).mean()), float(t)))
    p = softmax(logits / best[1])
    right = p.max(1)[p.argmax(1) == y[held]]
    threshold = min(0.5, float(np.quantile(right, LOSS))) if len(right) else 0.0
    return LanguageModel(np.ascontiguousarray(table), bias.astype(np.float64), languages, best[1], threshold)


def in_fold(id_col: Column, folds: int = 3, held_out: int = 1) -> Column:
    """Whether a document is held out: crc32 of its id as text modulo ``folds`` equals ``held_out``."""
    return F.coalesce(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == held_out, F.lit(False))


def training_sample(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``text, lang`` of the training texts: of each language those of least hash outside the held-out fold, as many as the SAMPLE parameters say.

    Every language takes part, however rare or frequent: the least hashes are taken language by language,
    after a share of each, by a 64-bit hash, has been let through that holds them (a language of no more
    texts than are wanted goes through whole). Texts of more than SAMPLE_BYTES are taken, by their start,
    for languages that have no others. Only of more than SAMPLE_LANGUAGES the rarest are left out.
    """
    rows = documents.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~in_fold(F.col(id_col)))
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col), F.lit(3)).alias("u"), (F.octet_length(text_col) <= SAMPLE_BYTES).alias("fits"))
    counts = rows.groupBy("lang").agg(F.count_if("fits").alias("fit"), F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(SAMPLE_LANGUAGES).collect()
    want = min(SAMPLE_LANGUAGE, max(SAMPLE_LEAST, SAMPLE_ROWS // max(len(counts), 1)))
    through = want + 8 * int(want**0.5) + 30  # so many are expected: fewer than wanted come through about never
    limits = [(r["lang"], not r["fit"], min((1 << 63) - 1, through * (1 << 64) // (r["fit"] or r["n"]) - (1 << 63))) for r in counts]
    limit = F.broadcast(documents.sparkSession.createDataFrame(limits, "lang string, long boolean, most long"))  # SAMPLE_LANGUAGES rows at most
    some = rows.join(limit, "lang").where((F.col("fits") | F.col("long")) & (F.col("u") <= F.col("most")))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("u", "text"))
    longest = min(SAMPLE_BYTES, SAMPLE_CHARACTERS // (want * max(len(counts), 1)))
    text = F.substring("text", F.lit(1), F.when(F.col("fits"), longest).otherwise(min(longest, SAMPLE_BYTES // 4)))
    return some.withColumn("nth", nth).where(F.col("nth") <= want).select(text.alias("text"), "lang", "u")


def fit_language_model(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Train on ``training_sample``: labelled documents outside the held-out fold, bounded by the SAMPLE parameters."""
    picked = training_sample(documents, id_col, text_col, lang_col).collect()
    picked.sort(key=lambda r: (r["u"], r["lang"], r["text"]))
    return train([r["text"] for r in picked], [r["lang"] for r in picked])


def identify(documents: DataFrame, model: LanguageModel, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``row`` (a struct of ``columns``, all by default), ``lang_pred``, ``score`` and ``rejected`` for each row.

    Texts that are null or hold no letter, and all texts if the model knows no language, are ``und`` with
    score 0. ``rejected`` is true for ``und`` and for scores under the model's threshold.
    """
    names = np.array([*model.languages, UNKNOWN], object)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = np.asarray(batch.column(2).fill_null(False).to_numpy(zero_copy_only=False), bool)
            for c in chunks(batch, "text"):
                ok = letters[c.first : c.first + c.n] & (len(model.languages) > 0)
                best = np.full(c.n, len(model.languages))
                score = np.zeros(c.n)
                if ok.any():
                    p = model.probabilities(c)
                    best[ok] = p.argmax(1)[ok]
                    score[ok] = p.max(1)[ok]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(c.first, c.n), pa.array(names[best], pa.string()), pa.array(score), pa.array(~ok | (score < model.threshold))],
                    ["row", "lang_pred", "score", "rejected"],
                )

    text = F.col(text_col).cast("string")
    src = documents.select(F.struct(*[F.col(c) for c in (columns or documents.columns)]).alias("row"), text.alias("text"), text.rlike(r"\p{L}").alias("letters"))
    return src.mapInArrow(run, f"row {src.schema['row'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")
