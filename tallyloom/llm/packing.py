"""Packing documents into fixed-length sequences by length patterns (operator 3).

Lengths are counted in a histogram of at most ``limit`` entries, whatever the corpus' size. All
patterns of one, two or three lengths that fill a sequence exactly are enumerated; non-negative
least squares fits how often to use each so that together they match the histogram; the counts
are rounded without using a length more often than it occurs; what is left is packed best-fit,
again on the histogram. The plan is a short table of intervals, and every document finds its
place from its rank among the documents of its length.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import cut

LIMIT = 2048
#: Rows of one length that one task ranks.
RANK_ROWS = 50_000


@dataclass(frozen=True)
class TokenizerFiles:
    """One vocabulary in two forms: for ``tokenizers`` (JSON) and as ranks, with the pattern that splits text."""

    json: str
    ranks: str
    pattern: str


def default_tokenizer() -> TokenizerFiles:
    import public_tokenizers

    return TokenizerFiles(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


_ENCODERS: dict[TokenizerFiles, object] = {}


class Encoder:
    """Ids as ``tokenizers`` gives them from the JSON file, without special tokens added.

    The ranks hold the same vocabulary and are several times faster, but libraries may class rare
    characters differently. So only texts of Latin letters, ASCII and general punctuation go by the
    ranks; all others, and texts that hold a special token's string, go to ``tokenizers`` itself.
    """

    def __init__(self, files: TokenizerFiles):
        import tiktoken
        from tokenizers import Tokenizer

        with open(files.ranks, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=files.pattern, mergeable_ranks=ranks, special_tokens={})
        self.exact = Tokenizer.from_file(files.json)
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]

    def plain(self, text: str) -> bool:
        if text.isascii():
            known = True
        else:
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            known = bool(((points < 0x180) & ((points < 0x80) | (points >= 0xA0))).all())
        return known and not any(s in text for s in self.special)

    def encode(self, text: str) -> list[int]:
        if self.plain(text):
            return self.fast.encode_ordinary(text)
        return self.exact.encode(text, add_special_tokens=False).ids


def encoder(files: TokenizerFiles) -> Encoder:
    if files not in _ENCODERS:
        _ENCODERS[files] = Encoder(files)
    return _ENCODERS[files]


def token_pieces(documents: DataFrame, files: TokenizerFiles, limit: int = LIMIT, end_id: int = 0) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each document's ids, then ``end_id``, in pieces.

    Only documents of more than ``limit`` ids are cut; all pieces but the first then have ``limit``.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(files)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows, piece, start, length, crc = [], [], [], [], []
                for r, text in enumerate(part.column(1)):
                    ids = np.array([*enc.encode(text.as_py() or ""), end_id], "<u4")
                    cut_at = [0, *range((len(ids) - 1) % limit + 1, len(ids) + 1, limit)]
                    for k, (a, b) in enumerate(zip(cut_at, cut_at[1:], strict=False)):
                        rows.append(r)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(ids[a:b].tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pc.take(part.column(0), pa.array(rows, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return documents.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def exact_patterns(hist: np.ndarray, limit: int) -> np.ndarray:
    """All patterns of up to three occurring lengths, longest first, that sum to ``limit``; 0 pads."""
    have = hist > 0
    found = [np.array([[limit, 0, 0]])] if have[limit] else []
    a = np.arange(limit // 2 + limit % 2, limit)
    two = np.stack([a, limit - a, np.zeros_like(a)], 1)
    found.append(two[have[two[:, 0]] & have[two[:, 1]]])
    lengths = np.flatnonzero(have[: limit - 1])
    for x in lengths:
        y = lengths[(lengths <= x) & (2 * lengths >= limit - x) & (lengths < limit - x)]
        z = limit - x - y
        ok = have[z]
        found.append(np.stack([np.full(int(ok.sum()), x), y[ok], z[ok]], 1))
    return np.concatenate(found) if found else np.zeros((0, 3), int)


def fit_counts(patterns: np.ndarray, hist: np.ndarray, rounds: int = 40, inner: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative least squares of the patterns' counts to the histogram, by column generation.

    Each round adds, for every length, the pattern that most reduces what is left, and then runs
    projected gradient steps over the patterns chosen so far. Few patterns stay in use, so that
    rounding loses little. Returns the chosen patterns and their real-valued counts.
    """
    goal = hist.astype(float).copy()
    goal[0] = 0
    chosen = np.zeros(len(patterns), bool)
    x = np.zeros(len(patterns))
    used = (patterns > 0).sum(1)
    for _ in range(rounds):
        on = np.flatnonzero(chosen)
        rest = goal - np.bincount(patterns[on].ravel(), weights=np.repeat(x[on], 3), minlength=len(goal))
        rest[0] = 0
        gain = rest[patterns].sum(1) / np.sqrt(used)
        gain[chosen] = 0
        order = np.argsort(-gain, kind="stable")
        order = order[gain[order] > 1e-9 * max(goal.max(), 1)]
        if not len(order):
            break
        _, firsts = np.unique(patterns[order, 0], return_index=True)
        chosen[order[firsts]] = True
        on = np.flatnonzero(chosen)
        p, v = patterns[on], x[on].copy()
        per = np.bincount(p.ravel(), minlength=len(goal)).astype(float)
        per[0] = 0
        step = 1.0 / (per[p].sum(1) + 1e-9)  # a safe step for each pattern: |A'A| row sums bound it
        for _ in range(inner):
            left = goal - np.bincount(p.ravel(), weights=np.repeat(v, 3), minlength=len(goal))
            left[0] = 0
            v = np.maximum(0, v + 1.5 * step * left[p].sum(1))
        x[on] = v
        chosen[on[v < 1e-6]] = False
        x[~chosen] = 0
    on = np.flatnonzero(chosen)
    return patterns[on], x[on]


def round_counts(patterns: np.ndarray, x: np.ndarray, hist: np.ndarray, up: float) -> tuple[np.ndarray, np.ndarray]:
    """Whole counts that never use a length more often than it occurs, and the histogram that is left.

    Fractions from ``up`` on are rounded up where enough documents are left.
    """
    left = hist.astype(np.int64).copy()
    counts = np.zeros(len(patterns), np.int64)

    def take(k: int, most: int) -> None:
        parts, times = np.unique(patterns[k][patterns[k] > 0], return_counts=True)
        n = min(most, int((left[parts] // times).min()))
        counts[k] += n
        left[parts] -= n * times

    for k in np.argsort(-x, kind="stable"):
        if x[k] >= 1:
            take(k, int(x[k]))
    part = x - counts
    for k in np.argsort(-part, kind="stable"):
        if part[k] >= up:
            take(k, int(np.ceil(part[k])))
    return counts, left


def best_fit(left: np.ndarray, limit: int, first: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best fit of a histogram, longest first: (length, count, per sequence, first sequence, offset), and the next free sequence."""
    out = []
    open_: dict[int, list[tuple[int, int]]] = {}  # by space left: (first sequence, how many)
    spaces = np.zeros(limit + 1, bool)

    def keep(space: int, seq: int, n: int) -> None:
        if space and n:
            open_.setdefault(space, []).append((seq, n))
            spaces[space] = True

    for length in range(limit, 0, -1):
        todo = int(left[length])
        while todo:
            fits = np.flatnonzero(spaces[length:])
            if len(fits):
                space = int(fits[0]) + length
                seq, n = open_[space].pop()
                spaces[space] = bool(open_[space])
            else:
                space, seq, n = limit, first, -(-todo // (limit // length))
                first += n
            per = space // length
            full = min(n, todo // per)
            rest = todo - full * per if full < n else 0
            for s, k, m in ((seq, full, per), (seq + full, 1, rest)):
                if k and m:
                    out.append((length, k * m, m, s, limit - space))
                    keep(space - m * length, s, k)
                    todo -= k * m
            keep(space, seq + full + (rest > 0), n - full - (rest > 0))
    return out, first


def plan_packing(hist: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, int]:
    """Intervals (length, first rank, count, per sequence, first sequence, first offset), and how many sequences.

    ``hist[n]`` documents have length n, for n from 1 to ``limit``. A document of ``length`` and
    rank r in [first, first + count) goes to sequence ``first sequence + (r - first) // per`` at
    ``first offset + ((r - first) % per) * length``. Of several roundings the one with the fewest
    sequences is taken.
    """
    patterns, x = fit_counts(exact_patterns(hist, limit), hist)
    best = None
    for up in (2.0, 0.9, 0.5, 0.0):
        counts, left = round_counts(patterns, x, hist, up)
        rest, n_seq = best_fit(left, limit, int(counts.sum()))
        if best is None or n_seq < best[0]:
            best = n_seq, counts, rest
    n_seq, counts, rest = best
    out, seq = [], 0
    for pattern, n in zip(patterns.tolist(), counts.tolist(), strict=True):
        offset = 0
        for length in pattern:
            if length and n:
                out.append((length, n, 1, seq, offset))
                offset += length
        seq += n
    rank = np.zeros(limit + 1, np.int64)
    plan = []
    for length, count, per, s, offset in [*out, *rest]:
        plan.append((length, int(rank[length]), count, per, s, offset))
        rank[length] += count
    return np.array(plan, np.int64).reshape(-1, 6), n_seq


def pack(pieces: DataFrame, limit: int = LIMIT, id_col: str = "doc_id") -> DataFrame:
    """``pieces`` (a table that can be read twice) with ``sequence_id`` and ``offset`` for each row.

    Needs ``length`` (1 to ``limit``). Ties in length are ranked by a hash of the id and the piece;
    repeated rows are packed as often as they occur. The plan held by every task has a size
    bounded by ``limit`` alone.
    """
    counts = pieces.groupBy("length").count().collect()  # at most `limit` rows
    hist = np.zeros(limit + 1, np.int64)
    for length, n in counts:
        hist[length] = n
    plan, _ = plan_packing(hist, limit)
    order = np.lexsort((plan[:, 1], plan[:, 0]))
    plan = plan[order]
    span = int(hist.max(initial=0)) + 1

    # rank among equal lengths in two levels, so that no length has to meet in one task
    salts = max(1, int(hist.max(initial=0) // RANK_ROWS) + 1) if len(counts) else 1
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(id_col, "piece"), F.lit(salts)))
    cells = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = cells.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).drop("_n")
    ranked = salted.withColumn("_r", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(F.xxhash64(id_col, "piece"), id_col, "piece")) - 1)
    ranked = ranked.join(before, ["length", "_salt"]).withColumn("_rank", F.col("_r") + F.col("_before")).drop("_salt", "_r", "_before")
    columns = [c for c in ranked.columns if c != "_rank"]
    starts = plan[:, 0] * span + plan[:, 1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("_rank")).to_numpy()
            row = plan[np.searchsorted(starts, length * span + rank, "right") - 1]
            k = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in columns), pa.array(row[:, 4] + k // row[:, 3]), pa.array(row[:, 5] + k % row[:, 3] * length)], [*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name != "_rank")
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(documents: DataFrame, files: TokenizerFiles | None = None, limit: int = LIMIT, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents as pieces with their place: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A null text counts as empty and gives the end id alone. An empty table gives no rows. A null id
    is kept. Repeated rows are packed as often as they occur. Other columns are ignored.
    """
    src = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = cut(token_pieces(src, files or default_tokenizer(), limit, end_id), "pieces")
    return pack(pieces, limit).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
