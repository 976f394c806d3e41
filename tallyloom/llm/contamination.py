"""Benchmark decontamination by winnowing (operator 12).

A window is ``size`` consecutive words of a benchmark item, or all words of a shorter one. Windows of a
length have their own fingerprints: of the k-gram hashes in a window the least is kept, with k two words
less than the window, so that any two texts that share a window share its fingerprint wherever it
stands; nothing of that length can be missed. Documents are fingerprinted in the same way, a fixed-size
Bloom filter of the benchmark's fingerprints lets few others through, and fingerprints are joined. A hit
is extended to its window by comparing the words themselves, as part of the join's condition, so that a
frequent k-gram never makes pairs of all documents and items that have it.

Windows with equal words are one, with the list of its items, so copies of an item or a passage cost
no more than one; the items of a document come from the distinct lists its windows have, made once for
all documents that share them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import cut

from .textbuf import Chunk, PrefixHash, chunks, mix, words

#: Words of a window.
SIZE = 10
#: Words of a window that its k-gram leaves out.
SLACK = 2
#: Bits of the filter, as a power of two; three bits are set a fingerprint.
FILTER_BITS = 24
#: Candidate windows of an output batch.
BATCH = 8192

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The lower-case words of a chunk of texts: runs of ASCII letters, digits and bytes of other characters."""

    def __init__(self, c: Chunk):
        self.data = _LOWER[c.data]
        self.start, self.end, self.text = words(Chunk(c.first, self.data, c.offs), _WORD[self.data])
        self.hash = mix(PrefixHash(self.data, seed=12).of(self.start, self.end) + (self.end - self.start).astype(np.uint64))
        self.count = np.bincount(self.text, minlength=c.n)
        self.first = np.concatenate([[0], np.cumsum(self.count)])

    def fingerprints(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of the windows of a length, and each window's least k-gram hash."""
        k = max(1, length - SLACK)
        n = len(self.hash) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            gram = np.zeros(len(self.hash) - k + 1, np.uint64)
            for j in range(k):
                gram = gram * _STEP + self.hash[j : j + len(gram)]
            gram = mix(gram + np.uint64(length))
        least = gram[:n]
        for j in range(1, length - k + 1):
            least = np.minimum(least, gram[j : j + n])
        within = np.flatnonzero(self.text[length - 1 :] == self.text[:n])
        return within, least[within].view(np.int64)

    def window(self, at: int, length: int) -> str:
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.start[at : at + length].tolist(), self.end[at : at + length].tolist(), strict=True)).decode()


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """``length, fp, window, items, set_id``: every distinct window with its fingerprint, the sorted items (strings) that hold it, and a key of that list.

    Items without id, text or words have none. Items that repeat an id are one.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for c in chunks(b, "text"):
                w = Words(c)
                for length in sorted({min(size, n) for n in w.count.tolist() if n}):
                    at, fp = w.fingerprints(length)
                    mine = (w.count[w.text[at]] == length) if length < size else np.ones(len(at), bool)
                    at, fp = at[mine], fp[mine]
                    for i in range(0, len(at), BATCH):
                        some = at[i : i + BATCH]
                        rows = pa.array(c.first + w.text[some])
                        yield pa.RecordBatch.from_arrays([ids.take(rows), pa.array(np.full(len(some), length, np.int32)), pa.array(fp[i : i + BATCH]), pa.array([w.window(x, length) for x in some.tolist()], pa.string())], ["item", "length", "fp", "window"])

    given = items.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    each = given.mapInArrow(run, "item string, length int, fp long, window string")
    lists = each.groupBy("length", "fp", "window").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return lists.withColumn("set_id", F.sha2(F.to_json("items"), 256))


def _bits(fp: Column) -> Column:
    m = F.lit((1 << FILTER_BITS) - 1)
    return F.array(*[F.shiftrightunsigned(fp, s).bitwiseAND(m) for s in (0, 20, 64 - FILTER_BITS)])


def fingerprint_filter(windows: DataFrame) -> tuple[np.ndarray, list[int]]:
    """A Bloom filter of the windows' fingerprints (2^FILTER_BITS bits, however many they are), and the windows' lengths."""
    bit = windows.select(F.explode(_bits(F.col("fp"))).alias("bit"))
    spread = bit.select(F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("b"))
    lengths = windows.select(F.lit(-1).cast("long").alias("word"), F.expr("shiftleft(1L, length)").alias("b"))
    found = spread.union(lengths).groupBy("word").agg(F.bit_or("b").alias("b")).toArrow()
    word, b = np.asarray(found["word"]), np.asarray(found["b"])
    held = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    held[word[word >= 0]] = b[word >= 0]
    lens = int(b[word < 0][0]) if (word < 0).any() else 0
    return held.view(np.uint64), [n for n in range(63) if lens >> n & 1]


def _passes(held: np.ndarray, fp: np.ndarray) -> np.ndarray:
    x = fp.view(np.uint64)
    out = np.ones(len(x), bool)
    for s in (0, 20, 64 - FILTER_BITS):
        bit = (x >> np.uint64(s)) & np.uint64((1 << FILTER_BITS) - 1)
        out &= (held[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
    return out


_SCHEMA = "uid long, n_words long, length int, fp long, start long, window string"


def _scan(rows: DataFrame, held: np.ndarray, lengths: list[int]) -> DataFrame:
    """For rows (uid, row, text): a line with ``n_words`` for each, and a line for each window whose fingerprint passes the filter."""
    shared = rows.sparkSession.sparkContext.broadcast(held)
    kind = rows.schema["row"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            uid, row = b.column(0), b.column(1)
            none = lambda n, t: pa.nulls(n, t)
            for c in chunks(b, "text"):
                w = Words(c)
                mine = slice(c.first, c.first + c.n)
                yield pa.RecordBatch.from_arrays([uid[mine], pa.array(w.count.astype(np.int64)), none(c.n, pa.int32()), none(c.n, pa.int64()), none(c.n, pa.int64()), none(c.n, pa.string()), row[mine]], names)
                for length in lengths:
                    at, fp = w.fingerprints(length)
                    some = _passes(shared.value, fp)
                    at, fp = at[some], fp[some]
                    for i in range(0, len(at), BATCH):
                        part = at[i : i + BATCH]
                        n, text = len(part), w.text[part]
                        found = [w.window(x, length) for x in part.tolist()]
                        yield pa.RecordBatch.from_arrays([uid.take(pa.array(c.first + text)), none(n, pa.int64()), pa.array(np.full(n, length, np.int32)), pa.array(fp[i : i + BATCH]), pa.array(part - w.first[text]), pa.array(found, pa.string()), none(n, row.type)], names)

    names = [*(x.split()[0] for x in _SCHEMA.split(", ")), "row"]
    return rows.mapInArrow(run, f"{_SCHEMA}, row {kind}")


def contaminated(docs: DataFrame, items: DataFrame, columns: list[str] | None = None, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = SIZE) -> DataFrame:
    """``row, n_words, n_hit, spans, items, n_items, items_sha256, contaminated`` for every document.

    ``row`` is a struct of ``columns`` (all but the text by default), so that no name can clash. A word is
    hit if it lies inside any occurrence of a window; ``spans`` are the maximal runs (start, end) of hit
    words, ``items`` the sorted ids (as strings) of the items with a window in the document, and
    ``items_sha256`` the lowercase hex sha256 of these joined by commas.

    Null and empty texts have no words and no hits; rows without id, and rows that repeat an id or a text,
    are documents of their own. Without items, or with items that have no words, nothing is hit.
    """
    windows = benchmark_windows(items, item_id, item_text, size)
    held, lengths = fingerprint_filter(windows)
    columns = [c for c in docs.columns if c != text_col] if columns is None else columns
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.struct(*[F.col(c) for c in columns], F.lit(None).cast("int").alias("_")).alias("row"), F.col(text_col).cast("string").alias("text"))
    seen = cut(_scan(rows, held, lengths), "winnowed")
    key = ["length", "fp", "window"]
    hits = seen.where("start IS NOT NULL").select("uid", "start", *key).join(windows.select(*key, "set_id"), key).select("uid", "start", (F.col("start") + F.col("length")).alias("end"), "set_id")
    w = Window.partitionBy("uid").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = hits.withColumn("_new", F.coalesce(F.col("start") > before, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("uid", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.collect_set("set_id").alias("sets"))
    each = spans.groupBy("uid").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("sets")))).alias("sets"))
    found = cut(each.withColumn("sets_id", F.sha2(F.array_join("sets", ","), 256)), "hits")
    lists = windows.groupBy("set_id").agg(F.first("items").alias("items"))
    union = found.groupBy("sets_id").agg(F.first("sets").alias("sets")).select("sets_id", F.explode("sets").alias("set_id")).join(lists, "set_id")
    of = union.groupBy("sets_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    of = of.select("sets_id", "items", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    hit = found.drop("sets").join(of, "sets_id").drop("sets_id")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    zero = lambda c, v: F.coalesce(F.col(c), v).alias(c)
    row = F.struct(*[F.col("row")[c].alias(c) for c in columns]) if columns else F.struct(F.lit(None).cast("int").alias("_"))
    return (
        seen.where("n_words IS NOT NULL").select("uid", "row", "n_words").join(hit, "uid", "left")
        .select(row.alias("row"), "n_words", zero("n_hit", F.lit(0).cast("long")), zero("spans", none), zero("items", F.array().cast("array<string>")), zero("n_items", F.lit(0).cast("long")), zero("items_sha256", F.sha2(F.lit(""), 256)), F.col("n_hit").isNotNull().alias("contaminated"))
    )
