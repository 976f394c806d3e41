"""MinHash near-duplicates by a signature-coordinate inverted join (operator 6).

1. Every document becomes its set of word shingles and a signature of ``coordinates`` minima.
2. Documents of equal sets collapse to the smallest id.
3. A representative is posted under its rarest ``coordinates - matches + 1`` coordinate-value
   pairs. Two signatures with ``matches`` equal coordinates share one of these pairs (prefix
   filter); the order only has to be global, so rarity may be estimated by a fixed-size sketch.
4. Star rounds: each posting list is compared with one of its members. First each document meets the
   smallest ids of its lists, the FIRST_CENTRES that most of its lists have. Pairs with too few equal
   coordinates go, the others are confirmed on their full sets, and linked ones are merged. Lists of
   more than ``LONG`` members whose members are then not all in one component have further members as
   centres, as long as that links anything.
5. Skip round: lists whose members all meet in one component are skipped. In the others, only
   members of different components are compared by their coordinates, those of many lists in one
   task; a list of more than ``BLOCK`` members is compared in pairs of blocks. The comparison runs
   twice. First it names the documents that are near any other. Of these the shingles are counted: one
   that no other of them has is in no intersection, so documents and pairs with too many of them are
   done with. Then it gives the pairs left, each once however many lists it is in, but those whose
   bitmaps show too many shingles that only one of them has; the rest are confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import floor, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import cut, drop

from .components import connected_components
from .textbuf import Chunk, PrefixHash, chunks, mix, words

COORDINATES = 96
#: Counters of the rarity sketch, whatever the input's size.
SKETCH = 1 << 18
#: Members of a posting list that one task compares with as many others.
BLOCK = 1024
#: Members from which an open list has further centres, and how many at most.
LONG, CENTRES = 64, 8
#: Rows of open lists that one task compares.
BUCKET_ROWS = 20_000
#: Lists' smallest members that a document is compared with at first: those of most of its lists.
FIRST_CENTRES = 3
#: Bits of the filter of wanted ids, as a power of two, however many they are.
FILTER_BITS = 24

#: 64-bit words of a set's bitmap.
WORDS = 32

_KEEP = np.uint64(52)
_CELL = np.uint64(64 - 18)


def match_threshold(percent: float, coordinates: int = COORDINATES) -> int:
    """Equal coordinates to ask for: 4.6 standard deviations under the mean of a pair just similar enough."""
    j = percent / 100
    return max(1, floor(coordinates * j - 4.6 * sqrt(coordinates * j * (1 - j))))


def shingle_sets(c: Chunk, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles as sorted 52-bit hashes, and their counts per text.

    Words are compared with A-Z in lower case. A text of fewer than ``size`` words is one shingle;
    a text without words has none.
    """
    data = np.where((c.data >= 65) & (c.data <= 90), c.data + np.uint8(32), c.data)
    starts, ends, owner = words(Chunk(c.first, data, c.offs))
    n = len(starts)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(c.n, np.int64)
    ph = PrefixHash(data)
    per = np.bincount(owner, minlength=c.n)
    first = np.cumsum(per) - per
    with np.errstate(over="ignore"):
        w = mix(ph.of(starts, ends) + (ends - starts).astype(np.uint64))
        keys, owners = [], []
        if n >= size:
            h = np.full(n - size + 1, np.uint64(size))
            for j in range(size):
                h = (h ^ w[j : n - size + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            whole = np.flatnonzero(owner[: n - size + 1] == owner[size - 1 :])
            keys.append(mix(h[whole]))
            owners.append(owner[whole])
        for m in range(1, size):
            short = np.flatnonzero(per == m)
            if len(short):
                h = np.full(len(short), np.uint64(m))
                for j in range(m):
                    h = (h ^ w[first[short] + j]) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(29)
                keys.append(mix(h))
                owners.append(short)
    key, own = np.concatenate(keys), np.concatenate(owners).astype(np.uint64)
    packed = np.sort((own << _KEEP) | (key >> (np.uint64(64) - _KEEP)))
    packed = packed[np.concatenate([[True], packed[1:] != packed[:-1]])]
    count = np.bincount((packed >> _KEEP).astype(np.int64), minlength=c.n)
    return packed & np.uint64((1 << 52) - 1), count


def _constants(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20011)
    return rng.integers(0, 1 << 63, coordinates, dtype=np.uint64), rng.integers(0, 1 << 62, coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(values: np.ndarray, counts: np.ndarray, coordinates: int) -> np.ndarray:
    """One row of 32-bit minima per text that has shingles."""
    full = counts > 0
    starts = (np.cumsum(counts) - counts)[full]
    out = np.empty((int(full.sum()), coordinates), np.uint32)
    if len(out):
        x = mix(values.copy())
        for i, (flip, by) in enumerate(zip(*_constants(coordinates), strict=True)):
            with np.errstate(over="ignore"):
                out[:, i] = np.minimum.reduceat((x ^ flip) * by, starts) >> np.uint64(32)
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as a binary value."""
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def describe(documents: DataFrame, size: int, coordinates: int) -> DataFrame:
    """``doc_id, n_shingles, a, b, sig``: the size of the set, its 128-bit hash, and the signature (null for no words)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch, "text"):
                values, counts = shingle_sets(c, size)
                at = np.cumsum(counts)
                sums = []
                for salt in (11, 12):
                    with np.errstate(over="ignore"):
                        s = np.concatenate([[np.uint64(0)], np.cumsum(mix(values + (np.uint64(salt) << np.uint64(53))))])
                        sums.append(mix(s[at] - s[at - counts] + counts.astype(np.uint64)).view(np.int64))
                sig = _binary(signatures(values, counts, coordinates))
                place = np.cumsum(counts > 0) - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(c.first, c.n), pa.array(counts), *map(pa.array, sums), sig.take(pa.array(place, mask=counts == 0))],
                    ["doc_id", "n_shingles", "a", "b", "sig"],
                )

    return documents.mapInArrow(run, "doc_id long, n_shingles long, a long, b long, sig binary")


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size that holds the hash of every id."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.unique(mix(batch.column(0).to_numpy().astype(np.uint64)) >> np.uint64(64 - FILTER_BITS))
            yield pa.RecordBatch.from_arrays([pa.array((cell >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (cell & np.uint64(63))).view(np.int64))], ["word", "bits"])

    found = ids.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[np.asarray(found["word"])] = np.asarray(found["bits"])
    return out.view(np.uint64)


def full_sets(documents: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``doc_id, grams``: the whole shingle set of each wanted document, as sorted 64-bit integers.

    Texts stay where they are read: a filter of fixed size passes over most documents that are not
    wanted, and only sets are moved to the exact join.
    """
    held = documents.sparkSession.sparkContext.broadcast(id_filter(wanted))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = mix(batch.column(0).fill_null(0).to_numpy().astype(np.uint64)) >> np.uint64(64 - FILTER_BITS)
            some = (held.value[cell >> np.uint64(6)] >> (cell & np.uint64(63))) & np.uint64(1) == 1
            batch = batch.filter(pa.array(some))
            for c in chunks(batch, "text"):
                values, counts = shingle_sets(c, size)
                offs = np.concatenate([[0], np.cumsum(counts) * 8]).astype(np.int32)
                grams = pa.Array.from_buffers(pa.binary(), c.n, [None, pa.py_buffer(offs), pa.py_buffer(values)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.n), grams], ["doc_id", "grams"])

    return documents.mapInArrow(run, "doc_id long, grams binary").join(wanted, "doc_id", "left_semi")


def exploded(sets: DataFrame) -> DataFrame:
    """``doc_id, n, g``: a row for each shingle of the sets, n the size of its set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1).slice(i, 256)]
                size = np.array([len(x) for x in part])
                ids = batch.column(0).slice(i, 256).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, size)), pa.array(np.repeat(size, size)), pa.array(np.concatenate(part) if part else np.zeros(0, np.int64))], ["doc_id", "n", "g"])

    return sets.select("doc_id", "grams").mapInArrow(run, "doc_id long, n long, g long")


def bitmaps(sets: DataFrame) -> DataFrame:
    """``doc_id, bits``: ``WORDS`` words in which each shingle of a set sets one bit.

    A bit that only one of two sets has stands for a shingle that the other lacks, so no pair is lost by them.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.zeros((batch.num_rows, WORDS), np.uint64)
            for k, x in enumerate(batch.column(1)):
                g = np.frombuffer(x.as_buffer(), np.uint64)
                np.bitwise_or.at(bits[k], (g % np.uint64(WORDS)).astype(np.int64), np.uint64(1) << ((g >> np.uint64(16)) & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([batch.column(0), _binary(bits)], ["doc_id", "bits"])

    return sets.select("doc_id", "grams").mapInArrow(run, "doc_id long, bits binary")


def _pair_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each coordinate-value pair."""
    with np.errstate(over="ignore"):
        return mix(sig.astype(np.uint64) + (np.arange(1, sig.shape[1] + 1, dtype=np.uint64) << np.uint64(32)))


def _matrix(col: pa.Array, coordinates: int) -> np.ndarray:
    if not len(col):
        return np.zeros((0, coordinates), np.uint32)
    col = col.cast(pa.large_binary())
    first = np.frombuffer(col.buffers()[1], np.int64)[col.offset]  # a slice may hold the whole array's data
    return np.frombuffer(col.buffers()[2], np.uint32, len(col) * coordinates, first).reshape(-1, coordinates)


def rarity(reps: DataFrame, coordinates: int) -> np.ndarray:
    """How often each cell of the fixed-size sketch is hit by a coordinate-value pair."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            total += np.bincount((_pair_keys(_matrix(batch.column(0), coordinates)) >> _CELL).astype(np.int64).ravel(), minlength=SKETCH)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "n"])

    out = np.zeros(SKETCH, np.int32)
    for cell, n in reps.select("sig").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():
        out[cell] = min(n, 2**31 - 1)
    return out


def _rarest(keys: np.ndarray, sketch: np.ndarray, n: int) -> np.ndarray:
    """The n rarest keys of each row, by an order that is the same for all rows."""
    keep = np.lexsort((keys, sketch[(keys >> _CELL).astype(np.int64)]), axis=1)[:, :n]
    return np.take_along_axis(keys, keep, 1)


def postings(reps: DataFrame, sketch: np.ndarray, coordinates: int, prefix: int) -> DataFrame:
    """``key, doc_id``: each representative under its ``prefix`` rarest coordinate-value pairs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                chosen = _rarest(_pair_keys(_matrix(part.column(1), coordinates)), sketch, prefix).view(np.int64).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(chosen), pa.array(np.repeat(part.column(0).to_numpy(), prefix))], ["key", "doc_id"])

    return reps.select("doc_id", "sig").mapInArrow(run, "key long, doc_id long")


def _lists(posted: DataFrame) -> DataFrame:
    """``key, size, dst`` of the lists of two or more members, dst the smallest id; lists of equal members once."""
    lists = posted.groupBy("key").agg(F.count("*").alias("size"), F.min("doc_id").alias("dst"), F.sum(F.shiftright(F.xxhash64("doc_id"), 20)).alias("who")).where("size > 1")
    return lists.groupBy("dst", "size", "who").agg(F.min("key").alias("key")).drop("who")


def _similar(a: np.ndarray, b: np.ndarray, percent: float) -> bool:
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _confirm(pairs: DataFrame, percent: float) -> DataFrame:
    """Keep the pairs (src, dst) whose full sets ga, gb are similar enough."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [
                _similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent)
                for x, y in zip(batch.column(2), batch.column(3), strict=True)
            ]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return pairs.select("src", "dst", "ga", "gb").mapInArrow(run, "src long, dst long")


def _alike(pairs: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """Keep the pairs with at least ``matches`` equal coordinates."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = (_matrix(batch.column(2), coordinates) == _matrix(batch.column(3), coordinates)).sum(1)
            yield batch.select([0, 1]).filter(pa.array(same >= matches))

    return pairs.select("src", "dst", "sa", "sb").mapInArrow(run, "src long, dst long")


def _low_bytes(sig: DataFrame, coordinates: int) -> DataFrame:
    """``doc_id, low``: the low byte of each coordinate. Equal coordinates have equal bytes, so no pair is lost by them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _binary((_matrix(batch.column(1), coordinates) & 255).astype(np.uint8))], ["doc_id", "low"])

    return sig.mapInArrow(run, "doc_id long, low binary")


def _in_buckets(members: DataFrame) -> DataFrame:
    """Members of lists of a ``size`` (key, doc_id, ...; a written table), dealt to pairs of blocks x, y of about BLOCK members, and these to buckets of lists.

    A list of at most BLOCK members is the one pair (0, 0).
    """
    buckets = members.count() // BUCKET_ROWS + 1
    m = members.withColumn("nb", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("blk", F.pmod(F.xxhash64("doc_id"), F.col("nb")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumns({"x": F.least("blk", "other"), "y": F.greatest("blk", "other")})
    return m.withColumn("bucket", F.pmod(F.xxhash64("key", "x", "y"), F.lit(buckets))).drop("nb", "blk", "other", "size")


def _near(coordinates: int, matches: int, percent: float, pairs: bool):
    """Of the lists of a bucket: pairs (src, dst) of members of different components with at least ``matches`` equal coordinates, or the members of any such pair.

    ``n`` is the size of a member's set and ``m`` how many of it may be in another's. Pairs are also held against their bitmaps.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "x", "y", "doc_id"], ignore_index=True)
        sig = np.frombuffer(b"".join(pdf["low"]), np.uint8).reshape(-1, coordinates)
        key, ids, label = pdf[["key", "x", "y"]].to_numpy(), pdf["doc_id"].to_numpy(), pdf["label"].to_numpy()
        n, m = pdf["n"].to_numpy(), pdf["m"].to_numpy()
        bits = np.frombuffer(b"".join(pdf["bits"]), np.uint64).reshape(-1, WORDS) if pairs else None
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(key)))
        found, any_of = [], np.zeros(len(ids), bool)

        def keep(i: np.ndarray, j: np.ndarray) -> None:
            most = np.minimum(m[i], m[j])
            apart = np.flatnonzero((label[i] != label[j]) & (100 * most >= percent * (n[i] + n[j] - most)))
            for k in range(0, len(apart), 50_000):
                u, v = i[apart[k : k + 50_000]], j[apart[k : k + 50_000]]
                near = (sig[u] == sig[v]).sum(1) >= matches
                if pairs:
                    u, v = u[near], v[near]
                    own = lambda x, y: np.bitwise_count(bits[x] & ~bits[y]).sum(1, dtype=np.int64)
                    most = np.minimum(n[u] - own(u, v), n[v] - own(v, u))
                    near = 100 * most >= percent * (n[u] + n[v] - most)
                    found.append(np.stack([ids[v[near]], ids[u[near]]], 1))
                else:
                    any_of[u[near]] = any_of[v[near]] = True

        for count in np.unique(size):
            at = first[size == count]
            if count <= 64:
                i, j = np.triu_indices(count, 1)
                step = max(1, 200_000 // max(len(i), 1))
                for k in range(0, len(at), step):
                    keep((at[k : k + step, None] + i).ravel(), (at[k : k + step, None] + j).ravel())
            else:
                for a in at:
                    for i in range(a, a + count - 1):
                        j = np.arange(i + 1, a + count)
                        keep(np.full(len(j), i), j)
        if pairs:
            return pd.DataFrame(np.unique(np.concatenate([np.zeros((0, 2), np.int64), *found]), axis=0), columns=["src", "dst"])
        return pd.DataFrame({"doc_id": np.unique(ids[any_of])})

    return run


def near_duplicates(documents: DataFrame, size: int = 5, percent: float = 80, coordinates: int = COORDINATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row: documents linked by Jaccard similarity of word shingles.

    Two documents are linked if 100 * intersection >= percent * union of their full sets.
    Texts without words (null and empty ones too) are linked with nothing. Rows that repeat an id
    count as texts of that id: the id is linked where one of its texts is. A row of null id is its
    own component (null) and kept. Other columns are ignored, whatever their names.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    matches = match_threshold(percent, coordinates)
    prefix = coordinates - matches + 1
    about = cut(describe(docs, size, coordinates), "signatures")

    classes = about.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("a", "b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.max("n_shingles").alias("size"), F.min_by("sig", "doc_id").alias("sig"))
    classes = cut(classes, "classes")
    reps = classes.select(F.col("rep").alias("doc_id"), "sig")
    sketch = rarity(reps, coordinates)
    posted = cut(postings(reps, sketch, coordinates, prefix), "postings")
    lists = cut(_lists(posted), "lists")
    members = cut(posted.join(lists, "key").select("key", "size", "dst", F.col("doc_id").alias("src")), "members")
    drop(posted, lists)

    side = lambda name, value, table, column: table.select(F.col("doc_id").alias(name), F.col(column).alias(value))

    def alike(pairs: DataFrame) -> DataFrame:
        return cut(_alike(pairs.join(side("src", "sa", reps, "sig"), "src").join(side("dst", "sb", reps, "sig"), "dst"), coordinates, matches), "likely")

    def confirmed(likely: DataFrame) -> DataFrame:
        """The links among pairs; ``likely`` is used up."""
        wanted = cut(likely.select(F.col("src").alias("doc_id")).union(likely.select("dst")).distinct(), "wanted")
        sets = cut(full_sets(docs, wanted, size), "sets")
        pairs = likely.join(side("src", "ga", sets, "grams"), "src").join(side("dst", "gb", sets, "grams"), "dst")
        out = cut(_confirm(pairs, percent), "confirmed")
        drop(likely, sets, wanted)
        return out

    def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
        """Labels after more links; both are used up. Only the components that links touch are joined, as nodes of their own."""
        names = labels.select(F.col("node").alias("_n"), F.col("component").alias("_l"))
        end = lambda df, c: df.join(names, F.col(c) == F.col("_n"), "left").withColumn(c, F.coalesce("_l", c)).drop("_n", "_l")
        new = connected_components(end(end(links.select("src", "dst"), "src"), "dst"))
        moved = new.select(F.col("node").alias("_n"), F.col("component").alias("_l"))
        kept = labels.join(moved, F.col("component") == F.col("_n"), "left").select("node", F.coalesce("_l", "component").alias("component"))
        fresh = new.join(labels.select("node"), "node", "left_anti")
        out = cut(kept.union(fresh), "labels")
        drop(links, labels, new)
        return out

    def still_open(posted: DataFrame) -> DataFrame:
        """``key, doc_id, label, size`` of the lists that hold several components."""
        named = posted.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("label"))
        named = cut(named, "labelled")
        lists = named.groupBy("key").agg(F.count("*").alias("size"), F.min("label").alias("l"), F.max("label").alias("h")).where("l < h")
        out = cut(named.join(lists.select("key", "size"), "key"), "open")
        drop(named)
        return out

    often = members.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("n"), "dst"))  # a document is in few lists
    first = confirmed(alike(often.withColumn("nth", nth).where(F.col("nth") <= FIRST_CENTRES).select("src", "dst")))
    labels = connected_components(first)
    drop(first)
    waiting = still_open(members.select("key", F.col("src").alias("doc_id")))
    drop(members)
    for turn in range(CENTRES):
        long = waiting.where(F.col("size") > LONG)
        centres = long.groupBy("key").agg(F.min_by(F.struct("doc_id", "label"), F.xxhash64("doc_id", F.lit(turn))).alias("c"))
        pairs = long.join(centres, "key").where(F.col("label") != F.col("c.label"))
        likely = alike(pairs.select(F.greatest("doc_id", "c.doc_id").alias("src"), F.least("doc_id", "c.doc_id").alias("dst")).distinct())
        if not likely.take(1):
            drop(likely)
            break
        links = confirmed(likely)
        if not links.take(1):
            drop(links)
            break
        labels = merged(labels, links)
        old, waiting = waiting, still_open(waiting.select("key", "doc_id"))
        drop(old)
    size_of = classes.select(F.col("rep").alias("doc_id"), F.col("size").alias("n"))
    dealt = cut(waiting.join(size_of, "doc_id").join(_low_bytes(reps, coordinates), "doc_id"), "dealt")
    drop(waiting)
    buckets = _in_buckets(dealt.withColumn("m", F.col("n")))
    some = cut(buckets.groupBy("bucket").applyInPandas(_near(coordinates, matches, percent, pairs=False), "doc_id long").distinct(), "near")
    sets = cut(full_sets(docs, some, size), "sets")
    each = exploded(sets)
    elsewhere = each.groupBy("g").agg(F.count("*").alias("often")).where("often > 1").select("g")
    bound = cut(each.join(elsewhere, "g").groupBy("doc_id", "n").agg(F.count("*").alias("m")).where(100 * F.col("m") >= percent * F.col("n")).select("doc_id", "m"), "bounds")
    left = cut(dealt.join(bound.join(bitmaps(sets), "doc_id"), "doc_id"), "left")
    drop(sets, some)
    drop(dealt, bound)
    near = _in_buckets(left).groupBy("bucket").applyInPandas(_near(coordinates, matches, percent, pairs=True), "src long, dst long")
    near = cut(near.distinct(), "likely")
    drop(left)
    if near.take(1):
        labels = merged(labels, confirmed(near))

    # every document gets its set's representative; only sets of several documents need the join,
    # and a set of very many is spread over salts
    salts = 16
    many = classes.where("n > 1").select("a", "b", "rep", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    out = about.select("doc_id", "n_shingles", "a", "b", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt")).join(many, ["a", "b", "salt"], "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")).alias("node"))
    multi = out.join(labels, "node", "left")
    return multi.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node")).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
