"""Removal of byte strings that occur earlier, by a hash-compared suffix sort (operator 4).

A byte goes if a window of ``width`` bytes covers it whose string also starts earlier. Sorting every
suffix of the corpus would move many times the corpus. So windows are first told apart by content:

1. Of the k-grams of a window the one of smallest hash is its anchor. Equal windows have equal
   anchors at the same place, so only windows of an anchor that occurs again can repeat. A member is
   a run of windows with one anchor; members of equal content around it collapse to the first, and
   the others repeat as a whole. Equal content is told by hashes and then verified: the members' bytes
   meet and are compared. (Anchors are hashed to buckets; a document batch sends an anchor and
   content once, and one of very many contents only as a marker. What a task has sent twice it does
   not send again, so a passage that very many documents share sends a bucket two entries a task.)
2. Windows of anchors with very many contents ("hot") are told apart by hashes of the whole window.
3. The bytes of what is left meet in buckets, where a mergesort orders the suffixes. Two suffixes are
   compared by a binary search for their common extension over prefix hashes. Neighbours whose
   extension reaches ``width`` are compared byte by byte, so that a hash collision never decides; the
   first of equals in corpus order stays and the others repeat.
4. Each document joins its repeating windows and is cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import cut, drop

from .textbuf import Chunk, PrefixHash, chunks, mix

WIDTH = 100
GRAM = 32
#: Bytes of text that one bucket stands for.
BUCKET_BYTES = 4 << 20
#: Bytes of one batch of documents; an anchor of more contents than HOT_HERE in a batch, or HOT in a bucket, is hot.
BATCH_BYTES, HOT_HERE, HOT = 2 << 20, 8, 32
#: Bytes of a long document worked on at once.
LONG_BYTES = 4 << 20
#: Bytes of text that one task stands for: several buckets, met one after the other.
TASK_BYTES = 64 << 20
#: Keys, and members with their bytes, that a task remembers; those beyond are sent once a batch.
SIGHTS, KEPT = 1 << 19, 1 << 15

# kinds: all windows repeat; to sort with its anchor; hot, or a window to sort by itself; said to be equal by its hashes
DUP, CAND, WINDOW, CHECK = 1, 2, 3, 4
_MARK = np.dtype([("at", "<u4"), ("lo", "u1"), ("hi", "u1"), ("kind", "u1")])  # windows at - lo to at - hi
_ENTRY = np.dtype([("anchor", "<u8"), ("content", "<u8"), ("doc", "<u4"), ("at", "<u4"), ("lo", "u1"), ("hi", "u1"), ("hot", "u1")])
_NULL_ID = -(1 << 63)


def find_anchors(c: Chunk, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: text, anchor position, first and last window (in the chunk's buffer), anchor and content hash."""
    n = len(c.data)
    empty = np.zeros(0, np.int64)
    span = width - gram + 1
    if n < width:
        return empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    ph = PrefixHash(c.data, 2)
    at = np.arange(n - gram + 1)
    code = (mix(ph.of(at, at + gram)) >> np.uint64(24) << np.uint64(24)) | at.astype(np.uint64)
    size = 1
    while size * 2 <= span:
        code = np.minimum(code[:-size], code[size:])
        size *= 2
    if size < span:
        code = np.minimum(code[: len(code) - (span - size)], code[span - size :])
    # code[p]: least over the k-grams of window p
    owner = np.repeat(np.arange(c.n), np.diff(c.offs))[: len(code)]
    p = np.flatnonzero(np.arange(len(code)) + width <= c.offs[owner + 1])
    if not len(p):
        return empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    m = (code[p] & np.uint64((1 << 24) - 1)).astype(np.int64)
    doc = owner[p]
    new = np.concatenate([[True], (m[1:] != m[:-1]) | (doc[1:] != doc[:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    lo, hi, m, doc = p[first], p[last], m[first], doc[first]
    with np.errstate(over="ignore"):
        anchor = mix(ph.of(m, m + gram))
    return doc, m, lo, hi, anchor, content_hash(ph, m, lo, hi, width)


def content_hash(ph: PrefixHash, m: np.ndarray, lo: np.ndarray, hi: np.ndarray, width: int) -> np.ndarray:
    """A hash of the bytes of members and of where the anchor stands in them."""
    with np.errstate(over="ignore"):
        return mix(ph.of(lo, hi + width) + ((m - lo) * 256 + (m - hi)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _parts(c: Chunk, width: int) -> Iterator[tuple[Chunk, int]]:
    """The chunk itself, or overlapping parts of a long text with their offsets: each window lies in just one part."""
    if c.n > 1 or len(c.data) <= LONG_BYTES:
        yield c, 0
        return
    for base in range(0, len(c.data), LONG_BYTES - width + 1):
        data = c.data[base : base + LONG_BYTES]
        if len(data) >= width:
            yield Chunk(c.first, data, np.array([0, len(data)])), base


def _rows(columns: dict[str, list], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in types.items()], list(types))


_MOVED = {"bucket": pa.int32(), "doc_id": pa.int64(), "h": pa.int64(), "docs": pa.binary(), "blob": pa.binary()}
_MOVED_SQL = "bucket int, doc_id long, h long, docs binary, blob binary"
_INFO_SQL = "doc_id long, h long, blob binary"


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Where each run of equal neighbours begins and ends."""
    if not len(values):
        return []
    at = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])).tolist()
    return list(zip(at, [*at[1:], len(values)], strict=True))


def _send(out: dict[str, list], entries: np.ndarray, ids: np.ndarray, key: str, buckets: int) -> None:
    """Add the entries to ``out``, a row for each bucket, with the keys of the documents they name."""
    to = (entries[key] % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((entries["doc"], to))
    entries, to = entries[order], to[order]
    doc, runs = entries["doc"].copy(), _runs(to)
    new = np.ones(len(doc), bool)
    new[1:] = (to[1:] != to[:-1]) | (doc[1:] != doc[:-1])
    nth = np.append(np.cumsum(new) - 1, new.sum())  # the documents of all rows, one row's after another's
    named, size = ids[doc[new]].tobytes(), entries.itemsize
    first = np.array([a for a, _ in runs], np.int64)
    entries["doc"] = nth[:-1] - np.repeat(nth[first], [b - a for a, b in runs])
    whole = entries.tobytes()
    out["bucket"] += to[first].tolist()
    out["doc_id"] += [0] * len(runs)
    out["h"] += [0] * len(runs)
    out["docs"] += [named[16 * nth[a] : 16 * nth[b]] for a, b in runs]
    out["blob"] += [whole[size * a : size * b] for a, b in runs]


def _tell(out: dict[str, list], doc: np.ndarray, marks: np.ndarray, ids: np.ndarray, buckets: int | None = None) -> None:
    """Add marks to ``out``, a row for each document."""
    order = np.argsort(doc, kind="stable")
    doc, whole, size = doc[order], marks[order].tobytes(), marks.itemsize
    runs = _runs(doc)
    keys = ids[doc[[a for a, _ in runs]]].tolist() if runs else []
    out["doc_id"] += [k for k, _ in keys]
    out["h"] += [h for _, h in keys]
    out["blob"] += [whole[size * a : size * b] for a, b in runs]
    if buckets is not None:
        out["bucket"] += [(h ^ k) % buckets for k, h in keys]
        out["docs"] += [None] * len(runs)


def _marks(at: np.ndarray, lo: np.ndarray, hi: np.ndarray, kind) -> np.ndarray:
    out = np.zeros(len(at), _MARK)
    out["at"], out["lo"], out["hi"], out["kind"] = at, lo, hi, kind
    return out


def _firsts(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row order by the keys, and where the first key's values, or the first two's, begin anew (bits 1 and 2)."""
    order = np.lexsort(keys[::-1])
    a, b = keys[0][order], keys[1][order]
    new = np.zeros(len(order), np.uint8)
    if len(order):
        new[0] = 3
        da = a[1:] != a[:-1]
        new[1:] = da * np.uint8(1) + (da | (b[1:] != b[:-1])) * np.uint8(2)
    return order, new


def _ranks(ids: np.ndarray) -> np.ndarray:
    """The place of each document in corpus order."""
    order = np.lexsort((ids[:, 1], ids[:, 0]))
    out = np.empty(len(ids), np.int64)
    new = np.concatenate([[0], np.cumsum((ids[order][1:] != ids[order][:-1]).any(1))]) if len(ids) else np.zeros(0, np.int64)
    out[order] = new
    return out


class _Sights:
    """What a task has sent already: the keys (a, b), the first place in corpus order of each, and how often (up to twice).

    Only the first ``SIGHTS`` keys are remembered; a key of many documents is met early. One that is
    not remembered is sent each time, so what is found does not depend on it.
    """

    def __init__(self) -> None:
        self.seen = np.zeros(0, [("a", "<u8"), ("b", "<u8"), ("doc_id", "<i8"), ("h", "<i8"), ("at", "<u4"), ("n", "u1")])

    def meet(self, a: np.ndarray, b: np.ndarray, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of distinct keys: which were sent for two places, one of them earlier, and which for this same place (of a repeated row).

        What comes before all that was sent is not among them: the first of equals must reach its bucket.
        """
        if not len(self.seen):
            known = np.zeros(len(a), bool)
            late, same = known, known.copy()
        else:
            i = np.minimum(np.searchsorted(self.seen["a"], a), len(self.seen) - 1)
            had = self.seen[i]
            known = (had["a"] == a) & (had["b"] == b)
            same, before = np.ones(len(a), bool), np.zeros(len(a), bool)
            for k, here in (("doc_id", ids[:, 0]), ("h", ids[:, 1]), ("at", at)):
                before |= same & (here < had[k])
                same &= here == had[k]
            same &= known
            late = known & ~same & ~before & (had["n"] > 1)
            self.seen["n"][i[known & ~same]] = 2
            new = known & before
            self.seen["doc_id"][i[new]], self.seen["h"][i[new]], self.seen["at"][i[new]] = ids[new, 0], ids[new, 1], at[new]
        fresh = np.flatnonzero(~known)[: max(0, SIGHTS - len(self.seen))]
        if len(fresh):
            more = np.zeros(len(fresh), self.seen.dtype)
            more["a"], more["b"], more["doc_id"], more["h"], more["at"], more["n"] = a[fresh], b[fresh], ids[fresh, 0], ids[fresh, 1], at[fresh], 1
            both = np.concatenate([self.seen, more])
            self.seen = both[np.argsort(both["a"], kind="stable")]
        return late, same


class _Kept:
    """Members whose bytes a task has sent: of each key the first in corpus order, at most ``KEPT`` keys (others are sent each time)."""

    def __init__(self) -> None:
        self.members: dict[tuple, tuple] = {}

    def meet(self, c: Chunk, e: np.ndarray, at: np.ndarray, ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Which members are to be sent, and which hold the bytes of an earlier one that was sent; a repeated row's are neither."""
        send, later = np.ones(len(e), bool), np.zeros(len(e), bool)
        content = e["content"].tolist() if "content" in e.dtype.names else [0] * len(e)
        places = zip(e["anchor"].tolist(), content, e["lo"].tolist(), e["hi"].tolist(), ids[e["doc"]].tolist(), e["at"].tolist(), at.tolist(), strict=True)
        for i, (anchor, what, lo, hi, (doc_id, h), place, x) in enumerate(places):
            key, here = (anchor, what, lo, hi), (doc_id, h, place)
            had = self.members.get(key)
            if had is None and len(self.members) >= KEPT:
                continue
            text = c.data[x - lo : x - hi + width].tobytes()
            if had is not None and had[1] == text and had[0] <= here:
                send[i], later[i] = False, had[0] < here
            elif had is None or had[1] == text:
                self.members[key] = (here, text)
        return send, later


def _sketch(width: int, gram: int, buckets: int):
    """Step 1 over documents: entries to the anchors' buckets, and marks of what is known already."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, met_hot = _Sights(), _Sights()
        for batch in batches:
            keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1)
            for whole in chunks(batch, "text", BATCH_BYTES):
                ids = keys[whole.first : whole.first + whole.n]
                rank = _ranks(ids)
                for c, base in _parts(whole, width):
                    doc, m, lo, hi, anchor, content = find_anchors(c, width, gram)
                    if not len(m):
                        continue
                    start = c.offs[doc]
                    e = np.zeros(len(m), _ENTRY)
                    e["anchor"], e["content"], e["doc"], e["at"] = anchor, content, doc, m - start + base
                    e["lo"], e["hi"] = m - lo, m - hi
                    order, new = _firsts(e["anchor"], e["content"], rank[doc], e["at"])
                    e = e[order]
                    lead = (new & 2) > 0  # the first of its anchor and content
                    group = np.cumsum(new & 1) - 1
                    contents = np.bincount(group[lead], minlength=group[-1] + 1)[group]
                    out = {k: [] for k in _MOVED}
                    hot = contents > HOT_HERE
                    e["hot"] = hot
                    # a repeated row is the same document: its members repeat nothing
                    lead_at = np.maximum.accumulate(np.where(lead, np.arange(len(e)), 0))
                    same = (rank[e["doc"]] == rank[e["doc"][lead_at]]) & (e["at"] == e["at"][lead_at])
                    rows = np.flatnonzero(~lead & ~same)
                    equal = _equal_members(c.data, e, c.offs[e["doc"]] + e["at"] - base, rows, lead_at[rows], width)
                    apart = np.concatenate([rows[~equal], lead_at[rows[~equal]]])  # a collision of hashes: all ways to meet others stay open
                    direct = np.flatnonzero(hot & lead)
                    send = lead & (~hot | ((new & 1) > 0))
                    first = np.flatnonzero(send & ~hot)
                    late, again = met.meet(e["content"][first], e["anchor"][first], ids[e["doc"][first]], e["at"][first])
                    send[first[late | again]] = False
                    late = first[late]  # two members of this content meet in the bucket; this one meets them when their bytes do
                    first = np.flatnonzero(send & hot)
                    known, again = met_hot.meet(e["anchor"][first], np.zeros(len(first), np.uint64), ids[e["doc"][first]], e["at"][first])
                    send[first[known | again]] = False  # the bucket knows the anchor as hot; its windows are marked here
                    kind = np.repeat([DUP, WINDOW, CAND, WINDOW, CHECK], [int(equal.sum()), len(direct), len(apart), len(apart), len(late)])
                    rows = np.concatenate([rows[equal], direct, apart, apart, late])
                    _tell(out, e["doc"][rows].astype(np.int64), _marks(e["at"][rows], e["lo"][rows], e["hi"][rows], kind), ids, buckets)
                    _send(out, e[send], ids, "anchor", buckets)
                    yield _rows(out, _MOVED)

    return run


def _gathered(pdf: pd.DataFrame, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All entries of a bucket and the keys of their documents."""
    entries, ids, n = [], [], 0
    for docs, blob in zip(pdf["docs"], pdf["blob"], strict=True):
        d = np.frombuffer(docs, "<i8").reshape(-1, 2)
        e = np.frombuffer(blob, dtype).copy()
        e["doc"] += n
        n += len(d)
        entries.append(e)
        ids.append(d)
    return (np.concatenate(entries), np.concatenate(ids)) if entries else (np.zeros(0, dtype), np.zeros((0, 2), np.int64))


def _passed(pdf: pd.DataFrame, out: dict[str, list]) -> pd.DataFrame:
    """The marks that only passed through the bucket, and those that it found."""
    found = pd.DataFrame({k: pd.Series(v, dtype=object if k == "blob" else "int64") for k, v in out.items()})
    through = pdf.loc[pdf["docs"].isna(), ["doc_id", "h", "blob"]].astype({"doc_id": "int64", "h": "int64"})
    return pd.concat([through, found], ignore_index=True)


def _meet(pdf: pd.DataFrame) -> pd.DataFrame:
    """Step 1 in a bucket: which members repeat as a whole, and which windows are still to be told apart."""
    out = {k: [] for k in ("doc_id", "h", "blob")}
    e, ids = _gathered(pdf[pdf["docs"].notna()], _ENTRY)
    if len(e):
        rank = _ranks(ids)
        order, new = _firsts(e["anchor"], e["content"], rank[e["doc"]], e["at"])
        e = e[order]
        lead = (new & 2) > 0
        group = np.cumsum(new & 1) - 1
        contents = np.bincount(group[lead], minlength=group[-1] + 1)
        hot = (np.bincount(group, weights=e["hot"], minlength=group[-1] + 1) > 0) | (contents > HOT)
        kind = np.where(lead, np.where(hot[group], WINDOW, np.where(contents[group] > 1, CAND, 0)), CHECK)
        lead_at = np.maximum.accumulate(np.where(lead, np.arange(len(e)), 0))
        same = (rank[e["doc"]] == rank[e["doc"][lead_at]]) & (e["at"] == e["at"][lead_at])
        kind[~lead & same] = 0
        rows = np.flatnonzero(kind)
        leads = np.unique(lead_at[kind == CHECK])
        kind = np.concatenate([kind[rows], np.full(len(leads), CHECK)])
        rows = np.concatenate([rows, leads])
        _tell(out, e["doc"][rows].astype(np.int64), _marks(e["at"][rows], e["lo"][rows], e["hi"][rows], kind), ids)
    return _passed(pdf, out)


def _equal_members(data: np.ndarray, e: np.ndarray, at: np.ndarray, x: np.ndarray, y: np.ndarray, width: int, block: int = 8192) -> np.ndarray:
    """Which members x hold the bytes of members y, rows of ``e`` with their anchors at ``at`` in ``data``."""
    out = (e["lo"][x] == e["lo"][y]) & (e["hi"][x] == e["hi"][y])
    first = at - e["lo"]
    size = e["lo"].astype(np.int64) - e["hi"] + width
    for i in range(0, len(x), block):
        a, b = x[i : i + block], y[i : i + block]
        step = np.arange(int(size[a].max()))
        last = len(data) - 1
        same = data[np.minimum(first[a, None] + step, last)] == data[np.minimum(first[b, None] + step, last)]
        out[i : i + block] &= (same | (step >= size[a, None])).all(1)
    return out


_HASHED = np.dtype([("anchor", "<u8"), ("doc", "<u4"), ("at", "<u4")])


def _flat(blobs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The marks of all blobs in one array, and where each blob's begin and end."""
    if not len(blobs):
        return np.zeros(0, _MARK), np.zeros(1, np.int64)
    blobs = blobs.cast(pa.large_binary())
    offs = np.frombuffer(blobs.buffers()[1], np.int64, len(blobs) + 1, 8 * blobs.offset)  # a slice may hold the whole array's data
    data = np.frombuffer(blobs.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]]
    return data.view(_MARK), (offs - offs[0]) // _MARK.itemsize


def _read_marks(blobs: pa.ListArray) -> list[np.ndarray]:
    """The marks of each list of blobs, each once, in order; a null list has none."""
    size = blobs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    m, ends = _flat(blobs.flatten())
    stop = ends[np.cumsum(size)]
    owner = np.repeat(np.arange(len(blobs)), np.diff(stop, prepend=0))
    key = m["at"].astype(np.uint64)
    for field in ("lo", "hi", "kind"):
        key = key << np.uint64(8) | m[field]
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    key, owner = key[new], owner[new]
    low = lambda k: (key >> np.uint64(k)) & np.uint64(255)
    return np.split(_marks(key >> np.uint64(24), low(16), low(8), low(0)), np.searchsorted(owner, np.arange(1, len(blobs))))[: len(blobs)]


def _spread(marks: np.ndarray) -> np.ndarray:
    """All window starts of the marks."""
    n = marks["lo"].astype(np.int64) - marks["hi"] + 1
    first = marks["at"].astype(np.int64) - marks["lo"]
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(first, n) + step


def _marked_chunks(batch: pa.RecordBatch) -> Iterator[tuple[Chunk, np.ndarray, list[np.ndarray]]]:
    """Chunks of a batch (doc_id, h, text, blobs), the documents' keys and marks."""
    keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1)
    for c in chunks(batch, "text", BATCH_BYTES):
        yield c, keys[c.first : c.first + c.n], _read_marks(batch.column(3).slice(c.first, c.n))


def _hash_windows(width: int, buckets: int):
    """Step 2 over documents with hot marks: the windows' hashes, each once a batch and twice a task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = _Sights()
        for batch in batches:
            for c, ids, marks in _marked_chunks(batch):
                doc, at = [], []
                for i, m in enumerate(marks):
                    p = np.unique(_spread(m[m["kind"] == WINDOW]))
                    at.append(p)
                    doc.append(np.full(len(p), i))
                doc, at = np.concatenate(doc), np.concatenate(at).astype(np.int64)
                if not len(at):
                    continue
                rank = _ranks(ids)
                place = c.offs[doc] + at
                e = np.zeros(len(at), _HASHED)
                e["anchor"], e["doc"], e["at"] = mix(PrefixHash(c.data, 3).of(place, place + width)), doc, at
                order, new = _firsts(e["anchor"], rank[doc], e["at"])
                e = e[order]
                lead = (new & 1) > 0
                # of windows that occur again here, the first and the others are all to be sorted
                again = np.zeros(len(e), bool)
                again[:-1] |= ~lead[1:]
                again |= ~lead
                first = np.flatnonzero(lead)
                late, same = met.meet(e["anchor"][first], np.zeros(len(first), np.uint64), ids[e["doc"][first]], e["at"][first])
                again[first[late]] = True
                lead[first[late | same]] = False
                out = {k: [] for k in _MOVED}
                rows = np.flatnonzero(again)
                zero = np.zeros(len(rows), np.uint8)
                _tell(out, e["doc"][rows].astype(np.int64), _marks(e["at"][rows], zero, zero, WINDOW), ids, buckets)
                _send(out, e[lead], ids, "anchor", buckets)
                yield _rows(out, _MOVED)

    return run


def _meet_windows(pdf: pd.DataFrame) -> pd.DataFrame:
    """Step 2 in a bucket: the hot windows whose hash occurs again."""
    out = {k: [] for k in ("doc_id", "h", "blob")}
    e, ids = _gathered(pdf[pdf["docs"].notna()], _HASHED)
    if len(e):
        order, new = _firsts(e["anchor"], e["doc"], e["at"])
        e = e[order]
        lead = (new & 1) > 0
        again = ~lead
        again[:-1] |= ~lead[1:]
        rows = np.flatnonzero(again)
        zero = np.zeros(len(rows), np.uint8)
        _tell(out, e["doc"][rows].astype(np.int64), _marks(e["at"][rows], zero, zero, WINDOW), ids)
    return _passed(pdf, out)


_CLAIM = np.dtype([("anchor", "<u8"), ("content", "<u8"), ("doc", "<u4"), ("at", "<u4"), ("lo", "u1"), ("hi", "u1")])


def _ship(out: dict[str, list], c: Chunk, e: np.ndarray, at: np.ndarray, ids: np.ndarray, width: int, buckets: int) -> None:
    """Add members with their bytes to ``out``, a row for each bucket of their anchors."""
    to = (e["anchor"] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    for a, b in _runs(to[order]):
        rows = order[a:b]
        part = e[rows]
        docs, part["doc"] = np.unique(part["doc"], return_inverse=True)
        text = b"".join(c.data[x - l : x - h + width].tobytes() for x, l, h in zip(at[rows].tolist(), part["lo"].tolist(), part["hi"].tolist(), strict=True))
        for k, v in (("bucket", int(to[rows[0]])), ("doc_id", 0), ("h", 0), ("docs", ids[docs].tobytes()), ("blob", len(part).to_bytes(8, "little") + part.tobytes() + text)):
            out[k].append(v)


def _shipped(pdf: pd.DataFrame, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The members that met in a bucket, the keys of their documents, and their bytes in one buffer."""
    entries, ids, texts, n = [np.zeros(0, dtype)], [np.zeros((0, 2), np.int64)], [np.zeros(0, np.uint8)], 0
    sent = pdf[pdf["docs"].notna()]
    for docs, blob in zip(sent["docs"], sent["blob"], strict=True):
        k = int.from_bytes(blob[:8], "little")
        e = np.frombuffer(blob, dtype, k, 8).copy()
        d = np.frombuffer(docs, "<i8").reshape(-1, 2)
        e["doc"] += n
        n += len(d)
        entries.append(e)
        ids.append(d)
        texts.append(np.frombuffer(blob, np.uint8, offset=8 + k * dtype.itemsize))
    return np.concatenate(entries), np.concatenate(ids), np.concatenate(texts)


def _compared(data: np.ndarray, e: np.ndarray, at: np.ndarray, rank: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of members of one anchor and content hash: those that hold the bytes of the first, those that do not, and the firsts of these."""
    order, new = _firsts(e["anchor"], e["content"], rank, e["at"])
    lead_at = order[np.maximum.accumulate(np.where((new & 2) > 0, np.arange(len(order)), 0))]
    other = (rank[order] != rank[lead_at]) | (e["at"][order] != e["at"][lead_at])
    rows, leads = order[other], lead_at[other]
    equal = _equal_members(data, e, at, rows, leads, width)
    return rows[equal], rows[~equal], np.unique(leads[~equal])


def _claims(width: int, gram: int, buckets: int):
    """Step 1 over documents with members said to be equal: their bytes, once where they are equal in a batch or to what the task has kept."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _Kept()
        for batch in batches:
            for c, ids, marks in _marked_chunks(batch):
                doc = np.repeat(np.arange(c.n), [len(m) for m in marks])
                m = np.concatenate(marks)
                if not len(m):
                    continue
                ph = PrefixHash(c.data, 2)
                at = c.offs[doc] + m["at"]
                e = np.zeros(len(m), _CLAIM)
                e["anchor"], e["content"] = mix(ph.of(at, at + gram)), content_hash(ph, at, at - m["lo"], at - m["hi"], width)
                e["doc"], e["at"], e["lo"], e["hi"] = doc, m["at"], m["lo"], m["hi"]
                rows, _, _ = _compared(c.data, e, at, _ranks(ids)[doc], width)
                send = np.ones(len(e), bool)
                send[rows] = False
                rest = np.flatnonzero(send)
                send[rest], later = kept.meet(c, e[rest], at[rest], ids, width)
                rows = np.concatenate([rows, rest[later]])
                out = {k: [] for k in _MOVED}
                _tell(out, doc[rows], _marks(e["at"][rows], e["lo"][rows], e["hi"][rows], DUP), ids, buckets)
                _ship(out, c, e[send], at[send], ids, width, buckets)
                yield _rows(out, _MOVED)

    return run


def _verify(width: int):
    """Step 1 in a bucket: members that hold the bytes of the first repeat; where hashes collide, all ways to meet others stay open."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = {k: [] for k in ("doc_id", "h", "blob")}
        e, ids, data = _shipped(pdf, _CLAIM)
        if len(e):
            size = e["lo"].astype(np.int64) - e["hi"] + width
            at = np.cumsum(size) - size + e["lo"]
            equal, apart, leads = _compared(data, e, at, _ranks(ids)[e["doc"]], width)
            apart = np.concatenate([apart, leads])
            rows = np.concatenate([equal, apart, apart])
            kind = np.repeat([DUP, CAND, WINDOW], [len(equal), len(apart), len(apart)])
            _tell(out, e["doc"][rows].astype(np.int64), _marks(e["at"][rows], e["lo"][rows], e["hi"][rows], kind), ids)
        return _passed(pdf, out)

    return run


_BYTES = np.dtype([("anchor", "<u8"), ("doc", "<u4"), ("at", "<u4"), ("lo", "u1"), ("hi", "u1"), ("lone", "u1")])


def _bring_bytes(width: int, gram: int, buckets: int):
    """Step 3 over documents: the bytes around each member still to be told apart."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _Kept()
        for batch in batches:
            for c, ids, marks in _marked_chunks(batch):
                doc = np.concatenate([np.full(len(m), i) for i, m in enumerate(marks)])
                m = np.concatenate(marks)
                keep = m["kind"] != DUP
                doc, m = doc[keep], m[keep]
                if not len(m):
                    continue
                ph = PrefixHash(c.data, 2)
                lone = m["kind"] == WINDOW
                at = c.offs[doc] + m["at"]
                e = np.zeros(len(m), _BYTES)
                with np.errstate(over="ignore"):
                    e["anchor"] = mix(ph.of(at, at + np.where(lone, width, gram)) + lone.astype(np.uint64))
                e["doc"], e["at"], e["lo"], e["hi"], e["lone"] = doc, m["at"], m["lo"], m["hi"], lone
                # equal lone windows of one batch: only the first goes, the others repeat it (compared byte by byte)
                rank = _ranks(ids)[doc]
                order, new = _firsts(e["anchor"], lone, rank, e["at"])
                e, at, lone, rank = e[order], at[order], lone[order], rank[order]
                lead_at = np.maximum.accumulate(np.where((new & 1) > 0, np.arange(len(e)), 0))
                rows = np.flatnonzero(lone & ((rank != rank[lead_at]) | (e["at"] != e["at"][lead_at])))
                out = {k: [] for k in _MOVED}
                rows = rows[_equal_bytes(c.data, at[rows], at[lead_at[rows]], width)]
                send = np.ones(len(e), bool)
                send[rows] = False
                rest = np.flatnonzero(send & lone)  # also those that the task has sent from a batch before
                send[rest], later = kept.meet(c, e[rest], at[rest], ids, width)
                rows = np.concatenate([rows, rest[later]])
                zero = np.zeros(len(rows), np.uint8)
                _tell(out, e["doc"][rows].astype(np.int64), _marks(e["at"][rows], zero, zero, DUP), ids, buckets)
                _ship(out, c, e[send], at[send], ids, width, buckets)
                yield _rows(out, _MOVED)

    return run


def _equal_bytes(data: np.ndarray, x: np.ndarray, y: np.ndarray, width: int, block: int = 65536) -> np.ndarray:
    """Which windows at x and y hold the same bytes."""
    out = np.ones(len(x), bool)
    step = np.arange(width)
    for i in range(0, len(x), block):
        out[i : i + block] = (data[x[i : i + block, None] + step] == data[y[i : i + block, None] + step]).all(1)
    return out


def common_extension(ph: PrefixHash, x: np.ndarray, y: np.ndarray, limit: int) -> np.ndarray:
    """How many bytes the strings at x and y share, up to ``limit``: binary search over prefix hashes."""
    got = np.zeros(len(x), np.int64)
    step = 1 << (limit.bit_length() - 1)
    while step:
        longer = np.flatnonzero(got + step <= limit)
        a, b = x[longer] + got[longer], y[longer] + got[longer]
        got[longer[ph.of(a, a + step) == ph.of(b, b + step)]] += step
        step >>= 1
    return got


def suffix_sort(data: np.ndarray, starts: np.ndarray, segment: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by segment, then by their first ``limit`` bytes, and the extension each shares with the one before.

    A bottom-up mergesort of all segments at once; every element finds its rank in the run beside
    its own by binary search, and each comparison is a ``common_extension``. Neighbours said to be
    equal are compared byte by byte; a segment with a hash collision is sorted anew by its bytes.
    All suffixes must have ``limit`` bytes.
    """
    ph = PrefixHash(data, 4)
    order = np.argsort(segment, kind="stable")
    seg = segment[order]
    n = len(order)
    if not n:
        return order, np.zeros(0, np.int64)
    base = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
    length = np.diff(np.append(base, n))
    place = np.arange(n) - np.repeat(base, length)  # in its segment
    total = np.repeat(length, length)
    start = np.repeat(base, length)
    run = 1
    while run < length.max():
        at = np.flatnonzero(total > run)
        k = place[at] // run
        mine = start[at] + k * run
        left = k % 2 == 0
        other = np.where(left, mine + run, mine - run)
        stop = np.minimum(start[at] + total[at], other + run)
        lo, hi = np.minimum(other, stop), stop.copy()
        first = lo.copy()
        me = starts[order[at]]
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) // 2
            x, y = me[open_], starts[order[mid]]
            same = common_extension(ph, x, y, limit)
            inside = np.minimum(same, limit - 1)
            less = np.where(same >= limit, ~left[open_], data[y + inside] < data[x + inside])  # the other goes first
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        to = np.minimum(mine, np.where(left, mine, other)) + (at - mine) + (lo - first)
        moved = order[at]
        order[to] = moved
        run *= 2
    shared = np.zeros(n, np.int64)
    inner = np.flatnonzero(place > 0)
    shared[inner] = common_extension(ph, starts[order[inner - 1]], starts[order[inner]], limit)
    full = inner[shared[inner] >= limit]
    wrong = full[~_equal_bytes(data, starts[order[full - 1]], starts[order[full]], limit)]
    for b in np.unique(start[wrong]):
        stop = b + int(total[b])
        text = {i: data[starts[i] : starts[i] + limit].tobytes() for i in order[b:stop]}
        order[b:stop] = sorted(order[b:stop], key=lambda i: (text[i], i))
        shared[b] = 0
        for j in range(b + 1, stop):
            u, v = text[order[j - 1]], text[order[j]]
            shared[j] = next((k for k in range(limit) if u[k] != v[k]), limit)
    return order, shared


def _sort_bucket(width: int):
    """Step 3 in a bucket: sort the suffixes of equal anchors; all but the first of equals repeat."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = {k: [] for k in ("doc_id", "h", "blob")}
        e, ids, data = _shipped(pdf, _BYTES)
        if len(e):
            windows = e["lo"].astype(np.int64) - e["hi"] + 1
            sizes = windows + width - 1
            member = np.repeat(np.arange(len(e)), windows)
            step = np.arange(len(member)) - np.repeat(np.cumsum(windows) - windows, windows)
            starts = (np.cumsum(sizes) - sizes)[member] + step
            back = e["lo"][member].astype(np.int64) - step  # the anchor's place in the window
            with np.errstate(over="ignore"):
                key = mix(e["anchor"][member] + back.astype(np.uint64))
            at = e["at"][member].astype(np.int64) - back
            rank = _ranks(ids)[e["doc"][member]]
            _, segment, count = np.unique(key, return_inverse=True, return_counts=True)
            some = np.flatnonzero(count[segment] > 1)
            order, shared = suffix_sort(data, starts[some], segment[some], width)
            order = some[order]
            klass = np.cumsum(shared < width)
            by = np.lexsort((at[order], rank[order], klass))
            row, k = order[by], klass[by]
            lead = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
            lead_at = np.maximum.accumulate(np.where(lead, np.arange(len(k)), 0))
            later = (rank[row] != rank[row[lead_at]]) | (at[row] != at[row[lead_at]])
            row = row[later]
            zero = np.zeros(len(row), np.uint8)
            _tell(out, e["doc"][member[row]].astype(np.int64), _marks(at[row], zero, zero, DUP), ids)
        return _passed(pdf, out)

    return run


def _cut_texts(width: int):
    """Step 4: remove the bytes that repeating windows cover."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, _, marks in _marked_chunks(batch):
                n_bytes, removed, spans, digest, kept = np.diff(c.offs), [], [], [], []
                for i, m in enumerate(marks):
                    text = c.data[c.offs[i] : c.offs[i + 1]]
                    m = m[m["kind"] == DUP]
                    if len(m):
                        edge = np.zeros(len(text) + 1, np.int32)
                        first = m["at"].astype(np.int64) - m["lo"]
                        np.add.at(edge, first, 1)
                        np.add.at(edge, m["at"].astype(np.int64) - m["hi"] + width, -1)
                        gone = np.cumsum(edge[:-1]) > 0
                        removed.append(int(gone.sum()))
                        spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                        text = text[~gone]
                    else:
                        removed.append(0)
                        spans.append(0)
                    rest = text.tobytes()
                    kept.append(rest)
                    digest.append(hashlib.sha256(rest).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(c.first, c.n), pa.array(n_bytes), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    return run


def remove_repeats(documents: DataFrame, width: int = WIDTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` (the bytes that stay).

    A text is its UTF-8 bytes, null counts as empty, and no window crosses texts. Corpus order is
    (doc_id, start), a null id first. Rows that repeat id and text are one document and are not held
    against each other; rows that share only the id are ordered by a hash of their text. Texts
    shorter than ``width`` bytes stay whole. Removal may split a character, so ``kept`` is binary.
    Other columns are ignored, whatever their names.
    """
    if not gram < width <= gram + 255:
        raise ValueError("gram must be less than width, and width at most gram + 255")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = documents.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(size // BUCKET_BYTES) + 1  # by the input alone
    tasks = max(int(size // TASK_BYTES) + 1, min(buckets, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    wide = buckets // 2 + 1  # windows come without their bytes; fewer buckets tell a document in fewer rows
    bucketed = lambda df: df.repartition(tasks, "bucket").groupBy("bucket")

    dealt = docs.repartition(tasks, "doc_id", "h")
    marked = lambda info, how: dealt.join(info.groupBy("doc_id", "h").agg(F.collect_list("blob").alias("blobs")), ["doc_id", "h"], how).select("doc_id", "h", "text", "blobs")
    only = lambda info, *kinds: info.mapInArrow(_only(kinds), _INFO_SQL)

    said = bucketed(docs.mapInArrow(_sketch(width, gram, buckets), _MOVED_SQL)).applyInPandas(_meet, _INFO_SQL)
    said = cut(said, "anchors")
    verified = bucketed(marked(only(said, CHECK), "inner").mapInArrow(_claims(width, gram, buckets), _MOVED_SQL)).applyInPandas(_verify(width), _INFO_SQL)
    verified = cut(verified, "verified")
    found = said.union(verified)
    hashed = bucketed(marked(only(found, WINDOW), "inner").mapInArrow(_hash_windows(width, wide), _MOVED_SQL)).applyInPandas(_meet_windows, _INFO_SQL)
    hashed = cut(hashed, "windows")
    todo = only(found, CAND).union(hashed)
    sorted_ = bucketed(marked(todo, "inner").mapInArrow(_bring_bytes(width, gram, buckets), _MOVED_SQL)).applyInPandas(_sort_bucket(width), _INFO_SQL)
    sorted_ = cut(sorted_, "sorted")
    last = cut(only(found, DUP).union(sorted_), "repeats")
    drop(said, verified, hashed, sorted_)
    rows = marked(last, "left").mapInArrow(_cut_texts(width), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return rows.withColumn("doc_id", F.when(F.col("doc_id") != _NULL_ID, F.col("doc_id")))


def _only(kinds: tuple[int, ...]):
    """The marks of some kinds."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, ends = _flat(batch.column(2))
            keep = np.isin(marks["kind"], kinds)
            so_far = np.concatenate([[0], np.cumsum(keep)])[ends]
            rows = np.flatnonzero(np.diff(so_far))
            offs = np.append(0, so_far[1:][rows]).astype(np.int32) * _MARK.itemsize
            blobs = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offs), pa.py_buffer(marks[keep].tobytes())])
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), blobs], ["doc_id", "h", "blob"])

    return run
