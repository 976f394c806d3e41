import hashlib
import random

import numpy as np
import pytest

from tallyloom.llm import substrings
from tallyloom.llm.substrings import remove_repeats, suffix_sort


def brute(rows, width=100):
    """Removed bytes by a table of all windows, in corpus order."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - width + 1):
            s = b[p : p + width]
            if s in seen:
                gone[p : p + width] = True
            seen.add(s)
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(b) else 0
        out[d] = (len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


def digest(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


def corpus(seed):
    rng = random.Random(seed)
    passage = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [passage(rng.choice([60, 99, 100, 101, 150, 400])) for _ in range(8)]
    rows = []
    for d in range(60):
        parts = [passage(rng.randint(0, 80)) if rng.random() < 0.5 else rng.choice(shared) for _ in range(rng.randint(0, 6))]
        rows.append((d, "".join(parts)))
    rows += [(60, "a" * 1000), (61, "ab" * 300), (62, "a" * 150), (63, rows[3][1]), (64, None), (65, "")]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed, monkeypatch):
    rows = corpus(seed)
    if seed == 3:  # many anchors count as hot
        monkeypatch.setattr(substrings, "HOT_HERE", 1)
        monkeypatch.setattr(substrings, "HOT", 1)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert digest(remove_repeats(df)) == brute(rows)


def test_equal_hashes_of_unequal_members(spark, monkeypatch):
    """Every content hash is the same: bytes alone tell the members of an anchor apart."""
    real = substrings.find_anchors

    def anchors(c, width, gram):
        *rest, content = real(c, width, gram)
        return *rest, np.zeros_like(content)

    def content(ph, m, lo, hi, width):
        return np.zeros(len(m), np.uint64)

    monkeypatch.setattr(substrings, "find_anchors", anchors)
    monkeypatch.setattr(substrings, "content_hash", content)
    rows = corpus(7)
    for parts in (1, 6):
        assert digest(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts))) == brute(rows)
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 4000)
    assert digest(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))) == brute(rows)


def test_long_document_in_parts(spark, monkeypatch):
    monkeypatch.setattr(substrings, "LONG_BYTES", 3000)
    monkeypatch.setattr(substrings, "BATCH_BYTES", 3000)
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh") for _ in range(9000))
    rows = [(1, text + text[1000:4000]), (2, text[2950:3200])]
    assert digest(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_edges(spark):
    one = "some words that are repeated " * 3 + "x" * 40
    df = spark.createDataFrame([(1, one, "b"), (1, one, "b"), (None, one, "b"), (2, "short", "b")], "doc_id long, text string, h string")
    out = [(r["doc_id"], r["n_removed"]) for r in remove_repeats(df).collect()]
    # a null id comes first, and repeated rows are one document
    assert sorted(out, key=str) == sorted([(1, len(one)), (1, len(one)), (None, 0), (2, 0)], key=str)
    twice = df.where("doc_id = 1")
    assert [(r["n_removed"], r["kept"]) for r in remove_repeats(twice).collect()] == [(0, one.encode())] * 2
    assert remove_repeats(df.limit(0)).collect() == []


def test_suffix_sort():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 2, 3000).astype(np.uint8)
    starts = rng.integers(0, 2900, 1500)
    segment = rng.integers(0, 5, 1500)
    order, shared = suffix_sort(data, starts, segment, 100)
    text = [data[s : s + 100].tobytes() for s in starts]
    key = [(segment[i], text[i]) for i in order]
    assert key == sorted(key)
    for j in range(1, len(order)):
        if segment[order[j]] == segment[order[j - 1]]:
            a, b = text[order[j - 1]], text[order[j]]
            assert shared[j] == next((k for k in range(100) if a[k] != b[k]), 100)
        else:
            assert shared[j] == 0


def of_many_batches():
    """A passage in hundreds of documents, in two contexts or in one of each's own; some rows come twice."""
    rng = random.Random(11)
    some = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, frame = some(320), [some(90), some(90)]
    rows = [(d, frame[d % 2] + passage + frame[d % 2] if d % 3 else some(90) + passage + some(90)) for d in range(150)]
    return rows + [rows[0], rows[0], rows[0], rows[7]]


@pytest.mark.parametrize("parts", [1, 4])
def test_what_a_task_has_sent_already(spark, monkeypatch, parts):
    """Every document is a batch: what was sent before is told apart without being sent."""
    monkeypatch.setattr(substrings, "BATCH_BYTES", 300)
    rows = of_many_batches()
    random.Random(parts).shuffle(rows)
    assert digest(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts))) == brute(sorted(set(rows)))


def test_hot_anchor_sends_a_bounded_number_of_entries(monkeypatch):
    """2,000 batches of one task that share a passage send it twice, and its bytes once."""
    import pyarrow as pa

    rng = random.Random(2)
    some = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = some(400)
    ids = np.arange(2000)
    texts = [some(50) + passage + some(50) for _ in ids]
    batches = [pa.record_batch({"doc_id": pa.array([i]), "h": pa.array([i]), "text": pa.array([t])}) for i, t in zip(ids, texts, strict=True)]

    def entries(out, dtype, skip=0):
        found = {}
        for b in out:
            for docs, blob in zip(b["docs"].to_pylist(), b["blob"].to_pylist(), strict=True):
                if docs is not None:
                    e = np.frombuffer(blob, dtype, int.from_bytes(blob[:8], "little") if skip else -1, skip)
                    for a, what in zip(e["anchor"].tolist(), e["content"].tolist(), strict=True):
                        found[a, what] = found.get((a, what), 0) + 1
        return found

    sent = entries(substrings._sketch(100, 32, 4)(batches), substrings._ENTRY)
    assert max(sent.values()) == 2
    doc, m, lo, hi, *_ = substrings.find_anchors(substrings.Chunk(0, np.frombuffer(texts[0].encode(), np.uint8), np.array([0, 500])), 100, 32)
    inside = (lo >= 60) & (hi + 100 <= 440)
    assert inside.any()

    def marks(text):
        _, m, lo, hi, *_ = substrings.find_anchors(substrings.Chunk(0, np.frombuffer(text.encode(), np.uint8), np.array([0, 500])), 100, 32)
        keep = (lo >= 60) & (hi + 100 <= 440)
        return substrings._marks(m[keep], (m - lo)[keep], (m - hi)[keep], substrings.CHECK).tobytes()

    claimed = [b.append_column("blobs", pa.array([[marks(t)]], pa.list_(pa.binary()))) for b, t in zip(batches, texts, strict=True)]
    assert set(entries(substrings._claims(100, 32, 4)(claimed), substrings._CLAIM, 8).values()) == {1}
    random.Random(3).shuffle(claimed)  # out of corpus order, those that come before all that were sent are sent too
    assert max(entries(substrings._claims(100, 32, 4)(claimed), substrings._CLAIM, 8).values()) < 30


def test_members_beyond_the_memory_of_a_task(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BATCH_BYTES", 300)
    monkeypatch.setattr(substrings._Kept, "meet", lambda self, c, e, at, ids, width: (np.ones(len(e), bool), np.zeros(len(e), bool)))
    monkeypatch.setattr(substrings._Sights, "meet", lambda self, a, b, ids, at: (np.zeros(len(a), bool), np.zeros(len(a), bool)))
    rows = of_many_batches()[:60]
    assert digest(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))) == brute(rows)


def test_small_rows_of_marks_cost_no_call_each():
    """Marks come as one small row a document and bucket; to filter and to read them takes no Python step a row."""
    import time

    import pyarrow as pa

    from tallyloom.llm import substrings as S

    n = 200_000
    rng = np.random.default_rng(3)
    marks = S._marks(rng.integers(0, 50, 2 * n), np.full(2 * n, 9), np.full(2 * n, 2), rng.integers(1, 5, 2 * n))
    blobs = pa.array([marks[2 * i : 2 * i + 2].tobytes() for i in range(n)], pa.binary())
    ids = pa.array(np.arange(n))
    batch = pa.RecordBatch.from_arrays([ids, ids, blobs], ["doc_id", "h", "blob"])
    began = time.process_time()
    found = list(S._only((S.DUP, S.CHECK))([batch.slice(0, n // 2), batch.slice(n // 2), batch.slice(0, 0)]))
    lists = pa.ListArray.from_arrays(pa.array([0, *range(4, n + 1, 4)], pa.int32()), blobs)
    read = S._read_marks(lists.slice(1))
    assert time.process_time() - began < 2
    keep = np.isin(marks["kind"], (S.DUP, S.CHECK)).reshape(-1, 2)
    assert np.concatenate([b.column(0).to_numpy() for b in found]).tolist() == np.flatnonzero(keep.any(1)).tolist()
    assert b"".join(x.as_py() for b in found for x in b.column(2)) == marks[keep.ravel()].tobytes()
    for i in range(0, len(read), 997):
        assert [tuple(x) for x in read[i].tolist()] == sorted({tuple(x) for x in marks[8 * (i + 1) : 8 * (i + 2)].tolist()})
    empty = S._read_marks(pa.array([None, [], [marks[:1].tobytes()]], pa.list_(pa.binary())))
    assert [len(x) for x in empty] == [0, 0, 1] and not len(S._read_marks(pa.array([], pa.list_(pa.binary()))))
