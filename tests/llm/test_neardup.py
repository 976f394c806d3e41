import random
import re

import numpy as np
import pytest

from tallyloom.llm import neardup
from tallyloom.llm.components import connected_components
from tallyloom.llm.neardup import _binary, _matrix, near_duplicates


def sets_of(text, size):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def brute(rows, size, percent):
    ids = [d for d, _ in rows]
    sets = [sets_of(t, size) for _, t in rows]
    root = {d: d for d in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(ids[i]), find(ids[j])))
                root[b] = a
    return {d: (len(s), find(d)) for d, s in zip(ids, sets)}


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(300)]
    originals = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 120))] for _ in range(25)]
    rows = []
    for d in rng.sample(range(1000), n):
        words = list(rng.choice(originals))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary).upper()
        rows.append((d, rng.choice([" ", "\n", "\t "]).join(words)))
    return rows


@pytest.mark.parametrize(("seed", "size", "percent"), [(1, 3, 85), (2, 5, 80)])
def test_against_all_pairs(spark, seed, size, percent):
    rows = corpus(seed)
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=size, percent=percent).collect()
    expected = brute(rows, size, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == expected
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


@pytest.mark.parametrize("block", [2, 6])
def test_long_open_lists(spark, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "LONG", block)
    monkeypatch.setattr(neardup, "BUCKET_ROWS", 50)
    if block == 2:
        monkeypatch.setattr(neardup, "CENTRES", 0)
    rows = corpus(5, 200)
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=3, percent=85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute(rows, 3, 85)


def test_many_representatives_in_one_partition(spark):
    rng = random.Random(7)
    rows = []
    for pair in range(2000):
        words = ["p%d" % pair if rng.random() < 0.3 else "v%d" % rng.randrange(5000) for _ in range(60)]
        rows.append((pair, " ".join(words)))
        words[30] = "other"
        rows.append((10_000 + pair, " ".join(words)))
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), size=3, percent=85).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == {d: d % 10_000 for d, _ in rows}


def test_slices_keep_their_rows():
    rows = np.arange(3000 * 4, dtype=np.uint32).reshape(-1, 4)
    for first in (0, 1024, 2048):
        part = _binary(rows).slice(first, 1024)
        assert (_matrix(part, 4) == rows[first : first + 1024]).all()


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one two three"), (8, "x " * 20000), (8, "x " * 20000), (None, "one"), (9, "é b c d")]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, n_shingles int, key string")
    out = near_duplicates(df, size=3, percent=85).collect()
    assert len(out) == len(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in out}
    assert got[1] == (0, 1, True) and got[2] == (0, 2, True) and got[3] == (0, 3, True)
    assert got[4] == (1, 4, True) and got[5] == (1, 4, False) and got[6] == (1, 6, True) and got[8] == (1, 8, True)
    assert got[None][1:] == (None, True)
    assert near_duplicates(df.limit(0)).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (50, 100), (7, 7), (60, 61), (61, 50), (None, 3)]
    out = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert out == {**{i: 1 for i in range(1, 41)}, 50: 50, 100: 50, 60: 50, 61: 50}


def test_pairs_that_are_apart_are_not_joined(spark, monkeypatch):
    """A large group of texts that are 69 percent alike: few of its pairs come to the join with full sets, no link is lost."""
    rng = random.Random(11)
    base = ["w%d" % i for i in range(100)]
    rows = []
    for d in range(240):
        words = list(base)
        for i in rng.sample(range(100), 3 if d % 8 else 1):
            words[i] = "x%d" % rng.randrange(10**6)
        rows.append((d, " ".join(words)))
    joined, confirm = [], neardup._confirm

    def counted(pairs, percent):
        joined.append(pairs.count())
        return confirm(pairs, percent)

    monkeypatch.setattr(neardup, "_confirm", counted)
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=3, percent=85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute(rows, 3, 85)
    assert joined[-1] < 100
