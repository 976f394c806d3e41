"""Centroid clustering, hard negatives and benchmark decontamination against brute force, on odd rows too."""

import hashlib
import random
import re

import numpy as np
import pytest

from tallyloom.llm import contamination
from tallyloom.llm.centroids import centroid_hash, cluster, fit_centroids, nearest, tables
from tallyloom.llm.contamination import benchmark_windows, contaminated, fingerprint_filter
from tallyloom.llm.negatives import fields_of, hard_negatives, packed_scores

ODD = [(900, None), (901, [1.0, None, 0.0, 0.0]), (902, [float("nan")] * 4), (903, [1.0]), (904, []), (905, [float("inf"), 0.0, 0.0, 0.0])]


def brute_clusters(rows, k, rounds, dim, scale):
    kept = [(i, [int(np.floor(scale * np.float64(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in first]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))[::-1] for _, v in kept]

    for _ in range(rounds):
        of = assigned()
        for n in range(len(centroids)):
            mine = [v for (_, v), (c, _) in zip(kept, of) if c == n]
            if mine:
                centroids[n] = [sum(col) // len(mine) for col in zip(*mine)]
    of = assigned()
    total = sum(d for _, d in of)
    return sorted((str(i), c, d, sum(e for b, e in of if b == c), total, tuple(centroids[c])) for (i, _), (c, d) in zip(kept, of))


def test_clusters(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in rng.normal(0, 1, 4).round(1)]) for i in range(200)]
    rows += ODD + [(None, [0.1, 0.2, 0.3, 0.4]), (7, [5.0, 5.0, 5.0, 5.0]), (7, rows[7][1]), (8, rows[8][1])]
    df = spark.createDataFrame([(i, v, 3, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, total string").repartition(5)
    got = cluster(df, k=6, rounds=3, dim=4, scale=16)
    assert sorted((str(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], tuple(r["centroid"])) for r in got.collect()) == brute_clusters(rows, 6, 3, 4, 16)
    assert cluster(df.limit(0), dim=4).collect() == [] and cluster(df.where("vec_id > 899"), dim=4).collect() == []
    few = cluster(df.where("vec_id < 3"), k=6, dim=4).collect()
    assert len(few) == 3 and {r["distance"] for r in few} == {0}
    assert centroid_hash(np.array([-1, 2])) == hashlib.sha256(b"-1,2").hexdigest()


def test_clusters_of_ties_copies_and_great_numbers(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(50)], "vec_id int, embedding array<double>")
    got = cluster(same, k=4, dim=2, scale=1)
    assert {(r["cluster"], r["distance"]) for r in got.collect()} == {(0, 0)} and got.schema["vec_id"].dataType.simpleString() == "int"
    great = [(i, [float(x), 0.5]) for i, x in enumerate((2.0**40, 2.0**40 + 3, -(2.0**41), 1.0, 2.0))]
    df = spark.createDataFrame(great, "vec_id int, embedding array<double>")
    c = fit_centroids(df, 2, 2, 2, 1)
    for _, best, d in nearest(np.array([[int(v[0]), 0] for _, v in great]), c):
        assert [int(x) for x in d] == [min(sum((a - b) ** 2 for a, b in zip((int(v[0]), 0), row)) for row in c.tolist()) for _, v in great]
    assert max(r["distance"] for r in cluster(df, 1, 1, 2, 1).collect()) == (1 << 63) - 1  # cut to 64 bits


@pytest.mark.parametrize("top", [5, 1 << 20])
def test_tables_hold_what_occurs(top):
    v = np.random.default_rng(1).integers(-top, top, (40, 3))
    c = np.random.default_rng(2).integers(-top, top, (5, 3))
    table, at = tables(v, c)
    assert len(table) == sum(len(set(v[:, d].tolist())) for d in range(3))
    assert (table[at].sum(1) == ((v[:, None] - c[None]) ** 2).sum(2)).all()


@pytest.mark.parametrize("top", [1, 9, 300, 1 << 24, 1 << 33, 1 << 62])
def test_packed_scores(top):
    rng = np.random.default_rng(top % 97)
    a, x = rng.integers(-top, top + 1, (7, 6)), rng.integers(-top, top + 1, (301, 6))
    want = [[min(max(sum(p * q for p, q in zip(r, c)), -(1 << 63)), (1 << 63) - 1) for c in x.tolist()] for r in a.tolist()]
    assert packed_scores(a, x).tolist() == want
    assert packed_scores(a[:0], x).shape == (0, 301) and packed_scores(a, x[:0]).shape == (7, 0)
    low = packed_scores(np.full((1, 6), top), np.full((3, 6), -top)).tolist()  # every field at an end of its range
    assert low == [[max(-6 * top * top, -(1 << 63))] * 3]


def test_several_candidates_share_a_wide_integer():
    a = np.random.default_rng(0).integers(0, 512, (4, 64))
    assert 53 // fields_of(a, a) >= 2


def brute_negatives(rows, every, positives, negatives, low, high, scale):
    ok = [(i, lab, tuple(int(np.floor(scale * np.float64(np.float32(x)))) for x in v)) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    ok = sorted(set(ok))
    out = []
    for i, lab, v in ok:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in ok if j != i and len(w) == len(v))
        for s, p, _ in [z for z in scored if z[2] == lab][:positives]:
            inside = [(t, j) for t, j, m in scored if m != lab and low * -s <= 100 * -t <= high * -s][:negatives]
            out += [(i, p, r + 1, j, -s, -t) for r, (t, j) in enumerate(inside)]
    return sorted(out)


def test_hard_negatives(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), int(rng.integers(0, 4)) if i % 3 else 0, [float(x) for x in rng.normal(0.3, 1, 4).round(1)]) for i in range(300)]
    rows += [(i, 0, v) for i, v in ODD] + [(None, 0, [1.0] * 4), (950, None, [1.0] * 4), (1000, 1, [0.0] * 4), (1050, 2, [2.0, 2.0]), (1051, 2, [3.0, 3.0]), (1052, 1, [2.0, 2.0]), (11, *rows[11][1:]), (50, *rows[50][1:])]
    df = spark.createDataFrame([(i, lab, v, 1, "k") for i, lab, v in rows], "vec_id long, label int, embedding array<float>, rank int, key string").repartition(3)
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_negatives(rows, 50, 5, 3, 50, 95, 16)
    for size in (16384, 40):
        got = hard_negatives(df, scale=16, candidates=size, anchors=max(2, size // 20))
        assert got.columns == columns and sorted(tuple(r) for r in got.collect()) == want
    assert len(want) > 30 and hard_negatives(df.limit(0)).collect() == [] and hard_negatives(df.where("vec_id % 50 > 0")).collect() == []
    words = df.withColumn("label", df["label"].cast("string"))
    assert sorted(tuple(r) for r in hard_negatives(words, scale=16).collect()) == want


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute_contamination(docs, items, size=10):
    windows = {}
    for i, t in items:
        w = WORD.findall(low(t))
        if i is not None and w:
            n = min(size, len(w))
            for k in range(len(w) - n + 1):
                windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    lengths = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w = WORD.findall(low(t))
        hit, found = set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= x
        out.append((str(d), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def digest(df):
    return sorted((str(r["doc_id"]), *r[1:]) for r in df.select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())


def corpus(seed, vocabulary):
    rng = random.Random(seed)
    say = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.choice([1, 2, 3, 5, 8, 9, 10, 11, 15, 40]) if len(vocabulary) > 9 else rng.choice([9, 10, 12, 30]))) for i in range(40)]
    docs = []
    for d in range(120):
        parts = [say(rng.randrange(0, 40))]
        for _ in range(rng.randrange(0, 3)):
            w = rng.choice(items)[1].split()
            a = rng.randrange(len(w))
            parts += [" ".join(w[a : a + rng.randrange(1, 20)]).upper(), say(rng.randrange(0, 9))]
        docs.append((d, " ".join(parts)))
    return docs, items


@pytest.mark.parametrize("seed, vocabulary", [(1, [f"w{i}" for i in range(400)]), (2, ["a", "b"]), (3, ["é", "ß", "Ab9", "x", "日本", "k"])])
def test_contamination(spark, seed, vocabulary):
    docs, items = corpus(seed, vocabulary)
    docs += [(None, docs[0][1]), (5, docs[5][1]), (5, items[9][1]), (700, None), (701, ""), (702, "-- \0 ..."), (703, " ".join(t for _, t in items) * 20)]
    items += [(None, "null item words that nothing may count as they have no id"), (3, items[4][1]), (41, items[7][1]), (42, None), (43, ""), (44, "..."), (7, items[7][1])]
    df = spark.createDataFrame([(d, t, 1, "u", "r") for d, t in docs], "doc_id long, text string, n_words int, uid string, row string").repartition(4)
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, window string").repartition(3)
    out = contaminated(df, bench)
    assert digest(out) == brute_contamination(docs, items)
    for r in out.where("contaminated").collect():
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"] and r["items"] == sorted(set(r["items"])) and len(r["items"]) == r["n_items"]
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))
        assert r["row"]["uid"] == "u" and r["row"]["n_words"] == 1
    assert {r["n_hit"] for r in contaminated(df, bench.limit(0)).collect()} == {0} and contaminated(df.limit(0), bench).collect() == []


def test_a_full_filter_only_costs_time(spark, monkeypatch):
    """The filter lets everything through once its bits are all set; results are the same."""
    docs, items = corpus(6, [f"w{i}" for i in range(60)])
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    held, lengths = fingerprint_filter(benchmark_windows(bench))
    assert max(lengths) == 10 and held.nbytes == 1 << contamination.FILTER_BITS - 3
    monkeypatch.setattr(contamination, "fingerprint_filter", lambda w: (np.full_like(held, 2**64 - 1), lengths))
    assert digest(contaminated(df, bench)) == brute_contamination(docs, items)


def test_many_copies_of_documents_and_items(spark):
    """A passage that all documents and all items hold: windows and lists of items are held once."""
    passage = " ".join(f"p{i}" for i in range(30))
    docs = [(d, f"d{d} {passage} tail") for d in range(400)]
    items = [(i, f"head{i} {passage}") for i in range(200)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert benchmark_windows(bench).count() == 21 + 200
    assert digest(contaminated(df, bench)) == brute_contamination(docs, items)
