import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import lines as L
from tallyloom.llm.lines import SHINGLE, dedup_lines, line_groups, sketch


def shingles_of(x):
    return {x[i : i + SHINGLE] for i in range(max(1, len(x) - SHINGLE + 1))}


def brute(rows, percent=80):
    """First line of each line's group, by all pairs; products of hashed counts only rule out pairs that are surely apart."""
    lines = sorted((d, n, x.strip(" ")) for d, t in rows if t is not None and d is not None for n, x in enumerate(t.split("\n")) if x.strip())
    texts = sorted({x for _, _, x in lines})
    sets = [shingles_of(x) for x in texts]
    size = np.array([len(s) for s in sets], np.float32)
    cells = np.zeros((len(texts), 1024), np.float32)
    for k, s in enumerate(sets):
        np.add.at(cells[k], [hash(g) & 1023 for g in s], 1)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for a in range(0, len(texts), 512):
        most = cells[a : a + 512] @ cells.T
        for i, j in zip(*np.nonzero(100 * most >= percent * (size[a : a + 512, None] + size[None] - most)), strict=True):
            if (i := i + a) < j and find(i) != find(j):
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    group = {x: find(k) for k, x in enumerate(texts)}
    first = {}
    for d, n, x in lines:
        first.setdefault(group[x], (d, n))
    return {(d, n): first[group[x]] for d, n, x in lines if first[group[x]] != (d, n)}


def found_in(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {(r["doc_id"], r["n"]): (r["first_doc"], r["first_n"]) for r in line_groups(df).collect()}


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(60)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 30))) for _ in range(40)]
    rows = []
    for d in range(n):
        lines = []
        for _ in range(rng.randint(0, 5)):
            x = rng.choice(base)
            if rng.random() < 0.5:
                words = x.split(" ")
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
                x = " ".join(words)
            lines.append(x)
        rows.append((d, "\n".join(lines)))
    return rows


def templates(seed, kept, of=20, n=400):
    """Lines of one template of ``of`` words, ``kept`` of them fixed; every fifth nearly repeats an earlier one."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    fixed = [word() for _ in range(of)]
    free = sorted(rng.sample(range(of), of - kept))
    lines = []
    for k in range(n):
        if k % 5 == 4:
            x = rng.choice(lines) + rng.choice([" abcdefg", " ", " ponmlkjih"])
        else:
            words = list(fixed)
            for i in free:
                words[i] = word()
            x = " ".join(words)
        lines.append(x)
    return list(enumerate(lines))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rows = corpus(seed)
    found, expected = found_in(spark, rows), brute(rows)
    assert set(found) <= set(expected)  # every link is exact
    assert len(found) >= 0.99 * len(expected)


@pytest.mark.parametrize("kept", [12, 17, 18])
def test_templates(spark, kept, monkeypatch):
    """A list of mostly unlike lines: every pair of it is met, by rare shingles and further leads."""
    monkeypatch.setattr(L, "LONG", 16)
    rows = templates(kept, kept)
    found, expected = found_in(spark, rows), brute(rows)
    assert set(found) <= set(expected)
    assert len(found) >= 0.99 * len(expected)


def test_recall_on_documents(spark):
    """All lines of the 1,000 documents of sf0.01, against all pairs of lines."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    found = {(r["doc_id"], r["n"]): (r["first_doc"], r["first_n"]) for r in line_groups(docs).collect()}
    expected = brute(rows)
    assert set(found) <= set(expected)
    assert len(found) >= 0.99 * len(expected)
    near = {k for k, f in expected.items() if dict(rows)[k[0]].split("\n")[k[1]].strip(" ") != dict(rows)[f[0]].split("\n")[f[1]].strip(" ")}
    assert len(near & set(found)) >= 0.99 * len(near)


def test_edges(spark):
    long = "x" * 5000 + " tail of the long line"
    rows = [(None, "a line that is long enough"), (1, None), (2, ""), (3, "short\nshort\na line that is long enough\n" + long), (4, "a line that is long enough\nshort\n" + long), (4, "a line that is long enough\nshort\n" + long), (5, "a line that is long enough")]
    df = spark.createDataFrame([(*r, 0, "s") for r in rows], "doc_id long, text string, n int, row string")
    out = {(r["row"]["doc_id"], r["row"]["text"]): r for r in dedup_lines(df).collect()}
    assert out[rows[0]]["kept_text"] == rows[0][1]
    assert out[rows[1]]["kept_text"] is None and out[rows[1]]["n_lines"] == 0
    assert out[rows[2]]["kept_text"] == ""
    assert out[rows[3]]["n_removed"] == 1 and out[rows[3]]["kept_text"] == "short\na line that is long enough\n" + long
    assert out[rows[4]]["kept_text"] == "" and out[rows[4]]["n_removed"] == 3
    assert out[rows[6]]["kept_text"] == "" and out[rows[6]]["n_removed"] == 1
    assert len(out) == 6
    assert dedup_lines(df.limit(0)).collect() == []


def test_short_lines_and_other_scripts(spark):
    rows = [(1, "short\n\nshort\nshorter \n \n\t"), (2, "Short\n shorter\nnew\n\n\t"), (3, "。" * 19 + "\n" + "。" * 19 + "\n" + "漢字かな交じり文の一行である" + "\n" + "漢字かな交じり文の一行であろう"), (4, "漢字かな交じり文の一行である!")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["row"]["doc_id"]: r["kept_text"] for r in dedup_lines(df).collect()}
    assert out == {1: "short\n\nshorter \n \n\t", 2: "Short\nnew\n\n\t", 3: "。" * 19 + "\n" + "漢字かな交じり文の一行である" + "\n" + "漢字かな交じり文の一行であろう", 4: ""}


def test_sketch_of_repeated_shingles(spark):
    hashes = [h << 40 for h in (1, 2, 3)]
    df = spark.createDataFrame([([hashes[0]] * 40 + hashes[1:],), (hashes,)], "h array<long>").select(sketch(F.col("h")).alias("s"))
    one, other = [r["s"] for r in df.collect()]
    assert one == other and len(one) == 3


def test_template_pairs_make_few_rows(spark, monkeypatch):
    """Unlike lines of one template are told apart where they meet: few pairs come to be written, and few tables."""
    monkeypatch.setattr(L, "LONG", 16)
    rows, tables, write = templates(3, 14, n=600), [], L.cut
    monkeypatch.setattr(L, "cut", lambda df, name: tables.append((name, out := write(df, name), out.count())) or out)
    assert set(found_in(spark, rows)) <= set(brute(rows))
    assert sum(n for name, _, n in tables if name == "pairs") < 4 * len(rows)
    assert sum(name == "pairs" for name, _, _ in tables) <= 3
