import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm.packing import TokenizerFiles, best_fit, default_tokenizer, encoder, exact_patterns, pack_documents, plan_packing


def check_packed(rows, texts, limit):
    """Every id in place once, sequences within the limit and without gaps."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(default_tokenizer().json)
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by_doc) == set(texts)
    for doc, text in texts.items():
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        parts = sorted(by_doc[doc], key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(len(parts)))
        for r in parts:
            assert r["start"] == at and 1 <= r["length"] <= limit
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
        assert len(parts) == -(-len(ids) // limit)
        assert all(r["length"] == limit for r in parts[1:])
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    return len(by_seq)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r[0]: r[1] for r in docs.select("doc_id", "text").collect()}
    rows = pack_documents(docs).collect()
    n = check_packed(rows, texts, 2048)
    hist = np.bincount([r["length"] for r in rows], minlength=2049)
    assert n <= best_fit(hist, 2048, 0)[1]


def test_edges(spark):
    texts = {1: None, 2: "", 3: "word " * 700, 4: "a", 5: "a", 6: "ąć 漢字 \U0001f600 tail", 7: "x <|endoftext|> y", 8: "line\n\n\tend  "}
    docs = spark.createDataFrame([(k, v, "x", 1) for k, v in texts.items()], "doc_id long, text string, length string, sequence_id int")
    assert check_packed(pack_documents(docs, limit=64).collect(), texts, 64)
    assert pack_documents(docs.limit(0)).collect() == []
    twice = pack_documents(docs.where("doc_id = 4").union(docs.where("doc_id = 4"))).collect()
    assert sorted(r["offset"] for r in twice) == [0, 2]


def test_null_id(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "c")], "doc_id long, text string")
    assert {r["doc_id"] for r in pack_documents(docs).collect()} == {None, 1}


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_close_to_the_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(512, rng.lognormal(4.5, 1, 20_000).astype(int) + 1)
    hist = np.bincount(lengths, minlength=513)
    plan, n = plan_packing(hist, 512)
    used = np.zeros(n, int)
    for length, _, count, per, seq, _ in plan.tolist():
        np.add.at(used, seq + np.arange(count) // per, length)
    assert plan[:, 2].sum() == len(lengths) and used.max() <= 512
    assert n <= -(-lengths.sum() // 512) + 8


def test_patterns_fill_exactly():
    hist = np.ones(33, int)
    p = exact_patterns(hist, 32)
    assert (p.sum(1) == 32).all() and len(np.unique(np.sort(p, 1), axis=0)) == len(p)


def test_encoder_matches_library(spark, sf):
    enc = encoder(default_tokenizer())
    for text in ["It's  a test—ok", "ÀÉ ñandú ß\r\n\x0b x", "12 345's 'S", "tab\t\ttab ", "ŉſ", "àb"]:
        assert enc.encode(text) == enc.exact.encode(text, add_special_tokens=False).ids
    assert isinstance(default_tokenizer(), TokenizerFiles)
    rows = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("text")).collect()
    assert all(enc.encode(r[0]) == enc.exact.encode(r[0], add_special_tokens=False).ids for r in rows[:60])
