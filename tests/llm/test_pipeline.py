"""Each stage of the pipeline on its own, on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tallyloom.llm.language import fit_language_model, identify

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the quick brown fox jumps over the lazy dog and then it runs away from the big house on the hill while the sun goes down slowly"
DE = "der schnelle braune fuchs springt über den faulen hund und läuft dann vom großen haus auf dem hügel weg während die sonne langsam sinkt"


def words(n, seed):
    return " ".join(f"w{(k * 7919 + seed * 104729) % 9973}" for k in range(n))


ROWS = [
    (1, EN, "en", "a"), (2, DE, "de", "a"), (3, None, "en", "a"), (4, "", None, "b"), (5, "12 34 !", "en", "b"), (6, EN + "\nmore lines here", "en", None),
    (7, words(60, 1), "en", "b"), (8, words(60, 1).replace("w5", "x5", 1), "en", "b"), (9, words(60, 1), "en", "c"), (9, words(60, 1), "en", "c"), (10, words(30_000, 2), "en", "c"),
    (None, EN, "en", "a"), (None, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, g, s, None if t is None else len(t)) for d, t, g, s in ROWS], SCHEMA)


@pytest.mark.parametrize("stage", [f for _, f in P.STAGES[:-1]], ids=[n for n, _ in P.STAGES[:-1]])
def test_stages_keep_the_columns_and_take_odd_tables(spark, docs, sf, stage):
    out = stage(spark, docs, sf)
    assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema]
    assert out.count() <= docs.count()
    assert stage(spark, docs.limit(0), sf).collect() == []
    more = docs.withColumns({"row": F.lit(1), "keep": F.lit("x"), "epoch": F.lit(2), "score": F.lit(0.5)})
    assert stage(spark, more, sf).columns == more.columns


def test_language_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(-1, None, "en", "s", None), (-2, "", "en", "s", 0), (-3, "12 + 3", "en", "s", 6)], docs.schema)
    both = docs.union(odd)
    kept = {r["doc_id"] for r in P.language_id(spark, both, sf).collect()}
    want = {r["id"] for r in identify(both, fit_language_model(both), columns=["doc_id"]).where("NOT rejected").select(F.col("row.doc_id").alias("id")).collect()}
    assert kept == want and not kept & {-1, -2, -3}
    assert len(kept) >= 0.95 * docs.where(F.col("text").rlike(r"\p{L}")).count()


def test_line_stage(spark, docs, sf):
    out = {(r["doc_id"], r["text"]): r["n_chars"] for r in P.line_dedup(spark, docs, sf).collect()}
    assert out[6, "more lines here"] == 15  # its first line repeats document 1's
    assert (1, EN) in out and (None, EN) in out and (3, None) in out and (4, "") in out
    assert out[9, ""] == 0 and (7, words(60, 1)) in out


def test_near_dup_stage(spark, docs, sf):
    kept = [r["doc_id"] for r in P.near_dedup(spark, docs, sf).collect()]
    assert 7 in kept and 8 not in kept and 9 not in kept
    assert kept.count(None) == 2 and {1, 2, 3, 4, 5, 10} <= set(kept)
    twice = docs.where("doc_id = 9")
    assert [r["doc_id"] for r in P.near_dedup(spark, twice, sf).collect()] == [9]


def test_mixing_stage(spark, docs, sf):
    out = P.mix_sources(spark, docs, sf)
    size = lambda df: df.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] or 0
    assert size(out) <= size(docs) * P.MIX_PERCENT // 100
    assert out.where("text IS NULL OR text = ''").count() == 0


def test_whole_run(spark, sf):
    rows = P.run(spark, sf).collect()
    assert rows and {"doc_id", "piece", "start", "length", "sequence_id", "offset"} <= set(rows[0].asDict())
    known = {r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    assert {r["doc_id"] for r in rows} <= known
