"""Training samples of any number of languages, scores in slices, and pages whose elements stay open."""

import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import language
from tallyloom.llm.html import main_text, parse, path_features, trained
from tallyloom.llm.language import LanguageModel, fit_language_model, training_sample
from tallyloom.llm.textbuf import Chunk


def test_every_language_of_a_large_corpus_is_learned(spark, monkeypatch):
    for name, n in (("SAMPLE_LANGUAGE", 1), ("SAMPLE_LEAST", 1), ("SAMPLE_ROWS", 4)):
        monkeypatch.setattr(language, name, n)
    kind = F.element_at(F.array(*map(F.lit, ("de", "en", "es", "fr"))), (F.col("id") % 4 + 1).cast("int"))
    docs = spark.range(3_000_000).select(F.col("id").alias("doc_id"), F.concat(kind, F.lit(" text")).alias("text"), kind.alias("lang"))
    assert sorted(r["lang"] for r in training_sample(docs).collect()) == ["de", "en", "es", "fr"]


def test_a_language_of_one_text_among_many_is_learned(spark):
    docs = spark.range(100_000).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"), F.concat(F.lit("l"), (F.col("id") % 49).cast("string")).alias("lang"))
    for k in range(8):  # whatever the hash of its id
        rare = spark.createDataFrame([(10**6 + i, "rare words", "rare") for i in range(3 * k, 3 * k + 3)], "doc_id long, text string, lang string")
        rare = rare.where(~language.in_fold(F.col("doc_id"))).limit(1)
        got = training_sample(docs.union(rare)).groupBy("lang").count().collect()
        n = {r["lang"]: r["count"] for r in got}
        assert len(n) == 50 and n["rare"] == 1 and set(n.values()) == {1, language.SAMPLE_ROWS // 50}


def test_the_sample_is_the_least_hashes(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_BYTES", 40)
    monkeypatch.setattr(language, "SAMPLE_LANGUAGE", 20)
    rows = [(i, f"text {i} " * (1 + 9 * (i % 2)), "a" if i % 3 else "b") for i in range(900)] + [(5000 + i, "long " * 50, "c") for i in range(4)] + [(None, "t", "d"), (9000, None, "e"), (9001, "t", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    picked = training_sample(docs).collect()
    hashed = docs.where(~language.in_fold(F.col("doc_id"))).withColumn("u", F.xxhash64("doc_id", F.lit(3))).collect()
    for lang in "ab":
        want = sorted((r["u"], r["text"]) for r in hashed if r["lang"] == lang and len(r["text"]) <= 40)[:20]
        assert sorted((r["u"], r["text"]) for r in picked if r["lang"] == lang) == want
    assert {len(r["text"]) for r in picked if r["lang"] == "c"} == {10} and {r["lang"] for r in picked} == set("abcd")
    monkeypatch.setattr(language, "SAMPLE_LANGUAGES", 2)
    assert {r["lang"] for r in training_sample(docs).collect()} == {"a", "b"}
    assert training_sample(docs.limit(0)).collect() == [] and fit_language_model(docs.limit(0)).languages == []


def test_scores_do_not_depend_on_slices(monkeypatch):
    rng = np.random.default_rng(0)
    model = LanguageModel(rng.normal(0, 1, (language.BUCKETS, 19)).astype(np.float32), rng.normal(0, 1, 19), [f"l{i}" for i in range(19)], 1.3, 0.1)
    texts = ["", "ab", "hello there world", "x " * 500, "", "last é text"]
    data = [t.encode() for t in texts]
    c = Chunk(0, np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    whole = model.probabilities(c)
    one = np.concatenate([model.probabilities(Chunk(0, np.frombuffer(d, np.uint8), np.array([0, len(d)]))) for d in data])
    assert np.allclose(whole, one)
    monkeypatch.setattr(language, "SCORE_POSITIONS", 7)
    monkeypatch.setattr(language, "SCORE_LANGUAGES", 3)
    assert np.allclose(model.probabilities(c), whole)


UNITS = ["<div>x", "<ul><li>x", "<font>x<br>", "x<svg>", "<svg></b>", "<font>x</b>", "<div class='w{}'>x", "<p><b>x", "<template><p>x", "<a>x"]


@pytest.mark.parametrize("unit", UNITS)
def test_elements_that_stay_open(unit):
    """Time and memory in proportion to the page."""
    page = lambda n: "".join(unit.replace("{}", str(i)) for i in range(n))
    crf = trained()
    began = time.process_time()
    main_text(page(100_000), crf)
    assert time.process_time() - began < 15
    tracemalloc.start()
    blocks = parse(page(10_000))
    assert tracemalloc.get_traced_memory()[1] < 50e6
    tracemalloc.stop()
    assert len(blocks) in (0, 1, 10_000)


def test_features_of_a_path():
    (b,) = parse("<html class='post'><body><main><div class='nav menu'><div class='nav'><p>x</p></div></div></main></body></html>")
    assert path_features(b.path) == ("depth:4", "host:main", "in:div", "in:main", "in:p", "kind:nav", "leaf:p", "word:menu", "word:nav")
    (b,) = parse("<body class='content'><font>x")
    assert path_features(b.path) == ("depth:0", "host:named:clean", "in:font", "leaf:")
    first, second = parse("<div class=a>x</div><div class=a>y</div>")
    assert path_features(first.path) == path_features(second.path)
