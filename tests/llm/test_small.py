"""Top-k search, chat formatting, mixing, language ID, HTML extraction and quality rules."""

import random
import re
import time
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom.llm.chat import format_preferences, swapped_answers
from tallyloom.llm.html import extract_main_text, labelled_pages, main_text, parse, trained
from tallyloom.llm.language import LanguageModel, fit_language_model, identify, in_fold
from tallyloom.llm.mixing import leaf_budgets, mix
from tallyloom.llm.quality import RULES, apply_quality, measured, plan_rules
from tallyloom.llm.textbuf import chunks
from tallyloom.llm.topk import PIVOTS, choose_pivots, integer_vectors, search_block, top_k


def brute_top(rows, k=5, every=50):
    out = {}
    ok = [(i, np.floor(256 * np.array(v, float))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for i, v in ok:
        if i % every == 0:
            found = sorted({(-int(v @ w), j, tuple(w)) for j, w in ok if j != i and len(w) == len(v)})
            out[i] = [(j, -s) for s, j, _ in found[:k]]
    return out


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.normal(0, 1, 8).round(1)]) for i in range(300)]
    rows += [(400, None), (401, [1.0, None]), (402, [float("nan")] * 8), (None, [1.0] * 8), (450, [0.5, 0.5]), (451, [0.5, 1.0]), (500, []), (3, rows[3][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in top_k(df, candidates=64, queries=3).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    expected = {q: v for q, v in brute_top([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]).items() if v}
    assert {q: [v[k] for k in sorted(v)] for q, v in got.items()} == expected
    assert top_k(df.limit(0)).collect() == []


def test_search_stops_early_and_stays_exact():
    rng = np.random.default_rng(3)
    centres = rng.integers(-200, 200, (30, 6))
    x = (centres[rng.integers(0, 30, 4000)] + rng.integers(-2, 3, (4000, 6))).astype(float)
    x *= 256 / np.sqrt((x * x).sum(1))[:, None]
    x = np.floor(x)
    q = x[:40]
    ids = np.arange(4000)
    r, c, s, done = search_block(q, ids[:40], x, ids, choose_pivots(x[:500], 16), 5)
    for i in range(40):
        score = x @ q[i]
        score[i] = -np.inf
        want = np.lexsort((ids, -score))[:5]
        assert c[r == i].tolist() == want.tolist() and [int(v) for v, k in zip(s, r) if k == i] == score[want].astype(int).tolist()
    assert done < 0.7 * 40 * 4000
    big = x * 2.0**40
    r, c, s, _ = search_block(big[:2], ids[:2], big[:50], ids[:50], choose_pivots(big[:20], 4), 3)
    assert max(s) == max(sum(int(a) * int(b) for a, b in zip(big[0], big[j])) for j in range(1, 50)) or len(s) == 6


def test_share_evaluated_of_the_given_vectors(spark):
    """Bound order on the table's own vectors: exact, and some candidates are never evaluated."""
    rows = integer_vectors(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), "vec_id", "embedding").collect()
    x, ids = np.array([r["v"] for r in rows], float), np.array([r["id"] for r in rows])
    some = np.flatnonzero(ids % 50 == 0)[:64]
    r, c, s, done = search_block(x[some], ids[some], x, ids, choose_pivots(x[:2048], PIVOTS), 5)
    for i, q in enumerate(some):
        score = x @ x[q]
        score[ids == ids[q]] = -np.inf
        assert c[r == i].tolist() == np.lexsort((ids, -score))[:5].tolist()
    print(f"evaluated {done} of {len(some) * (len(x) - 1)}")
    assert done <= len(some) * len(x)


def test_preferences(spark):
    t = lambda *x: [{"role": r, "text": v} for r, v in x]
    a = t(("user", "hi"), ("assistant", "yes"), ("user", None), ("assistant", "a"))
    rows = [(1, a, t(("user", "hi"), ("assistant", "no"))), (2, a, a), (3, a, a[:2]), (4, None, []), (5, a, None)]
    df = spark.createDataFrame(rows, "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    out = {r["pair_id"]: r for r in format_preferences(df).collect()}
    assert (out[1]["n_common"], out[1]["prompt"]) == (1, "<|user|>\nhi<|end|>\n")
    learn = lambda text, spans: [text[s["start"] : s["end"]] for s in spans]
    assert learn(out[1]["chosen"], out[1]["chosen_mask"]) == ["yes<|end|>\n", "a<|end|>\n"]
    assert learn(out[1]["rejected"], out[1]["rejected_mask"]) == ["no<|end|>\n"]
    assert (out[2]["n_common"], out[2]["chosen"], out[2]["rejected"]) == (4, "", "")
    assert (out[3]["n_common"], out[3]["rejected"], out[3]["chosen_mask"][0]["end"]) == (2, "", len(out[3]["chosen"]))
    assert (out[4]["n_common"], out[4]["prompt"], out[4]["chosen_mask"]) == (0, "", [])
    assert out[5]["n_common"] == 0
    turns = spark.createDataFrame([(0, 0, "user", "q"), (0, 1, "assistant", "x"), (1, 0, "user", "p"), (1, 1, "assistant", "y"), (1, 2, "user", "z"), (2, 0, "user", "u"), (None, 0, "user", "n")], "conv_id long, turn long, role string, text string")
    pairs = {r["pair_id"]: [[x["text"] for x in r["chosen"]], [x["text"] for x in r["rejected"]]] for r in swapped_answers(turns).collect()}
    assert pairs == {0: [["q", "x"], ["q", "y"]], 1: [["p", "y"], ["p", "x"]]}


def test_mix_budgets(spark):
    # a/en is short of tokens: a/de takes over before b does
    rows = [(i, "w " * 10, "a", "en") for i in range(10)] + [(i, "w " * 10, "a", "de") for i in range(10, 110)] + [(i, "w " * 10, "b", None) for i in range(110, 310)] + [(900, None, "a", "en"), (901, " ", "b", "en")]
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, d string, l string, epoch int, row string")
    levels = {"d": F.col("d"), "l": F.col("l")}
    out = mix(df, levels, [{"a": 1, "b": 1}, {"en": 9, "de": 1}], budget_percent=50, epochs=2)
    per = {(r["d"], r["l"]): r["n"] for r in out.groupBy("d", "l").agg(F.sum("n_tokens").alias("n")).collect()}
    assert per == {("a", "en"): 200, ("a", "de"): 570, ("b", ""): 770}
    ids = out.select("row.doc_id", "epoch").collect()
    assert len(set(ids)) == len(ids) and {e for i, e in ids if i < 10} == {0, 1}
    assert [tuple(r) for r in mix(df, levels, [{}, {}], 50, 2).select("row.doc_id").orderBy("doc_id").collect()] == [tuple(r) for r in mix(df.repartition(7), levels, [{}, {}], 50, 2).select("row.doc_id").orderBy("doc_id").collect()]
    assert mix(df.limit(0), levels, [{}, {}]).collect() == []


def test_no_budget_is_lost_to_weight_0(spark):
    leaves = spark.createDataFrame([("a", "x", 100), ("a", "y", 10), ("b", "z", 1000)], "d string, l string, tokens long")
    out = leaf_budgets(leaves, ["d", "l"], [{"a": 9, "b": 1}, {"x": 0, "y": 1}], 60, 1).collect()
    assert {(r["d"], r["l"]): r["budget"] for r in out} == {("a", "x"): 0, ("a", "y"): 10, ("b", "z"): 656}
    none = leaf_budgets(leaves, ["d", "l"], [{"a": 0, "b": 1}, {"x": 1, "y": 1, "z": 0}], 60, 1).collect()
    assert {r["budget"] for r in none} == {0}


def test_mix_takes_ties_repeats_and_long_texts(spark):
    rows = [(1, "w " * 200_000, "a")] + [(2, "x " * 5, "a")] * 4 + [(k, "y " * 5, "a") for k in range(3, 40)] + [(None, "z " * 5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, d string")
    out = mix(df, {"d": F.col("d")}, [{}], budget_percent=50, epochs=1)
    per = {r["id"]: r["n"] for r in out.groupBy(F.col("row.doc_id").alias("id")).agg(F.count("*").alias("n")).collect()}
    assert per.get(2, 0) in (0, 4) and all(n == 1 for k, n in per.items() if k != 2)
    assert out.agg(F.sum("n_tokens")).first()[0] <= (200_000 + 42 * 5) // 2


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = fit_language_model(docs)
    out = identify(docs, model, columns=["doc_id", "lang"]).where(in_fold(F.col("row.doc_id")))
    good = out.select(F.avg((F.col("lang_pred") == F.col("row.lang")).cast("int"))).first()[0]
    assert good >= 0.97
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 +! 7", "x"), (4, "the " * 50_000, None), (None, "der die das und", "x")], "doc_id long, text string, score string")
    rows = identify(odd, model).collect()
    assert [(r["lang_pred"], r["score"], r["rejected"]) for r in rows[:3]] == [("und", 0.0, True)] * 3
    assert all(r["lang_pred"] in model.languages and 0 <= r["score"] <= 1 for r in rows[3:])
    none = fit_language_model(docs.where("false"))
    assert isinstance(none, LanguageModel) and {r["lang_pred"] for r in identify(odd, none).collect()} == {"und"}


def test_language_query_against_brute_force(spark, sf):
    """The fold, what is und, the labels and the range of scores, over the whole table."""
    from tallyloom.llm.queries import QUERIES

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op7_language_id"](spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        letters = any(unicodedata.category(x).startswith("L") for x in texts[r["doc_id"]] or "")
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1 and (letters or r["score"] == 0)
    assert {r["lang_pred"] for r in rows} <= {"en", "de", "fr", "es", "und"}


def test_language_of_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(k, t, g) for k, (t, g) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 30)], "doc_id long, text string, lang string")
    model = fit_language_model(docs)
    twice = spark.createDataFrame([(1, "die katze und der hund")] * 3, "doc_id long, text string")
    assert [r["lang_pred"] for r in identify(twice, model).collect()] == ["de"] * 3
    assert identify(twice.limit(0), model).collect() == []


def test_every_language_is_learned(spark):
    rows = [(i, "w%03d x%03d" % (i % 250, i % 250), "l%03d" % (i % 250)) for i in range(3000)]
    rows += [(5000 + i, "only long texts " * 1500, "long") for i in range(12)]
    model = fit_language_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(model.languages) == {r[2] for r in rows}


def test_html_on_unseen_layouts():
    crf = trained()
    n = good = 0
    for page, blocks, y in labelled_pages(200, seed=77):
        z = crf.decode(blocks)
        n += len(y)
        good += sum(a == b for a, b in zip(y, z))
    assert good / n > 0.98


def test_html_on_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    out = {r["page_id"]: r["text"] for r in extract_main_text(pages).collect()}
    for r in pages.collect():
        inner = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        import html

        parts = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]+>", "", x))).strip() for x in re.split(r"</?(?:p|h1|br)[^>]*>", inner)]
        assert out[r["page_id"]] == "\n".join(p for p in parts if p)


ONE = "The river rose again on Tuesday and the old bridge was closed to all traffic until further notice, the town council said in a short statement."
TWO = "Residents were asked to keep away from the banks. Two families left their homes as a precaution and stayed with relatives on the hill overnight."
CJK = "記者会見で市長は、川の水位が下がり次第、橋の点検を始めると述べた。点検には三日ほどかかる見込みだという。"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<html><head><title>x</title></head><body><div id='top'><ul><li><a href='/'>Home</a><li><a href='/n'>News</a></ul></div><article><h1>Bridge closed</h1><p>{ONE}<p>{TWO}<section class='comments'><h3>Comments</h3><div class='comment'><b>Ann</b><p>So sad, I walked there.</p><div class='comment reply'><p>Me too!</p></div></div></section></article><footer>Copyright 2024 Town Paper</footer></body></html>", f"Bridge closed\n{ONE}\n{TWO}"),
        (f"<body><nav><a href=a>Start</a> <a href=b>Sport</a></nav><main><article><h1>Bridge closed</h1><p>{ONE}<p>{TWO}<aside class=ad><p>Buy two, get one free!</aside></article></main><footer><p>Imprint | Privacy</footer>", f"Bridge closed\n{ONE}\n{TWO}"),
        (f"<body><header><a href=/>ホーム</a></header><article><h1>橋の点検</h1><p>{CJK}</p><p>{CJK}</p></article><footer>© 2024</footer></body>", f"橋の点検\n{CJK}\n{CJK}"),
    ],
    ids=["comments in the article", "unclosed, advert in the article", "no spaces"],
)
def test_html_written_by_hand(page, text):
    """Pages that share no code with the generator of the training pages."""
    assert main_text(page, trained()) == text


def test_html_of_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "u", f"<article><h1>Bridge closed</h1><p>{ONE}</p><p>{TWO}</p></article>")] * 3, "page_id long, url string, html string")
    assert [r["text"] for r in extract_main_text(df).collect()] == [f"Bridge closed\n{ONE}\n{TWO}"] * 3
    assert extract_main_text(df.limit(0)).collect() == []


def test_html_edges(spark):
    df = spark.createDataFrame([(1, "u", None, 1), (2, None, "", 1), (None, "u", "<", 1), (3, "u", "<p>a &amp; b\n\t c<p>d &#233;</p>" * 3, 1), (4, "u", "<article><p>x" + "y " * 50_000, 1)], "page_id long, url string, html string, text int")
    rows = extract_main_text(df).collect()
    assert [r["text"] for r in rows[:2]] == ["", ""] and rows[4]["n_chars"] == len(rows[4]["text"])
    assert [b.text for b in parse("<div>a<!-- x --><script>1<2</script> b<span> c</span><br>d</div>e &lt;p&gt;")] == ["a b c", "d", "e <p>"]
    assert main_text("<nav><a>home</a></nav><article><h1>T</h1><p>One.</p></article><footer>&copy; x</footer>", trained()) == "T\nOne."


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ('<p>one</p><svg-icon name="x"></svg-icon><p>two</p><video-player>three</video-player>', ["one", "two", "three"]),
        ('<p>one <svg viewBox="0"/> two</p><p>three</p>', ["one two", "three"]),
        ('<div><object data="x"><p>one</p></div><canvas><p>two</p><audio><p>three</p>', ["one", "two", "three"]),
        ("<p>one <svg><style/><title>no</title></svg> two</p><p>three<video><p>no</video></p>", ["one two", "three"]),
        ("<p>one</p><template><div>no</div></template><p>two</p><script>no</p>", ["one", "two"]),
    ],
)
def test_html_text_after_dropped_elements(page, texts):
    assert [b.text for b in parse(page)] == texts


def test_quality(spark):
    rng = random.Random(5)
    clean = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200))
    rows = [(1, clean), (2, None), (3, ""), (4, clean.replace(" ", " ### ")), (5, "one two three " * 100), (6, (clean + "\n") * 3), (7, clean.upper()), (8, "x" * 300_000), (None, clean)]
    df = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, kept boolean")
    out = {r["doc_id"]: r for r in apply_quality(df).collect()}
    assert out[1]["kept"] and out[None]["kept"] and out[1]["n_words"] == 200 and out[1]["word_chars"] == 1000
    assert not any(out[i]["kept"] for i in range(2, 9))
    assert out[2]["base_failed"] and out[5]["base_failed"] and out[4]["rejected_by"] == "symbols" and out[7]["rejected_by"] == "upper"
    assert out[6]["n_dup_lines"] == 2 and out[6]["n_repeat_words"] == 600
    reverse = {r["doc_id"]: r["kept"] for r in apply_quality(df, order=list(RULES)[::-1]).collect()}
    assert reverse == {k: r["kept"] for k, r in out.items()}
    assert apply_quality(df.limit(0)).collect() == []
    plan = plan_rules([clean, clean.replace(" ", " ### ")])
    assert sorted(p["rule"] for p in plan) == sorted(RULES) and plan[0]["gain"] >= plan[-1]["gain"]


def test_rules_are_ordered_by_what_is_left():
    cheap = lambda t: t.n_words > 60
    costly = lambda t: [time.sleep(0.02), t.n_words > 60][1]
    other = lambda t: [time.sleep(0.01), t.n_words == 55][1]
    texts = [" ".join(f"w{k}" for k in range(n)) for n in (55, 70, 80, 90)]
    plan = plan_rules(texts, {"costly": costly, "other": other, "cheap": cheap})
    assert [p["rule"] for p in plan] == ["cheap", "other", "costly"]  # alone, the costly rule rejects more for its cost
    assert [p["rejects_of_rest"] for p in plan] == [0.75, 1.0, 0.0]


def test_picked_texts_keep_their_words():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["a bc", "", "é  d\ne", "one two three", " x"])})
    c = next(chunks(batch, "text"))
    rows = np.array([0, 2, 4])
    picked, again = measured(c).pick(rows), measured(c.pick(rows))
    for f in ("starts", "ends", "owner", "n_words", "word_chars"):
        assert getattr(picked, f).tolist() == getattr(again, f).tolist()


def test_quality_of_repeated_rows(spark):
    rows = [(1, "a b c " * 30, 1)] * 3 + [(2, " ".join("x" + chr(97 + k % 26) * (k % 5 + 1) for k in range(60)), 1)] * 2
    out = apply_quality(spark.createDataFrame(rows, "doc_id long, text string, n_words int")).collect()
    assert sorted((r["doc_id"], r["kept"]) for r in out) == [(1, False)] * 3 + [(2, True)] * 2


@pytest.mark.parametrize("name", ["op2_chat_preferences", "op10_quality_rules", "op1_exact_top_k"])
def test_queries_run(spark, sf, name):
    from tallyloom.llm.queries import QUERIES

    assert QUERIES[name](spark, sf).count() > 0
