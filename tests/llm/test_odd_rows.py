"""Chat formatting and packing on empty tables, repeated rows, long texts, ties and clashing columns."""

from collections import Counter


from tallyloom.llm.chat import format_preferences, swapped_answers
from tallyloom.llm.packing import pack_documents
from tests.llm.test_packing import check_packed

TURNS = "array<struct<role:string,text:string>>"


def test_preferences_of_odd_rows(spark):
    long = "é" * 200_000
    a = [{"role": "user", "text": long}, {"role": "assistant", "text": long + "a"}]
    b = [{"role": "user", "text": long}, {"role": "assistant", "text": "b"}]
    rows = [(1, a, b, "x", 7), (1, a, b, "x", 7), (None, b, a, None, None), (2, [], [], "y", 1)]
    df = spark.createDataFrame(rows, f"pair_id long, chosen {TURNS}, rejected {TURNS}, prompt string, n_common int")
    out = format_preferences(df).collect()
    assert Counter(r["pair_id"] for r in out) == {1: 2, None: 1, 2: 1}
    for r in out:
        for text, mask in ((r["chosen"], r["chosen_mask"]), (r["rejected"], r["rejected_mask"])):
            assert [text[s["start"] : s["end"]] for s in mask] == ([] if not text else [text[text.index("\n") + 1 :]])
    one = next(r for r in out if r["pair_id"] == 1)
    assert one["n_common"] == 1 and long in one["prompt"] and one["chosen"].count("é") == 200_000
    assert format_preferences(df.limit(0)).collect() == []


def test_pairs_of_repeated_turns_and_empty_tables(spark):
    rows = [(4, 0, "user", "q", 1), (4, 0, "user", "q", 1), (4, 1, "assistant", "x", 1), (5, 0, "user", None, 1), (5, 1, "assistant", None, 1), (6, 0, None, "n", 1), (7, 0, "assistant", "z", 1)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, chosen int").repartition(3)
    pairs = {r["pair_id"]: [[t["text"] for t in r["chosen"]], [t["text"] for t in r["rejected"]]] for r in swapped_answers(turns).collect()}
    assert pairs == {4: [["q", "q", "x"], ["q", "q", None]], 5: [[None, None], [None, "x"]]}
    assert swapped_answers(turns.limit(0)).collect() == []


def test_packing_of_long_texts_and_ties(spark):
    texts = {i: "same words here " * 30 for i in range(40)} | {100: "word " * 120_000, 101: "", 102: None, 103: "x"}
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in texts.items()], "doc_id long, text string, piece int, offset string")
    counts = set()
    for parts in (1, 9):
        rows = pack_documents(df.repartition(parts), limit=512).collect()
        counts.add(check_packed(rows, texts, 512))
    assert len(counts) == 1  # as few sequences however the rows come
    assert pack_documents(df.limit(0)).collect() == []


def test_packing_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "d")], "doc_id long, text string")
    rows = pack_documents(df, limit=64).collect()
    assert Counter(r["doc_id"] for r in rows) == {1: 2, None: 1}
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    assert all(a[0] != b[0] or a[1] + a[2] == b[1] for a, b in zip(places, places[1:]))
