"""Plans of row-wise queries: no nested loops, no exchange into a single partition; streams of payloads."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from tallyloom.catalogue import QUERIES
from tallyloom.operators import relational as R
from tallyloom.operators import resolution
from tallyloom.session import shared_dir
from tallyloom.streaming import webhooks as W


@pytest.mark.parametrize(
    "name",
    "shared_with_me shared_by_me effective_permission permission_at_least accessible_documents upsert_share uniqueness_violations client_by_phone retrieval_by_message match_client_tenant match_client_registry duplicates routing folder_path classify extract_name process_documents documents_by_client_type webhook_answers".split(),
)
def test_no_single_task_and_no_nested_loop(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "SinglePartition" not in plan


def test_phones_of_any_length(spark):
    clients = spark.createDataFrame([(1, 1, "a", "98765 00001", True), (2, 1, "b", "12", True), (3, 1, "c", None, True), (4, 1, "d", "9876500001", False), (5, 1, "e", "0098765 00001", True)], "id long, firm_id long, client_name string, mobile string, is_active boolean")
    messages = spark.createDataFrame([(1, "+91 98765-00001"), (2, "1"), (3, "12"), (4, ""), (5, None), (6, "x")], "id long, phone string")
    got = {(r["id"], r["client_id"]) for r in R.clients_by_phone(messages, clients).collect()}
    assert got == {(1, 1), (1, 5), (2, 1), (2, 5), (3, 2)}
    asked = {(r["id"], r["client_id"]) for r in R.clients_by_phone(messages, clients, blank=True).collect()}
    assert asked == got | {(m, c) for m in (4, 5, 6) for c in (1, 2, 5)}


def test_names_that_contain_one_another(spark):
    names = ["asha", "asha rao", "rao", "r", "bina", "bina kumari devi", "kumari", "x", ""]
    x = spark.createDataFrame([(i, f, n) for i, n in enumerate(names) for f in (1, 2) if n], "id int, _firm int, _own string")
    y = spark.createDataFrame([(100 + i, 1, n) for i, n in enumerate(names) if n], "client_id int, _firm int, _name string")
    got = sorted(tuple(r) for r in resolution._either_contains(x, y).collect())
    assert got == sorted((i, 100 + j) for i, a in enumerate(names) for j, b in enumerate(names) if a and b and (a in b or b in a))


def test_a_syllable_that_most_names_share(spark):
    """A firm of many names with one ending: the pairs that are looked at stay in proportion."""
    n = 30_000
    code = lambda i: F.substring(F.md5(i.cast("string")), 1, 8)
    x = spark.range(n).select("id", F.lit(1).alias("_firm"), F.concat(code(F.col("id")), F.lit(" limited")).alias("_own"))
    y = spark.range(n).select((F.col("id") + n // 2).alias("client_id"), F.lit(1).alias("_firm"), F.concat(F.lit("the "), code(F.col("id") + n // 2), F.lit(" limited company")).alias("_name"))
    pairs = resolution._either_contains(x, y)
    assert pairs.where("id = client_id").count() == n // 2 == pairs.count()
    named = lambda df, key, name: df.select(F.col(key).alias("id"), "_firm", name.alias("name"))
    met = resolution._contained(named(x, "id", F.concat("_own", F.lit("!"))), named(y, "client_id", F.col("_name")))
    assert met.count() == 0  # a name with a substring that no other holds is not looked for


@pytest.fixture
def family(spark):
    clients = spark.createDataFrame(
        [(1, 1, "Asha", "9876500001", True), (2, 1, "Bina", "98765 00001", True), (3, 2, "Chetan", "9876500001", True), (4, 1, "Dev", "9876500001", False)],
        "id long, firm_id long, client_name string, mobile string, is_active boolean",
    )
    documents = spark.createDataFrame(
        [(7, 1, 1, "p.pdf", "PAN Card", None, "2024-01-01"), (8, 1, 1, "i.pdf", "ITR Acknowledgement", "2019-20", "2024-01-02"), (9, 1, 2, "q.pdf", "PAN Card", None, "2024-01-03"), (10, 2, 3, "r.pdf", "PAN Card", None, "2024-01-04"), (11, 1, 4, "s.pdf", "PAN Card", None, "2024-01-05")],
        "id long, firm_id long, client_id long, filename string, document_type string, assessment_year string, uploaded_at string",
    ).withColumn("uploaded_at", F.col("uploaded_at").cast("timestamp"))
    return clients, documents


def test_a_request_of_many_messages_is_answered_once(spark, family):
    messages = spark.range(500).select("id", F.lit("+91 98765-00001").alias("phone"), F.when(F.col("id") % 2 == 0, "my pan").otherwise("PAN please").alias("body"))
    assert R._requests(messages, [])[1].count() == 1
    got = R.retrieval(messages, *family).select("id", F.col("files.document_id").alias("d")).collect()
    assert len(got) == 500 and all(r["d"] == [9, 7] for r in got)


def test_pairs_are_of_all_firms(spark, family):
    messages = spark.createDataFrame([(0, "98765 00001", "my pan"), (1, "", "my pan"), (2, "98765 00001", "hello")], "id long, phone string, body string")
    assert sorted(tuple(r) for r in R.retrieve(messages, *family).collect()) == [(0, 7), (0, 9), (0, 10)]


def test_retrieval_of_a_family(spark, family):
    asks = ["my pan", "hello", "gst for 2019-20", "itr 2018-19", "itr and pan 19-20", ""]
    messages = spark.createDataFrame([(i, "+91 98765-00001", b) for i, b in enumerate(asks)] + [(90, "5", "pan"), (91, None, "pan")], "id long, phone string, body string")
    got = {r["id"]: r for r in R.retrieval(messages, *family).collect()}
    assert [f["filename"] for f in got[0]["files"]] == ["q.pdf", "p.pdf"] and got[0]["client_name"] == "Asha"
    assert got[0]["action"] == "WhatsApp retrieval | Asha | my pan | 2 document(s) found"
    assert got[1]["reply"] == got[1]["error"] == "No supported document keywords found" and got[1]["action"].endswith("| hello | No supported document keywords found")
    assert got[2]["error"] is None and "for GST right now" in got[2]["reply"] and got[2]["action"].endswith("| No document available")
    assert "ITR for AY 2018-19 right now" in got[3]["reply"] and got[3]["action"].endswith(got[3]["reply"])
    assert [f["filename"] for f in got[4]["files"]] == ["i.pdf"]
    assert "| blank message |" in got[5]["action"]
    assert got[90]["error"] == got[91]["error"] == W.NO_CLIENT and got[90]["action"] is None
    within = {r["id"]: [f["filename"] for f in r["files"]] for r in R.retrieval(messages.withColumn("firm_id", F.lit(2)), *family).collect()}
    assert within[0] == ["r.pdf"]
    linked = family[1].withColumn("google_drive_file_id", F.when(F.col("id") == 9, "abc"))
    assert R.retrieval(messages, family[0], linked).where("id = 0").first()["reply"].split("\n")[2::2] == ["https://drive.google.com/uc?export=download&id=abc", "Drive link unavailable"]


def deliver(spark, folder, out, family, forms=False):
    """All that lies in the folder, a file a trigger."""
    stream = W.payload_stream(spark, str(folder), files_per_batch=1)
    W.answer_stream(stream, lambda: family[0], lambda: family[1], str(out / "out"), str(out / "check"), forms=forms).awaitTermination(120)
    return spark.read.parquet(str(out / "out")).collect()


def test_stream_of_payloads(spark, family, tmp_path):
    say = lambda sender, **more: {"from": sender, **more}
    sent = [
        {"entry": [{"changes": [{"value": {"messages": [say("+91 98765 00001", type="text", text={"body": "my pan"}), say("5", type="text", text={"body": "pan"})]}}]}]},
        {"entry": [{"changes": [{"value": {"messages": [say("919876500001", type="document", document={"id": "m"}), say("919876500001", type="image", image={}), say("919876500001", type="audio")]}}, {"value": {}}]}]},
        {"entry": [{}, {"changes": [{}, {"value": {"messages": [say("919876500001", type="text", text="no object"), 5, say("919876500001", type="text", text=None), say("919876500001", type="text")]}}]}]},
        {"entry": []},
    ]
    (tmp_path / "in").mkdir()
    texts = [json.dumps(p) for p in sent] + ['{"entry": [{"changes"', json.dumps({"entry": 3})]
    for k, p in enumerate(texts):
        (tmp_path / "in" / f"{k}.json").write_text(p)
    rows = deliver(spark, tmp_path / "in", tmp_path, family)
    key = {hashlib.sha256(p.encode()).hexdigest(): k for k, p in enumerate(texts)}
    named = lambda rows: sorted((f"{key[r['id'].split(':')[0]]}:{r['n']}", r["status"]) for r in rows)
    want = [("0:0", "searched"), ("0:1", "no_client"), ("1:0", "received"), ("1:1", "missing_media_id"), ("1:2", "unsupported"), ("2:0", "error"), ("2:1", "error"), ("2:2", "error"), ("2:3", "searched"), ("4:0", "error"), ("5:0", "error")]
    assert named(rows) == want
    of = {f"{key[r['id'].split(':')[0]]}:{r['n']}": r for r in rows}
    assert of["0:0"]["n_documents"] == 2 and "1. q.pdf (PAN Card)" in of["0:0"]["reply"]
    assert of["0:1"]["reply"] == W.NO_CLIENT and of["1:2"]["reply"] is None
    assert of["2:0"]["reply"] == W.NOT_PROCESSED and of["2:0"]["error"] == "malformed message" and "no object" in of["2:0"]["raw"]
    assert of["4:0"]["error"] == "malformed payload" and of["4:0"]["raw"] == texts[4] and of["4:0"]["reply"] is None
    # the same payloads are delivered again, in files of their own, after a restart: nothing is answered twice
    for k, p in enumerate(texts[:2]):
        (tmp_path / "in" / f"again{k}.json").write_text(p)
    late = json.dumps({"entry": [{"changes": [{"value": {"messages": [say("5", type="text", text={"body": "late"})]}}]}]})
    (tmp_path / "in" / "late.json").write_text(late)
    ago = os.stat(tmp_path / "in" / "0.json").st_mtime - 3 * 24 * 3600
    os.utime(tmp_path / "in" / "late.json", (ago, ago))  # a file of days ago is answered too
    key[hashlib.sha256(late.encode()).hexdigest()] = 9
    assert named(deliver(spark, tmp_path / "in", tmp_path, family)) == [*want, ("9:0", "no_client")]


def test_stream_of_forms(spark, family, tmp_path):
    who = "From=whatsapp%3A%2B919876500001"
    texts = [f"{who}&Body=my+pan&NumMedia=0", f"{who}&Body=&NumMedia=2&MediaUrl0=https%3A%2F%2Fx%2F0&MediaContentType0=image%2Fjpeg&MediaUrl1=u1&MediaContentType1=video%2Fmp4", f"{who}&NumMedia=two", "From=222&Body=pan", "%zz=%", f"{who}&Body=my+pan&NumMedia=0"]
    (tmp_path / "in").mkdir()
    for k, p in enumerate(texts):
        (tmp_path / "in" / f"{k}.txt").write_text(p)
    rows = deliver(spark, tmp_path / "in", tmp_path, family, forms=True)
    key = {hashlib.sha256(p.encode()).hexdigest(): k for k, p in reversed(list(enumerate(texts)))}
    got = {(key[r["id"].split(":")[0]], r["n"]): (r["status"], r["reply"]) for r in rows}
    assert len(rows) == 6 and {k: v[0] for k, v in got.items()} == {(0, 0): "searched", (1, 0): "received", (1, 1): "received", (2, 0): "error", (3, 0): "no_client", (4, 0): "no_client"}
    assert got[2, 0][1] == W.NOT_PROCESSED and "q.pdf" in got[0, 0][1]


def test_a_cluster_needs_a_shared_folder():
    class Conf(dict):
        def get(self, k, default=None):
            return super().get(k, default)

    session = type("Session", (), {"conf": Conf({"spark.master": "yarn"})})()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session)
    session.conf["spark.checkpoint.dir"] = "hdfs://x/y/"
    assert shared_dir(session) == "hdfs://x/y"
