"""Written tables, references, revisions, the search index, the cache, arriving files and SQL functions."""

import random
import re
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import sql as S
from tallyloom.functions import text as T
from tallyloom.operators import relational as R
from tallyloom.operators import resolution as E
from tallyloom.operators import revisions as V
from tallyloom.operators.integrity import CASCADE, RESTRICT, SET_NULL, Reference, delete_with_references, deletion_order
from tallyloom.operators.search import SearchIndex
from tallyloom.plans.changes import REVISIONS
from tallyloom.session import cut, release, shared_dir
from tallyloom.sources.cache import ResultCache
from tallyloom.sources.keyed import KeyedTable
from tallyloom.streaming.duplicates import detect_files


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- references --------------------------------------------------------------------------------


def tables_of(spark):
    row = lambda rows, schema: spark.createDataFrame(rows, schema)
    return {
        "a": row([(1,), (2,), (3,)], "id int"),
        "b": row([(10, 1), (11, 2), (12, None)], "id int, a_id int"),
        "c": row([(20, 1, 11), (21, 3, 10), (22, 3, 11), (23, None, None), (24, 9, 12)], "id int, a_id int, b_id int"),
        "log": row([(30, 20), (31, 22), (32, None)], "id int, c_id int"),
    }


REFS = [Reference("b", "a_id", "a", CASCADE), Reference("c", "a_id", "a", CASCADE), Reference("c", "b_id", "b", CASCADE), Reference("log", "c_id", "c", SET_NULL)]


def test_cascade_along_two_ways(spark):
    after = delete_with_references(tables_of(spark), {"a": spark.createDataFrame([(1,), (77,)], "id int")}, REFS)
    got = {k: sorted(tuple(r) for r in v.collect()) for k, v in after.items()}
    assert got["a"] == [(2,), (3,)] and got["b"] == sorted([(11, 2), (12, None)], key=str)
    assert sorted(r[0] for r in got["c"]) == [22, 23, 24] and got["log"] == [(30, None), (31, 22), (32, None)]


def test_what_still_refers_refuses_the_delete(spark):
    refs = [Reference("b", "a_id", "a", RESTRICT), *REFS[1:]]
    with pytest.raises(ValueError, match="b 10 still refers"):
        delete_with_references(tables_of(spark), {"a": spark.createDataFrame([(1,)], "id int")}, refs)
    both = {"a": spark.createDataFrame([(1,)], "id int"), "b": spark.createDataFrame([(10,)], "id int")}
    assert delete_with_references(tables_of(spark), both, refs)["b"].count() == 2  # who refers goes too: no objection


def test_references_in_a_circle():
    assert deletion_order("cba", REFS[:3]) == ["a", "b", "c"]
    for circle in ([Reference("a", "x", "a")], [Reference("a", "x", "b"), Reference("b", "x", "a")]):
        with pytest.raises(ValueError, match="circle"):
            deletion_order("ab", circle)


# --- revisions ---------------------------------------------------------------------------------


def test_revisions_are_ordered_and_checked():
    assert [r.id for r in V.in_order(REVISIONS[::-1])][:3] == ["1-firms", "2-clients", "3-client-type"]
    for bad, why in (([V.Revision("x", ("y",), ())], "not there"), ([V.Revision("x", ("y",), ()), V.Revision("y", ("x",), ())], "circle"), ([V.Revision("x", (), ())] * 2, "twice")):
        with pytest.raises(ValueError, match=why):
            V.in_order(bad)


def test_upgrade_once_and_back(spark):
    none = spark.createDataFrame([], "version string")
    tables, versions = V.upgrade(spark, {}, none, REVISIONS)
    assert tables["clients"].columns == ["id", "firm_id", "client_name", "mobile", "client_type", "is_primary_personal", "google_drive_folder_id", "is_active"]
    again, v2 = V.upgrade(spark, tables, versions, REVISIONS)
    assert again["clients"] is tables["clients"] and v2.count() == 6
    back, v3 = V.downgrade(tables, versions, REVISIONS, "3-client-type")
    assert back["clients"].columns == ["id", "firm_id", "client_name", "mobile", "client_type", "is_primary_personal", "legacy_code"] and sorted(r[0] for r in v3.collect()) == ["1-firms", "2-clients", "3-client-type"]
    assert V.downgrade(tables, versions, REVISIONS, None)[0] == {}


def test_defaults_of_old_files_and_of_inserts(spark, tmp_path):
    chain = [
        V.Revision("r1", (), (V.CreateTable("t", {"id": "int", "old": "string"}),)),
        V.Revision("r2", ("r1",), (V.AddColumn("t", "level", "int", 1),)),
        V.Revision("r3", ("r2",), (V.AlterDefault("t", "level", 5), V.DropColumn("t", "old"))),
        V.Revision("r4", ("r3",), (V.AddColumn("t", "kind", "string", "plain"),)),
    ]
    spark.createDataFrame([(1, "x")], "id int, old string").write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([(2, 9)], "id int, level int").write.parquet(str(tmp_path / "b"))
    parts = [(spark.read.parquet(str(tmp_path / "a")), "r1"), (spark.read.parquet(str(tmp_path / "b")), "r3")]
    whole = V.read_parts(parts, "t", chain)
    more = V.insert(whole, spark.createDataFrame([(3,)], "id int"), chain, "t")
    assert sorted(tuple(r) for r in more.collect()) == [(1, 1, "plain"), (2, 9, "plain"), (3, 5, "plain")]
    assert re.findall(r"ReadSchema: struct<([^>]*)>", plan_of(whole)) == ["id:int", "id:int,level:int"]  # a dropped column is not read


# --- tables in parts ---------------------------------------------------------------------------


def files_of(folder):
    return {p.name: {f.name for f in p.glob("*.parquet")} for p in Path(folder).glob("_part=*")}


def test_a_change_rewrites_only_its_parts(spark, tmp_path):
    rows = spark.range(5000).select("id", (F.col("id") % 7).alias("x"))
    table = KeyedTable(spark, str(tmp_path / "t"), ["id"], 50).create(rows)
    before = files_of(tmp_path / "t")
    assert len(before) == 50
    changes = spark.createDataFrame([(i * 400, 100) for i in range(9)] + [(9999, 100)], "id long, x long")
    parts = table.upsert(changes, lambda old, new: old.join(new.select("id"), "id", "left_anti").union(new))
    after = files_of(tmp_path / "t")
    changed = {k for k in after if after[k] != before.get(k)}
    assert changed == {f"_part={p}" for p in parts} and 0 < len(changed) <= 10
    want = {(i, i % 7) for i in range(5000)} - {(i * 400, i * 400 % 7) for i in range(9)} | {(i * 400, 100) for i in range(9)} | {(9999, 100)}
    assert {tuple(r) for r in table.rows().collect()} == want
    one = table.rows().where("id < 5000").select("id").limit(1)
    key = one.first()[0]
    gone = table.read().where(f"_part = (SELECT pmod(xxhash64({key}L), 50))")
    ids = [r["id"] for r in gone.collect()]
    table.delete(gone.select("id"))  # a part without rows goes
    assert len(files_of(tmp_path / "t")) == 49 and not {r["id"] for r in table.rows().collect()} & set(ids)
    assert table.upsert(changes.limit(0), lambda old, new: old) == [] and table.delete(changes.where("id < 0").select("id")) == []
    found = table.lookup(spark.createDataFrame([(4999,), (-1,)], "id long"))
    assert [r["id"] for r in found.collect()] == [4999] or 4999 in ids
    scanned = re.search(r"PartitionFilters: \[([^\]]*)", found._jdf.queryExecution().executedPlan().toString().replace("\n", " "))
    assert scanned and "_part" in scanned[1]


def test_release_deletes_what_cut_wrote(spark):
    t = cut(spark.range(3).toDF("x"), "released")
    path = [p for p in Path(shared_dir(spark).replace("file:", "")).glob("released-*")]
    assert t.count() == 3 and path and release(spark) >= 1 and not path[0].exists()


# --- search and cache --------------------------------------------------------------------------


def test_search_reads_candidates_only(spark, tmp_path):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "de%lta", "ΣΟΦΟΣ", "İstanbul", "x", "", None, "common"]
    docs = [(i, 1 + i % 2, i % 5 if i % 9 else None, f"f{i}.pdf", rng.choice(words), "s", f"2024-01-{1 + i % 28:02d}") for i in range(400)]
    d = spark.createDataFrame(docs, "id long, firm_id int, client_id long, filename string, document_type string, status string, uploaded_at string")
    c = spark.createDataFrame([(i, f"Client {w}", f"PAN{i}") for i, w in enumerate(words[:5])], "id long, client_name string, pan_number string")
    t = spark.createDataFrame([(i, f"needle{i} in {rng.choice(words)} common text") for i in range(0, 400, 3)], "id long, text string")
    index = SearchIndex(spark, str(tmp_path / "i"), 32).build(d, c, t)
    for term in ("needle36 ", "needle39 ", "COMMON", "σοφος", "istanbul", "İst", "ab", "e%a", "de\\%l", "needle%3_", "no such thing", "f3", ".pdf", "", "x"):
        want = [tuple(r) for r in R.search(d, c, 1, term, 1000, t).collect()]
        assert [tuple(r) for r in index.search(c, 1, term, 1000).collect()] == want, term
    assert index.candidates(1, "needle36 ").count() < 20 and index.candidates(1, "ab") is None
    scans = plan_of(index.search(c, 1, "needle36 ")).split("FileScan")[1:]
    assert len(scans) >= 2 and all(re.search(r"PartitionFilters: \[[^\]]*_part", x) for x in scans)


def test_the_index_keeps_a_row_a_document(spark, tmp_path):
    d = spark.range(60).select("id", F.lit(1).alias("firm_id"), F.lit(None).cast("long").alias("client_id"), F.concat(F.lit("f"), "id").alias("filename"), F.lit("T").alias("document_type"))
    c = spark.createDataFrame([], "id long, client_name string, pan_number string")
    t = d.where("id % 2 = 0").select("id", F.repeat(F.sha2(F.col("id").cast("string"), 256), 2).alias("text"))
    signs = SearchIndex(spark, str(tmp_path / "i"), 4).build(d, c, t).signs.rows()
    assert signs.count() == 60 and signs.where("text IS NOT NULL").count() == 30 and signs.agg(F.max(F.size("text"))).first()[0] <= 4
    term = t.where("id = 6").first()["text"][20:30]
    assert [r["id"] for r in SearchIndex(spark, str(tmp_path / "i"), 4).candidates(1, term).collect()] == [6]


def test_the_cache_is_not_exchanged(spark, tmp_path):
    results = spark.range(2000).select(F.sha2(F.col("id").cast("string"), 256).alias("sha"), F.col("id").alias("result"))
    cache = ResultCache(spark, f"cache_{time.time_ns()}", str(tmp_path / "c"), 8).create(results)
    cache.add(spark.range(1990, 2010).select(F.sha2(F.col("id").cast("string"), 256).alias("sha"), F.lit(-1).cast("long").alias("result")))
    assert cache.table().count() == 2010
    files = spark.range(100).select(F.sha2((F.col("id") * 50).cast("string"), 256).alias("sha"), "id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hit, rest = E.split_by_cache(files, cache.table())
        assert (hit.count(), rest.count()) == (41, 59)
        for df in (hit, rest):
            plan = plan_of(df)
            assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


# --- arriving files ----------------------------------------------------------------------------


def arrive(spark, tmp_path, rows, ttl_ms=10**9):
    spark.createDataFrame(rows, "seq long, file string, sha string, fp string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    detect_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), ttl_ms=ttl_ms).awaitTermination(120)
    return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_duplicates_over_lots_and_restarts(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, f"f{i}", None if rng.random() < 0.1 else f"s{rng.randrange(40)}", None if rng.random() < 0.1 else f"p{rng.randrange(20)}") for i in range(150)]
    for k in range(0, 150, 75):
        got = arrive(spark, tmp_path, rows[k : k + 75])
    df = spark.createDataFrame(rows, "seq long, file string, sha string, fp string")
    assert got == sorted(tuple(r) for r in E.find_duplicates(df).collect())


def test_state_ends_after_its_time(spark, tmp_path):
    arrive(spark, tmp_path, [(1, "a", "s", "p")], ttl_ms=1000)
    time.sleep(1.5)
    assert [r[4] for r in arrive(spark, tmp_path, [(2, "b", "s", "p"), (3, "c", "s", "q")], ttl_ms=1000)] == [None, None, "exact"]


# --- SQL functions -----------------------------------------------------------------------------


def test_sql_functions(spark):
    names = S.register(spark)
    assert len(names) == len(S.SCALARS) + 2
    rows = ["mr. asha rao", "ABCPJ38O1H", "22ABCDE1234F1Z5", "+91 98765-43210", "AY 2019-20", "2020-21", "it's \\ a \"test\"\n x", "", None, "1234 5678 9012", "12 >= (3) = 'q'"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "id int, x string")
    ones = [n for n, (p, _, _) in S.SCALARS.items() if p == ["x STRING"]]
    by_sql = spark.sql(f"SELECT id, {', '.join(f'{n}(x) AS {n}' for n in ones)} FROM {{df}}", df=df)
    by_columns = df.select("id", *[S.SCALARS[n][2](F.col("x")).alias(n) for n in ones])
    assert sorted(map(str, by_sql.collect())) == sorted(map(str, by_columns.collect()))
    assert "Python" not in plan_of(by_sql) and "Arrow" not in plan_of(by_sql)
    fields = spark.sql("SELECT d.id, f.* FROM {df} d, LATERAL document_fields(d.x, 50.0D) f", df=df)
    assert fields.count() == len(rows) and not re.search("Python|Arrow|Join", plan_of(fields))
    assert spark.sql("SELECT nfkc('ﬁ①')").first()[0] == "fi1"
    assert S.sql_text(T.valid_year(F.col("a"))).count("`=`(") >= 1
