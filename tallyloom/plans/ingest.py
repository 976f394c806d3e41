"""Files to texts, documents into their table, batches with a cache, messages to answers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.operators import documents as D
from tallyloom.operators import ingest as I
from tallyloom.operators import relational as R
from tallyloom.session import shared_dir
from tallyloom.sources import files as S
from tallyloom.streaming import webhooks as W

from . import documents as P
from . import relational as Q
from .registry import Tables, query

# --- files -------------------------------------------------------------------------------------


def _files(t: Tables) -> DataFrame:
    """A PDF that shows the text, an image that a stand-in recogniser reads, another type, a broken PDF."""
    shown = F.concat(F.lit("%PDF-1.4\n1 0 obj << /Length 9 >>\nstream\nBT\n("), F.replace("text", F.lit("\n"), F.lit(") Tj T*\n(")), F.lit(") Tj\nET\nendstream\nendobj"))
    k = F.col("id") % 4
    content = F.when(k == 0, shown).when(k == 1, F.col("text")).otherwise("broken")
    return t.ocr_texts.select(F.concat("file", F.when(k == 1, ".PNG").when(k == 2, ".docx").otherwise(".pdf")).alias("file"), content.cast("binary").alias("content"))


def _reads(image: bytes) -> list[tuple[str, str]]:
    """Two passes of a stand-in recogniser whose images are their texts: a part of it, and all."""
    text = image.decode()
    return [("part", text[:8]), ("whole", text)]


@query(
    "ocr_texts",
    f"""SELECT CASE id % 4 WHEN 1 THEN file || '.PNG' WHEN 2 THEN file || '.docx' ELSE file || '.pdf' END AS file,
CASE id % 4 WHEN 0 THEN CASE WHEN length(text) >= 40 AND {P._QUALITY} >= 0.3 THEN 'embedded' ELSE 'unknown' END WHEN 1 THEN 'ocr' WHEN 2 THEN 'unsupported' ELSE 'error' END AS method,
CASE id % 4 WHEN 2 THEN '' WHEN 3 THEN '[PDF error: no PDF header]' ELSE text END AS text, CASE WHEN id % 4 < 2 THEN 1 ELSE 0 END AS page_count, CASE WHEN id % 4 = 1 THEN 2 ELSE 0 END AS pass_count FROM ocr_texts""",
)
def document_texts(t: Tables) -> DataFrame:
    return S.document_texts(_files(t), ocr=_reads).select("file", "method", "text", "page_count", "pass_count")


@query("app_documents", "SELECT id, 'a_b_' || filename AS name, CASE WHEN id % 4 = 0 THEN 'pdf' WHEN id % 4 < 3 THEN 'image' ELSE 'other' END AS kind FROM app_documents")
def secured_names(t: Tables) -> DataFrame:
    odd = F.concat(F.lit("../a b/"), "filename", F.lit("?é "))
    return t.app_documents.select("id", F.regexp_replace(S.secured_name(odd), "e$", "").alias("name"), S.kind_of(F.col("filename")).alias("kind"))


_ROT = "rot AS (SELECT id % 900 AS file, CAST(id AS INTEGER) AS angle, text, " + " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN 10 ELSE 0 END" for w in S.K.ROTATION_WORDS) + " + 0.01 * length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) AS s FROM ocr_texts)"


@query("ocr_texts", f", {_ROT} SELECT file, angle, text, round(s, 4) AS score FROM rot QUALIFY row_number() OVER (PARTITION BY file ORDER BY round(s, 6) DESC, angle) = 1")
def best_rotation(t: Tables) -> DataFrame:
    r = t.ocr_texts.select((F.col("id") % 900).alias("file"), F.col("id").cast("int").alias("angle"), "text")
    return S.best_rotation(r).withColumn("score", F.round("score", 4))


@query("ocr_texts", f", {_ROT}, pages AS (SELECT id % 700 AS file, id AS page, CASE WHEN id % 5 = 0 THEN text WHEN id % 5 = 1 THEN substr(text, 1, 18) WHEN id % 5 = 2 THEN ' ' END AS embedded FROM ocr_texts), turns AS (SELECT id % 700 AS file, id - (id // 700) % 2 * 700 AS page, angle, r.text, r.s FROM rot r JOIN ocr_texts o ON o.id = r.angle), best AS (SELECT * FROM turns WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY file, page ORDER BY round(s, 6) DESC, angle) = 1), parts AS (SELECT p.file, p.page, CASE WHEN length(trim(embedded)) > 20 THEN embedded ELSE coalesce(b.text, '') END AS part, coalesce(length(trim(embedded)) > 20, false) AS own FROM pages p LEFT JOIN best b ON b.file = p.file AND b.page = p.page) SELECT file, regexp_replace(string_agg(part, chr(10) ORDER BY page), '^\\s+|\\s+$', '', 'g') AS text, CAST(count(*) FILTER (own) AS BIGINT) AS n_embedded FROM parts GROUP BY file")
def legacy_texts(t: Tables) -> DataFrame:
    """Pages with enough embedded text, too little, blank and none; every other page has two rotations and the next none."""
    k = F.col("id") % 5
    pages = t.ocr_texts.select((F.col("id") % 700).alias("file"), F.col("id").alias("page"), F.when(k == 0, F.col("text")).when(k == 1, F.substring("text", 1, 18)).when(k == 2, F.lit(" ")).alias("embedded"))
    odd = F.floor(F.col("id") / 700) % 2
    turns = t.ocr_texts.select((F.col("id") % 700).alias("file"), (F.col("id") - odd * 700).alias("page"), F.col("id").cast("int").alias("angle"), "text")
    return S.legacy_texts(pages, turns)


@query("ocr_texts", "SELECT id % 900 AS file, CAST(arg_max(id, (length(text), -id)) AS INTEGER) AS angle, arg_max(text, (length(text), -id)) AS text FROM ocr_texts GROUP BY 1")
def longest_rotation(t: Tables) -> DataFrame:
    r = t.ocr_texts.select((F.col("id") % 900).alias("file"), F.col("id").cast("int").alias("angle"), "text")
    return S.longest_rotation(r)


@query("", "SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS n_bytes, sha256(html) AS sha, true AS name_ok FROM pages")
def files_read(t: Tables) -> DataFrame:
    """Pages written as files of one line a page, read as binary files, and named for keeping."""
    folder = f"{shared_dir(t.spark)}/files-{uuid.uuid4().hex}"
    lines = t.base("pages").select(F.to_json(F.struct("page_id", "html")))
    lines.write.text(folder)
    found = S.read_files(t.spark, folder, "*.txt")
    kept = found.withColumn("kept", S.stored_name(F.concat(F.lit("../a "), "file"), fold=False))
    line = kept.select("kept", F.explode(F.split(F.col("content").cast("string"), "\n")).alias("line")).where("line <> ''")
    row = line.select("kept", F.from_json("line", "page_id long, html string").alias("p"))
    return row.select("p.page_id", F.octet_length("p.html").cast("long").alias("n_bytes"), F.sha2("p.html", 256).alias("sha"), F.col("kept").rlike(r"^[0-9a-f]{32}_a_part-[0-9A-Za-z-]+(-c000)?\.txt$").alias("name_ok"))


@query("", r"SELECT doc_id, doc_id % 3 = 0 AS odd, trim(regexp_replace(regexp_replace(regexp_replace(CASE WHEN doc_id % 3 = 0 THEN text || ' fi 1 IV 5' ELSE text END, '[^\t\n\x20-\x7E\x{0900}-\x{097F}]', ' ', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS cleaned FROM documents")
def clean_texts(t: Tables) -> DataFrame:
    """Texts whose rows beyond ASCII alone are sent to the normal form: ligatures, circled and Roman numbers, wide digits."""
    d = t.base("documents").select("doc_id", (F.col("doc_id") % 3 == 0).alias("odd"), F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" ﬁ ① Ⅳ ５"))).otherwise(F.col("text")).alias("cleaned"))
    return D.clean_texts(d, "cleaned")


@query("clients ocr_texts", "SELECT id, upper(substr(client_type, 1, 1)) || substr(client_type, 2) AS title, client_name || '_' || pan_number AS folder, CASE WHEN client_type = 'huf' THEN 'Hindu-Undivided (Family) Of One' ELSE '-' END AS long_title FROM clients")
def client_cards(t: Tables) -> DataFrame:
    long = F.when(F.col("client_type") == "huf", "hindu-UNDIVIDED (family) of oNE").otherwise("")
    return t.clients.select("id", T.shown_type(F.col("client_type")).alias("title"), T.folder_title(F.col("client_name"), F.col("pan_number")).alias("folder"), T.shown_type(long).alias("long_title"))


@query("clients", "SELECT id, 'x ' || pan_number || ' y' AS joined, regexp_replace(coalesce(mobile, ''), '[^0-9]', '', 'g') AS recipient FROM clients")
def legacy_clean(t: Tables) -> DataFrame:
    p = F.col("pan_number")
    spaced = F.concat(F.lit("x "), F.substring(p, 1, 5), F.lit(" "), F.substring(p, 6, 4), F.lit("\n"), F.substring(p, 10, 1), F.lit(" y"))
    return t.clients.select("id", T.join_spaced_pan(spaced).alias("joined"), T.digits(F.col("mobile")).alias("recipient"))


@query("ocr_texts", r"SELECT id, CASE WHEN id % 6 = 4 THEN regexp_extract(text, 'Account Number: (\d{12})', 1) END AS account, CASE WHEN id % 2 = 0 THEN 'U12345MH2019PTC' || lpad(CAST(id % 1000000 AS VARCHAR), 6, '0') END AS cin, CASE WHEN id % 2 = 1 THEN '2020-01-22' END AS iso_date FROM ocr_texts")
def declared_patterns(t: Tables) -> DataFrame:
    more = F.when(F.col("id") % 2 == 0, F.concat(F.lit("\nu12345mh2019ptc"), F.lpad((F.col("id") % 1000000).cast("string"), 6, "0"))).otherwise("\ndated 2020-01-22")
    found = T.declared_ids(F.concat("text", more))
    return t.ocr_texts.select("id", *[v.alias(k) for k, v in found.items()])


@query("app_documents", "SELECT id, CASE WHEN id % 4 = 0 THEN 'pdf' WHEN id % 4 < 3 THEN 'img' ELSE 'gen' END AS icon, strftime(uploaded_at, '%Y-%m-%d') AS day FROM app_documents")
def listing_columns(t: Tables) -> DataFrame:
    return t.app_documents.select("id", T.file_icon(F.col("filename")).alias("icon"), T.shown_date(F.col("uploaded_at")).alias("day"))


# --- the whole process, and what is made of it --------------------------------------------------

_VALUES = f"""vals AS (SELECT *, coalesce({P._PAN_L}, {P._first("(" + P._PAN + ")", "upper(text)")}) AS pan_v, {P._G} AS gstin_v, {P._Y} AS year_v, {P._first(r"Form (ITR-[0-9])")} AS itr_v,
 CASE WHEN len(list_distinct(list_filter(string_split({P._AAD}, ''), lambda c: c <> ' '))) >= 4 THEN {P._AAD} END AS aad_v, CASE WHEN id % 6 = 5 THEN 'Plain Note' ELSE {P._N} END AS name_v FROM classified),
refined AS (SELECT * REPLACE (
 CASE WHEN aad_rule THEN CASE WHEN document_confidence >= 75 OR own >= 3 * p[2] THEN document_type ELSE 'Aadhaar Card' END WHEN gst_rule AND cert THEN 'GST Certificate' WHEN gst_rule AND inv THEN 'Invoice' WHEN itr_rule THEN 'ITR Acknowledgement' ELSE document_type END AS document_type,
 CAST(CASE WHEN aad_rule THEN CASE WHEN document_confidence >= 75 OR own >= 3 * p[2] THEN document_confidence ELSE greatest(document_confidence, 70) END WHEN gst_rule AND (cert OR inv) THEN 65 WHEN itr_rule THEN 72 ELSE document_confidence END AS INTEGER) AS document_confidence)
 FROM (SELECT *, aad_v IS NOT NULL AND document_type NOT IN ('Aadhaar Card', 'PAN Card', 'Form 16', 'Salary Slip', 'ITR Acknowledgement') AND (contains(lower(text), 'aadhaar') OR contains(lower(text), 'uidai')) AS aad_rule, CASE WHEN document_type = 'Other' THEN 0 ELSE best END AS own,
  gstin_v IS NOT NULL AND document_type = 'Other' AS gst_rule, contains(lower(text), 'certificate') OR contains(lower(text), 'registration') AS cert, contains(lower(text), 'invoice') AS inv, document_type = 'Other' AND pan_v IS NOT NULL AND yr AND itr AS itr_rule FROM vals)),
processed AS (SELECT *, 'Document Type: ' || document_type || ' (confidence: ' || CAST(document_confidence AS VARCHAR) || '%)' || coalesce(' | Name: ' || name_v, '') || coalesce(' | PAN: ' || pan_v, '') || coalesce(' | Aadhaar: ' || aad_v, '') || coalesce(' | GSTIN: ' || gstin_v, '') || coalesce(' | Assessment Year: ' || year_v, '') || coalesce(' | ITR Type: ' || itr_v, '') AS summary FROM refined)"""
PROCESSED = f"{P._CLASSIFIED}, {_VALUES}"


@query("ocr_texts", f", {PROCESSED} SELECT id, document_type, document_confidence, pan_v AS pan, gstin_v AS gstin, name_v AS name, summary FROM processed")
def process_documents(t: Tables) -> DataFrame:
    """The whole pipeline from raw text to result rows."""
    corrected = t.ocr_texts.withColumn("text", T.correct(F.col("text")))
    return D.process(corrected).select("id", "document_type", "document_confidence", F.col("pan.value").alias("pan"), F.col("gstin.value").alias("gstin"), F.col("name.value").alias("name"), "summary")


@query("ocr_texts", f", {PROCESSED} SELECT id, document_type, year_v AS assessment_year, document_confidence AS confidence_score, pan_v AS pan, aad_v AS aadhaar, gstin_v AS gstin, CAST(NULL AS VARCHAR) AS tan, name_v AS name, ocr_score, substr(text, 1, 500) AS text_preview FROM processed")
def document_metadata(t: Tables) -> DataFrame:
    d = D.process(t.ocr_texts)
    m = I.safe_result(d.withColumn("m", I.metadata(d)))
    return m.select("id", "m.document_type", "m.assessment_year", "m.confidence_score", "m.important_ids.*", "m.name", "m.ocr_score", "text_preview")


@query("app_documents", "SELECT id, json_object('id', id, 'filename', filename, 'document_type', document_type) AS json FROM app_documents")
def json_export(t: Tables) -> DataFrame:
    d = t.app_documents.select("id", "filename", "document_type", F.lit("x").alias("_debug"))
    return d.select("id", I.as_json(d).alias("json"))


_MATCHED = f"""src AS (SELECT id, firm_id, lower(document_type) AS ty, pan_v AS p, substr(gstin_v, 3, 10) AS g, {P._DIGITS.format("aad_v")} AS a, lower(name_v) AS n FROM processed),
act AS (SELECT id AS cid, firm_id, upper(pan_number) AS p, replace(aadhaar_number, ' ', '') AS a, lower(client_name) AS n, client_type = 'personal' AND is_primary_personal AS prime FROM clients WHERE is_active),
r1 AS (SELECT s.id, 1 AS rule, min(cid) AS client, false AS amb FROM src s JOIN act USING (firm_id, p) GROUP BY s.id UNION ALL SELECT s.id, 2, min(cid), false FROM src s JOIN act t ON t.firm_id = s.firm_id AND t.p = s.g GROUP BY s.id
 UNION ALL SELECT s.id, 3, CASE WHEN count(*) = 1 THEN min(cid) WHEN contains(any_value(ty), 'aadhaar') THEN min(CASE WHEN prime THEN cid END) END, count(*) > 1 AND NOT (contains(any_value(ty), 'aadhaar') AND min(CASE WHEN prime THEN cid END) IS NOT NULL) FROM src s JOIN act USING (firm_id, a) WHERE s.a <> '' GROUP BY s.id),
r4 AS (SELECT s.id, 4, CASE WHEN count(*) = 1 THEN min(cid) END, count(*) > 1 FROM src s JOIN act t ON t.firm_id = s.firm_id AND (contains(s.n, t.n) OR contains(t.n, s.n)) WHERE s.id NOT IN (SELECT id FROM r1) GROUP BY s.id),
found AS (SELECT * FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r4) QUALIFY row_number() OVER (PARTITION BY id ORDER BY rule) = 1)"""
_KIND_FOLDER = "CASE document_type WHEN 'PAN Card' THEN 'PAN' WHEN 'Aadhaar Card' THEN 'Aadhaar' WHEN 'ITR Acknowledgement' THEN 'ITR' WHEN 'GST Certificate' THEN 'GST' WHEN 'Bank Statement' THEN 'Bank Statements' WHEN 'Balance Sheet' THEN 'Balance Sheet' ELSE 'Other' END"


def _ingested(fallback: str, where: str) -> str:
    return f""", {PROCESSED}, {_MATCHED}, own AS (SELECT p.*, amb, coalesce(client, {fallback}) AS client_id FROM processed p LEFT JOIN found USING (id) WHERE {where})
SELECT o.id, o.client_id, coalesce(CASE WHEN o.id % 3 <> 0 THEN 9 END, (SELECT min(id) FROM users u WHERE u.role = 'firm_admin' AND u.firm_id = o.firm_id)) AS uploaded_by, document_type, coalesce(client_name, name_v) AS name,
CASE WHEN document_type <> 'Other' AND o.client_id IS NOT NULL AND NOT coalesce(amb, false) AND document_confidence >= 70 AND ocr_score >= 25 THEN 'auto_classified' ELSE 'pending_review' END AS status,
firm_name || '/' || coalesce(client_name || ' - ' || pan_number, 'UNMATCHED') || '/' || {_KIND_FOLDER} || CASE WHEN document_type = 'ITR Acknowledgement' AND year_v IS NOT NULL THEN '/AY ' || year_v ELSE '' END AS folder_path
FROM own o JOIN firms f ON f.id = o.firm_id LEFT JOIN clients c ON c.id = o.client_id"""


def _arrived(t: Tables) -> DataFrame:
    return t.ocr_texts.select("id", "firm_id", F.concat("file", F.lit(".pdf")).alias("filename"), "text", "ocr_score", F.when(F.col("id") % 3 != 0, 9).cast("long").alias("uploaded_by"), F.when(F.col("id") % 4 == 0, 7).cast("long").alias("fallback_client"), F.when(F.col("id") % 10 == 3, "error").otherwise("ocr").alias("method"))


_ROW = ["id", "client_id", "uploaded_by", "document_type", "name", "status", "folder_path"]


@query("firms users clients ocr_texts", _ingested("CASE WHEN p.id % 4 = 0 THEN 7 END", "true"))
def ingest_documents(t: Tables) -> DataFrame:
    return I.ingest(_arrived(t), t.clients, t.users, t.firms).select(*_ROW)


@query("firms users clients ocr_texts", _ingested("NULL", "p.id % 10 <> 3"))
def bulk_upload(t: Tables) -> DataFrame:
    return I.ingest(_arrived(t), t.clients, t.users, t.firms, fallback=False).select(*_ROW)


def _batch(t: Tables) -> tuple[DataFrame, DataFrame]:
    o = t.ocr_texts.select(F.col("id").alias("seq"), "file", F.sha2(F.concat_ws("|", (F.col("id") % 700).cast("string"), "text"), 256).alias("sha"), F.when(F.col("id") % 20 != 5, F.col("text")).alias("text"), "ocr_score", F.when(F.col("id") % 40 == 7, "cannot be read").alias("error"))
    known = D.process(o.where("seq % 9 = 0 AND text IS NOT NULL AND error IS NULL").select("sha", "text", "ocr_score", "seq"))
    return o, known.groupBy("sha").agg(F.min_by(F.struct(*I.RESULT), "seq").alias("result"))


_BATCH_SQL = f""", {PROCESSED}, files AS (SELECT p.id AS seq, file, sha256(CAST(p.id % 700 AS VARCHAR) || '|' || text) AS sha, p.id % 20 = 5 AS gone, p.id % 40 = 7 AS bad, p.* FROM processed p),
cached AS (SELECT sha, arg_min(document_confidence, seq) AS c, arg_min(ocr_score, seq) AS s FROM files WHERE seq % 9 = 0 AND NOT gone AND NOT bad GROUP BY sha),
res AS (SELECT f.* REPLACE (coalesce(k.s, ocr_score) AS ocr_score, coalesce(k.c, document_confidence) AS document_confidence), CASE WHEN k.sha IS NOT NULL THEN 'cached' WHEN bad THEN 'error' WHEN gone THEN 'missing' ELSE 'ok' END AS status FROM files f LEFT JOIN cached k USING (sha)),
good AS (SELECT *, md5(upper(document_type || '|' || coalesce(pan_v, '') || '|' || coalesce(replace(aad_v, ' ', ''), '') || '|' || coalesce(gstin_v, '') || '||' || coalesce(year_v, ''))) AS fp FROM res WHERE status IN ('ok', 'cached')),
a AS (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY seq) > 1 AS ex, first_value(file) OVER (PARTITION BY sha ORDER BY seq) AS ef FROM good),
b AS (SELECT seq, row_number() OVER (PARTITION BY fp ORDER BY seq) > 1 AS se, first_value(file) OVER (PARTITION BY fp ORDER BY seq) AS sf FROM a WHERE NOT ex),
reg AS (SELECT id AS client_id, pan_number AS pan, client_name FROM clients),
routed AS (SELECT a.seq, r.client_id, CASE WHEN document_confidence < 60 THEN 'Uncategorised' ELSE {P._FOLDERS} END AS folder_name, CASE WHEN ex THEN 'exact' WHEN se THEN 'semantic' END AS dup, CASE WHEN ex THEN ef ELSE sf END AS orig, client_name,
 concat_ws('; ', CASE WHEN ocr_score < 20 THEN 'low OCR score (' || CAST(ocr_score AS VARCHAR) || ')' END, CASE WHEN document_confidence < 60 THEN 'low classification confidence (' || CAST(document_confidence AS VARCHAR) || '%)' WHEN {P._FOLDERS} = 'Uncategorised' THEN 'unrecognised document type ''' || document_type || '''' END) AS why
 FROM a LEFT JOIN b USING (seq) LEFT JOIN reg r ON r.pan = a.pan_v)
"""
_BATCH_SQL = _BATCH_SQL.replace("{", "{{").replace("}", "}}") + "{out}"


@query(
    "clients ocr_texts",
    _BATCH_SQL.format(
        out="""SELECT res.seq, res.status, r.client_id, folder_name, CASE WHEN r.seq IS NULL THEN NULL WHEN dup IS NOT NULL THEN 'skip' WHEN why <> '' OR r.client_id IS NULL THEN 'review' ELSE 'upload' END AS action,
CASE WHEN r.seq IS NULL THEN NULL WHEN dup IS NOT NULL THEN 'Duplicate (' || dup || '): matches ' || orig WHEN why <> '' OR r.client_id IS NULL THEN concat_ws('; ', nullif(why, ''), CASE WHEN r.client_id IS NULL THEN 'no client match' END) ELSE 'Matched client ''' || client_name || ''' via pan' END AS action_reason
FROM res LEFT JOIN routed r ON r.seq = res.seq"""
    ),
)
def batch_results(t: Tables) -> DataFrame:
    files, cache = _batch(t)
    none = F.lit(None).cast("string")
    registry = t.clients.select(F.col("id").alias("registry_idx"), F.col("id").alias("client_id"), F.col("client_name").alias("name"), F.col("pan_number").alias("pan"), none.alias("gstin"), none.alias("tan"), none.alias("aadhaar"))
    return I.run_batch(files, cache, registry)[0].select("seq", "status", "client_id", "folder_name", "action", "action_reason")


@query(
    "clients ocr_texts",
    _BATCH_SQL.format(
        out="""SELECT file, '' AS original_filename, res.status, CAST(0 AS DOUBLE) AS elapsed_s, CASE WHEN status IN ('ok', 'cached') THEN document_type END AS document_type, CASE WHEN status IN ('ok', 'cached') THEN document_confidence END AS document_confidence, CASE WHEN status IN ('ok', 'cached') THEN ocr_score END AS ocr_score,
CASE WHEN status IN ('ok', 'cached') THEN name_v END AS detected_name, CASE WHEN status IN ('ok', 'cached') THEN pan_v END AS pan, folder_name, r.client_id, CASE WHEN bad THEN 'cannot be read' END AS error FROM res LEFT JOIN routed r ON r.seq = res.seq"""
    ),
)
def batch_projection(t: Tables) -> DataFrame:
    """The 14 fields of a batch's results, structs shown by their parts."""
    files, cache = _batch(t)
    none = F.lit(None).cast("string")
    registry = t.clients.select(F.col("id").alias("registry_idx"), F.col("id").alias("client_id"), F.col("client_name").alias("name"), F.col("pan_number").alias("pan"), none.alias("gstin"), none.alias("tan"), none.alias("aadhaar"))
    shown = I.safe_batch_result(I.run_batch(files, cache, registry)[0])
    return shown.select("file", "original_filename", "status", "elapsed_s", "document_type", "document_confidence", "ocr_score", F.col("detected_name.value").alias("detected_name"), F.col("important_ids.pan.value").alias("pan"), "routing.folder_name", "routing.client_id", "error")


@query("ocr_texts", ", files AS (SELECT id AS seq, sha256(CAST(id % 700 AS VARCHAR) || '|' || text) AS sha, id % 20 = 5 AS gone, id % 40 = 7 AS bad FROM ocr_texts) SELECT sha, count(*) AS n FROM (SELECT DISTINCT sha FROM files WHERE NOT gone AND NOT bad) GROUP BY sha")
def batch_cache(t: Tables) -> DataFrame:
    """What the cache holds after the batch: one result a hash of the files that could be read."""
    return I.run_batch(*_batch(t))[1].groupBy("sha").agg(F.count("*").alias("n"))


# --- messages ----------------------------------------------------------------------------------


def _payloads(t: Tables) -> DataFrame:
    """A payload as JSON for each message: texts, documents with or without media id, further and malformed messages; one in eleven is cut short."""
    m = t.messages
    media = F.struct(F.when(F.col("id") % 3 == 0, F.lit("m1")).alias("id"), F.lit("application/pdf").alias("mime_type"), F.lit("a.pdf").alias("filename"))
    kind = F.when(F.col("id") % 5 == 0, "document").when(F.col("id") % 5 == 1, "sticker").otherwise("text")
    one = F.to_json(F.struct(F.col("phone").alias("from"), kind.alias("type"), F.when(kind == "text", F.struct("body")).alias("text"), F.when(kind == "document", media).alias("document")))
    two = F.when(F.col("id") % 2 == 0, F.lit('{"from": "no number", "type": "text", "text": {"body": "pan"}}'))
    odd = F.when(F.col("id") % 7 == 0, F.concat(F.lit('{"type": "text", "text": "pan", "from": "'), F.col("phone"), F.lit('"}')))
    whole = F.concat(F.lit('{"entry": [{"id": "e"}, {"changes": [{"field": "x"}, {"value": {"messages": ['), F.concat_ws(", ", one, two, odd), F.lit("]}}]}]}"))
    return m.select("id", F.when(F.col("id") % 11 == 0, F.substring(whole, 1, 60)).otherwise(whole).alias("value"))


_SENT = f"""sent AS (SELECT id, 0 AS n, phone AS sender, CASE id % 5 WHEN 0 THEN 'document' WHEN 1 THEN 'sticker' ELSE 'text' END AS type, CASE WHEN id % 5 < 2 THEN '' ELSE body END AS body, id % 5 = 0 AND id % 3 = 0 AS has_id, CAST(NULL AS VARCHAR) AS error FROM messages WHERE id % 11 <> 0
 UNION ALL SELECT id, 1, 'no number', 'text', 'pan', false, NULL FROM messages WHERE id % 2 = 0 AND id % 11 <> 0
 UNION ALL SELECT id, CASE WHEN id % 2 = 0 THEN 2 ELSE 1 END, phone, 'text', '', false, 'malformed message' FROM messages WHERE id % 7 = 0 AND id % 11 <> 0
 UNION ALL SELECT id, 0, NULL, NULL, '', false, 'malformed payload' FROM messages WHERE id % 11 = 0)"""

#: SQL of a retrieval: who sends, whose documents count, what is asked, found and answered.
_RETRIEVAL = f"""hits AS (SELECT s.id, s.n, c.id AS client_id, c.firm_id, c.client_name FROM sent s JOIN family_clients c ON c.is_active AND {Q._PHONE.replace("phone", "sender")} <> '' AND replace(c.mobile, ' ', '') LIKE '%' || {Q._PHONE.replace("phone", "sender")} WHERE s.error IS NULL),
who AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY id, n ORDER BY client_id) = 1),
terms(type, term) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in R.type_terms())}),
req AS (SELECT s.id, s.n, sender, body, {Q._TYPES} AS types, {Q._YEAR.format(x="body")} AS year FROM sent s WHERE s.type = 'text' AND s.error IS NULL),
got AS (SELECT DISTINCT r.id, r.n, d.id AS document_id, filename, document_type, google_drive_file_id, uploaded_at FROM req r JOIN who w ON w.id = r.id AND w.n = r.n JOIN hits h ON h.id = r.id AND h.n = r.n AND h.firm_id = w.firm_id
 JOIN family_documents d ON d.client_id = h.client_id AND d.firm_id = w.firm_id JOIN terms t ON list_contains(r.types, t.type) AND contains(lower(document_type), t.term) WHERE r.year IS NULL OR NOT list_contains(r.types, 'ITR') OR {Q._YEAR.format(x="assessment_year")} = r.year),
texts AS (SELECT id, n, count(*) AS k, 'Here are your matching documents:' || chr(10) || string_agg(CAST(i AS VARCHAR) || '. ' || filename || ' (' || document_type || ')' || chr(10) || coalesce('https://drive.google.com/uc?export=download&id=' || google_drive_file_id, 'Drive link unavailable'), chr(10) ORDER BY i) AS listed
 FROM (SELECT *, row_number() OVER (PARTITION BY id, n ORDER BY uploaded_at DESC, document_id DESC) AS i FROM got) GROUP BY id, n),
told AS (SELECT r.*, w.client_id, client_name, firm_id, coalesce(k, 0) AS k, listed, CASE WHEN len(types) = 0 THEN 'No supported document keywords found' WHEN k IS NULL AND year IS NOT NULL AND list_contains(types, 'ITR') THEN 'No document available for ' || array_to_string(types, ', ') || ' for AY ' || year || ' right now. Please ask your CA firm to upload it in our service.' END AS why
 FROM req r JOIN who w ON w.id = r.id AND w.n = r.n LEFT JOIN texts x ON x.id = r.id AND x.n = r.n),
said AS (SELECT *, coalesce(why, listed, 'No document available for ' || array_to_string(types, ', ') || ' right now. Please ask your CA firm to upload it in our service.') AS answer,
 'WhatsApp retrieval | ' || client_name || ' | ' || CASE WHEN trim(body) = '' THEN 'blank message' ELSE body END || ' | ' || coalesce(why, CASE WHEN k > 0 THEN CAST(k AS VARCHAR) || ' document(s) found' ELSE 'No document available' END) AS action FROM told)"""


@query("messages", f", {_SENT} SELECT id, CAST(n AS INTEGER) AS n, sender, type, body, has_id, error FROM sent")
def webhook_messages(t: Tables) -> DataFrame:
    m = W.payload_messages(_payloads(t))
    return m.select("id", "n", "sender", "type", "body", F.col("media.id").isNotNull().alias("has_id"), "error")


@query(
    "messages family_clients family_documents",
    f""", {_SENT}, {_RETRIEVAL}, state AS (SELECT s.*, w.client_id, CASE WHEN error IS NOT NULL THEN 'error' WHEN type = 'sticker' THEN 'unsupported' WHEN type = 'document' AND NOT has_id THEN 'missing_media_id' WHEN w.id IS NULL THEN 'no_client' WHEN type = 'document' THEN 'received' ELSE 'searched' END AS status FROM sent s LEFT JOIN who w ON w.id = s.id AND w.n = s.n)
SELECT CAST(s.id AS VARCHAR) || ':' || CAST(s.n AS VARCHAR) AS id, s.sender, status, CASE WHEN status IN ('searched', 'received') THEN s.client_id END AS client_id, CAST(coalesce(k, 0) AS INTEGER) AS n_documents, error, action,
CASE status WHEN 'error' THEN CASE WHEN s.sender IS NOT NULL THEN 'Sorry, this WhatsApp document could not be processed.' END WHEN 'missing_media_id' THEN 'Could not process this file: media ID missing.' WHEN 'no_client' THEN 'No access / client not found' WHEN 'searched' THEN answer END AS reply
FROM state s LEFT JOIN said ON said.id = s.id AND said.n = s.n""",
)
def webhook_answers(t: Tables) -> DataFrame:
    a = W.answers(W.payload_messages(_payloads(t)), t.family_clients, t.family_documents)
    return a.select("id", "sender", "status", "client_id", "n_documents", "error", "action", "reply")


@query(
    "messages family_clients family_documents",
    f""", sent AS (SELECT id, 0 AS n, phone AS sender, 'text' AS type, body, CAST(NULL AS VARCHAR) AS error FROM messages), {_RETRIEVAL.replace("WHERE s.error IS NULL),", "WHERE (c.firm_id = 7 OR s.id % 2 = 0)),", 1)}
SELECT m.id, s.client_id, CASE WHEN s.id IS NULL THEN 'No access / client not found' ELSE why END AS error, CASE WHEN s.id IS NULL THEN 'No access / client not found' ELSE answer END AS reply, (SELECT string_agg(CAST(document_id AS VARCHAR), ',' ORDER BY uploaded_at DESC, document_id DESC) FROM got g WHERE g.id = m.id) AS document_ids
FROM messages m LEFT JOIN said s ON s.id = m.id""",
)
def retrieval_within_firm(t: Tables) -> DataFrame:
    """The lookup of a session: every other message within firm 7, the others within the firm of the sender's first client."""
    m = t.messages.withColumn("firm_id", F.when(F.col("id") % 2 == 1, 7))
    r = R.retrieval(m, t.family_clients, t.family_documents)
    return r.select("id", "client_id", "error", "reply", F.nullif(F.array_join(F.col("files.document_id").cast("array<string>"), ","), F.lit("")).alias("document_ids"))


def _forms(t: Tables) -> DataFrame:
    """The other service's url-encoded forms: one in four has media, one in nine a NumMedia that is no number."""
    count = F.when(F.col("id") % 9 == 4, "many").when(F.col("id") % 4 == 0, (F.col("id") % 3).cast("string")).otherwise("")
    media = F.concat(*[F.lit(f"&MediaUrl{k}=https%3A%2F%2Fx%2F{k}&MediaContentType{k}={c}") for k, c in enumerate(("image%2Fjpeg", "video%2Fmp4", "application%2Fpdf"))])
    return t.messages.select("id", F.concat(F.lit("SmsSid=x&From=whatsapp%3A"), F.url_encode("phone"), F.lit("&Body="), F.url_encode("body"), F.lit("&NumMedia="), count, media).alias("value"))


@query(
    "messages family_clients family_documents",
    f""", forms AS (SELECT id, 'whatsapp:' || phone AS sender, body, CASE WHEN id % 9 = 4 THEN NULL WHEN id % 4 = 0 THEN id % 3 ELSE 0 END AS k FROM messages),
sent AS (SELECT id, 0 AS n, sender, 'text' AS type, body, CASE WHEN k IS NULL THEN 'malformed form' END AS error FROM forms WHERE coalesce(k, 0) = 0 UNION ALL SELECT id, i, sender, 'document', body, NULL FROM forms, range(0, 2) r(i) WHERE i < k), {_RETRIEVAL}
SELECT CAST(s.id AS VARCHAR) || ':' || CAST(s.n AS VARCHAR) AS id, CASE WHEN error IS NOT NULL THEN 'error' WHEN w.id IS NULL THEN 'no_client' WHEN type = 'document' THEN 'received' ELSE 'searched' END AS status, CASE WHEN error IS NOT NULL THEN 'Sorry, this WhatsApp document could not be processed.' WHEN w.id IS NULL THEN 'No access / client not found' ELSE answer END AS reply
FROM sent s LEFT JOIN who w ON w.id = s.id AND w.n = s.n LEFT JOIN said ON said.id = s.id AND said.n = s.n""",
)
def form_answers(t: Tables) -> DataFrame:
    return W.answers(W.form_messages(W.form_fields(_forms(t))), t.family_clients, t.family_documents).select("id", "status", "reply")


@query("messages", "SELECT id, CAST(i AS INTEGER) AS n, 'document' AS type, 'twilio_whatsapp_' || CAST(i AS VARCHAR) || CASE WHEN i = 0 THEN '.jpg' ELSE '' END AS filename FROM messages, range(0, 2) r(i) WHERE i < id % 3 UNION ALL SELECT id, 0, 'text', NULL FROM messages WHERE id % 3 = 0")
def form_messages(t: Tables) -> DataFrame:
    media = F.array(*[F.struct(F.lit(f"u{k}").alias("url"), F.lit(c).alias("content_type")) for k, c in enumerate(("image/jpeg", "video/mp4", "application/pdf"))])
    forms = t.messages.select("id", F.col("phone").alias("From"), F.col("body").alias("Body"), F.when(F.col("id") % 3 != 0, (F.col("id") % 3).cast("string")).otherwise("").alias("NumMedia"), media.alias("media"))
    return W.form_messages(forms).select("id", "n", "type", F.col("media.filename").alias("filename"))


# --- members and gates -------------------------------------------------------------------------

#: Ranks of the roles within an organization.
ORG_RANK = {"owner": 4, "manager": 3, "staff": 2, "viewer": 1}


@query("users", "SELECT id, CASE WHEN id % 4 = 1 THEN 77 ELSE firm_id END AS organization_id, CASE WHEN id % 4 = 1 THEN 'staff' ELSE role END AS role FROM users")
def add_member(t: Tables) -> DataFrame:
    users = t.users.select("id", F.col("firm_id").cast("long").alias("organization_id"), "role")
    members = t.users.where("id % 4 = 2").select(F.lit(77).cast("long").alias("organization_id"), F.col("id").alias("user_id"), F.lit("viewer").alias("role"))
    added = t.users.where("id % 4 IN (1, 2)").select(F.lit(77).cast("long").alias("organization_id"), F.col("id").alias("user_id"), F.lit("manager").alias("role"))
    return R.add_members(members, users, added)[1]


@query("users", "SELECT id, role = 'super_admin' AS super_admin, role = 'super_admin' AS professional, firm_id % 2 = 0 AS organization, id % 3 = 1 AS org_manager FROM users")
def role_gates(t: Tables) -> DataFrame:
    org_role = F.when(F.col("id") % 3 == 1, "manager").when(F.col("id") % 3 == 2, "staff")
    u = t.users.withColumn("org_role", org_role).withColumn("organization_id", F.when(F.col("firm_id") % 2 == 0, F.col("firm_id")))
    return R.role_gates(u, Q.ROLE_RANK, ORG_RANK)
