"""Text functions, corrections, scoring, classification, extraction, matching and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import constants as K
from tallyloom.functions import text as T
from tallyloom.operators import documents as D
from tallyloom.operators import resolution as R

from .registry import Tables, query

_DIGITS = "regexp_replace(coalesce({}, ''), '[^0-9]', '', 'g')"


def _has(pattern: str, x: str = "text") -> str:
    return f"regexp_matches({x}, '{pattern}')"


def _first(pattern: str, x: str = "text", group: int = 1) -> str:
    return f"nullif(trim(regexp_extract({x}, '{pattern}', {group})), '')"


def _points(value: str, base: int, score: str = "ocr_score") -> str:
    return f"CAST(CASE WHEN {value} IS NULL THEN 0 ELSE least(100, {base} + least(10, CAST(trunc({score} / 20) AS INTEGER))) END AS INTEGER)"


# --- identifiers and general text --------------------------------------------------------------


@query(
    "clients app_documents",
    f"SELECT c.id, {_DIGITS.format('aadhaar_number')} AS aadhaar_digits, upper(regexp_replace(pan_number, '[^A-Za-z0-9]', '', 'g')) AS pan, right({_DIGITS.format('mobile')}, 10) AS phone, CASE WHEN aadhaar_number IS NULL THEN NULL ELSE aadhaar_number END AS aadhaar_formatted, regexp_matches(pan_number, '^[A-Z]{{5}}[0-9]{{4}}[A-Z]$') AS pan_ok FROM clients c",
)
def normalize_ids(t: Tables) -> DataFrame:
    return t.clients.select("id", T.digits(F.col("aadhaar_number")).alias("aadhaar_digits"), T.normalize_pan(F.col("pan_number")).alias("pan"), T.normalize_phone(F.col("mobile")).alias("phone"), T.format_aadhaar(T.digits(F.col("aadhaar_number"))).alias("f"), T.valid_pan(F.col("pan_number")).alias("pan_ok")).select("id", "aadhaar_digits", "pan", "phone", F.when(F.col("f") != "", F.col("f")).alias("aadhaar_formatted"), "pan_ok")


@query("clients", "SELECT id, CASE WHEN id % 2 = 0 THEN pan_number END AS pan FROM clients")
def pan_from_gstin(t: Tables) -> DataFrame:
    g = F.when(F.col("id") % 2 == 0, F.concat(F.lit("22"), "pan_number", F.lit("1Z5"))).otherwise(F.concat(F.lit("22"), "pan_number", F.lit("1Z")))
    return t.clients.select("id", T.pan_from_gstin(g).alias("pan"))


@query("app_documents", "SELECT id, CASE WHEN assessment_year IS NOT NULL THEN substr(assessment_year, 1, 4) || '-' || right(assessment_year, 2) END AS year, coalesce(CAST(right(assessment_year, 2) AS INTEGER) = CAST(substr(assessment_year, 3, 2) AS INTEGER) + 1, false) AS ok FROM app_documents")
def normalize_ay(t: Tables) -> DataFrame:
    return t.app_documents.select("id", T.normalize_year(F.concat(F.lit("for AY "), "assessment_year")).alias("year"), T.valid_year(F.col("assessment_year")).alias("ok"))


@query("ocr_texts", f"SELECT id, {_points('text', 90)} AS label, {_points('text', 75)} AS strict, {_points('text', 70)} AS corrected, 0 AS missing FROM ocr_texts")
def field_confidence(t: Tables) -> DataFrame:
    s, x = F.col("ocr_score"), F.lit("x")
    return t.ocr_texts.select("id", T.field_confidence(x, s, label=True).alias("label"), T.field_confidence(x, s).alias("strict"), T.field_confidence(x, s, corrected=True).alias("corrected"), T.field_confidence(F.lit(None), s).alias("missing"))


@query(
    "firms clients app_documents",
    """SELECT d.id, firm_name || '/' || coalesce(client_name || ' - ' || pan_number, 'UNMATCHED') || '/' || CASE document_type WHEN 'PAN Card' THEN 'PAN' WHEN 'Aadhaar Card' THEN 'Aadhaar' WHEN 'ITR Acknowledgement' THEN 'ITR' WHEN 'GST Certificate' THEN 'GST' WHEN 'Bank Statement' THEN 'Bank Statements' WHEN 'Balance Sheet' THEN 'Balance Sheet' ELSE 'Other' END
|| CASE WHEN document_type = 'ITR Acknowledgement' THEN '/AY ' || assessment_year ELSE '' END AS path FROM app_documents d JOIN firms f ON f.id = d.firm_id LEFT JOIN clients c ON c.id = d.client_id""",
)
def folder_path(t: Tables) -> DataFrame:
    f, c = t.firms.select(F.col("id").alias("firm_id"), "firm_name"), t.clients.select(F.col("id").alias("client_id"), "client_name", "pan_number")
    d = t.app_documents.join(f, "firm_id").join(c, "client_id", "left")
    return d.select("id", T.folder_path(F.col("firm_name"), F.col("client_name"), F.col("pan_number"), F.col("document_type"), F.col("assessment_year")).alias("path"))


@query("", "SELECT doc_id, CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^0-9]', '', 'g')) / length(text) >= 0.4 ELSE false END AS numeric_heavy, CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS INTEGER) AS n_lines FROM documents")
def text_shape(t: Tables) -> DataFrame:
    return t.base("documents").select("doc_id", T.is_numeric_heavy(F.col("text")).alias("numeric_heavy"), F.size(T.lines_of(F.col("text"))).alias("n_lines"))


@query("", r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[^\t\n\x20-\x7E\x{0900}-\x{097F}]', ' ', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9)) AS cleaned, trim(regexp_replace(text, '\s+', ' ', 'g')) AS single FROM documents")
def clean_text(t: Tables) -> DataFrame:
    return t.base("documents").select("doc_id", T.clean_text(F.col("text")).alias("cleaned"), T.normalize_whitespace(F.col("text")).alias("single"))


@query("", "SELECT doc_id, n, CASE WHEN n < 1024 THEN format('{:.1f} B', n / 1) WHEN n < 1048576 THEN format('{:.1f} KB', n / 1024) ELSE format('{:.1f} MB', n / 1048576) END AS size FROM (SELECT doc_id, CAST(octet_length(encode(text)) * (1 + doc_id % 3 * 500) AS BIGINT) AS n FROM documents)")
def readable_size(t: Tables) -> DataFrame:
    n = (F.octet_length("text") * (1 + F.col("doc_id") % 3 * 500)).cast("long")
    return t.base("documents").select("doc_id", n.alias("n"), T.human_size(n).alias("size"))


@query("", r"SELECT doc_id, length(text) >= 5 AS long_enough, round(CASE WHEN length(text) < 5 THEN 0 ELSE length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) / length(text) END, 6) AS alnum FROM documents")
def text_quality_parts(t: Tables) -> DataFrame:
    n = F.length("text")
    return t.base("documents").select("doc_id", (n >= 5).alias("long_enough"), F.round(F.when(n < 5, 0.0).otherwise(T.count_of(F.col("text"), r"\p{L}\p{N}") / n), 6).alias("alnum"))


_PRINTABLE = r"(length(regexp_replace(text, '[\p{C}\p{Z}]', '', 'g')) + length(regexp_replace(text, '[^ \n\t]', '', 'g')))"
_QUALITY = rf"CASE WHEN length(text) < 5 THEN 0 ELSE 0.4 * {_PRINTABLE} / length(text) + 0.3 * length(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g')) / length(text) + 0.3 * least(1, len(regexp_extract_all(text, '\S+')) / 50) END"


@query("", f"SELECT doc_id, round(coalesce({_QUALITY}, 0), 6) AS score, coalesce(length(trim(text, ' ')) >= 40 AND {_QUALITY} >= 0.3, false) AS useful FROM documents")
def text_quality(t: Tables) -> DataFrame:
    return t.base("documents").select("doc_id", F.round(T.text_quality(F.col("text")), 6).alias("score"), T.is_useful(F.col("text")).alias("useful"))


_LIST = lambda words: "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
_CANDIDATE = "CASE id % 7 WHEN 1 THEN 'PAN' WHEN 2 THEN 'Place of Business' WHEN 3 THEN '12 45 x' WHEN 4 THEN 'Of ' || client_name WHEN 5 THEN client_name || ' Signature' WHEN 6 THEN 'A B C D' ELSE client_name END"


@query(
    "clients",
    rf"""SELECT id, client_name AS name, cand, length(cand) BETWEEN 2 AND 60 AND NOT list_contains({_LIST(K.NAME_BLACKLIST)}, lower(cand)) AND NOT regexp_matches(cand, '^[0-9]+$') AND length(regexp_replace(cand, '[^A-Za-z]', '', 'g')) >= 2 AS likely,
length(cand) >= 4 AND NOT list_contains({_LIST(K.NAME_BLOCKLIST)}, lower(cand)) AND NOT list_has_any(string_split(lower(cand), ' '), {_LIST(K.NAME_BAD_TOKENS)}) AND length(regexp_replace(cand, '[^0-9]', '', 'g')) / length(cand) <= 0.4
 AND NOT list_contains({_LIST(K.NAME_FIRST_STOPWORDS)}, string_split(lower(cand), ' ')[1]) AND len(list_filter(string_split(cand, ' '), lambda w: length(regexp_replace(w, '[^A-Za-z]', '', 'g')) >= 2)) > 0 AND length(regexp_replace(cand, '[^A-Za-z]', '', 'g')) >= 3 AS valid,
substr(client_name, 1, 60) AS cleaned FROM (SELECT *, {_CANDIDATE} AS cand FROM clients)""",
)
def name_functions(t: Tables) -> DataFrame:
    messy = F.concat(F.lit("  "), F.upper("client_name"), F.lit(" 123"))
    c = t.clients.withColumn("cand", F.expr(_CANDIDATE))
    return c.select("id", T.normalize_name(messy).alias("name"), "cand", T.is_likely_name(F.col("cand")).alias("likely"), T.is_valid_name(F.col("cand")).alias("valid"), T.clean_name(F.concat(F.lit("Mr. "), F.col("client_name"), F.lit(" 77"))).alias("cleaned"))


# --- corrections -------------------------------------------------------------------------------


@query("ocr_texts clients", "SELECT id, 'PAN: ' || CASE WHEN id % 3 = 0 THEN substr(pan_number, 1, 4) || '2' || right(pan_number, 5) || '1' ELSE pan_number END || ' end A1B2C3D4E5 ABCDEFGHIJ' AS fixed FROM clients")
def correct_pan(t: Tables) -> DataFrame:
    """PANs whose digits were read as letters come back; longer words and words that don't look like a PAN stay as they are."""
    p = F.col("pan_number")
    noisy = F.concat(F.substring(p, 1, 5), F.translate(F.substring(p, 6, 3), "01", "OI"), F.substring(p, 9, 2))
    longer = F.concat(F.substring(p, 1, 4), F.lit("2"), F.right(p, F.lit(5)), F.lit("1"))
    return t.clients.select("id", T.fix_pan(F.concat(F.lit("PAN: "), F.when(F.col("id") % 3 == 0, longer).otherwise(noisy), F.lit(" end A1B2C3D4E5 ABCDEFGHIJ"))).alias("fixed"))


@query("app_documents", "SELECT id, 'AY ' || assessment_year || ' 3OI5-16 2O15' AS fixed FROM app_documents WHERE assessment_year IS NOT NULL")
def correct_ay(t: Tables) -> DataFrame:
    noisy = F.concat(F.lit("AY "), F.translate("assessment_year", "01", "Ol"), F.lit(" 3OI5-16 2O15"))
    return t.app_documents.where("assessment_year IS NOT NULL").select("id", T.fix_year(noisy).alias("fixed"))


@query("clients", "SELECT id, CASE WHEN id % 5 = 2 THEN 'your number ' || translate(aadhaar_number, '0158', 'OISB') ELSE 'your aadhaar ' || aadhaar_number END AS fixed, aadhaar_number IS NOT NULL AS known FROM clients")
def correct_aadhaar(t: Tables) -> DataFrame:
    noisy = F.concat(F.when(F.col("id") % 5 == 2, "your number ").otherwise("your aadhaar "), F.translate("aadhaar_number", "0158", "OISB"))
    return t.clients.select("id", T.fix_aadhaar(noisy).alias("fixed"), F.col("aadhaar_number").isNotNull().alias("known"))


@query("clients", "SELECT id, CASE WHEN id % 5 = 2 THEN 'no 22' || substr(pan_number, 1, 5) || translate(substr(pan_number, 6, 4), '0158', 'OISB') || right(pan_number, 1) || '1Z5' ELSE 'GSTIN 22' || pan_number || '1Z5' END AS fixed FROM clients")
def correct_gstin(t: Tables) -> DataFrame:
    p = F.col("pan_number")
    noisy = F.concat(F.when(F.col("id") % 5 == 2, "no 22").otherwise("GSTIN 22"), F.substring(p, 1, 5), F.translate(F.substring(p, 6, 4), "0158", "OISB"), F.substring(p, 10, 1), F.lit("1Z5"))
    return t.clients.select("id", T.fix_gstin(noisy).alias("fixed"))


@query("clients", "SELECT id, 'it''s - ' || pan_number || ' x' AS fixed FROM clients")
def correct_broken(t: Tables) -> DataFrame:
    p = F.col("pan_number")
    noisy = F.concat(F.lit("it’s – "), F.substring(p, 1, 5), F.lit("\n"), F.substring(p, 6, 5), F.lit("   x​"))
    return t.clients.select("id", T.correct(noisy).alias("fixed"))


# --- scoring -----------------------------------------------------------------------------------

_KEYWORDS = " + ".join(f"CASE WHEN contains(lower(text), '{k}') THEN 8 ELSE 0 END" for k in K.OCR_SCORE_KEYWORDS)
_PAN = r"\b[A-Z]{5}[0-9]{4}[A-Z]\b"
_GSTIN = r"\b[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]Z[0-9A-Z]\b"
_AAD4 = r"\b\d{4}[\s\-]\d{4}[\s\-]\d{4}\b"
_YEARS = "(" + _has(r"(?i)(?:assessment\s*year|ay)[\s:—\-]*(\d{4}[\-/]\d{2,4})") + " OR " + _has(r"\b(20\d{2}[\-/](?:20)?\d{2})\b") + ")"
_ITR = _has(r"(?i)\bITR[\s\-]?[0-9A-Z]{1,2}\b")
_KV = r"len(regexp_extract_all(text, '\b\w[\w\s]{2,20}:\s*\S'))"


@query(
    "ocr_texts",
    rf"""SELECT id, round(greatest(0, {_KEYWORDS} + CASE WHEN {_has(_PAN, "upper(text)")} THEN 30 ELSE 0 END + CASE WHEN {_has(_AAD4)} AND (contains(lower(text), 'aadhaar') OR contains(lower(text), 'uidai') OR contains(lower(text), 'enrolment')) THEN 25 ELSE 0 END
+ CASE WHEN {_has(_GSTIN, "upper(text)")} THEN 25 ELSE 0 END + CASE WHEN {_YEARS} THEN 15 ELSE 0 END + 0.05 * len(regexp_extract_all(text, '\S+')) + 30.0 * length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) / length(text) + 2 * {_KV} - CASE WHEN length(text) < 50 THEN 10 ELSE 0 END), 4) AS score FROM ocr_texts""",
)
def ocr_score(t: Tables) -> DataFrame:
    return t.ocr_texts.select("id", F.round(D.ocr_score(F.col("text")), 4).alias("score"))


@query("ocr_texts", f"SELECT id, ocr_score >= 70 AND ({_has(_PAN, 'upper(text)')} OR ({_ITR} AND {_YEARS}) OR {_has(_GSTIN, 'upper(text)')} OR (contains(lower(text), 'aadhaar') AND {_has(_AAD4)})) AS stop FROM ocr_texts")
def short_circuit(t: Tables) -> DataFrame:
    return t.ocr_texts.select("id", D.short_circuit(F.col("text"), F.col("ocr_score")).alias("stop"))


def _passes(t: Tables) -> DataFrame:
    return t.ocr_texts.select((F.col("id") % 3000).alias("file"), F.col("id").alias("pass_no"), F.concat(F.lit("psm"), (F.col("id") % 7).cast("string")).alias("config"), "text", (F.col("id") % 11).cast("double").alias("score"))


_PASSES = "passes AS (SELECT id % 3000 AS file, id AS pass_no, 'psm' || CAST(id % 7 AS VARCHAR) AS config, text, CAST(id % 11 AS DOUBLE) AS score FROM ocr_texts)"


@query("ocr_texts", f", {_PASSES} SELECT * FROM passes QUALIFY row_number() OVER (PARTITION BY file ORDER BY score DESC, pass_no) = 1")
def best_pass(t: Tables) -> DataFrame:
    return D.best_pass(_passes(t))


@query("ocr_texts", f", {_PASSES} SELECT p.* FROM passes p WHERE NOT EXISTS (SELECT 1 FROM passes q WHERE q.file = p.file AND q.score >= 8 AND q.pass_no < p.pass_no)")
def pass_schedule(t: Tables) -> DataFrame:
    return D.scheduled_passes(_passes(t), 8)


_STOPS = f"({_has(_PAN, 'upper(text)')} OR ({_ITR} AND {_YEARS}) OR {_has(_GSTIN, 'upper(text)')} OR (contains(lower(text), 'aadhaar') AND {_has(_AAD4)}))"


def _mode_sql(mode: str) -> str:
    """The passes of a mode as SQL rows, from its lists."""
    m = K.OCR_MODES[mode]
    names = ["grayscale_only"] * m["grayscale"] + [p for p in K.OCR_PIPELINES if p in m["pipelines"]]
    values = lambda v: ", ".join(f"({i}, {x!r})" for i, x in enumerate(v))
    return f"""SELECT '{mode}' AS mode, row_number() OVER (ORDER BY a.i, b.i, c.i) AS pass_no, 'scale' || s || '__' || p || '__psm' || psm AS config, {m['stop']} AS threshold
FROM (VALUES {values([str(s) for s in m['scales']])}) a(i, s), (VALUES {values(names)}) b(i, p), (VALUES {values([str(x) for x in m['psm']])}) c(i, psm)"""


_SCHEDULE = f"""plan AS ({' UNION ALL '.join(map(_mode_sql, K.OCR_MODES))}),
runs AS (SELECT o.id AS file, p.*, substr(o.text, 1, CAST(25 * p.pass_no AS BIGINT)) AS text, CAST((o.id * 31 + p.pass_no * p.pass_no * 17) % 97 AS DOUBLE) AS score FROM ocr_texts o JOIN plan p ON p.mode = CASE o.id % 4 WHEN 0 THEN 'dev' WHEN 1 THEN 'balanced' ELSE 'prod' END),
ends AS (SELECT *, score >= 70 AND {_STOPS} AS short_circuit FROM runs),
ran AS (SELECT * FROM ends e WHERE pass_no <= coalesce((SELECT min(pass_no) FROM ends f WHERE f.file = e.file AND (f.short_circuit OR f.score >= f.threshold)), 999))"""


def _mode_runs(t: Tables) -> DataFrame:
    """What each pass of a file's mode would read: more of the text the later it is, with scores of every height; and passes no mode has."""
    plan = D.pass_plan(t.spark)
    odd = plan.where("pass_no = 1").withColumn("config", F.lit("scale9.0__other__psm1"))
    mode = F.when(F.col("id") % 4 == 0, "dev").when(F.col("id") % 4 == 1, "balanced").otherwise("prod")
    runs = t.ocr_texts.select(F.col("id").alias("file"), mode.alias("mode"), "text").join(F.broadcast(plan.union(odd)), "mode")
    score = (F.col("file") * 31 + F.col("pass_no") * F.col("pass_no") * 17) % 97
    return runs.select("file", "mode", "config", F.substring("text", F.lit(1), F.col("pass_no") * 25).alias("text"), score.cast("double").alias("score"))


@query("ocr_texts", f", {_SCHEDULE} SELECT file, mode, config, CAST(pass_no AS INTEGER) AS pass_no, score, short_circuit FROM ran")
def executed_passes(t: Tables) -> DataFrame:
    return D.executed_passes(_mode_runs(t)).select("file", "mode", "config", "pass_no", "score", "short_circuit")


@query("ocr_texts", f", {_SCHEDULE} SELECT file, mode, count(*) AS pass_count, count(DISTINCT split_part(config, '__', 1)) AS n_scales, bool_or(short_circuit) AS short_circuit, arg_max(config, (score, -pass_no)) AS config, max(score) AS score, arg_max(text, (score, -pass_no)) AS text FROM ran GROUP BY file, mode")
def pass_summary(t: Tables) -> DataFrame:
    return D.pass_summary(D.executed_passes(_mode_runs(t)))


@query(
    "ocr_texts",
    rf""", {_PASSES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, pass_no) AS r FROM passes),
lines AS (SELECT file, r, trim(x) AS line, i FROM (SELECT file, r, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM ranked) WHERE trim(x) <> ''),
new AS (SELECT file, line, r, i FROM lines l WHERE r > 1 AND NOT EXISTS (SELECT 1 FROM lines b WHERE b.file = l.file AND b.r = 1 AND lower(b.line) = lower(l.line))
 AND ((contains(line, ':') AND length(line) > 5) OR regexp_matches(lower(line), 'pan|aadhaar|gst|name|year|itr|date|account|ifsc|tan') OR regexp_matches(upper(line), '[A-Z]{{5}}[0-9]{{4}}[A-Z]') OR regexp_matches(line, '\d{{6,}}'))
 QUALIFY row_number() OVER (PARTITION BY file, lower(line) ORDER BY r, i) = 1)
SELECT k.file, text || coalesce(chr(10) || chr(10) || '[SUPPLEMENTAL LINES]' || chr(10) || (SELECT string_agg(line, chr(10) ORDER BY r, i) FROM new n WHERE n.file = k.file), '') AS text FROM ranked k WHERE r = 1""",
)
def merged_lines(t: Tables) -> DataFrame:
    return D.merge_passes(_passes(t))


@query("", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * 4 > 70 AS high_contrast, l_linenumber < 5 AS low_noise, l_extendedprice > 300 AS sharp, l_quantity * 4 > 70 AND l_linenumber < 5 AND l_extendedprice > 300 AS clean FROM lineitem")
def quality_flags(t: Tables) -> DataFrame:
    m = t.base("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") * 4).alias("contrast_std"), F.col("l_linenumber").alias("noise"), F.col("l_extendedprice").alias("laplacian"))
    return D.quality_flags(m).drop("contrast_std", "noise", "laplacian")


# --- classification ----------------------------------------------------------------------------


def _kw(t: str) -> str:
    return "(" + " + ".join(f"CASE WHEN contains(lower(text), '{k}') THEN {w} ELSE 0 END" for k, w in K.CLASSIFICATION_KEYWORDS[t]) + ")"


_TAN = r"\b[A-Z]{4}[0-9]{5}[A-Z]\b"
_FLAGS = rf"""{_has(_PAN, "upper(text)")} AS pan, {_has(_AAD4)} OR {_has(r"\b\d{12}\b")} AS aad, {_has(_GSTIN, "upper(text)")} AS gst, {_YEARS} AS yr, {_has(_TAN, "upper(text)")} AS tan, {_ITR} AS itr, {_KV} AS kv, len(regexp_extract_all(text, '[\d,.]+\s{{2,}}[\d,.]+')) AS rows_"""
_B = lambda *rules: "(" + " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for c, p in rules) + ")"
_BONUS = {
    "PAN Card": _B(("pan", 10), ("aad", 5)),
    "Aadhaar Card": _B(("aad", 20), ("pan AND aad", 5)),
    "ITR Acknowledgement": _B(("pan", 10), ("yr", 20), ("itr", 25), ("kv >= 5", 8)),
    "GST Certificate": _B(("gst", 30), ("pan", 5)),
    "Bank Statement": _B(("rows_ >= 5", 15), ("kv >= 3", 5)),
    "Salary Slip": _B(("pan", 5), ("rows_ >= 3", 8)),
    "Invoice": _B(("gst", 10)),
    "Form 16": _B(("tan", 20), ("pan", 10), ("yr", 10)),
    "Balance Sheet": _B(("rows_ >= 3", 8), ("contains(lower(text), 'balance sheet')", 20)),
}
_CLASSIFIED = f"""flags AS (SELECT *, {_FLAGS} FROM ocr_texts),
pts AS (SELECT *, [{", ".join(f"{_kw(x)} + {_BONUS.get(x, '0')}" for x in D.TYPES)}] AS p FROM flags),
top AS (SELECT *, list_max(p) AS best, list_sum(p) AS total, list_position(p, list_max(p)) AS pos FROM pts),
classified AS (SELECT *, CASE WHEN length(trim(text)) < 20 OR best < 15 THEN 'Other' ELSE [{", ".join(f"'{x}'" for x in D.TYPES)}][pos] END AS document_type,
 CAST(CASE WHEN length(trim(text)) < 20 THEN 0 WHEN best < 15 THEN greatest(5, best) WHEN ocr_score < 20 THEN least(60, least(98, trunc(best / total * 100 * 1.5))) ELSE least(98, trunc(best / total * 100 * 1.5)) END AS INTEGER) AS document_confidence FROM top)"""


@query("ocr_texts", "SELECT id, " + ", ".join(f'CAST({_kw(x)} AS INTEGER) AS "{x.lower().replace(" ", "_")}"' for x in D.TYPES) + " FROM ocr_texts")
def keyword_scores(t: Tables) -> DataFrame:
    k = D.keyword_scores(F.col("text"))
    return t.ocr_texts.select("id", *[k[x].cast("int").alias(x.lower().replace(" ", "_")) for x in D.TYPES])


@query("ocr_texts", f", flags AS (SELECT *, {_FLAGS} FROM ocr_texts) SELECT id, " + ", ".join(f'CAST({_BONUS.get(x, "0")} AS INTEGER) AS "{x.lower().replace(" ", "_")}"' for x in D.TYPES) + " FROM flags")
def structural_bonus(t: Tables) -> DataFrame:
    b = D.structural_bonus(F.col("text"))
    return t.ocr_texts.select("id", *[b[x].cast("int").alias(x.lower().replace(" ", "_")) for x in D.TYPES])


@query("ocr_texts", f", {_CLASSIFIED} SELECT id, document_type, document_confidence FROM classified")
def classify(t: Tables) -> DataFrame:
    return D.classify(t.ocr_texts).select("id", "document_type", "document_confidence")


def _typed(t: Tables) -> DataFrame:
    """Texts with a weak type of their own, so that every refinement rule meets some."""
    o = t.ocr_texts.withColumn("scores", F.create_map(F.lit("Aadhaar Card"), F.lit(10), F.lit("Invoice"), (F.col("id") % 50).cast("int")))
    kind = F.when(F.col("id") % 5 == 0, "Invoice").when(F.col("id") % 5 == 1, "PAN Card").otherwise("Other")
    return o.select("id", "text", "scores", kind.alias("document_type"), (F.col("id") % 90).cast("int").alias("document_confidence"), F.when(F.col("id") % 6 == 1, "2").alias("aadhaar"), F.when(F.col("id") % 6 == 3, "2").alias("gstin"), F.when(F.col("id") % 6 == 2, "P").alias("pan"))


@query(
    "ocr_texts",
    f""", typed AS (SELECT id, text, CASE WHEN id % 5 = 0 THEN 'Invoice' WHEN id % 5 = 1 THEN 'PAN Card' ELSE 'Other' END AS k, CAST(id % 90 AS INTEGER) AS c, id % 50 AS inv, id % 6 AS m, {_YEARS} AND {_ITR} AS yr, {_has(_TAN, "upper(text)")} AND contains(lower(text), 'form') AND contains(text, '16') AS form FROM ocr_texts)
SELECT id, CASE WHEN m = 1 AND k <> 'PAN Card' AND contains(lower(text), 'aadhaar') THEN CASE WHEN c >= 75 OR (CASE WHEN k = 'Invoice' THEN inv ELSE 0 END) >= 30 THEN k ELSE 'Aadhaar Card' END
 WHEN m = 3 AND k = 'Other' AND (contains(lower(text), 'certificate') OR contains(lower(text), 'registration')) THEN 'GST Certificate' WHEN k = 'Other' AND m = 2 AND yr THEN 'ITR Acknowledgement' WHEN form THEN 'Form 16' ELSE k END AS document_type,
 CAST(CASE WHEN m = 1 AND k <> 'PAN Card' AND contains(lower(text), 'aadhaar') THEN CASE WHEN c >= 75 OR (CASE WHEN k = 'Invoice' THEN inv ELSE 0 END) >= 30 THEN c ELSE greatest(c, 70) END
 WHEN m = 3 AND k = 'Other' AND (contains(lower(text), 'certificate') OR contains(lower(text), 'registration')) THEN 65 WHEN k = 'Other' AND m = 2 AND yr THEN 72 WHEN form THEN greatest(c, 70) ELSE c END AS INTEGER) AS document_confidence FROM typed""",
)
def refine(t: Tables) -> DataFrame:
    return D.refine(_typed(t)).select("id", "document_type", "document_confidence")


@query("app_documents", "SELECT id, CASE WHEN coalesce(document_type, 'Other') = 'Other' THEN 'pending_review' WHEN client_id IS NOT NULL AND id % 3 <> 0 AND confidence_score >= 70 AND id % 160 >= 25 THEN 'auto_classified' ELSE 'pending_review' END AS status FROM app_documents")
def status(t: Tables) -> DataFrame:
    return t.app_documents.select("id", D.status(F.coalesce("document_type", F.lit("Other")), F.col("client_id"), F.col("id") % 3 == 0, F.col("confidence_score"), F.col("id") % 160).alias("status"))


@query("ocr_texts", f"SELECT id, CASE WHEN length(trim(text)) < 20 THEN 'Unreadable' WHEN contains(lower(text), 'enrollment') THEN 'Enrollment Certificate' WHEN contains(lower(text), 'aadhaar') OR contains(lower(text), 'uidai') OR {_has(chr(92) + 'b' + chr(92) + 'd{4}' + chr(92) + 's' + chr(92) + 'd{4}' + chr(92) + 's' + chr(92) + 'd{4}' + chr(92) + 'b')} THEN 'Aadhaar' WHEN {_has(_PAN)} THEN 'PAN Card' ELSE 'Unknown' END AS kind FROM ocr_texts")
def legacy_classify(t: Tables) -> DataFrame:
    return t.ocr_texts.select("id", D.legacy_class(F.col("text")).alias("kind"))


# --- extraction --------------------------------------------------------------------------------


def _pick(t: Tables, field) -> DataFrame:
    return t.ocr_texts.select("id", field.alias("f")).select("id", "f.value", "f.confidence")


def _simple(value: str, confidence: str) -> str:
    return f"SELECT id, {value} AS value, {confidence} AS confidence FROM ocr_texts"


_PAN_L = f"CASE WHEN id % 6 IN (0, 2) THEN {_first(r'PAN: ([A-Z0-9]{10})')} END"


@query("ocr_texts", f"SELECT id, coalesce({_PAN_L}, {_first('(' + _PAN + ')', 'upper(text)')}) AS value, CASE WHEN {_PAN_L} IS NOT NULL THEN {_points(_PAN_L, 90)} ELSE {_points(_first('(' + _PAN + ')', 'upper(text)'), 75)} END AS confidence FROM ocr_texts")
def extract_pan(t: Tables) -> DataFrame:
    return _pick(t, D.pan_field(F.col("text"), F.col("ocr_score")))


_AAD = _first(r"Aadhaar No: ([0-9 ]{14})")


@query("ocr_texts", f", a AS (SELECT id, ocr_score, {_AAD} AS v FROM ocr_texts), b AS (SELECT id, ocr_score, CASE WHEN len(list_distinct(list_filter(string_split(v, ''), lambda c: c <> ' '))) >= 4 THEN v END AS value FROM a) SELECT id, value, {_points('value', 90)} AS confidence FROM b")
def extract_aadhaar(t: Tables) -> DataFrame:
    return _pick(t, D.aadhaar_field(F.col("text"), F.col("ocr_score")))


_G = _first(r"GSTIN: ([0-9A-Z]{15})")


@query("ocr_texts", _simple(_G, _points(_G, 90)))
def extract_gstin(t: Tables) -> DataFrame:
    return _pick(t, D.gstin_field(F.col("text"), F.col("ocr_score")))


@query("clients", "SELECT id, substr(pan_number, 1, 4) || '12345' || right(pan_number, 1) AS value, 94 AS confidence FROM clients")
def extract_tan(t: Tables) -> DataFrame:
    text = F.concat(F.lit("Form 16\nTAN: "), F.substring("pan_number", 1, 4), F.lit("12345"), F.right("pan_number", F.lit(1)))
    return t.clients.select("id", D.tan_field(text, F.lit(85.0)).alias("f")).select("id", "f.value", "f.confidence")


_I = _first(r"IFSC: ([A-Z0-9]{11})")


@query("ocr_texts", _simple(_I, _points(_I, 90)))
def extract_ifsc(t: Tables) -> DataFrame:
    return _pick(t, D.ifsc_field(F.col("text"), F.col("ocr_score")))


_Y = _first(r"Assessment Year: (\d{4}-\d{2})")


@query("ocr_texts", _simple(_Y, _points(_Y, 90)))
def extract_year(t: Tables) -> DataFrame:
    return _pick(t, D.year_field(F.col("text"), F.col("ocr_score")))


_N = _first(r"Name: ([A-Za-z ]+)")


@query("ocr_texts", f"SELECT id, CASE WHEN id % 6 = 5 THEN 'Plain Note' ELSE {_N} END AS value, CASE WHEN id % 6 = 5 THEN 40 WHEN id % 6 = 0 THEN {_points(_N, 75)} + 10 ELSE {_points(_N, 75)} END AS confidence FROM ocr_texts")
def extract_name(t: Tables) -> DataFrame:
    d, x = D.look_once(t.ocr_texts)
    d = d.withColumn("pan", D.pan_field(x, F.col("ocr_score"))["value"])
    return d.select("id", D.name_field(x, F.col("ocr_score"), F.col("pan")).alias("f")).select("id", "f.value", "f.confidence")


@query("ocr_texts", f"SELECT id, CASE WHEN id % 6 = 5 THEN 'Plain Note' ELSE {_N} END AS value, CASE WHEN id % 6 = 5 THEN 40 WHEN id % 6 = 0 THEN {_points(_N, 75)} + 10 ELSE {_points(_N, 75)} END AS confidence FROM ocr_texts")
def extract_name_all(t: Tables) -> DataFrame:
    """The names as ``extract_fields`` gives them."""
    return D.extract_fields(t.ocr_texts).select("id", "name.value", "name.confidence")


@query("clients", "SELECT id, 'INV-' || CAST(id + 100 AS VARCHAR) AS value, 90 AS confidence FROM clients")
def extract_invoice_number(t: Tables) -> DataFrame:
    text = F.concat(F.lit("Tax Invoice No: INV-"), (F.col("id") + 100).cast("string"), F.lit(" dated"))
    return t.clients.select("id", T.first_match(text, K.INVOICE_LABEL).alias("value")).withColumn("confidence", T.field_confidence(F.col("value"), F.lit(0.0), label=True))


@query("ocr_texts", "SELECT id, CASE id % 6 WHEN 4 THEN '9876500000' WHEN 2 THEN right(lpad(CAST(id AS VARCHAR), 15, '8'), 10) END AS value, CASE id % 6 WHEN 4 THEN 75 WHEN 2 THEN 55 ELSE 0 END AS confidence FROM ocr_texts")
def extract_phone(t: Tables) -> DataFrame:
    return _pick(t, D.phone_field(F.col("text")))


_E = _first(r"\b([a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,})\b")


@query("", f"SELECT doc_id, lower({_E}) AS value FROM documents")
def extract_email(t: Tables) -> DataFrame:
    return t.base("documents").select("doc_id", D.simple_field(F.col("text"), K.EMAIL, 90, lower=True)["value"].alias("value"))


@query("ocr_texts", r"SELECT id, array_to_string(regexp_extract_all(text, '\b(\d{1,2}[/\-.]\d{1,2}[/\-.]\d{4})\b', 1), ',') AS dates FROM ocr_texts")
def extract_dates(t: Tables) -> DataFrame:
    return t.ocr_texts.select("id", F.array_join(D.dates_field(F.col("text")), ",").alias("dates"))


@query("ocr_texts", f"SELECT id, {_first(r'Tax Period: (March 2024)')} AS month, CASE WHEN id % 6 = 3 THEN 85 ELSE 0 END AS confidence FROM ocr_texts")
def extract_gst_period(t: Tables) -> DataFrame:
    return t.ocr_texts.select("id", D.gst_period_field(F.col("text")).alias("f")).select("id", "f.month", "f.confidence")


@query("ocr_texts", f"SELECT id, {_first(r'Form (ITR-[0-9])')} AS value FROM ocr_texts")
def extract_itr_type(t: Tables) -> DataFrame:
    return t.ocr_texts.select("id", D.itr_type(F.col("text")).alias("value"))


_A = _first(r"Acknowledgement No. (\d{12,15})")


@query("ocr_texts", _simple(_A, f"CASE WHEN {_A} IS NULL THEN 0 ELSE 85 END"))
def extract_ack_number(t: Tables) -> DataFrame:
    return _pick(t, D.simple_field(F.col("text"), K.ACK_LABEL, 85))


@query("ocr_texts", rf"SELECT id, {_first('(' + _PAN + ')', 'upper(text)')} AS pan, {_first(r'\b([2-9]\d{3} ?\d{4} ?\d{4})\b')} AS aadhaar, {_first('(' + _GSTIN + ')', 'upper(text)')} AS gstin, {_first(r'\b([A-Z]{4}0[A-Z0-9]{6})\b', 'upper(text)')} AS ifsc, {_first(r'\b(20\d{2}-\d{2})\b')} AS assessment_year FROM ocr_texts")
def extract_legacy_ids(t: Tables) -> DataFrame:
    return D.legacy_ids(t.ocr_texts).select("id", "pan", "aadhaar", "gstin", "ifsc", "assessment_year")


@query("app_documents clients", "SELECT d.id, 'Document Type: ' || coalesce(document_type, 'Other') || ' (confidence: ' || CAST(CAST(confidence_score AS INTEGER) AS VARCHAR) || '%)' || coalesce(' | Name: ' || client_name, '') || coalesce(' | PAN: ' || pan_number, '') || coalesce(' | Assessment Year: ' || assessment_year, '') AS summary FROM app_documents d LEFT JOIN clients c ON c.id = d.client_id")
def summary_line(t: Tables) -> DataFrame:
    c = t.clients.select(F.col("id").alias("client_id"), "client_name", "pan_number")
    return t.app_documents.join(c, "client_id", "left").select("id", T.summary_line(F.coalesce("document_type", F.lit("Other")), F.col("confidence_score").cast("int"), Name=F.col("client_name"), PAN=F.col("pan_number"), Assessment_Year=F.col("assessment_year")).alias("summary"))


# --- matching, duplicates, routing -------------------------------------------------------------


def _to_match(t: Tables) -> DataFrame:
    """Documents that meet every rule: by PAN, GSTIN, Aadhaar, name, or nothing."""
    c = t.clients.select(F.col("id").alias("k"), F.col("pan_number").alias("p"), F.col("aadhaar_number").alias("a"), F.col("client_name").alias("n"))
    d = t.app_documents.select("id", "firm_id", "document_type", F.coalesce("client_id", (F.col("id") % 100).cast("long")).alias("k"), (F.col("id") % 5).alias("m")).join(c, "k")
    return d.select("id", "firm_id", "document_type", F.when(F.col("m") == 0, F.col("p")).alias("pan"), F.when(F.col("m") == 1, F.concat(F.lit("22"), "p", F.lit("1Z5"))).alias("gstin"), F.when(F.col("m") == 2, F.col("a")).alias("aadhaar"), F.when(F.col("m").isin(2, 3), F.col("n")).alias("name"))


_MATCH = f"""src AS (SELECT d.id, d.firm_id, lower(coalesce(document_type, '')) AS ty, CASE WHEN d.id % 5 = 0 THEN pan_number WHEN d.id % 5 = 1 THEN pan_number END AS p, d.id % 5 AS m, CASE WHEN d.id % 5 = 2 THEN {_DIGITS.format("aadhaar_number")} END AS a, CASE WHEN d.id % 5 IN (2, 3) THEN lower(client_name) END AS n
 FROM app_documents d JOIN clients c ON c.id = coalesce(d.client_id, d.id % 100)),
act AS (SELECT id AS cid, firm_id, upper(pan_number) AS p, replace(aadhaar_number, ' ', '') AS a, lower(client_name) AS n, client_type = 'personal' AND is_primary_personal AS prime FROM clients WHERE is_active),
r1 AS (SELECT s.id, CASE m WHEN 0 THEN 1 ELSE 2 END AS rule, min(cid) AS client_id, CASE m WHEN 0 THEN 1.0 ELSE 0.98 END AS confidence, false AS ambiguous, CASE m WHEN 0 THEN 'PAN match' ELSE 'PAN in GSTIN' END AS reason FROM src s JOIN act USING (firm_id, p) GROUP BY s.id, m),
g3 AS (SELECT s.id, ty, count(*) AS k, min(cid) AS c, min(CASE WHEN prime THEN cid END) AS q FROM src s JOIN act USING (firm_id, a) WHERE s.a <> '' GROUP BY s.id, ty),
r3 AS (SELECT id, 3 AS rule, CASE WHEN k = 1 THEN c WHEN contains(ty, 'aadhaar') AND q IS NOT NULL THEN q END AS client_id, CASE WHEN k = 1 THEN 0.95 WHEN contains(ty, 'aadhaar') AND q IS NOT NULL THEN 0.92 ELSE 0.5 END AS confidence, k > 1 AND NOT (contains(ty, 'aadhaar') AND q IS NOT NULL) AS ambiguous, 'Aadhaar match' AS reason FROM g3),
g4 AS (SELECT s.id, count(*) AS k, min(cid) AS c FROM src s JOIN act t ON t.firm_id = s.firm_id AND (contains(s.n, t.n) OR contains(t.n, s.n)) WHERE s.id NOT IN (SELECT id FROM r1) AND s.id NOT IN (SELECT id FROM r3) GROUP BY s.id),
r4 AS (SELECT id, 4 AS rule, CASE WHEN k = 1 THEN c END AS client_id, CASE WHEN k = 1 THEN 0.75 ELSE 0.4 END AS confidence, k > 1 AS ambiguous, 'Name match' AS reason FROM g4),
u AS (SELECT * FROM r1 UNION ALL SELECT * FROM r3 UNION ALL SELECT * FROM r4)
SELECT s.id, client_id, CAST(coalesce(confidence, 0) AS DOUBLE) AS confidence, coalesce(ambiguous, false) AS ambiguous, reason FROM src s LEFT JOIN u ON u.id = s.id"""


@query("app_documents clients", ", " + _MATCH)
def match_client_tenant(t: Tables) -> DataFrame:
    return R.match_in_firm(_to_match(t), t.clients)


@query(
    "clients app_documents",
    f""", d AS (SELECT d.id, CASE WHEN d.id % 3 = 0 THEN c.pan_number END AS pan, CASE WHEN d.id % 3 <> 2 THEN '22' || e.pan_number || '1Z5' END AS gstin, {_DIGITS.format("c.aadhaar_number")} AS a, d.id % 100 AS ac FROM app_documents d JOIN clients c ON c.id = coalesce(d.client_id, 1) JOIN clients e ON e.id = d.id % 700),
r AS (SELECT id AS client_id, 5000 - id AS registry_idx, pan_number AS pan, CASE WHEN id % 2 = 0 THEN '22' || pan_number || '1Z5' END AS gstin, nullif({_DIGITS.format("aadhaar_number")}, '') AS a FROM clients),
h AS (SELECT d.id, client_id, registry_idx, 0 AS k, 95 AS pts FROM d JOIN r USING (pan) UNION ALL SELECT d.id, client_id, registry_idx, 1, 90 FROM d JOIN r USING (gstin) UNION ALL SELECT d.id, client_id, registry_idx, 3, 82 FROM d JOIN r ON d.a = r.a WHERE ac >= 75),
b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY id ORDER BY registry_idx, k) = 1)
SELECT d.id, client_id, coalesce(pts, 0) AS match_confidence, ['pan', 'gstin', 'tan', 'aadhaar'][k + 1] AS match_field FROM d LEFT JOIN b USING (id)""",
)
def match_client_registry(t: Tables) -> DataFrame:
    c = t.clients
    one = c.select(F.col("id").alias("k"), "pan_number", "aadhaar_number")
    two = c.select(F.col("id").alias("e"), F.col("pan_number").alias("pan2"))
    d = t.app_documents.select("id", F.coalesce("client_id", F.lit(1).cast("long")).alias("k"), (F.col("id") % 700).alias("e")).join(one, "k").join(two, "e")
    none = F.lit(None).cast("string")
    d = d.select("id", F.when(F.col("id") % 3 == 0, F.col("pan_number")).alias("pan"), F.when(F.col("id") % 3 != 2, F.concat(F.lit("22"), "pan2", F.lit("1Z5"))).alias("gstin"), none.alias("tan"), F.col("aadhaar_number").alias("aadhaar"), (F.col("id") % 100).alias("aadhaar_confidence"))
    r = c.select((F.lit(5000) - F.col("id")).alias("registry_idx"), F.col("id").alias("client_id"), F.col("pan_number").alias("pan"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("22"), "pan_number", F.lit("1Z5"))).alias("gstin"), none.alias("tan"), F.col("aadhaar_number").alias("aadhaar"))
    return R.match_in_registry(d, r)


_FP = "md5(upper(coalesce(document_type, '') || '|' || CASE WHEN id % 3 = 0 THEN CAST(client_id AS VARCHAR) ELSE '' END || '|' || '||' || '|' || coalesce(assessment_year, '')))"
_FILES = f"files AS (SELECT id AS seq, filename AS file, CASE WHEN id % 11 = 0 THEN NULL ELSE sha256(CAST(id % 9000 AS VARCHAR)) END AS sha, {_FP.replace('CAST(client_id AS VARCHAR)', 'coalesce(CAST(client_id AS VARCHAR), chr(39))'.replace('chr(39)', repr('')))} AS fp FROM app_documents)"


def _files(t: Tables) -> DataFrame:
    none = F.lit(None).cast("string")
    pan = F.when(F.col("id") % 3 == 0, F.col("client_id").cast("string"))
    return t.app_documents.select(F.col("id").alias("seq"), F.col("filename").alias("file"), F.when(F.col("id") % 11 != 0, R.file_hash((F.col("id") % 9000).cast("string").cast("binary"))).alias("sha"), R.fingerprint(F.col("document_type"), pan, none, none, none, F.col("assessment_year")).alias("fp"))


@query("app_documents", f", {_FILES} SELECT seq, fp, sha FROM files")
def fingerprints(t: Tables) -> DataFrame:
    return _files(t).select("seq", "fp", "sha")


_DUPS = f"""{_FILES}, a AS (SELECT *, CASE WHEN sha IS NOT NULL THEN row_number() OVER (PARTITION BY sha ORDER BY seq) > 1 ELSE false END AS ex, first_value(file) OVER (PARTITION BY sha ORDER BY seq) AS f FROM files),
b AS (SELECT seq, row_number() OVER (PARTITION BY fp ORDER BY seq) > 1 AS se, first_value(file) OVER (PARTITION BY fp ORDER BY seq) AS g FROM a WHERE NOT ex),
dups AS (SELECT a.seq, file, CASE WHEN ex THEN 'exact' WHEN se THEN 'semantic' END AS duplicate_type, CASE WHEN ex THEN f WHEN se THEN g END AS original_file FROM a LEFT JOIN b USING (seq))"""


@query("app_documents", f", {_DUPS} SELECT * FROM dups")
def duplicates(t: Tables) -> DataFrame:
    return R.find_duplicates(_files(t)).drop("sha", "fp")


_FOLDERS = "CASE document_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.DRIVE_FOLDERS.items()) + " ELSE 'Uncategorised' END"
_DECIDE = f"""dec AS (SELECT id, CAST(confidence_score AS INTEGER) AS c, id % 160 AS s, coalesce(document_type, 'None') AS document_type, client_id FROM app_documents),
fol AS (SELECT *, CASE WHEN c < 60 THEN 'Uncategorised' ELSE {_FOLDERS} END AS folder_name FROM dec),
rev AS (SELECT *, concat_ws('; ', CASE WHEN s < 20 THEN 'low OCR score (' || CAST(s AS VARCHAR) || '.0)' END, CASE WHEN c < 60 THEN 'low classification confidence (' || CAST(c AS VARCHAR) || '%)' END, CASE WHEN c >= 60 AND folder_name = 'Uncategorised' THEN 'unrecognised document type ''' || document_type || '''' END) AS review_reason FROM fol)"""


def _decided(t: Tables) -> DataFrame:
    return t.app_documents.select("id", F.coalesce("document_type", F.lit("None")).alias("document_type"), F.col("confidence_score").cast("int").alias("document_confidence"), (F.col("id") % 160).cast("double").alias("ocr_score"), "client_id", "filename")


@query("app_documents", f", {_DECIDE} SELECT id, folder_name, '[Client Root]/' || folder_name AS folder_path, review_reason <> '' AS needs_review, review_reason FROM rev")
def folder_decision(t: Tables) -> DataFrame:
    d = _decided(t)
    return d.select("id", R.folder_decision(F.col("document_type"), F.col("document_confidence"), F.col("ocr_score"), F.lit(None).cast("string")).alias("f")).select("id", "f.*")


def _routed(t: Tables) -> DataFrame:
    c = t.clients.select(F.col("id").alias("client_id"), "client_name", F.lit("pan").alias("match_field"))
    d = R.find_duplicates(_files(t)).select(F.col("seq").alias("id"), "duplicate_type", "original_file")
    return R.route(_decided(t).join(c, "client_id", "left").join(d, "id"))


_ROUTE = f"""{_DUPS}, {_DECIDE}, routed AS (SELECT r.id, folder_name, CASE WHEN duplicate_type IS NOT NULL THEN 'skip' WHEN review_reason <> '' OR client_id IS NULL THEN 'review' ELSE 'upload' END AS action,
CASE WHEN duplicate_type IS NOT NULL THEN 'Duplicate (' || duplicate_type || '): matches ' || original_file WHEN review_reason <> '' OR client_id IS NULL THEN concat_ws('; ', nullif(review_reason, ''), CASE WHEN client_id IS NULL THEN 'no client match' END) ELSE 'Matched client ''' || client_name || ''' via pan' END AS action_reason
FROM rev r JOIN dups d ON d.seq = r.id LEFT JOIN clients c ON c.id = r.client_id)"""


@query("app_documents clients", f", {_ROUTE} SELECT * FROM routed")
def routing(t: Tables) -> DataFrame:
    return _routed(t).select("id", "folder_name", "action", "action_reason")


@query("app_documents clients", f", {_ROUTE} SELECT count(*) AS n_files, " + ", ".join(f"count(*) FILTER (id % 4 = {i}) AS n_{s}" for i, s in enumerate(("ok", "cached", "error", "missing"))) + ", " + ", ".join(f"count(*) FILTER (action = '{a}') AS n_{a}" for a in ("upload", "review", "skip")) + " FROM routed")
def batch_summary(t: Tables) -> DataFrame:
    state = F.get(F.array(*map(F.lit, ("ok", "cached", "error", "missing"))), (F.col("id") % 4).cast("int"))
    return R.batch_summary(_routed(t).withColumn("status", state))


@query("app_documents", f", {_FILES}, cache AS (SELECT DISTINCT sha FROM files WHERE seq % 2 = 0 AND sha IS NOT NULL) SELECT count(*) FILTER (sha IN (SELECT sha FROM cache)) AS hits, count(*) AS n, round(100.0 * count(*) FILTER (sha IN (SELECT sha FROM cache)) / count(*), 1) AS hit_percent FROM files WHERE sha IS NOT NULL")
def cache_stats(t: Tables) -> DataFrame:
    f = _files(t).where("sha IS NOT NULL")
    cache = f.where("seq % 2 = 0").select("sha").distinct().withColumn("hit", F.lit(1))
    return f.join(cache, "sha", "left").agg(F.count("hit").alias("hits"), F.count("*").alias("n")).withColumn("hit_percent", F.round(F.lit(100.0) * F.col("hits") / F.col("n"), 1))


@query("ocr_texts", "SELECT id, substr(text, 1, 500) AS text_preview, length(text) AS n_chars FROM ocr_texts")
def result_projection(t: Tables) -> DataFrame:
    return t.ocr_texts.select("id", F.substring("text", 1, 500).alias("text_preview"), F.length("text").cast("long").alias("n_chars"))
