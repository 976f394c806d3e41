"""Queries in SQL text that call the functions of ``functions.sql``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.functions import sql as S

from . import documents as P
from .ingest import PROCESSED
from .registry import Tables, query


def registered(spark: SparkSession) -> SparkSession:
    """The session with the SQL functions, created at the first use."""
    if not spark.catalog.functionExists("document_fields"):
        S.register(spark)
    return spark


@query("ocr_texts", f", {PROCESSED} SELECT p.id, d.doc_id, pan_v AS pan, aad_v AS aadhaar, gstin_v AS gstin, year_v AS year, itr_v AS itr_type, name_v AS name, coalesce(substr(pan_v, 3, 3), '') AS pan_part, document_type IN ('x') AS odd, round(coalesce({P._QUALITY.replace('text', 'd.text')}, 0), 6) AS prose_quality, coalesce(length(trim(d.text, ' ')) >= 40 AND {P._QUALITY.replace('text', 'd.text')} >= 0.3, false) AS prose_useful FROM processed p LEFT JOIN documents d ON d.doc_id = p.id")
def sql_document_fields(t: Tables) -> DataFrame:
    """Fields of every text by the table function, and scalar functions over the prose of the same id."""
    text = """
    SELECT o.id, d.doc_id, f.pan, f.aadhaar, f.gstin, f.year, f.itr_type, f.name, substr(normalize_pan(lower(f.pan)), 3, 3) AS pan_part, false AS odd,
      coalesce(round(text_quality(d.text), 6), 0) AS prose_quality, is_useful_text(d.text) AS prose_useful
    FROM {ocr_texts} o LEFT JOIN {documents} d ON d.doc_id = o.id, LATERAL document_fields(o.text, o.ocr_score) f
    """
    return registered(t.spark).sql(text, ocr_texts=t.ocr_texts, documents=t.base("documents"))


@query(
    "ocr_texts",
    f""", {PROCESSED}, v AS (SELECT id, unnest([{{'field': 'pan', 'value': pan_v}}, {{'field': 'aadhaar', 'value': aad_v}}, {{'field': 'gstin', 'value': gstin_v}}, {{'field': 'year', 'value': year_v}}, {{'field': 'name', 'value': name_v}}, {{'field': 'itr_type', 'value': itr_v}}]) AS x FROM processed)
SELECT x.field AS field, count(*) AS n, count(DISTINCT x.value) AS n_values FROM v WHERE x.value IS NOT NULL GROUP BY 1""",
)
def sql_field_counts(t: Tables) -> DataFrame:
    """How often each field is found, over the rows that the fields of a text make."""
    text = """
    SELECT field, count(*) AS n, count(DISTINCT value) AS n_values
    FROM {ocr_texts} o, LATERAL document_fields(o.text, o.ocr_score) f
    LATERAL VIEW stack(6, 'pan', f.pan, 'aadhaar', f.aadhaar, 'gstin', f.gstin, 'year', f.year, 'name', f.name, 'itr_type', f.itr_type) x AS field, value
    WHERE value IS NOT NULL GROUP BY field
    """
    return registered(t.spark).sql(text, ocr_texts=t.ocr_texts)


@query(
    "clients app_documents",
    """SELECT c.id, pan_number AS pan, CASE WHEN c.id % 3 = 0 THEN pan_number END AS from_gstin, regexp_replace(coalesce(mobile, ''), '[^0-9]', '', 'g') AS digits, right(regexp_replace(coalesce(mobile, ''), '[^0-9]', '', 'g'), 10) AS phone, true AS pan_ok, coalesce(aadhaar_number IS NOT NULL, false) AS aadhaar_ok,
CASE WHEN d.document_type IS NULL THEN 'Other' WHEN d.document_type LIKE 'ITR%' THEN 'ITR' WHEN d.document_type LIKE 'GST%' THEN 'GST' WHEN d.document_type LIKE 'Aadhaar%' THEN 'Aadhaar' WHEN d.document_type LIKE 'Bank%' THEN 'Bank Statements' WHEN d.document_type LIKE 'Balance%' THEN 'Balance Sheet' WHEN d.document_type LIKE 'PAN%' THEN 'PAN' ELSE 'Other' END AS folder,
d.id AS document_id, CASE WHEN d.assessment_year IS NOT NULL THEN substr(d.assessment_year, 1, 4) || '-' || right(d.assessment_year, 2) END AS year, md5(upper(coalesce(document_type, '') || '|' || pan_number || '||||' || coalesce(assessment_year, ''))) AS fingerprint
FROM clients c JOIN app_documents d ON d.client_id = c.id""",
)
def sql_normalisers(t: Tables) -> DataFrame:
    """The scalar functions over clients and their documents, joined and projected in SQL."""
    text = """
    SELECT c.id, normalize_pan(concat(' ', lower(substr(c.pan_number, 1, 5)), '-', substr(c.pan_number, 6))) AS pan,
      pan_from_gstin(CASE WHEN c.id % 3 = 0 THEN concat('22', c.pan_number, '1Z5') ELSE 'short' END) AS from_gstin,
      digits_of(c.mobile) AS digits, normalize_phone(c.mobile) AS phone, is_valid_pan(c.pan_number) AS pan_ok, is_valid_aadhaar(c.aadhaar_number) AS aadhaar_ok,
      document_folder(d.document_type) AS folder, d.id AS document_id, normalize_year(concat('AY ', d.assessment_year)) AS year,
      document_fingerprint(d.document_type, c.pan_number, NULL, NULL, NULL, d.assessment_year) AS fingerprint
    FROM {clients} c JOIN {documents} d ON d.client_id = c.id
    """
    return registered(t.spark).sql(text, clients=t.clients, documents=t.app_documents)
