"""Tables of the document engine derived from the driver's tables; one SQL text for Spark and for DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_MACROS = {
    "L": lambda e: f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(({e}) % 26 AS INT) + 1, 1)",
}


def _letter(e: str) -> str:
    return _MACROS["L"](e)


def pan(k: str) -> str:
    return "(" + " || ".join([_letter(k), _letter(f"CAST(floor({k} / 26) AS BIGINT)"), _letter(f"CAST(floor({k} / 676) AS BIGINT)"), "'P'", _letter(f"{k} % 7"), f"lpad(CAST({k} % 10000 AS STRING), 4, '0')", _letter(k)]) + ")"


def aadhaar(k: str) -> str:
    return f"('2' || lpad(CAST({k} * 7919 % 1000 AS STRING), 3, '0') || ' ' || lpad(CAST({k} * 104729 % 10000 AS STRING), 4, '0') || ' ' || lpad(CAST({k} % 10000 AS STRING), 4, '0'))"


def name(k: str) -> str:
    first = f"CASE {k} % 5 WHEN 0 THEN 'Asha' WHEN 1 THEN 'Bina' WHEN 2 THEN 'Chetan' WHEN 3 THEN 'Deepak' ELSE 'Esha' END"
    return f"({first} || ' ' || {_letter(k)} || lower({_letter(f'CAST(floor({k} / 26) AS BIGINT)')} || {_letter(f'CAST(floor({k} / 676) AS BIGINT)')} || 'ar'))"


_C = "c_custkey"
_O = "o.o_custkey"

#: view -> (base tables, SQL). Bases are written as {table}.
VIEWS: dict[str, str] = {
    "firms": "SELECT n_nationkey AS id, n_name AS firm_name, n_nationkey % 10 <> 9 AS is_active FROM {nation}",
    "users": "SELECT s_suppkey AS id, s_nationkey AS firm_id, s_name AS full_name, CASE WHEN s_suppkey = 0 THEN 'super_admin' WHEN s_suppkey % 4 = 0 THEN 'firm_admin' ELSE 'staff' END AS role, s_suppkey % 11 <> 10 AS is_active FROM {supplier}",
    "clients": f"""SELECT c_custkey AS id, c_nationkey AS firm_id, {name(_C)} AS client_name,
 CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE '9' || lpad(CAST(c_custkey AS STRING), 4, '0') || CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE '' END || '00000' END AS mobile,
 {pan(_C)} AS pan_number, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE {aadhaar("(c_custkey - c_custkey % 3)")} END AS aadhaar_number,
 CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'personal' WHEN 'BUILDING' THEN 'huf' WHEN 'MACHINERY' THEN 'company' ELSE 'business' END AS client_type,
 c_custkey % 3 = 0 AS is_primary_personal, c_custkey % 7 <> 6 AS is_active FROM {{customer}}""",
    "app_documents": """SELECT o.o_orderkey AS id, c.c_nationkey AS firm_id, CASE WHEN o.o_orderkey % 10 = 0 THEN NULL ELSE o.o_custkey END AS client_id,
 'doc_' || CAST(o.o_orderkey AS STRING) || CASE o.o_orderkey % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PNG' WHEN 2 THEN '.jpg' ELSE '.docx' END AS filename,
 CASE o.o_orderkey % 8 WHEN 0 THEN 'PAN Card' WHEN 1 THEN 'Aadhaar Card' WHEN 2 THEN 'ITR Acknowledgement' WHEN 3 THEN 'GST Certificate' WHEN 4 THEN 'Bank Statement' WHEN 5 THEN 'Balance Sheet' WHEN 6 THEN NULL ELSE 'Other' END AS document_type,
 CASE WHEN o.o_orderkey % 8 = 2 THEN CAST(2015 + o.o_orderkey % 9 AS STRING) || '-' || CAST(16 + o.o_orderkey % 9 AS STRING) ELSE NULL END AS assessment_year,
 CAST(o.o_orderkey % 101 AS DOUBLE) AS confidence_score, CASE o.o_orderstatus WHEN 'O' THEN 'pending_review' WHEN 'F' THEN 'auto_classified' ELSE 'approved' END AS status,
 o.o_orderdate AS uploaded_at FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey""",
    "ocr_texts": f"""SELECT o.o_orderkey AS id, 'f' || CAST(o.o_orderkey AS STRING) AS file, c.c_nationkey AS firm_id, CAST(o.o_orderkey % 160 AS DOUBLE) AS ocr_score,
 CASE o.o_orderkey % 6
 WHEN 0 THEN 'INCOME TAX DEPARTMENT' || chr(10) || 'GOVT. OF INDIA' || chr(10) || 'Permanent Account Number' || chr(10) || 'Name: ' || {name(_O)} || chr(10) || 'PAN: ' || {pan(_O)} || chr(10) || 'Date of Birth: 01/01/1980'
 WHEN 1 THEN 'Government of India' || chr(10) || 'Unique Identification Authority' || chr(10) || 'Your Aadhaar' || chr(10) || 'Aadhaar No: ' || {aadhaar("(o.o_custkey - o.o_custkey % 3)")} || chr(10) || 'Name: ' || {name(_O)}
 WHEN 2 THEN 'Income Tax Return Acknowledgement' || chr(10) || 'Assessment Year: ' || CAST(2015 + o.o_orderkey % 9 AS STRING) || '-' || CAST(16 + o.o_orderkey % 9 AS STRING) || chr(10) || 'Form ITR-' || CAST(o.o_orderkey % 7 + 1 AS STRING) || chr(10) || 'PAN: ' || {pan(_O)} || chr(10) || 'Acknowledgement No. ' || lpad(CAST(o.o_orderkey AS STRING), 15, '8') || chr(10) || 'Filing Date 22-01-2020'
 WHEN 3 THEN 'GST Certificate' || chr(10) || 'GSTIN: 22' || {pan(_O)} || '1Z5' || chr(10) || 'Registration Certificate under Goods and Services Tax' || chr(10) || 'Tax Period: March 2024'
 WHEN 4 THEN 'Statement of Account' || chr(10) || 'Account Number: ' || lpad(CAST(o.o_orderkey AS STRING), 12, '3') || chr(10) || 'IFSC: HDFC0' || lpad(CAST(o.o_custkey % 1000000 AS STRING), 6, '0') || chr(10) || 'Opening Balance 100.00 Closing Balance 250.00 debit credit' || chr(10) || 'Email: user' || CAST(o.o_custkey AS STRING) || '@example.com Mobile: 9876500000'
 ELSE 'plain note ' || CAST(o.o_orderkey % 50 AS STRING) || ' with nothing to find' END AS text
 FROM {{orders}} o JOIN {{customer}} c ON c.c_custkey = o.o_custkey""",
    "document_access": """SELECT (l_orderkey * 8 + l_linenumber) * 1000003 + (l_partkey * 31 + l_suppkey * 17 + CAST(round(l_extendedprice * 100) AS BIGINT)) % 1000003 AS id, l_orderkey AS document_id, l_suppkey AS shared_by_id, l_partkey % 100 AS shared_with_id,
 CASE l_linenumber % 3 WHEN 0 THEN 'viewer' WHEN 1 THEN 'contributor' ELSE 'editor' END AS permission, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_shipdate END AS expires_at, l_shipdate AS created_at FROM {lineitem}""",
    "audit_logs": """SELECT event_id AS id, user_id % 25 AS firm_id, CASE WHEN event_type = 'error' THEN NULL ELSE user_id END AS entity_id,
 CASE event_type WHEN 'view' THEN 'whatsapp_retrieval' WHEN 'click' THEN 'whatsapp_retrieval' ELSE 'document' END AS entity_type,
 'WhatsApp retrieval | client ' || CAST(user_id AS STRING) || ' | need itr | ' || CASE WHEN event_type = 'click' THEN 'No document available' ELSE '1 document(s) found' END AS action, ts AS ts FROM {events}""",
    "messages": """SELECT event_id AS id, ts, '+91 9' || lpad(CAST(user_id AS STRING), 4, '0') || '-00000' AS phone,
 CASE event_type WHEN 'view' THEN 'please send my PAN' WHEN 'click' THEN 'need ITR for AY 2019-20' WHEN 'purchase' THEN 'bank statment and gstin' WHEN 'signup' THEN 'hello' ELSE '' END AS body FROM {events}""",
}

#: Relatives with a client's mobile: in the same firm for one in three, in the next firm for one in four; some documents are theirs.
VIEWS["family_clients"] = f"""SELECT * FROM ({VIEWS["clients"]}) UNION ALL SELECT id + 1000000, firm_id, client_name || ' Jr', mobile, pan_number, aadhaar_number, client_type, false, is_active FROM ({VIEWS["clients"]}) WHERE id % 3 = 0
 UNION ALL SELECT id + 2000000, CAST((firm_id + 1) % 25 AS INT), client_name || ' Sr', mobile, pan_number, aadhaar_number, client_type, false, is_active FROM ({VIEWS["clients"]}) WHERE id % 4 = 0"""
VIEWS["family_documents"] = f"""SELECT id, CASE WHEN client_id % 4 = 0 AND id % 4 = 2 THEN CAST((firm_id + 1) % 25 AS INT) ELSE firm_id END AS firm_id,
 CASE WHEN client_id % 4 = 0 AND id % 4 = 2 THEN client_id + 2000000 WHEN client_id % 3 = 0 AND id % 2 = 1 THEN client_id + 1000000 ELSE client_id END AS client_id,
 filename, document_type, assessment_year, CASE WHEN id % 3 = 0 THEN 'g' || CAST(id AS STRING) END AS google_drive_file_id, uploaded_at FROM ({VIEWS["app_documents"]})"""


def view(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """One derived table over the Parquet tables of a folder."""
    bases = set(re.findall(r"\{(\w+)\}", VIEWS[which]))
    return spark.sql(VIEWS[which], **{b: spark.read.parquet(f"{sf_dir}/{b}.parquet") for b in bases})


def ctes(*which: str) -> str:
    """The same tables as common table expressions for DuckDB: ``WITH a AS (...), b AS (...)``."""
    return "WITH " + ", ".join(f"{w} AS ({re.sub(r'{(\w+)}', r'\1', VIEWS[w])})" for w in which)
