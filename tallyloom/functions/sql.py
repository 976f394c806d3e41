"""The engine's functions as SQL functions of a session: scalar ones, and table-valued ones for whole documents.

``register`` creates temporary SQL functions whose bodies are the expressions of ``text`` and of the
documents' operators, written out as SQL. Spark puts a body into the plan where the function is called,
so a query in SQL text gets the same plan as one made of Columns, without any Python.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import documents as D
from tallyloom.operators import resolution as R

from . import text as T

_STRING = re.compile(r"('(?:[^'\\]|\\.)*')", re.S)
#: Operators written as calls, whose names SQL reads as names only in back-quotes.
_OPERATOR = re.compile(r"(?<![\w`])(<=>|<=|>=|<>|==|=|<|>|\+|-|\*|/|%|!|&|\||\^|~|in|not|and|or)\(")


def sql_text(expression: Column) -> str:
    """A Column as SQL text that Spark parses to the same expression."""
    written = expression._jc.node().sql()
    return "".join(p if p.startswith("'") else _OPERATOR.sub(r"`\1`(", p) for p in _STRING.split(written))


def _scalar(f: Callable[..., Column], *parameters: str, returns: str) -> tuple[list[str], str, Callable[..., Column]]:
    return list(parameters), returns, f


#: Scalar functions by name: parameters with their types, the type returned, and the expression.
SCALARS = {
    "digits_of": _scalar(T.digits, "x STRING", returns="STRING"),
    "format_aadhaar": _scalar(T.format_aadhaar, "x STRING", returns="STRING"),
    "normalize_pan": _scalar(T.normalize_pan, "x STRING", returns="STRING"),
    "pan_from_gstin": _scalar(T.pan_from_gstin, "x STRING", returns="STRING"),
    "normalize_phone": _scalar(T.normalize_phone, "x STRING", returns="STRING"),
    "normalize_year": _scalar(T.normalize_year, "x STRING", returns="STRING"),
    "normalize_name": _scalar(T.normalize_name, "x STRING", returns="STRING"),
    "normalize_whitespace": _scalar(T.normalize_whitespace, "x STRING", returns="STRING"),
    "clean_ascii_text": _scalar(lambda x: T.clean_text(x, normal_form=False), "x STRING", returns="STRING"),
    "correct_ocr_text": _scalar(T.correct, "x STRING", returns="STRING"),
    "is_valid_pan": _scalar(T.valid_pan, "x STRING", returns="BOOLEAN"),
    "is_valid_gstin": _scalar(T.valid_gstin, "x STRING", returns="BOOLEAN"),
    "is_valid_ifsc": _scalar(T.valid_ifsc, "x STRING", returns="BOOLEAN"),
    "is_valid_aadhaar": _scalar(T.valid_aadhaar, "x STRING", returns="BOOLEAN"),
    "is_valid_year": _scalar(T.valid_year, "x STRING", returns="BOOLEAN"),
    "is_valid_name": _scalar(T.is_valid_name, "x STRING", returns="BOOLEAN"),
    "is_useful_text": _scalar(T.is_useful, "x STRING", returns="BOOLEAN"),
    "text_quality": _scalar(T.text_quality, "x STRING", returns="DOUBLE"),
    "ocr_text_score": _scalar(D.ocr_score, "x STRING", returns="DOUBLE"),
    "human_size": _scalar(T.human_size, "n BIGINT", returns="STRING"),
    "document_folder": _scalar(T.folder_name, "document_type STRING", returns="STRING"),
    "document_fingerprint": _scalar(R.fingerprint, *(f"{c} STRING" for c in ("document_type", "pan", "aadhaar", "gstin", "tan", "year")), returns="STRING"),
}

#: The fields of a document as columns of value and confidence.
FIELDS = ["pan", "aadhaar", "gstin", "tan", "ifsc", "year", "name", "invoice_number", "phone", "email", "itr_type", "acknowledgement_number"]


def _fields_query() -> str:
    """A SELECT of a struct a field, over the parameters ``text`` and ``ocr_score``; every pattern runs once a text."""
    seen = D._look(*map(F.col, ("t", "low", "up")))
    x = D.Seen(seen.t, seen.low, seen.up, {k: F.col(f"s_{k}") for k in seen.found})
    s = F.col("score")
    looks = ", ".join(f"{sql_text(v)} AS s_{k}" for k, v in seen.found.items())
    first, rest = D.id_fields(x, s), D.other_fields(x, s, F.col("pan.value"))
    cols = lambda d: ", ".join(f"{sql_text(v)} AS {k}" for k, v in d.items())
    base = "SELECT coalesce(text, '') AS t, lower(coalesce(text, '')) AS low, upper(coalesce(text, '')) AS up, ocr_score AS score"
    return f"SELECT *, {cols(rest)} FROM (SELECT *, {cols(first)} FROM (SELECT *, {looks} FROM ({base})))"


def table_functions() -> dict[str, str]:
    """CREATE statements of the table-valued functions, without their beginning."""
    wide = ", ".join(f"{f}.value AS {f}, {f}.confidence AS {f}_confidence" for f in FIELDS)
    schema = ", ".join(f"{f} STRING, {f}_confidence INT" for f in FIELDS)
    fields = f"SELECT {wide} FROM ({_fields_query()})"
    return {
        "document_fields": f"(text STRING, ocr_score DOUBLE) RETURNS TABLE ({schema}) RETURN {fields}",
    }


def register(spark: SparkSession) -> list[str]:
    """Create all functions in the session and give their names.

    ``document_fields(text, ocr_score)`` is a row of every field's value and confidence, called with
    LATERAL. ``nfkc`` alone is an Arrow function in Python, as Spark has no normal forms.
    """
    for name, (parameters, kind, f) in SCALARS.items():
        body = sql_text(f(*[F.col(p.split()[0]) for p in parameters]))
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(parameters)}) RETURNS {kind} RETURN {body}")
    tables = table_functions()
    for name, rest in tables.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{rest}")
    spark.udf.register("nfkc", T.nfkc)
    return [*SCALARS, *tables, "nfkc"]
