"""Words and identifiers whose letters look like a keyword."""

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import sql as S
from tallyloom.functions import text as T
from tallyloom.operators import documents as D


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "form"),
    [("Aadhaar No: 2992 7072 9568\nName: Asha Itrar", None), ("Name: Asha Itrar\nForm ITR-2", "ITR-2"), ("form itr v", "ITR-V"), ("ITR4S of the year", "ITR4S"), ("ITRV", "ITRV"), ("ITR-AR", "ITR-AR"), ("", None)],
)
def test_a_word_is_no_itr_form(spark, text, form):
    assert one(spark, text, D.itr_type) == form


def test_a_word_is_no_itr_form_in_sql(spark):
    S.register(spark)
    told = spark.createDataFrame([("Name: Asha Itrar",), ("Name: Asha Itrar\nForm ITR-2",)], "text string")
    assert {r[0] for r in spark.sql("SELECT f.itr_type FROM {told} t, LATERAL document_fields(t.text, 50.0) f", told=told).collect()} == {None, "ITR-2"}


@pytest.mark.parametrize(
    ("text", "confidence"),
    [("PAN: GSTPA1234G\nFiling Date 22-01-2020", 0), ("22GSTPA1234G1Z5 Filing Date 22-01-2020", 0), ("GST of GSTPA1234G\nFiling Date 22-01-2020", 85), ("GSTIN22ABCDE1234F1Z5 Tax Period: March 2024", 85), ("goods and services, period 03/2024", 85)],
)
def test_letters_of_an_identifier_do_not_speak_of_gst(spark, text, confidence):
    assert one(spark, text, D.gst_period_field)["confidence"] == confidence


@pytest.mark.parametrize(
    ("text", "fixed"),
    [("Acknowledgement No. 888888881069508 of GSTPA1234G", None), ("no 22GSTPAB7B2G1Z5", None), ("GSTIN 22GSTPAB7B2G1Z5", "GSTIN 22GSTPA8782G1Z5"), ("goods and services 22ABCDEI234F1Z5", "goods and services 22ABCDE1234F1Z5")],
)
def test_only_texts_about_gst_have_their_gstins_corrected(spark, text, fixed):
    assert one(spark, text, T.fix_gstin) == (fixed or text)
