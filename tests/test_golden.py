"""Texts of many layouts with the results that the rules give, worked out by hand; and PDFs of several kinds."""

import zlib

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.operators import documents as D
from tallyloom.operators import ingest as I
from tallyloom.sources import files as S

#: Name, text, OCR score, and what must come out: type, and values with their confidence.
CASES = [
    ("pan card, label in small letters", "INCOME TAX DEPARTMENT\nGOVT. OF INDIA\nName\nRavi Kumar\nFather's Name\nMohan Lal\npan no: abcpk1234f\nSignature", 100.0, "PAN Card", {"pan": ("ABCPK1234F", 95), "name": ("Ravi Kumar", 90)}),
    ("pan without label, name at the top", "Sunita Devi Sharma\nPermanent Account card\nabc ABCPK1234F\n12/03/1980", 0.0, "Other", {"pan": ("ABCPK1234F", 75), "name": ("Sunita Devi Sharma", 40)}),
    ("aadhaar, masked", "Unique Identification Authority of India\nYour Aadhaar\nXXXX-XXXX-4321\nName: Asha Rao", 40.0, "Aadhaar Card", {"aadhaar": ("XXXX XXXX 4321", 60), "name": ("Asha Rao", 77)}),
    ("aadhaar, grouped without label", "Government of India\nUIDAI\n(2345-6789-0123)\nDOB: 01/01/1990", 20.0, "Aadhaar Card", {"aadhaar": ("2345 6789 0123", 76)}),
    ("aadhaar, plain near its word", "my aadhaar 234567890123 is here and some more words", 20.0, None, {"aadhaar": ("2345 6789 0123", 91)}),
    ("digits after the word and others", "uid of the card no 234567890123 as printed", 20.0, None, {"aadhaar": ("2345 6789 0123", 91)}),
    ("plain digits far from the word", "aadhaar." + " filler" * 30 + " 234567890123 end of text", 20.0, None, {"aadhaar": (None, 0)}),
    ("grouped digits of an acknowledgement", "uidai, and\nAcknowledgement no 2345 6789 0123 given", 20.0, None, {"aadhaar": (None, 0)}),
    ("too few kinds of digits", "uidai text with 2222 3333 2233 in it, and so on", 20.0, None, {"aadhaar": (None, 0)}),
    ("gstin by label", "Tax Invoice\nGSTIN: 27AAPFU0939F1ZV\nInvoice No: INV-2024/001\nBill To: Some Body\nTotal Amount 500\nTax Period: March 2024\nDate of Filing: 20/04/2024", 60.0, "Invoice", {"gstin": ("27AAPFU0939F1ZV", 93), "invoice_number": ("INV-2024/001", 93)}),
    ("form 16", "FORM NO. 16\nCertificate under section 203\nTAN of Deductor: DELA12345B\nPAN of Employee: ABCPK1234F\nAssessment Year: 2021-22\nSalaries", 100.0, "Form 16", {"tan": ("DELA12345B", 80), "pan": ("ABCPK1234F", 80), "year": ("2021-22", 95)}),
    ("tan by label", "tax deducted by us TAN: DELA12345B for the quarter", 0.0, None, {"tan": ("DELA12345B", 90)}),
    ("financial year", "ledger of the financial year: 2019-20 as kept", 0.0, None, {"year": ("2019-20", 90)}),
    ("year alone, the first valid", "income tax paid in 2020-25 and 2021-22 for all", 0.0, None, {"year": ("2021-22", 75)}),
    ("year label that is none", "Assessment Year: 2020-25, then FY 2018-19 follows", 0.0, None, {"year": ("2018-19", 90)}),
    ("ifsc by label and by context", "IFSC: HDFC0001234 of the branch", 0.0, None, {"ifsc": ("HDFC0001234", 90)}),
    ("ifsc without context", "the code HDFC0001234 alone and more", 0.0, None, {"ifsc": (None, 0)}),
    ("salary slip", "Salary Slip for May\nEmployee Name: Mr. Vijay Patil\nBasic Salary 10,000  20,000\nGross Salary\nNet Salary\nProvident Fund", 80.0, "Salary Slip", {"name": ("Vijay Patil", 79)}),
    ("cheque", "Pay to the order of or bearer\nRupees ten\nAccount Payee\ndrawn on some place\nMICR", 80.0, "Cheque", {}),
    ("passbook", "Passbook\nSavings Account\nAccount Holder: Kiran Bedi Rao\nNominee\nOpening Balance", 80.0, "Passbook", {"name": ("Kiran Bedi Rao", 79)}),
    ("balance sheet", "BALANCE SHEET as at March\nEquity and Liabilities\nCurrent Assets\nNon-Current Assets\nCurrent Liabilities", 80.0, "Balance Sheet", {}),
    ("a label that is part of a phrase", "Name and Address of Premises\nFlat No 12\nThe Building\n12 34", 80.0, None, {"name": (None, 0)}),
    ("phone and mail", "Mobile: 98765 43210\nwrite to Some.One@Example.COM please", 0.0, None, {"phone": ("9876543210", 75), "email": ("some.one@example.com", 90)}),
    ("phone with its country", "Mobile: +91 98765 43210\nno other number", 0.0, None, {"phone": (None, 0)}),
    ("itr", "Indian Income Tax Return Acknowledgement\nForm ITR 4\nAcknowledgement Number: 123456789012345\nAY 2022-23\nFiled on 31-Jul-2022 and 01/08/2022", 100.0, "ITR Acknowledgement", {"itr_type": ("ITR-4", 85), "acknowledgement_number": ("123456789012345", 85), "year": ("2022-23", 95)}),
    ("short", "short text", 100.0, "Other", {}),
    ("empty", "", 100.0, "Other", {"pan": (None, 0), "name": (None, 0)}),
    ("none", None, None, "Other", {"pan": (None, 0), "name": (None, 0)}),
]


@pytest.fixture(scope="module")
def processed(spark):
    df = spark.createDataFrame([(i, t, s) for i, (_, t, s, _, _) in enumerate(CASES)], "id int, text string, ocr_score double")
    return {r["id"]: r for r in D.process(df).collect()}


@pytest.mark.parametrize("case", range(len(CASES)), ids=[c[0] for c in CASES])
def test_layouts(processed, case):
    _, _, _, kind, fields = CASES[case]
    r = processed[case]
    assert kind is None or r["document_type"] == kind
    assert {k: (r[k]["value"], r[k]["confidence"]) for k in fields} == fields


def test_further_parts(processed):
    of = {name: processed[i] for i, (name, *_) in enumerate(CASES)}
    assert of["itr"]["dates"] == ["31-Jul-2022", "01/08/2022"]
    assert (of["gstin by label"]["gst_period"]["month"], of["gstin by label"]["gst_period"]["filing_date"]) == ("March 2024", "20/04/2024")
    assert of["short"]["document_confidence"] == 0 and of["none"]["summary"] == "Document Type: Other (confidence: 0%)"


def test_years(spark):
    rows = {"2020-21": True, "2020-2021": True, "2035-36": True, "2020-021": True, "2020-0021": True, "2020-22": False, "1999-00": False, "2036-37": False, "2020-121": False, "2020": False, "x": False, "": False, None: False}
    df = spark.createDataFrame([(k,) for k in rows], "y string")
    assert {r["y"]: r["v"] for r in df.select("y", T.valid_year(F.col("y")).alias("v")).collect()} == rows


def pdf(*streams: bytes, packed: bool = False) -> bytes:
    parts = [b"%PDF-1.4\n"]
    for n, body in enumerate(streams, 1):
        data = zlib.compress(body) if packed else body
        parts.append(b"%d 0 obj << /Length %d %s>>\nstream\n" % (n, len(data), b"/Filter /FlateDecode " if packed else b"") + data + b"\nendstream\nendobj\n")
    return b"".join(parts)


def test_pdfs_of_several_kinds(spark):
    say = lambda t: b"BT\n(" + t + b") Tj\nET"
    long = b"A page with a text that is long enough to be of use by itself"
    read = lambda content: [(long.decode(), None), ("", b"image of page two")] if content == b"mixed" else S.embedded_pages(content)
    rows = [("plain.pdf", pdf(say(long))), ("packed.pdf", pdf(say(long), packed=True)), ("two.PDF", pdf(say(long), say(long + b" too"))), ("mixed.pdf", b"mixed"), ("none.pdf", b"x"), ("scan.jpg", b"a scanned page"), ("bad.png", b"\xff"), ("doc.txt", b"t"), ("null.pdf", None)]
    files = spark.createDataFrame(rows, "file string, content binary")
    ocr = lambda image: [("one", image.decode()[:5]), ("two", image.decode() + " income tax")]
    got = {r["file"]: r for r in S.document_texts(files, read_pdf=read, ocr=ocr).collect()}
    assert {k: r["method"] for k, r in got.items()} == {"plain.pdf": "embedded", "packed.pdf": "embedded", "two.PDF": "embedded", "mixed.pdf": "mixed", "none.pdf": "error", "scan.jpg": "ocr", "bad.png": "error", "doc.txt": "unsupported", "null.pdf": "error"}
    assert got["packed.pdf"]["raw_text"] == got["plain.pdf"]["raw_text"] == long.decode()
    assert "too" in got["two.PDF"]["raw_text"] and "image of page two income tax" in got["mixed.pdf"]["raw_text"] and "PAGE BREAK" in got["mixed.pdf"]["raw_text"]
    assert (got["mixed.pdf"]["page_count"], got["mixed.pdf"]["pass_count"]) == (2, 2)
    assert S.document_texts(files.limit(0)).collect() == []


def test_batch_projection_without_results(spark):
    shown = I.safe_batch_result(spark.createDataFrame([("a.pdf", "missing", "gone")], "file string, status string, error string"))
    assert shown.columns == I.BATCH_FIELDS
    assert shown.first().asDict() == {**dict.fromkeys(I.BATCH_FIELDS), "file": "a.pdf", "status": "missing", "error": "gone", "original_filename": "", "elapsed_s": 0.0}


def test_small_inputs_are_spread_and_others_left(spark):
    few = spark.range(10).toDF("id")
    assert D.spread(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1b")
        assert D.spread(few) is few
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16m")
        assert D.spread(few) is not few
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
