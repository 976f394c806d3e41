"""Name extraction over every kind of text."""

from tallyloom.catalogue import QUERIES
from tallyloom.sources.fixtures import view


def test_every_text_is_read(spark, sf):
    found = {r["id"]: (r["value"], r["confidence"]) for r in QUERIES["extract_name_all"](spark, sf).collect()}
    assert set(found) == {r["id"] for r in view(spark, sf, "ocr_texts").select("id").collect()}
    assert all(v == (None, 0) for d, v in found.items() if d % 6 in (2, 3, 4))
