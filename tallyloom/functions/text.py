"""Scalar text functions and OCR corrections as Column expressions.

A null input gives what the function says for a missing value; no function raises on odd input.
Word characters and word edges are Unicode-aware.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from . import constants as K

U = "(?U)"


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The group's first match, trimmed; null if there is none."""
    return F.nullif(F.trim(F.regexp_extract(text, U + pattern, group)), F.lit(""))


def all_matches(text: Column, pattern: str, group: int = 1) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(U + pattern), F.lit(group)), lambda s: F.trim(s))


def has(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(U + pattern), F.lit(False))


def low_contains_any(low: Column, words: list[str]) -> Column:
    """Whether a lower-cased text contains any of the words as plain substrings."""
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return F.coalesce(out, F.lit(False))


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether the text, once lower-cased, contains any of the words as plain substrings."""
    return once(F.lower(text), lambda low: low_contains_any(low, words))


def about_gst(low: Column) -> Column:
    """Whether a lower-cased text speaks of GST; the letters of a PAN or a GSTIN don't count."""
    word = low.contains("gst") & F.regexp_replace(low, U + K.ID_TOKEN, " ").contains("gst")
    return F.coalesce(word | low.contains("goods and services"), F.lit(False))


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with x computed once, however often f refers to it; Catalyst would put x in at every place."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def replace_tokens(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """Replace every match of a pattern by what ``change`` makes of it, without leaving the JVM."""

    def put(x: Column) -> Column:
        tokens = F.transform(F.regexp_extract_all(x, F.lit(U + pattern), F.lit(0)), lambda t: change(t))
        return F.array_join(F.zip_with(F.split(x, U + pattern, -1), tokens, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    return once(text, put)


# --- identifiers -------------------------------------------------------------------------------


def digits(x: Column) -> Column:
    """Only the digits; null gives ''."""
    return F.regexp_replace(F.coalesce(x, F.lit("")), "[^0-9]", "")


def format_aadhaar(x: Column) -> Column:
    """Twelve digits in groups of four, anything else unchanged."""
    d = F.regexp_replace(x, r"(?U)\D", "")
    return F.when(F.length(d) == 12, F.concat_ws(" ", F.substring(d, 1, 4), F.substring(d, 5, 4), F.substring(d, 9, 4))).otherwise(x)


def normalize_pan(x: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(x, F.lit("")), r"[^\p{L}\p{N}]", ""))


def pan_from_gstin(x: Column) -> Column:
    """Characters 3 to 12 of a 15-character GSTIN, else null."""
    g = normalize_pan(x)
    return F.when(F.length(g) == 15, F.substring(g, 3, 10))


def normalize_phone(x: Column) -> Column:
    return F.right(digits(x), F.lit(10))


def valid_pan(x: Column) -> Column:
    return F.coalesce(x.rlike("^[A-Z]{5}[0-9]{4}[A-Z]$"), F.lit(False))


def valid_gstin(x: Column) -> Column:
    return F.coalesce(x.rlike("^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]Z[0-9A-Z]$"), F.lit(False))


def valid_ifsc(x: Column) -> Column:
    return F.coalesce(x.rlike("^[A-Z]{4}0[A-Z0-9]{6}$"), F.lit(False))


def valid_aadhaar(x: Column) -> Column:
    """Twelve digits that don't start with 0."""
    return F.coalesce(F.regexp_replace(x, r"(?U)\D", "").rlike("^[1-9][0-9]{11}$"), F.lit(False))


def plausible_aadhaar(x: Column) -> Column:
    """Valid, first digit 2 or more, at least four different digits."""
    kinds = F.size(F.array_distinct(F.filter(F.split(x, ""), lambda c: c != "")))
    return valid_aadhaar(x) & ~F.substring(x, 1, 1).isin("0", "1") & (kinds >= 4)


def normalize_year(x: Column) -> Column:
    """The first assessment-year token as 20YY-YY, null if there is none."""
    start = F.regexp_extract(x, U + K.YEAR_TOKEN, 2)
    end = F.regexp_extract(x, U + K.YEAR_TOKEN, 4)
    return F.when(F.coalesce(start, F.lit("")) != "", F.concat(F.lit("20"), start, F.lit("-"), end))


def valid_year(x: Column) -> Column:
    """From 2000 to 2035, and the second year one later (two or four digits)."""
    start = F.regexp_extract(x, r"^([0-9]+)[-/]", 1).try_cast("int")
    end = F.regexp_extract(x, r"[-/]([0-9]+)$", 1)
    number = end.try_cast("int")
    follows = F.when(number < 100, number == (start + 1) % 100).otherwise(number == start + 1)
    return F.coalesce(start.between(2000, 2035) & follows, F.lit(False))


def field_confidence(value: Column, ocr_score: Column, valid: bool = True, regex: bool = True, label: bool = False, corrected: bool = False) -> Column:
    """0 to 100 points: 0 without a value; a part for the OCR score, ten at most."""
    points = 30 + 30 * valid + 15 * regex + 15 * label - 5 * corrected
    own = F.lit(points) + F.least(F.lit(10), F.floor(F.coalesce(ocr_score, F.lit(0.0)) / 20).cast("int"))
    return F.when(F.coalesce(value, F.lit("")) == "", 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), own))).cast("int")


# --- general text ------------------------------------------------------------------------------


def beyond_ascii(x: Column) -> Column:
    return F.coalesce(x.rlike(r"[^\x00-\x7F]"), F.lit(False))


@pandas_udf(StringType())
def nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode normal form KC, which Spark lacks."""
    for s in batches:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def clean_text(x: Column, normal_form: bool = True) -> Column:
    """Normal form KC, only printable ASCII, tabs, line ends and Devanagari, single spaces, at most one empty line in a row.

    Only texts beyond ASCII are sent to the normal form; with ``normal_form`` off nothing leaves the JVM
    (``documents.clean_texts`` keeps the rows apart).
    """
    t = F.coalesce(nfkc(F.when(beyond_ascii(x), x)), x) if normal_form else x
    t = F.regexp_replace(t, r"[^\t\n\x20-\x7Eऀ-ॿ]", " ")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def normalize_whitespace(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def lines_of(x: Column) -> Column:
    """Trimmed lines that are not empty."""
    return F.filter(F.transform(F.split(x, "\n"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")


def words_of(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r"(?U)\b\w+\b"), F.lit(0))


def count_of(x: Column, klass: str) -> Column:
    """How many characters are of a character class."""
    return F.length(F.regexp_replace(x, f"[^{klass}]", ""))


def text_quality(x: Column) -> Column:
    """0.4 of the printable share, 0.3 of the letters' and digits' share, 0.3 of words up to 50; 0 under five characters."""
    n = F.length(x)
    printable = F.length(F.regexp_replace(x, r"[\p{C}\p{Z}&&[^ \n\t]]", "")).cast("double") / n
    alnum = count_of(x, r"\p{L}\p{N}").cast("double") / n
    words = F.least(F.size(words_by_space(x)).cast("double") / 50, F.lit(1.0))
    return F.when(F.coalesce(n, F.lit(0)) < 5, 0.0).otherwise(printable * 0.4 + alnum * 0.3 + words * 0.3)


def words_by_space(x: Column) -> Column:
    return F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")


def is_useful(x: Column, least: int = 40) -> Column:
    return F.coalesce((F.length(F.trim(x)) >= least) & (text_quality(x) >= 0.3), F.lit(False))


def is_numeric_heavy(x: Column) -> Column:
    return F.coalesce((F.length(x) > 0) & (count_of(x, "0-9") / F.length(x) >= 0.4), F.lit(False))


def human_size(n: Column) -> Column:
    """Bytes with one decimal (a half to the even digit) in the largest unit under 1024."""
    shown = lambda power, unit: F.format_string(f"%.1f {unit}", F.bround(n / F.lit(float(1024**power)), 1))
    out = shown(4, "TB")
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(n < 1024 ** (power + 1), shown(power, unit)).otherwise(out)
    return out


# --- names -------------------------------------------------------------------------------------


def title_case(x: Column) -> Column:
    """Each run of letters with a capital first and the rest small."""
    return replace_tokens(x, r"[A-Za-z]+", lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 1_000_000))))


def normalize_name(x: Column) -> Column:
    return title_case(F.trim(F.regexp_replace(F.regexp_replace(x, r"[^a-zA-Z\s\-.]", ""), r"\s+", " ")))


def is_likely_name(x: Column) -> Column:
    t = F.trim(x)
    return F.coalesce(F.length(t).between(2, 60) & ~F.lower(t).isin(K.NAME_BLACKLIST) & ~t.rlike("^[0-9]+$") & (count_of(t, r"\p{L}") >= 2), F.lit(False))


def is_valid_name(x: Column) -> Column:
    """No label, address part or fragment: see the lists it refers to."""

    def good(v: Column) -> Column:
        t, tokens = v["t"], v["tokens"]
        first = F.regexp_replace(F.get(tokens, F.lit(0)), r"[.,:\-]+$", "")
        fine = (F.length(t) >= 4) & ~F.lower(t).isin(K.NAME_BLOCKLIST) & ~F.arrays_overlap(tokens, F.array(*map(F.lit, K.NAME_BAD_TOKENS)))
        fine = fine & (count_of(t, "0-9") / F.length(t) <= 0.4) & ~first.isin(K.NAME_FIRST_STOPWORDS)
        return fine & F.exists(tokens, lambda w: F.length(F.regexp_replace(w, r"[^\p{L}]", "")) >= 2) & (count_of(t, r"\p{L}") >= 3)

    return F.coalesce(once(F.struct(F.trim(x).alias("t"), words_by_space(F.lower(F.trim(x))).alias("tokens")), good), F.lit(False))


def clean_name(x: Column) -> Column:
    """A candidate without edges, digits, title and leading preposition; the title needs no word edge behind it."""
    t = F.regexp_replace(x, r"(?U)^[\W_]+|[\W_]+$", "")
    t = F.trim(F.regexp_replace(t, r"(?s)[0-9].*", ""))
    t = F.regexp_replace(t, r"(?i)^(name|assessee|applicant|mr\.?|mrs\.?|ms\.?|dr\.?)\s*", "")
    t = F.regexp_replace(t, r"^[ :|\-]+|[ :|\-]+$", "")
    t = F.trim(F.regexp_replace(t, r"(?i)^(of|and|the|in|to|for|from|by|with|on|at|as|an|a|see|per)\s+", ""))
    return F.trim(F.substring(t, 1, 60))


# --- folders and summaries ---------------------------------------------------------------------


def folder_name(document_type: Column) -> Column:
    """The folder of a document type: the first rule whose substring it contains."""
    t = F.lower(F.coalesce(document_type, F.lit("")))
    out = F.lit("Other")
    for words, folder in reversed(K.FOLDER_RULES):
        out = F.when(contains_any(t, words), folder).otherwise(out)
    return out


def folder_path(firm: Column, client: Column, pan: Column, document_type: Column, year: Column) -> Column:
    """Firm, client and document folder, and for ITR the year's; parts joined by /."""
    folder = folder_name(document_type)
    owner = F.when(client.isNull(), F.lit("UNMATCHED")).otherwise(F.concat_ws(" - ", client, pan))
    y = normalize_year(year)
    return F.concat_ws("/", firm, owner, folder, F.when((folder == "ITR") & y.isNotNull(), F.concat(F.lit("AY "), y)))


def summary_line(document_type: Column, confidence: Column, **parts: Column) -> Column:
    """Type and confidence, then the parts that are not null, joined by ' | '."""
    head = F.concat(F.lit("Document Type: "), document_type, F.lit(" (confidence: "), confidence.cast("string"), F.lit("%)"))
    return F.concat_ws(" | ", head, *[F.when(v.isNotNull(), F.concat(F.lit(k.replace("_", " ") + ": "), v)) for k, v in parts.items()])


# --- OCR corrections ---------------------------------------------------------------------------


def fix_ligatures(x: Column) -> Column:
    for bad, good in K.LIGATURES:
        x = F.replace(x, F.lit(bad), F.lit(good))
    return x


def looks_like_pan(token: Column) -> Column:
    t = F.upper(token)
    return (F.length(t) == 10) & F.substring(t, 10, 1).rlike("[A-Z]") & (F.regexp_count(F.substring(t, 1, 5), F.lit("[A-Z]")) >= 4) & (F.regexp_count(F.substring(t, 6, 4), F.lit("[0-9OILSBGZ]")) >= 3)


def fix_broken(x: Column) -> Column:
    """Join identifiers that a line end or spaces have split, drop invisible characters and runs of spaces."""
    x = F.regexp_replace(x, "[​‌‍﻿­]", "")
    x = F.regexp_replace(x, r"(?U)([A-Z]{5})\n([0-9]{4}[A-Z])\b", "$1$2")
    spaced = r"\b[A-Z]{5}\s+[0-9OoIlBGSZ]{4}\s+[A-Z]\b"
    x = replace_tokens(x, spaced, lambda t: F.when(looks_like_pan(F.regexp_replace(t, r"(?U)\s+", "")), F.regexp_replace(t, r"(?U)\s+", "")).otherwise(t))
    return F.regexp_replace(x, "  +", " ")


def fix_year(x: Column) -> Column:
    """In year tokens, letters that look like digits."""
    return replace_tokens(x, r"(?i)\b2[0O][0-9OIL]{2}[-/][0-9OIL]{2,4}\b", lambda t: F.translate(t, "OolI", "0011"))


def fix_pan(x: Column) -> Column:
    """Ten-character tokens that look like a PAN: look-alikes become letters or digits by position."""

    def change(t: Column) -> Column:
        u = F.upper(t)
        fixed = F.concat(F.translate(F.substring(u, 1, 5), *K.PAN_LETTERS), F.translate(F.substring(u, 6, 4), *K.PAN_DIGITS), F.translate(F.substring(u, 10, 1), *K.PAN_LETTERS))
        return F.when(valid_pan(u), t).when(looks_like_pan(t), fixed).otherwise(t)

    return replace_tokens(x, r"\b[A-Za-z0-9]{10}\b", change)


def fix_aadhaar(x: Column) -> Column:
    """Groups of four in texts about Aadhaar: letters that look like digits."""
    fixed = replace_tokens(x, r"(?i)\b[0-9OILSBGZ]{4}[\s\-][0-9OILSBGZ]{4}[\s\-][0-9OILSBGZ]{4}\b", lambda t: F.translate(F.upper(t), *K.NUMERIC_DIGITS))
    return F.when(contains_any(x, ["aadhaar", "uidai", "enrolment", "your aadhaar", "uid number"]), fixed).otherwise(x)


def fix_gstin(x: Column) -> Column:
    """Every 15-character token in texts about GST: look-alikes by position, upper case."""

    def change(t: Column) -> Column:
        u = F.upper(t)
        return F.concat(F.translate(F.substring(u, 1, 2), *K.PAN_DIGITS), F.translate(F.substring(u, 3, 5), *K.PAN_LETTERS), F.translate(F.substring(u, 8, 4), *K.PAN_DIGITS), F.translate(F.substring(u, 12, 1), *K.PAN_LETTERS), F.substring(u, 13, 3))

    return F.when(once(F.lower(x), about_gst), replace_tokens(x, r"\b[A-Za-z0-9]{15}\b", change)).otherwise(x)


def correct(x: Column) -> Column:
    """All corrections in their order."""
    for f in (fix_ligatures, fix_broken, fix_year, fix_pan, fix_aadhaar, fix_gstin):
        x = once(x, f)
    return x


def join_spaced_pan(x: Column) -> Column:
    """The older clean-up: a PAN written in three groups becomes one word."""
    return F.regexp_replace(x, r"(?U)([A-Z]{5})\s([0-9]{4})\s([A-Z])", "$1$2$3")


def declared_ids(x: Column) -> dict[str, Column]:
    """Company number, labelled account number and ISO date: patterns of their own, beside the fields."""
    return {"cin": first_match(F.upper(x), K.CIN), "account": F.regexp_replace(first_match(x, K.ACCOUNT_LABEL), r"(?U)\s", ""), "iso_date": first_match(x, K.DATE_ISO)}


def file_icon(filename: Column) -> Column:
    """pdf, img or gen, by the extension."""
    ext = F.lower(F.regexp_extract(F.coalesce(filename, F.lit("")), r"\.([^.]*)$", 1))
    return F.when(ext == "pdf", "pdf").when(ext.isin("jpg", "jpeg", "png"), "img").otherwise("gen")


def shown_date(x: Column) -> Column:
    return F.substring(x.cast("string"), 1, 10)


def shown_type(x: Column, missing: str = "-") -> Column:
    """A client's type as a title: each word with a capital first, and a dash where there is none."""
    t = F.coalesce(F.nullif(x, F.lit("")), F.lit(missing))
    return replace_tokens(t, r"[^-\s({\[<]+", lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000))))


def folder_title(name: Column, pan: Column) -> Column:
    return F.concat_ws("_", name, pan)
