"""Files as tables: the names under which they are kept, and the texts of PDFs and images.

Reading a page and recognising an image are pluggable functions; all that follows (usefulness, choice of
passes, joining pages, scores) is DataFrame work. One file that cannot be read is a row that says so.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from tallyloom.functions import constants as K
from tallyloom.functions import text as T
from tallyloom.operators import documents as D

#: A reader gives a PDF's pages as (embedded text, image to recognise or None); a recogniser an image's passes as (config, text).
PdfReader = Callable[[bytes], list[tuple[str, bytes | None]]]
Recogniser = Callable[[bytes], list[tuple[str, str]]]


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``file`` (its name), ``path``, ``length`` and ``content`` of the files of a folder and its subfolders."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "path", "length", "content")


@pandas_udf(StringType())
def ascii_letters(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Letters without their accents; other characters beyond ASCII go."""
    for s in batches:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


def secured_name(name: Column, fold: bool = True) -> Column:
    """A file name without folders, spaces and odd characters. ``fold`` off is for names of ASCII only: they never leave the JVM."""
    x = F.regexp_replace(ascii_letters(name) if fold else name, r"[/\\]", " ")
    x = F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), r"\s+", "_")
    return F.regexp_replace(F.regexp_replace(x, r"[^A-Za-z0-9_.\-]", ""), r"^[._]+|[._]+$", "")


def stored_name(name: Column, fold: bool = True) -> Column:
    """A fresh 32-digit prefix and the secured name; another one each time it runs."""
    return F.concat_ws("_", F.replace(F.uuid(), F.lit("-"), F.lit("")), secured_name(name, fold))


def kind_of(name: Column) -> Column:
    """pdf, image or other, by the extension."""
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return F.when(ext == "pdf", "pdf").when(ext.isin(K.IMAGE_EXTENSIONS), "image").otherwise("other")


# --- pages -------------------------------------------------------------------------------------

_SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\bT[djDJm]\b|T\*|'|\bET\b", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|.)", re.S)
_NAMED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _string(token: bytes) -> str:
    if token[:1] == b"<":
        raw = bytes.fromhex(re.sub(rb"\s", b"", token[1:-1]).decode() + "0" * (len(re.sub(rb"\s", b"", token[1:-1])) % 2))
    else:
        raw = _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _NAMED.get(m[1], m[1]), token[1:-1])
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")


def embedded_pages(content: bytes) -> list[tuple[str, bytes | None]]:
    """The text that a PDF's content streams show, a page a stream; no images. Fonts with codes of their own are not decoded."""
    if not content.startswith(b"%PDF"):
        raise ValueError("no PDF header")
    pages = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", content, re.S):
        head = content[content.rfind(b"<<", 0, m.start()) : m.start()]
        data = zlib.decompress(m[1]) if b"FlateDecode" in head else m[1]
        if b"BT" not in data:
            continue
        out, held = [], []
        for token in _SHOWN.findall(data):
            if token[:1] in (b"(", b"<"):
                held.append(_string(token))
            elif token in (b"Tj", b"TJ"):
                out.extend(held)
                held = []
            else:
                out += ["\n", *held]
                held = []
        pages.append(("".join(out).strip(), None))
    return pages


def _pages(read_pdf: PdfReader):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for file, kind, content in zip(pdf["file"], pdf["kind"], pdf["content"], strict=True):
                try:
                    if content is None:
                        raise ValueError("no content")
                    found = [("", bytes(content))] if kind == "image" else read_pdf(bytes(content))
                    rows += [(file, kind, n, (text or "").strip(), image, None) for n, (text, image) in enumerate(found)]
                    if not found:
                        rows.append((file, kind, -1, "", None, None))
                except Exception as error:  # one broken file is a row of its own and stops no other
                    rows.append((file, kind, -1, "", None, str(error)))
            yield pd.DataFrame(rows, columns=["file", "kind", "page", "embedded", "image", "error"])

    return run


def _recognised(ocr: Recogniser | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for file, page, image in zip(pdf["file"], pdf["page"], pdf["image"], strict=True):
                try:
                    passes = ocr(bytes(image))
                except Exception:  # as a page without passes: its embedded text, if any, stands in
                    passes = []
                rows += [(file, page, n, config, text or "") for n, (config, text) in enumerate(passes)]
            yield pd.DataFrame(rows, columns=["file", "page", "pass_no", "config", "text"])

    return run


def document_texts(files: DataFrame, read_pdf: PdfReader = embedded_pages, ocr: Recogniser | None = None, least: int = 40) -> DataFrame:
    """``file, text, raw_text, method, score, page_count, pass_count`` for files (file, content).

    A PDF's page gives its embedded text where that is useful, else the best pass of the recogniser, else
    what text it has; pages are joined by a page break. ``method`` is embedded, ocr, mixed or unknown;
    unsupported for other extensions and error for files that cannot be read. ``raw_text`` is before the
    corrections. Null content is an error; an empty table gives no rows. ``file`` must be unique.
    """
    typed = files.select("file", kind_of(F.col("file")).alias("kind"), "content")
    pages = typed.where("kind <> 'other'").mapInPandas(_pages(read_pdf), "file string, kind string, page int, embedded string, image binary, error string")
    pages = pages.withColumn("useful", (F.col("kind") == "pdf") & T.is_useful(F.col("embedded"), least))
    if ocr is None:
        best = pages.where("false").select("file", "page", F.lit("").alias("ocr"), F.lit(0).alias("passes"))
    else:
        passes = pages.where("NOT useful AND image IS NOT NULL").select("file", "page", "image").mapInPandas(_recognised(ocr), "file string, page int, pass_no int, config string, text string")
        scored = passes.withColumn("score", D.ocr_score(F.col("text")))
        best = scored.groupBy("file", "page").agg(F.max_by("text", F.struct("score", -F.col("pass_no"))).alias("ocr"), F.count("*").cast("int").alias("passes"))
    own = F.when(F.col("useful"), F.col("embedded")).otherwise(F.coalesce("ocr", F.nullif("embedded", F.lit(""))))
    used = F.when(F.col("useful"), "embedded").when(F.col("ocr").isNotNull(), "ocr")
    one = pages.drop("image").join(best, ["file", "page"], "left").withColumns({"own": own, "used": used})
    whole = one.groupBy("file", "kind").agg(
        F.max("error").alias("error"),
        F.sort_array(F.collect_list(F.when(F.col("own").isNotNull(), F.struct("page", "own")))).alias("parts"),
        F.collect_set("used").alias("ways"),
        F.coalesce(F.sum("passes"), F.lit(0)).cast("int").alias("pass_count"),
    )
    joined = F.array_join(F.transform("parts", lambda p: p["own"]), K.PAGE_BREAK)
    method = F.when(F.col("error").isNotNull(), "error").when(F.size("ways") > 1, "mixed").when(F.size("ways") == 1, F.get("ways", F.lit(0)))
    method = method.otherwise(F.when(F.col("kind") == "image", "error").otherwise("unknown"))
    raw = F.when(F.col("error").isNotNull(), F.when(F.col("kind") == "pdf", F.concat(F.lit("[PDF error: "), "error", F.lit("]"))).otherwise("")).when(F.col("kind") == "pdf", T.clean_text(joined)).otherwise(joined)
    whole = whole.select("file", raw.alias("raw_text"), method.alias("method"), F.when(F.col("error").isNull(), F.size("parts")).otherwise(0).alias("page_count"), "pass_count")
    whole = whole.withColumn("score", F.when(F.col("method") == "error", 0.0).otherwise(D.ocr_score(F.col("raw_text")))).withColumn("text", T.clean_text(T.correct(F.col("raw_text"))))
    out = ["file", "text", "raw_text", "method", "score", "page_count", "pass_count"]
    other = typed.where("kind = 'other'").select("file", F.lit("").alias("text"), F.lit("").alias("raw_text"), F.lit("unsupported").alias("method"), F.lit(0.0).alias("score"), F.lit(0).alias("page_count"), F.lit(0).alias("pass_count"))
    return whole.select(*out).unionByName(other)


def rotation_score(text: Column) -> Column:
    """The older score of a rotated page's text: points for common words and a little for letters and digits."""
    low, own = F.lower(text), F.lit(0.0)
    for w in K.ROTATION_WORDS:
        own = own + F.when(low.contains(w), float(K.ROTATION_POINTS["word"])).otherwise(0.0)
    return F.coalesce(own + T.count_of(text, r"\p{L}\p{N}") * F.lit(K.ROTATION_POINTS["alnum"]), F.lit(0.0))


def best_rotation(rotations: DataFrame, key: str = "file") -> DataFrame:
    """Of each key's rotations (angle, text) the one of highest score, the smallest angle of equals; '' where none scores."""
    s = rotations.withColumn("score", rotation_score(F.col("text")))
    best = s.groupBy(key).agg(F.max_by(F.struct("angle", "text", "score"), F.struct("score", -F.col("angle"))).alias("b"))
    return best.select(key, F.when(F.col("b.score") > 0, F.col("b.angle")).alias("angle"), F.when(F.col("b.score") > 0, F.col("b.text")).otherwise("").alias("text"), "b.score")


def longest_rotation(rotations: DataFrame, key: str = "file") -> DataFrame:
    """Of each key's rotations (angle, text) the angle with most text, the smallest of equals, and 0 where all are empty."""
    best = F.max_by(F.struct("angle", "text"), F.struct(F.length(F.coalesce("text", F.lit(""))), -F.col("angle")))
    b = rotations.groupBy(key).agg(best.alias("b"))
    none = F.length(F.coalesce("b.text", F.lit(""))) == 0
    return b.select(key, F.when(none, 0).otherwise(F.col("b.angle")).cast("int").alias("angle"), F.coalesce("b.text", F.lit("")).alias("text"))


def legacy_texts(pages: DataFrame, rotations: DataFrame, key: str = "file") -> DataFrame:
    """``key, text, n_embedded``: the older way to a PDF's text, from pages (key, page, embedded) and rotations (key, page, angle, text).

    A page gives its embedded text if that has more than 20 characters, else the text of its best
    rotation ('' where none scores); pages are joined by line ends and the whole is trimmed.
    """
    edge = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    enough = F.coalesce(F.length(edge(F.col("embedded"))) > 20, F.lit(False))
    p = pages.withColumn("_own", F.when(enough, F.col("embedded")))
    r = rotations.withColumn("_s", rotation_score(F.col("text"))).groupBy(key, "page").agg(F.max_by(F.struct("text", "_s"), F.struct("_s", -F.col("angle"))).alias("b"))
    turned = F.when(F.col("b._s") > 0, F.col("b.text"))
    one = p.join(r, [key, "page"], "left").select(key, "page", F.coalesce("_own", turned, F.lit("")).alias("part"), F.col("_own").isNotNull().alias("own"))
    parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "part"))), lambda x: x["part"]), "\n")
    return one.groupBy(key).agg(edge(parts).alias("text"), F.count_if("own").alias("n_embedded"))
