"""Document search by an index: a bitmap of the trigrams of each document, kept by firm, so that only candidates' texts are read."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.sources.keyed import KeyedTable

from . import relational as R
from .documents import spread

GRAM = 3


def grams_of(text: Column) -> Column:
    """The distinct substrings of ``GRAM`` characters of a text, lower-cased; none of a shorter text or null."""
    low = F.lower(text)
    cut = F.transform(F.sequence(F.lit(1), F.length(low) - (GRAM - 1)), lambda i: F.substring(low, i, F.lit(GRAM)))
    return F.when(F.length(low) >= GRAM, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def _word(h: Column, size: Column) -> Column:
    """Which of ``size`` words of 64 bits holds a hash's bit; ``size`` is a power of two."""
    return F.shiftright(h, 6).bitwiseAND(size - 1)


def _bit(h: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)))


def hashes_of(grams: Column) -> Column:
    return F.transform(grams, lambda g: F.xxhash64(g).bitwiseAND(F.lit(2**31 - 1)).cast("int"))


def sign_of(grams: Column) -> Column:
    """The grams' hashes as bits of an array of words: twice as many bits as grams, at least 64 and a power of two; null without grams."""
    size = F.call_function("shiftleft", F.lit(1), F.greatest(F.lit(0), F.ceil(F.log2(F.size(grams) / 32)).cast("int")))
    made = T.once(F.struct(hashes_of(grams).alias("h"), size.alias("n")), lambda v: F.transform(F.sequence(F.lit(0), v["n"] - 1), lambda i: F.aggregate(F.filter(v["h"], lambda h: _word(h, v["n"]) == i), F.lit(0).cast("long"), lambda acc, h: acc.bitwiseOR(_bit(h)))))
    return F.when(F.size(grams) > 0, made)


def holds_all(sign: Column, hashes: list[int]) -> Column:
    """Whether all of the hashes' bits are set; false for null."""
    one = lambda h: F.get(sign, _word(h, F.size(sign))).bitwiseAND(_bit(h)) != 0
    return F.coalesce(F.forall(F.array(*map(F.lit, hashes)), one), F.lit(False))


class SearchIndex:
    """Signs of documents (firm_id, id, own, text: bitmaps of the trigrams of the fields and of the text), documents and texts, as tables keyed for lookup below a folder.

    A sign takes a byte for four distinct trigrams, about; a search reads the signs of its firm.
    """

    def __init__(self, spark: SparkSession, folder: str, partitions: int = 64):
        self.spark = spark
        self.signs = KeyedTable(spark, f"{folder}/signs", ["firm_id"], partitions)
        self.texts = KeyedTable(spark, f"{folder}/texts", ["id"], partitions)
        self.documents = KeyedTable(spark, f"{folder}/documents", ["id"], partitions)

    def build(self, documents: DataFrame, clients: DataFrame, texts: DataFrame | None = None) -> SearchIndex:
        """Index documents (id, firm_id, client_id, filename, document_type, ...) with their clients' name and PAN and their texts (id, text)."""
        none = F.lit(None).cast("string")
        t = documents.select("id", none.alias("text")).limit(0) if texts is None else texts.select("id", "text")
        self.texts.create(t)
        self.documents.create(documents)
        c = clients.select(F.col("id").alias("client_id"), "client_name", "pan_number")
        d = documents.select("id", "firm_id", "client_id", "filename", "document_type").join(c, "client_id", "left")
        every = F.array_distinct(F.flatten(F.array(*[grams_of(F.col(f)) for f in ("filename", "document_type", "client_name", "pan_number")])))
        d = d.select("firm_id", "id", T.once(every, sign_of).alias("own"))
        x = spread(t).select("id", T.once(grams_of(F.col("text")), sign_of).alias("text"))  # before the join: signs are smaller than texts
        self.signs.create(d.join(x, "id", "left"))
        return self

    def candidates(self, firm_id: int, term: str) -> DataFrame | None:
        """Ids whose fields or text may hold all the term's trigrams; None where the term has no run of ``GRAM`` plain characters."""
        runs = [x for x in re.split(r"\\.|[%_]", term, flags=re.S) if len(x) >= GRAM]
        if not runs:
            return None
        grams = self.spark.createDataFrame([(x,) for x in runs], "x string").select(F.explode(hashes_of(grams_of(F.col("x")))).alias("h")).distinct()
        hashes = sorted(r["h"] for r in grams.collect())  # as many as the term has trigrams at most
        if not hashes:
            return None
        key = self.spark.createDataFrame([(firm_id,)], "firm_id int")
        return self.signs.lookup(key).where(holds_all(F.col("own"), hashes) | holds_all(F.col("text"), hashes)).select("id")

    def search(self, clients: DataFrame, firm_id: int, term: str, limit: int = 50, with_texts: bool = True) -> DataFrame:
        """The rows of ``relational.search``; documents and texts are read from the parts that hold candidates.

        A term with fewer than three plain characters in a row scans the firm's documents, as there.
        """
        ids = self.candidates(firm_id, term)
        documents, texts = (self.documents.rows(), self.texts.rows()) if ids is None else (self.documents.lookup(ids), self.texts.lookup(ids))
        return R.search(documents, clients, firm_id, term, limit, texts if with_texts else None)
