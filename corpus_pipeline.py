"""The corpus pipeline: language ID, line dedup, near-dedup, mixing to target weights, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``. Each is written as Parquet and read again as the next one's ``docs``.

Null and empty texts have no language and go with the first stage; given to a later stage they stay
there, but mixing chooses no text without words. Rows without id keep their lines and count as no
one's near-duplicate. Empty tables give no rows; further columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.language import fit_language_model, identify
from tallyloom.llm.lines import dedup_lines
from tallyloom.llm.mixing import mix
from tallyloom.llm.neardup import near_duplicates
from tallyloom.llm.packing import pack_documents
from tallyloom.llm.queries import LANGUAGE_WEIGHTS
from tallyloom.session import cut

#: Share of the tokens that mixing keeps; every document is used once at most.
MIX_PERCENT = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the language model rejects: no letters, or a score under its threshold."""
    return identify(docs, fit_language_model(docs)).where("NOT rejected").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out every line that repeats an earlier one, exactly or nearly; the documents stay."""
    out = dedup_lines(docs).select(F.when(F.col("n_removed") > 0, F.struct(*[_with_text(c) for c in docs.columns])).otherwise(F.col("row")).alias("row"))
    return out.select("row.*")


def _with_text(c: str):
    if c == "text":
        return F.col("kept_text").alias("text")
    if c == "n_chars":
        return F.length("kept_text").cast("long").alias("n_chars")
    return F.col("row")[c].alias(c)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) keep the smallest id.

    Rows that repeat an id and a text stay once; rows without words or without id stay.
    """
    found = near_duplicates(docs, size=5, percent=80)
    ids = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_or(~F.col("kept")).alias("_gone"), F.count("*").alias("_rows")).where("_gone OR _rows > 1")
    rest = docs.join(ids, "doc_id", "left").where("_gone IS NULL OR NOT _gone")
    several = F.coalesce(F.col("_rows") > 1, F.lit(False)) & F.col("text").isNotNull()
    return rest.where(~several).select(*docs.columns).union(rest.where(several).select(*docs.columns).dropDuplicates(["doc_id", "text"]))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Choose documents so that languages, and sources within them, come near their weights."""
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    return mix(docs, levels, [LANGUAGE_WEIGHTS, {}], budget_percent=MIX_PERCENT, epochs=1).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens."""
    return pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("packing", packing),
]

#: SQL cannot express the language model or the tokenizer; tests/llm/test_pipeline.py holds each stage on its own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
