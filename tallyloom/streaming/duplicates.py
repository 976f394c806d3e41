"""The duplicate detector over files that keep arriving: keyed state instead of a table of all that was seen.

Two stateful steps follow one another in a query. The first, by content hash, holds the first file of
each hash; the second, by fingerprint, the first file of each fingerprint among those that were no exact
copy. State lives in the query's checkpoint, so a restart goes on where the last batch ended, and every
entry ends after a time to live.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_OUT = "seq long, file string, sha string, fp string, duplicate_type string, original_file string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _FirstFile(StatefulProcessor):
    """Rows of a key in arrival order: the first file is kept, later ones are duplicates of it."""

    def __init__(self, kind: str, ttl_ms: int):
        self.kind, self.ttl_ms = kind, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "file string", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        known = self.first.get()[0] if self.first.exists() else None
        for r in sorted(rows, key=lambda r: r["seq"]):
            out = r.asDict()
            out.pop("key")
            if out["duplicate_type"] is None and r["key"][:1] != "#":
                if known is None:
                    known = r["file"]
                    self.first.update((known,))
                else:
                    out |= {"duplicate_type": self.kind, "original_file": known}
            yield Row(**out)

    def close(self) -> None:
        pass


def find_duplicates_stream(files: DataFrame, ttl_ms: int = 90 * 24 * 3600 * 1000) -> DataFrame:
    """A stream of files (seq, file, sha, fp) with ``duplicate_type`` (exact, semantic or null) and ``original_file``.

    As ``resolution.find_duplicates`` over all that has arrived, where files arrive in the order of
    ``seq``: a file of a hash seen before is exact and leaves its fingerprint alone, another of a
    fingerprint seen before is semantic; a null hash is never exact and a null fingerprint never semantic.
    What was last first seen more than ``ttl_ms`` ago is forgotten. Of a trigger, all files of one hash or
    one fingerprint meet in a task; ``maxFilesPerTrigger`` bounds them.
    """
    alone = F.concat(F.lit("#"), F.col("seq").cast("string"))  # a key of its own: needs no state
    none = F.lit(None).cast("string")

    def step(rows: DataFrame, key: str, kind: str) -> DataFrame:
        done = F.col("duplicate_type").isNotNull() | F.col(key).isNull()
        keyed = rows.withColumn("key", F.when(done, alone).otherwise(F.concat(F.lit("="), F.col(key))))
        return keyed.groupBy("key").transformWithState(_FirstFile(kind, ttl_ms), _OUT, "Append", "ProcessingTime")

    given = files.select(F.col("seq").cast("long").alias("seq"), "file", "sha", "fp", none.alias("duplicate_type"), none.alias("original_file"))
    return step(step(given, "sha", "exact"), "fp", "semantic")


def detect_files(spark: SparkSession, folder: str, out: str, checkpoint: str, files_per_batch: int = 1, ttl_ms: int = 90 * 24 * 3600 * 1000):
    """A running query over Parquet files (seq, file, sha, fp) that arrive in a folder; its rows are appended to ``out``.

    It ends once all that has arrived is done. Batches without data, which state with a time to live
    would ask for without end, are off.
    """
    settings = {_PROVIDER: _ROCKS, _EMPTY_BATCHES: "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        arriving = spark.readStream.schema("seq long, file string, sha string, fp string").option("maxFilesPerTrigger", files_per_batch).parquet(folder)
        found = find_duplicates_stream(arriving, ttl_ms)
        return found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
