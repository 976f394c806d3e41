"""The cache of results by content hash, as a bucketed table: batches are dealt to its buckets and it never moves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class ResultCache:
    """A table (sha, result) in buckets by sha, at ``path`` and under ``name`` in the session's catalog."""

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = 64):
        self.spark, self.name, self.path, self.buckets = spark, name, path, buckets

    def _save(self, results: DataFrame, mode: str) -> None:
        """A file a bucket for each write."""
        dealt = results.where("sha IS NOT NULL").repartition(self.buckets, "sha")
        dealt.write.format("parquet").bucketBy(self.buckets, "sha").sortBy("sha").option("path", self.path).mode(mode).saveAsTable(self.name)

    def create(self, results: DataFrame) -> ResultCache:
        self._save(results, "overwrite")
        return self

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, results: DataFrame) -> None:
        """Append results of hashes that are not there; of several with one hash any one."""
        self._save(results.dropDuplicates(["sha"]).join(self.table().select("sha"), "sha", "left_anti"), "append")
