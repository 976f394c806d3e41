"""Tables written by hash of their key, so that a change rewrites only the partitions that hold changed keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.session import cleaning, cut, drop

PART = "_part"


class KeyedTable:
    """A Parquet table in a folder, in ``partitions`` parts by the hash of ``key``.

    A change reads and rewrites whole parts, so the number of parts should make one small enough to
    rewrite (a few files) and large enough to be worth one. Changes to a table follow one another; a
    reader that has begun before a change may have to begin again.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], partitions: int = 64):
        self.spark, self.path, self.key, self.partitions = spark, path.rstrip("/"), list(key), partitions

    def part_of(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.partitions)).cast("int")

    def create(self, rows: DataFrame) -> KeyedTable:
        self._write(rows, "static")
        return self

    def read(self) -> DataFrame:
        """The rows with their part; a filter or a join on both key and part reads the parts it needs."""
        return self.spark.read.parquet(self.path)

    def rows(self) -> DataFrame:
        return self.read().drop(PART)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Rows of the keys given, from the parts that may hold them."""
        return self._rows_of(self._parts(keys)).join(keys.select(*self.key).distinct(), self.key, "left_semi")

    def upsert(self, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Replace the parts of the changes' keys by ``merge(their rows, changes)``; gives the parts."""
        parts = self._parts(changes)
        self._replace(parts, merge(self._rows_of(parts), changes))
        return parts

    def delete(self, keys: DataFrame) -> list[int]:
        """Take out the rows of the keys given; gives the parts rewritten."""
        parts = self._parts(keys)
        self._replace(parts, self._rows_of(parts).join(keys.select(*self.key).distinct(), self.key, "left_anti"))
        return parts

    def _parts(self, keys: DataFrame) -> list[int]:
        return sorted(r[0] for r in keys.select(self.part_of().alias("p")).distinct().collect())  # as many as there are parts at most

    def _rows_of(self, parts: list[int]) -> DataFrame:
        return self.read().where(F.col(PART).isin(parts) if parts else F.lit(False)).drop(PART)

    def _replace(self, parts: list[int], rows: DataFrame) -> None:
        """The new rows are complete in a table of their own before the first old file goes."""
        if not parts:
            return
        new = cut(rows, "keyed")
        left = set(self._parts(new))
        if stray := left - set(parts):
            raise ValueError(f"the merge made keys of other parts: {sorted(stray)[:5]}")
        if left:
            self._write(new, "dynamic")
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.path).getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        for p in set(parts) - left:  # parts that have no rows any more
            fs.delete(path(f"{self.path}/{PART}={p}"), True)
        self.spark.catalog.refreshByPath(self.path)
        drop(new)

    def _write(self, rows: DataFrame, mode: str) -> None:
        dealt = rows.withColumn(PART, self.part_of()).hint("rebalance", PART)
        with cleaning(self.spark):
            dealt.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(PART).parquet(self.path)
