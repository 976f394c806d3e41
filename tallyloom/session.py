"""Session settings shared by tests, bench and the operators that cut lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8, app: str = "tallyloom") -> SparkSession:
    """A session for tests and benches on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TALLYLOOM_DRIVER_MEMORY", "4g"))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset and Spark runs within one
    process (tests, one machine) a local folder is chosen and remembered in the session; a cluster
    without the setting is an error, as its executors would not see each other's files.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.conf.get("spark.tallyloom.shared.dir", None)
    if not where:
        master = spark.conf.get("spark.master", "local")
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        where = tempfile.mkdtemp(prefix="tallyloom-")
        spark.conf.set("spark.tallyloom.shared.dir", where)
    return where.rstrip("/")


#: Spark's setting that removes a query's shuffle files as it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaning(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a query that runs within go as it ends."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    The result no longer depends on the plan that made it, survives lost executors, and has
    known sizes for the planner. The shuffle files of the write go as it ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with cleaning(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    _WRITTEN.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return out


#: By application, the folders that ``cut`` has written and nobody has deleted.
_WRITTEN: dict[str, set[str]] = {}
_PATHS: "weakref.WeakKeyDictionary[DataFrame, str]" = weakref.WeakKeyDictionary()


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
    _WRITTEN.get(spark.sparkContext.applicationId, set()).discard(path)


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` has written, once nothing needs them; others are left alone."""
    for df in tables:
        if path := _PATHS.pop(df, None):
            _delete(df.sparkSession, path)


def release(spark: SparkSession) -> int:
    """Delete every table that ``cut`` has written in this application; results not read or written yet are lost. Gives how many went."""
    paths = sorted(_WRITTEN.get(spark.sparkContext.applicationId, ()))
    for path in paths:
        _delete(spark, path)
    return len(paths)
