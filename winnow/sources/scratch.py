"""Written intermediate tables, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder where it is unset and the master local."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = tempfile.mkdtemp(prefix="winnow-")
        atexit.register(shutil.rmtree, _OWN[sc.applicationId], ignore_errors=True)
    return _OWN[sc.applicationId]


_SCOPES: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """At its end, tables that were written inside are removed; what is lazy must be computed before."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for folder in _SCOPES.pop():
            remove(spark, folder)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _place(spark: SparkSession, name: str) -> str:
    path = os.path.join(scratch_dir(spark), name)
    for made in _SCOPES:
        made.append(path)
    return path


def written(df: DataFrame, rows_a_file: int = 0) -> DataFrame:
    """``df``, written once and read back: cuts the lineage and fixes what a rerun could change. ``rows_a_file``: at most, if not 0."""
    path = _place(df.sparkSession, f"table-{uuid.uuid4().hex}")
    df.write.option("maxRecordsPerFile", rows_a_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Dealt:
    """A written table in ``parts`` buckets by a key: tables of equal parts are joined on it, and grouped by it, without a shuffle."""

    def __init__(self, df: DataFrame, key: str, parts: int, dealt: bool = False):
        """``dealt``: the rows come from such a table and stand in its parts."""
        self.spark, self.key, self.parts, self.name = df.sparkSession, key, parts, f"winnow_{uuid.uuid4().hex}"
        self.path = _place(self.spark, self.name)
        self._write(df if dealt else df.repartition(parts, key), "error")

    def _write(self, df: DataFrame, mode: str) -> None:
        df.write.mode(mode).format("parquet").bucketBy(self.parts, self.key).option("path", self.path).saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, df: DataFrame) -> Dealt:
        """More rows, which stand in the parts of such a table."""
        self._write(df, "append")
        return self

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.path)
