"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is missing, a local master gets a temporary folder; a
    cluster has no folder that is safe to assume, so that is an error.
    """
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


def materialise(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage, so a lost executor does not repeat the work below, and
    fixes what a second evaluation could deal out in another way.
    """
    spark = df.sparkSession
    if path is None:
        path = os.path.join(scratch_dir(spark), f"winnow-{uuid.uuid4().hex}")
        for made in _SCOPES:
            made.append(path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SCOPES: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """At its end, tables that :func:`materialise` made inside without a path are removed; what is lazy must be written before."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for folder in _SCOPES.pop():
            _remove(spark, folder)


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Remove the files of a frame that :func:`materialise` returned."""
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        _remove(df.sparkSession, folder)


def small(df: DataFrame, most: int = 20_000) -> DataFrame:
    """``df`` with a broadcast hint if it has ``most`` rows at most, else as it is.

    ``df`` should be cheap to count (materialised or aggregated).
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


HOT = 4096


def join_by_key(rows: DataFrame, keyed: DataFrame, key: str) -> DataFrame:
    """``rows`` left-joined with ``keyed``, in which ``key`` is unique; ``rows`` are read more than once, so they should be written.

    Keys of more than one in ``HOT`` of all rows, which are fewer than ``HOT`` keys, go to
    all tasks, so that none of them is one task; only the rows of other keys are shuffled.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    counts = materialise(counts)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    often = counts.where((F.col("n") * HOT > total) & F.col(key).isNotNull()).select(key)
    if total <= HOT or often.isEmpty():
        return rows.join(keyed, key, "left")
    hot = materialise(keyed.join(F.broadcast(often), key, "left_semi"))
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(keyed, key, "left")
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def row_hash(df: DataFrame) -> Column:
    """xxHash64 over all columns; maps count as their sorted entries."""
    kinds = dict(df.dtypes)
    return F.xxhash64(*(F.array_sort(F.map_entries(F.col(f"`{c}`"))) if kinds[c].startswith("map<") else F.col(f"`{c}`") for c in df.columns))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
