"""Readers and writers of manifests, label tables, listings, splits, feature caches and result documents."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.functions.order import seeded
from winnow.operators.curation import label_of, last_flags, name_parts
from winnow.operators.sampling import head_per_class, split_halves

MANIFEST = "subject_id string, study_id string, dicom_id string, split string, label string, relpath string"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_strings(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A headed CSV (also gzipped, with quoted commas) as strings."""
    reader = spark.read.option("header", True).option("escape", '"').option("enforceSchema", False)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_flags(spark: SparkSession, path: str, keys: list[str], flag: str) -> DataFrame:
    """(keys, flag) of a headed CSV; a repeated key has the flag of its last row."""
    rows = read_strings(spark, path).select(*keys, F.trim(F.coalesce(F.col(flag), F.lit(""))).alias("flag"), F.monotonically_increasing_id().alias("line"))
    return last_flags(rows, keys, "flag", "line")


def read_hits(spark: SparkSession, path: str, key: str) -> DataFrame:
    return read_strings(spark, path).select(key).distinct()


def list_files(spark: SparkSession, root: str, glob: str = "*.{png,jpg}") -> DataFrame:
    """(path, cls, name, length): files below ``root`` by class folder; contents are not read. Spark lists no files of length 0."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(root).select("path", "length")
    return files.select("path", F.element_at(F.split("path", "/"), -2).alias("cls"), F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def read_images(spark: SparkSession, paths: DataFrame, root: str, decode: Callable, glob: str = "*.{png,jpg}") -> DataFrame:
    """(path, image) of the listed paths; ``decode``: a pandas or Arrow UDF from bytes, which should return null for what it can't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(root).select("path", "content")
    return files.join(paths.select("path").distinct(), "path", "left_semi").select("path", decode("content").alias("image"))


def tolerant(fn: Callable[[bytes], np.ndarray]):
    """A UDF from bytes to struct(px, height, width, truncated): ``fn`` decodes a whole image; null pixels for what it raises at.

    ``truncated``: the end mark of a JPEG or PNG file is missing. Such bytes are tried with the mark added, too.
    """
    ends = {b"\xff\xd8": b"\xff\xd9", b"\x89PNG": b"IEND\xaeB`\x82"}

    @F.pandas_udf("px array<short>, height int, width int, truncated boolean")
    def read(contents: pd.Series) -> pd.DataFrame:
        out = []
        for raw in contents:
            mark = next((e for head, e in ends.items() if raw is not None and bytes(raw).startswith(head)), b"")
            cut = bool(mark) and mark not in bytes(raw)[-64:]
            image = None
            for attempt in ([] if raw is None else [bytes(raw), bytes(raw) + mark] if cut else [bytes(raw)]):
                try:
                    image = np.asarray(fn(attempt))
                    break
                except Exception:  # whatever a decoder raises at damaged bytes
                    continue
            out.append((None, None, None, cut) if image is None else (image.ravel().astype(np.int16), *image.shape[:2], cut))
        return pd.DataFrame(out, columns=["px", "height", "width", "truncated"])

    return read


def images_of(spark: SparkSession, manifest: DataFrame, root: str, split: str, positive: str, normal: str, decode: Callable, per_class: int | None = None) -> DataFrame:
    """(path, cls, image): the records of one split with a known label whose file is there, ``per_class`` of each class at most, in the order of their paths."""
    base = F.lit(root.rstrip("/") + "/")
    rows = manifest_records(manifest, split, positive, normal).withColumn("path", F.concat(base, "relpath")).select("path", "cls").distinct()
    there = list_files(spark, root).select(F.regexp_replace("path", "^file:/+", "/").alias("path"))
    rows = rows.join(there, "path", "left_semi")
    if per_class is not None:
        rows = head_per_class(rows, "cls", "path", per_class)
    plain = read_images(spark, list_files(spark, root), root, decode).withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    return rows.join(plain, "path")


def sample_files(listing: DataFrame, limit: int, seed: int = 0) -> DataFrame:
    return listing.orderBy(seeded(seed, "name"), "path").limit(limit)


def manifest_records(manifest: DataFrame, split: str, positive: str, normal: str) -> DataFrame:
    """Rows of one split with a known label, as ``cls``."""
    return manifest.where(F.col("split") == split).withColumn("cls", label_of(F.col("label"), positive, normal)).where("cls is not null")


def with_identity(listing: DataFrame) -> DataFrame:
    return listing.withColumn("who", name_parts(F.col("path"))).select("*", "who.*").drop("who")


def load_split(spark: SparkSession, path: str, build: Callable[[], DataFrame], part: str, cls: str = "cls", seed: int = 0, key: str = "id") -> DataFrame:
    """The ``select`` or ``eval`` half of a written split; built and written on first use."""
    if not exists(spark, path):
        split_halves(build(), cls, seed, key).write.mode("ignore").partitionBy("part").parquet(path)
    return spark.read.parquet(path).where(F.col("part") == part)


def cached_features(spark: SparkSession, root: str, backbone: str, paths: DataFrame, extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Features of (path), kept in a folder named by the backbone and the set of paths; computed on the first call.

    The name is a hash of the count and of order-free sums of path hashes, so the paths are not gathered.
    """
    h = paths.select(F.xxhash64("path").alias("h"), F.xxhash64(F.lit(1), "path").alias("g"))
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    r = h.agg(F.count("*").alias("n"), wide("h").alias("h"), wide("g").alias("g")).select(F.substring(F.sha1(F.concat_ws("\x00", F.lit(backbone), *(F.col(c).cast("string") for c in ("n", "h", "g")))), 1, 16).alias("key")).first()
    at = f"{root.rstrip('/')}/{r['key']}"
    if not exists(spark, f"{at}/_SUCCESS"):
        extract(paths).write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def write_selection(selected: DataFrame, path: str, cls: str = "cls") -> None:
    """Selected rows by class folder; written again only if there is nothing yet."""
    selected.write.mode("ignore").partitionBy(cls).parquet(path)


def not_yet(wanted: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """What a resumed run still has to do."""
    return wanted.join(done.select(key), key, "left_anti")


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).where("value is not null").write.mode("overwrite").text(path)


def write_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Result documents (one or many lines each); empty if there are none yet."""
    return spark.read.schema(schema).option("multiLine", True).json(path) if exists(spark, path) else spark.createDataFrame([], schema)
