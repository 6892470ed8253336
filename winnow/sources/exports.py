"""Sets of files that a run makes or copies, each file committed on its own, and generated pools committed by chunks.

Tasks write to the target through its own file system (a shared folder or an object store). A file is written under
another name beside its place and moved there when it is whole, so a reader never sees half a file, and a task that
runs twice writes the same. What is there already is left as it is: a run that broke off goes on where it was.
Names are unique within a class; of rows with one name the last that gets there stays.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.functions.images import png
from winnow.sources.manifests import exists
from winnow.sources.scratch import written


def _place(root: str) -> tuple[fs.FileSystem, str]:
    if "://" not in root and not root.startswith("/"):
        root = root.removeprefix("file:")
    return fs.FileSystem.from_uri(root if "://" in root or root.startswith("/") else f"/{root}")


def _commit(system: fs.FileSystem, path: str, data: bytes | pa.Buffer) -> None:
    folder, _, name = path.rpartition("/")
    system.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, path)


def _there(system: fs.FileSystem, path: str) -> bool:
    return system.get_file_info(path).type == fs.FileType.File


def _export(rows: DataFrame, root: str, content: Callable[[dict], bytes | pa.Buffer]) -> DataFrame:
    """``content`` of each row (cls, name, ...) at root/cls/name; (cls, name, made), computed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _place(root)
        for batch in batches:
            names, made = batch.select(["cls", "name"]).to_pylist(), []
            for i, row in enumerate(names):
                path = f"{base.rstrip('/')}/{row['cls']}/{row['name']}"
                made.append(not _there(system, path))
                if made[-1]:
                    _commit(system, path, content(batch.slice(i, 1).to_pylist()[0]))
            yield pa.RecordBatch.from_arrays([batch["cls"].cast(pa.string()), batch["name"], pa.array(made, pa.bool_())], ["cls", "name", "made"])

    return written(rows.mapInArrow(run, "cls string, name string, made boolean"))


def write_images(images: DataFrame, root: str) -> DataFrame:
    """Images (cls, name, px, height, width) as grey PNG files at root/cls/name; (cls, name, made). Rows with null pixels are left out."""

    def content(row: dict) -> bytes:
        return png(np.clip(np.array(row["px"]), 0, 255).astype(np.uint8).reshape(row["height"], row["width"]))

    return _export(images.where("px is not null").select("cls", "name", "px", "height", "width"), root, content)


def copy_files(selected: DataFrame, root: str) -> DataFrame:
    """Files (cls, path) to root/cls/<file name>, file by file; (cls, name, made)."""

    def content(row: dict) -> pa.Buffer:
        system, path = _place(row["path"])
        with system.open_input_file(path) as source:
            return source.read_buffer()

    return _export(selected.select("cls", "path", F.element_at(F.split("path", "/"), -1).alias("name")), root, content)


def generated_pool(spark: SparkSession, root: str, wanted: dict[str, int], chunk: int, make: Callable[[str, DataFrame], DataFrame]) -> DataFrame:
    """All rows of a generated pool, with ``cls`` and ``chunk``; ``make(cls, seeds)`` makes the rows of some seeds (seed long).

    A class's seeds go from 0 to its number wanted, in chunks. A chunk is a folder that counts once its commit marker is there; chunks
    that have one are not made again, and the next has the seeds that follow. More rows wanted later add chunks, and remake a last one that was not full.
    """
    done = {(r["cls"], r["chunk"]): r["n"] for r in chunk_log(spark, root).collect()} if exists(spark, root) else {}
    folders = []
    for cls, n in wanted.items():
        for no, first in enumerate(range(0, n, chunk)):
            last = min(n, first + chunk)
            at = f"{root.rstrip('/')}/cls={cls}/chunk={no}"
            if done.get((cls, no), -1) < last - first or not exists(spark, f"{at}/rows/_SUCCESS"):
                make(cls, spark.range(first, last).withColumnRenamed("id", "seed")).write.mode("overwrite").parquet(f"{at}/rows")
                spark.createDataFrame([(last - first,)], "n long").coalesce(1).write.mode("overwrite").json(f"{at}/log")
            folders.append(f"{at}/rows")
    if not folders:
        raise ValueError("no rows are wanted")
    return spark.read.option("basePath", root).parquet(*folders)


def chunk_log(spark: SparkSession, root: str) -> DataFrame:
    """(cls, chunk, n): the committed chunks of a pool and the seeds of each."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/cls=*/chunk=*/log/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    folders = [str(f.getPath().getParent()) for f in found or []]
    if not folders:
        return spark.createDataFrame([], "cls string, chunk int, n long")
    return spark.read.schema("n long, cls string, chunk int").option("basePath", root).json(folders).select("cls", "chunk", "n")


def write_report(spark: SparkSession, path: str, config: dict, ranking: DataFrame, notes: list[str] | None = None) -> None:
    """A result document: how a run was set, its ranking as a list of rows in the order of ``rank``, and notes. A ranking has a row a method."""
    rows = ranking.withColumn("_row", F.struct(*ranking.columns)).agg(F.array_sort(F.collect_list(F.struct("rank", F.col("_row").alias("row")))).alias("r"))
    said = F.array(*(F.lit(n) for n in notes or [])).cast("array<string>")
    setting = F.create_map(*(F.lit(str(x)) for kv in config.items() for x in kv)).cast("map<string,string>") if config else F.create_map().cast("map<string,string>")
    rows.select(setting.alias("config"), F.transform("r", lambda e: e["row"]).alias("ranking"), said.alias("notes")).coalesce(1).write.mode("overwrite").json(path)
