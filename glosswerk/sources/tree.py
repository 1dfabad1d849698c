"""Files of a folder tree on any file system that Arrow opens (local, HDFS, S3, GCS, Azure).

Spark's file sources skip names that begin with ``.`` or ``_`` and cannot leave out
folders by name.  Here folders are listed level by level in tasks, each level a table, so
the driver holds no path; links to folders are not followed.  The files found are dealt
out by their bytes, and each task reads its own.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glosswerk.operators.settle import new_folder

#: Bytes of files that one task reads; a larger file is a task's only one.
SPLIT_BYTES = 64 << 20
#: Files also cost their opening: each counts as so many bytes at least.
FILE_BYTES = 64 << 10
#: Folders that one task lists.
FOLDERS_A_TASK = 64

_ENTRY = "file string, name string, folder boolean, size long"


def _open(root: str) -> tuple[afs.FileSystem, str]:
    if "://" in root or root.startswith("file:"):
        return afs.FileSystem.from_uri(root if "://" in root else f"file://{root.removeprefix('file:')}")
    return afs.LocalFileSystem(), os.path.abspath(root)


def _lister(root: str, extensions: tuple[str, ...], exclude: frozenset[str], dot: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = _open(root)
        local = isinstance(files, afs.LocalFileSystem)
        for batch in batches:
            for folder in batch.column("file").to_pylist():
                found: list[tuple] = []
                for info in files.get_file_info(afs.FileSelector(f"{top}/{folder}" if folder else top)):
                    name, is_folder = info.base_name, info.type == afs.FileType.Directory
                    if name in exclude or (not dot and name.startswith(".")):
                        continue
                    if is_folder and local and os.path.islink(info.path):
                        continue
                    if is_folder or name.endswith(extensions):
                        found.append((f"{folder}/{name}" if folder else name, name, is_folder, None if is_folder else info.size))
                columns = [*zip(*found, strict=True)] or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.bool_(), pa.int64()), strict=True)], names=["file", "name", "folder", "size"])

    return run


def listing(spark: SparkSession, root: str, extensions: str, exclude: str = "", dot: bool = True, deep: bool = True) -> DataFrame:
    """file (relative path), name, size of the files below ``root`` (or, not ``deep``, in
    it) whose names end with one of the ``extensions`` and that lie in no folder, and have
    no name, of ``exclude`` (both comma lists).  Without ``dot`` names that begin with a
    dot are left out."""
    run = _lister(root, tuple(extensions.split(",")), frozenset(filter(None, exclude.split(","))), dot)
    path, level = new_folder(spark, "scan"), 0
    frontier, n = spark.createDataFrame([("",)], "file string"), 1
    while n:
        frontier.repartition(math.ceil(n / FOLDERS_A_TASK)).mapInArrow(run, _ENTRY).write.parquet(f"{path}/level={level}")
        frontier = spark.read.schema(_ENTRY).parquet(f"{path}/level={level}").where("folder")
        n, level = frontier.count() if deep else 0, level + 1
    return spark.read.schema(_ENTRY).parquet(path).where("NOT folder").select("file", "name", "size")


def _dealt(files: DataFrame) -> DataFrame:
    """``files`` in partitions of ``SPLIT_BYTES`` and at most one file more."""
    cost = F.greatest("size", F.lit(FILE_BYTES))
    total = files.select(F.coalesce(F.sum(cost), F.lit(0)).alias("n")).first().n
    # Bytes are summed up within lanes of some tens of tasks each, so no task sums them all.
    lanes = math.ceil(total / (64 * SPLIT_BYTES)) or 1
    lane = F.pmod(F.xxhash64("file"), F.lit(lanes)).cast("int")
    longest = files.groupBy(lane.alias("lane")).agg(F.sum(cost).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first().n
    turns = longest // SPLIT_BYTES + 1
    before = F.sum(cost).over(Window.partitionBy(lane).orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    turn = F.floor(F.coalesce(before, F.lit(0)) / SPLIT_BYTES).cast("int")
    return files.withColumn("__part", lane * turns + turn).repartitionById(lanes * turns, "__part").drop("__part")


def contents(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """file, name, content (UTF-8, broken bytes replaced) of a ``listing``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, top = _open(root)
        for batch in batches:
            for k, file in enumerate(batch.column("file").to_pylist()):
                with source.open_input_stream(f"{top}/{file}", compression=None) as stream:
                    text = stream.read().decode("utf-8", "replace")
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, 1) for c in ("file", "name")), pa.array([text], pa.string())], names=["file", "name", "content"])

    return _dealt(files).mapInArrow(run, "file string, name string, content string")


def scan(spark: SparkSession, root: str, extensions: str, exclude: str = "", dot: bool = True, deep: bool = True) -> DataFrame:
    return contents(spark, root, listing(spark, root, extensions, exclude, dot, deep))


def write(files: DataFrame, root: str) -> DataFrame:
    """Writes each (file, content) as a file below ``root``; the paths written.  A task
    that is tried again writes the same files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, top = _open(root)
        made: set[str] = set()
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist(), strict=True):
                path = f"{top}/{file}"
                folder = path.rsplit("/", 1)[0]
                if folder not in made:
                    target.create_dir(folder, recursive=True)
                    made.add(folder)
                with target.open_output_stream(path, compression=None) as stream:
                    stream.write((content or "").encode())
            yield batch.select(["file"])

    return files.select("file", "content").mapInArrow(run, "file string")
