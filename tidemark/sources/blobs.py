"""Files by their content: tasks write files below a shared folder, and a store keeps every distinct content once.

The store has one file for each SHA-256 and manifests that name what a run has seen; a manifest is written last, so a run that
is broken off leaves contents without names and is simply run again. A run writes only contents that the store lacks, checks
each by reading it back, and leaves everything else alone.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import saved, tasks

READ_ROWS, READ_BYTES = 1000, 32 << 20  # of files that a task hands over at once


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _put(system: fs.FileSystem, path: str, data: bytes, made: set[str] | None = None) -> None:
    """Writes a file whole: under another name first, then moved. ``made``: the folders that are there already."""
    folder = path.rsplit("/", 1)[0]
    if made is None or folder not in made:
        system.create_dir(folder, recursive=True)
        if made is not None:
            made.add(folder)
    new = f"{path}.{uuid.uuid4().hex}.new"
    with system.open_output_stream(new) as out:
        out.write(data)
    system.move(new, path)


def write_files(files: DataFrame, path: str) -> int:
    """Writes rows (name, content) as files of a folder, each whole; returns how many."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (system, root), made = _open(path), set()
        for pdf in frames:
            for name, data in zip(pdf["name"], pdf["content"]):
                _put(system, f"{root}/{name}", bytes(data), made)
            yield pd.DataFrame({"n": [len(pdf)]})

    return files.select("name", "content").repartition(tasks(files.sparkSession), "name").mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, content) of the files in the folders of a folder. The driver lists the folders; tasks list and read what is in them."""
    system, root = _open(path)
    folders = [(i.path,) for i in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if i.type == fs.FileType.Directory]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, _ = _open(path)
        for folder in (f for pdf in frames for f in pdf["folder"]):
            names, held, size = [], [], 0
            for info in system.get_file_info(fs.FileSelector(folder)):
                if info.type == fs.FileType.File:
                    with system.open_input_stream(info.path) as file:
                        names.append(info.base_name), held.append(file.read())
                    size += len(held[-1])
                    if len(held) >= READ_ROWS or size >= READ_BYTES:
                        yield pd.DataFrame({"name": names, "content": held})
                        names, held, size = [], [], 0
            if names:
                yield pd.DataFrame({"name": names, "content": held})

    return spark.createDataFrame(folders, "folder string").repartition(max(1, min(len(folders), tasks(spark)))).mapInPandas(run, "name string, content binary")


def _lacking(hashes: DataFrame, store: str) -> DataFrame:
    """The hashes whose contents the store doesn't have; each is looked for by a task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = _open(store)
        for pdf in frames:
            found = system.get_file_info([f"{root}/contents/{h[:2]}/{h}.blob" for h in pdf["hash"]])
            yield pdf[[i.type == fs.FileType.NotFound for i in found]]

    return hashes.repartition(tasks(hashes.sparkSession), "hash").mapInPandas(run, "hash string")


def manifest(spark: SparkSession, store: str) -> DataFrame | None:
    """(name, hash, size) of the last whole run."""
    try:
        runs = spark.read.parquet(f"{store}/manifests")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return runs.where(F.col("run") == runs.agg(F.max("run")).first()[0]).drop("run")


def keep(files: DataFrame, store: str, run: int) -> tuple[int, DataFrame]:
    """Puts files (name, content) in the store as run number ``run``: how many contents were new, and the manifest of the run
    (name, hash, size). Files are read once for their hashes, and those of contents that the store lacks once more; contents go
    by their hash to tasks, one of each."""
    named = files.select("name", "content", F.sha2("content", 256).alias("hash"), F.length("content").cast("long").alias("size"))
    told = saved(named.select("name", "hash", "size"), "hashes")
    lacking = saved(_lacking(told.where("hash IS NOT NULL").select("hash").distinct(), store), "lacking")
    new = named.join(lacking, "hash").groupBy("hash").agg(F.first("content").alias("content")).repartition(tasks(files.sparkSession), "hash")

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (system, root), made = _open(store), set()
        for pdf in frames:
            for name, data in zip(pdf["hash"], pdf["content"]):
                path = f"{root}/contents/{name[:2]}/{name}.blob"
                _put(system, path, bytes(data), made)
                with system.open_input_stream(path) as back:
                    if hashlib.sha256(back.read()).hexdigest() != name:
                        raise OSError(f"{path} was not written whole")
            yield pd.DataFrame({"n": [len(pdf)]})

    written = 0 if lacking.isEmpty() else new.mapInPandas(put, "n long").agg(F.sum("n")).first()[0] or 0
    told.write.mode("overwrite").parquet(f"{store}/manifests/run={run}")
    return written, files.sparkSession.read.parquet(f"{store}/manifests/run={run}")
