"""Files as rows: real listings, and documents written as files of their own."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .shared import kept

HELD_BYTES = 4 << 20  # of files that a task holds before it passes them on
LISTED = 50_000  # files of a folder that are passed on together


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime, length) of all files below root, path being relative to it: those too that Spark's sources pass over, because they are
    empty or their names begin with _ or a dot. No file is opened.

    Folders are listed by tasks, level by level; no folder's files are listed twice.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for b in batches:
            for folder in b["path"]:
                found = store.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/")))
                for at in range(0, len(found), LISTED):
                    some = found[at : at + LISTED]
                    yield pd.DataFrame([(f.path[len(base) :].lstrip("/"), f.mtime, f.size or 0, f.type == fs.FileType.Directory) for f in some], columns=["path", "mtime", "length", "folder"])

    out, folders = None, spark.createDataFrame([("",)], "path string")
    while True:
        level = kept(folders.mapInPandas(run, "path string, mtime timestamp, length long, folder boolean"), "listing")
        files = level.where("not folder").drop("folder")
        out = files if out is None else out.unionByName(files)
        folders = level.where("folder").select("path").repartition(2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
        if level.where("folder").isEmpty():
            return out


def contents(root: str, paths: DataFrame) -> DataFrame:
    """(path, content) of the files below root that paths(path) names, read as text by the tasks that hold the names."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for b in batches:
            held, texts, size = [], [], 0
            for path in b["path"]:
                with store.open_input_stream(f"{base}/{path}") as f:
                    data = f.read()
                held.append(path)
                texts.append(data.decode("utf-8", "replace"))
                size += len(data)
                if size >= HELD_BYTES:
                    yield pd.DataFrame({"path": held, "content": texts})
                    held, texts, size = [], [], 0
            if held:
                yield pd.DataFrame({"path": held, "content": texts})

    # a listing has a file for each folder, which one task would read; its names are dealt anew
    parts = 2 * int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return paths.select("path").repartition(parts, "path").mapInPandas(run, "path string, content string")


def write_files(rows: DataFrame, root: str) -> None:
    """rows(path, content), a file each below root, written by the tasks that hold them; a task that runs again writes the same files."""

    def write(batch) -> None:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        made = set()
        for r in batch:
            at = f"{base}/{r['path']}"
            parent = at.rpartition("/")[0]
            if parent not in made:
                store.create_dir(parent, recursive=True)
                made.add(parent)
            with store.open_output_stream(at) as out:
                out.write((r["content"] or "").encode())

    rows.select("path", "content").foreachPartition(write)
