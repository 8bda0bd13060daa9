"""Listing the files of a volume."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from itertools import batched

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed

SCHEMA = "absolute_path string, relative_path string, size_bytes bigint, modification_time bigint"


def volume_root(base: str, catalog: str, schema: str, volume: str, prefix: str | None = None) -> str:
    parts = [base.rstrip("/"), catalog, schema, volume]
    return "/".join(parts + ([prefix.strip("/")] if prefix else []))


def list_files(spark: SparkSession, root: str, prefix: str | None = None) -> DataFrame:
    """Every file below ``root``, with its path relative to it, size and change time in seconds.

    Folders are read inside tasks, level by level. Nothing is left out, whatever its name and however the address
    is spelled, but what may not be read and links that lead back up their own path. Addresses with a scheme are read
    through the file system it names.
    """
    start = root if not prefix else f"{root.rstrip('/')}/{prefix.strip('/')}"
    if start.startswith("file:"):
        start = "/" + start.removeprefix("file:").lstrip("/")
    return _walked(spark, start)


def _walked(spark: SparkSession, start: str) -> DataFrame:
    """Level by level: each round lists the folders the round before found, spread over tasks."""
    folders = spark.createDataFrame([(start,)], "folder string")
    found = None
    while True:
        scan = folders.repartition("folder").mapInPandas(_scanner(start), f"is_folder boolean, {SCHEMA}")
        entries = checkpointed(scan)
        files = entries.filter("NOT is_folder").drop("is_folder")
        found = files if found is None else found.unionByName(files)
        folders = entries.filter("is_folder").select(F.col("absolute_path").alias("folder"))
        if folders.isEmpty():
            return found


def _scanner(start: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    columns = ["is_folder", "absolute_path", "relative_path", "size_bytes", "modification_time"]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder in batch["folder"]:
                for rows in batched(_entries(folder, start), 10_000):
                    yield pd.DataFrame(list(rows), columns=columns)

    return scan


def _entries(folder: str, start: str) -> Iterator[tuple[bool, str, str, int, int]]:
    yield from _remote_entries(folder, start) if "://" in folder else _local_entries(folder, start)


def _remote_entries(folder: str, start: str) -> Iterator[tuple[bool, str, str, int, int]]:
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(folder)
    home = fs.FileSystem.from_uri(start)[1].rstrip("/") + "/"
    site = folder.removesuffix(inner.rstrip("/")) if folder.rstrip("/").endswith(inner.rstrip("/")) else folder[: folder.index("://") + 3]
    for child in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
        if child.type == fs.FileType.Directory:
            yield True, site + child.path, "", 0, 0
        elif child.type == fs.FileType.File:
            changed = int((child.mtime_ns or 0) // 1_000_000_000)
            yield False, site + child.path, child.path.removeprefix(home), child.size, changed


def _local_entries(folder: str, start: str) -> Iterator[tuple[bool, str, str, int, int]]:
    try:
        children = list(os.scandir(folder))
    except OSError:
        return
    # a link up the tree, or to the real place of a folder on the way here, would never end
    here = os.path.realpath(folder) + os.sep
    above, steps = {os.path.realpath(start)}, os.path.relpath(folder, start).split(os.sep)
    for depth in range(1, len(steps) + 1):
        above.add(os.path.realpath(os.path.join(start, *steps[:depth])))
    for child in children:
        try:
            if child.is_dir():
                place = os.path.realpath(child.path)
                if place not in above and not here.startswith(place + os.sep):
                    yield True, child.path, "", 0, 0
            elif child.is_file():
                stat = child.stat()
                relative = os.path.relpath(child.path, start).replace(os.sep, "/")
                yield False, child.path, relative, stat.st_size, int(stat.st_mtime)
        except OSError:  # gone meanwhile, or a link that can't be followed
            continue
