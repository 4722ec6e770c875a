"""Listing of trees by tasks: folders are opened level by level, never by the driver.

The folders of one depth are a DataFrame.  Tasks list each of them once, a large folder in many rows; its
files are written, its folders are the next round's DataFrame, less those that a rule prunes: these are
never opened.  The driver sees counts only.  Hidden names are names like others.
"""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import new_folder

LEVEL = "path string, relative string, size bigint, link boolean, error string, folder boolean"
_NAMES = ["path", "relative", "size", "link", "error", "folder"]
_SCHEME = re.compile(r"^([A-Za-z][A-Za-z0-9+.-]*):")
#: Stores that tasks open themselves; a path without a scheme is one that all nodes mount.
TASK_STORES = ("file", "s3", "s3a", "gs")


def scheme_of(uri: str) -> str:
    found = _SCHEME.match(uri)
    return found.group(1).lower() if found else ""


def mounted(uri: str) -> str:
    """A local URI as the path under which nodes mount it."""
    return re.sub(r"^file:/+", "/", uri)


def tasks_open(uri: str) -> bool:
    return scheme_of(uri) in ("", *TASK_STORES)


def remote(uri: str):
    """(file system, path) of an object store."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3a:", "s3:", uri))


def entry(path: str, relative: str) -> tuple:
    """A file as a row; one that cannot be asked is an error row."""
    try:
        return path, relative, os.stat(path).st_size, os.path.islink(path), None, False
    except OSError as problem:
        return path, relative, None, os.path.islink(path), problem.strerror or type(problem).__name__, False


def _below(folder: str, name: str, relative: str) -> tuple[str, str]:
    return f"{folder.rstrip('/')}/{name}", f"{relative}/{name}" if relative else name


def _own_ancestor(path: str, folder: str) -> bool:
    """Does a link lead back to a folder above it?"""
    return (os.path.realpath(folder) + "/").startswith(os.path.realpath(path).rstrip("/") + "/")


def list_folder(folder: str, relative: str, follow: bool) -> Iterator[tuple]:
    """Rows of one folder; one that may not be listed holds nothing, as in any walk."""
    if scheme_of(folder):
        from pyarrow import fs

        store, path = remote(folder)
        for info in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            own, below = _below(folder, info.base_name, relative)
            is_folder = info.type == fs.FileType.Directory
            yield own, below, None if is_folder else info.size, False, None, is_folder
        return
    try:
        with os.scandir(folder) as entries:
            for item in entries:
                own, below = _below(folder, item.name, relative)
                if item.is_dir(follow_symlinks=follow):
                    if not (item.is_symlink() and _own_ancestor(own, folder)):
                        yield own, below, None, item.is_symlink(), None, True
                elif not (item.is_symlink() and item.is_dir()):
                    yield entry(own, below)
    except OSError:
        return


def walk(
    spark: SparkSession,
    roots: list[tuple[str, str]],
    follow: bool = False,
    opened: Callable[[DataFrame], DataFrame] = lambda folders: folders,
    chunk: int = 10_000,
) -> DataFrame:
    """``path, relative, size, link, error`` of every file below the folders ``roots`` (path, relative).

    ``opened`` keeps the folders that may be opened.  One round of listing a depth.
    """
    target = new_folder(spark, "listing")
    cores = spark.sparkContext.defaultParallelism

    def list_level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder, relative in zip(batch["path"], batch["relative"]):
                rows = list_folder(folder, relative, follow)
                while some := list(itertools.islice(rows, chunk)):
                    yield pd.DataFrame(some, columns=_NAMES).astype({"size": "Int64"})

    folders, count, depth = spark.createDataFrame(roots, "path string, relative string"), len(roots), 0
    while count:
        path = f"{target}/depth={depth}"
        tasks = min(count, max(4 * cores, count // 256))
        folders.repartition(tasks).mapInPandas(list_level, LEVEL).write.parquet(path)
        level = spark.read.schema(LEVEL).parquet(path)
        folders = opened(level.where("folder")).select("path", "relative")
        count, depth = folders.count(), depth + 1
    if not depth:
        return spark.createDataFrame([], LEVEL).drop("folder")
    return spark.read.schema(LEVEL).parquet(target).where("not folder").select(*_NAMES[:-1])
