"""Source trees of any file system as tables.

Spark's own file sources skip names that start with ``_`` or ``.`` and empty files; a source tree has both
(``__init__.py``). Here folders are rows: each level of the tree is listed by tasks and written, and its folders are the
rows of the next. The files found are dealt to tasks by size, which open them through the file system of the URI.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from fnmatch import fnmatchcase
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codecatalog.session import new_run_dir

TASK_BYTES = 64 << 20
FILE_COST = 64 << 10  # opening a file costs about as much as reading this many bytes
#: Bytes of files that a task holds before it hands them on; a larger file goes alone.
BATCH_BYTES = 16 << 20
LISTING = "path string, is_dir boolean, size long, modified long"
_LISTING = pa.schema([("path", pa.string()), ("is_dir", pa.bool_()), ("size", pa.int64()), ("modified", pa.int64())])
_FILES = pa.schema([("path", pa.string()), ("content", pa.binary())])


def mounted_path(uri: str) -> str | None:
    """The plain path of a mounted folder, or None for a remote URI."""
    if uri.startswith("file:"):
        return "/" + uri.removeprefix("file:").lstrip("/")
    return None if "://" in uri else uri


def file_system(root: str):
    """File system and path of a folder, mounted or by its URI; tasks and driver open it alike."""
    from pyarrow import fs

    mounted = mounted_path(root)
    if mounted is not None:
        return fs.LocalFileSystem(), mounted.rstrip("/") or "/"
    system, path = fs.FileSystem.from_uri(root)
    return system, path.rstrip("/")


def is_folder(path: str) -> bool:
    """Whether tasks can list ``path``: it is a folder of a file system that they can open."""
    from pyarrow import fs

    try:
        system, base = file_system(path)
        return system.get_file_info(base).type == fs.FileType.Directory
    except (pa.ArrowException, OSError):
        return False


def folder_entries(system, folder: str) -> Iterator[tuple[str, bool, int, int | None]]:
    """``name, is_dir, size, modified`` of what is in a folder, without links to folders. A mounted one is read entry by entry,
    however many it holds."""
    from pyarrow import fs

    if not isinstance(system, fs.LocalFileSystem):
        for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            modified = None if info.mtime_ns is None else info.mtime_ns // 1000
            yield info.base_name, info.type == fs.FileType.Directory, info.size or 0, modified
        return
    try:
        entries = os.scandir(folder)
    except FileNotFoundError:
        return
    with entries:
        for entry in entries:
            is_dir = entry.is_dir()
            if is_dir and entry.is_symlink():
                continue
            try:
                found = entry.stat()
            except FileNotFoundError:  # gone by now, or a link to nothing
                yield entry.name, is_dir, 0, None
                continue
            yield entry.name, is_dir, 0 if is_dir else found.st_size, found.st_mtime_ns // 1000


def list_folder(spark: SparkSession, root: str, extensions: Sequence[str], exclude: Sequence[str]) -> DataFrame:
    """The entries of one folder, written, so that later reads see the same ones. Without ``extensions`` all files are wanted."""
    out = new_run_dir(spark, "listing")
    list_folders(spark.createDataFrame([("",)], "path string"), root, extensions, exclude).write.parquet(out)
    return spark.read.schema(LISTING).parquet(out)


def list_folders(folders: DataFrame, root: str, extensions: Sequence[str], exclude: Sequence[str]) -> DataFrame:
    """The entries of each folder (``path``, relative to ``root``): folders to go on with and files that are wanted."""
    endings, exclude = tuple(extensions) or "", tuple(exclude)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(root)
        for batch in batches:
            for folder in batch["path"].to_pylist():
                found = folder_entries(system, f"{base}/{folder}" if folder else base)
                rows = (
                    (f"{folder}/{name}" if folder else name, is_dir, size, modified)
                    for name, is_dir, size, modified in found
                    if (is_dir or name.endswith(endings)) and not any(fnmatchcase(name, pattern) for pattern in exclude)
                )
                while held := list(islice(rows, 10_000)):
                    columns = zip(*held, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _LISTING, strict=True)], schema=_LISTING)

    return folders.mapInArrow(entries, LISTING)


def list_tree(spark: SparkSession, root: str, extensions: Sequence[str], exclude: Sequence[str]) -> DataFrame:
    """``path, size, modified`` (microseconds) of every wanted file below ``root``, with paths relative to it. The driver only
    learns whether a level has folders. Links to folders are not followed, so a tree has an end."""
    out = new_run_dir(spark, "listing")
    folders, level = spark.createDataFrame([("",)], "path string"), 0
    while True:
        list_folders(folders, root, extensions, exclude).write.parquet(f"{out}/level={level}")
        found = spark.read.schema(LISTING).parquet(f"{out}/level={level}").where("is_dir")
        if found.isEmpty():
            break
        # Few large folders must not stay together in the task that found them.
        folders, level = found.select("path").repartition(F.xxhash64("path")), level + 1
    return spark.read.schema(LISTING).parquet(*[f"{out}/level={n}" for n in range(level + 1)]).where("NOT is_dir").drop("is_dir")


def read_files(listing: DataFrame, root: str) -> DataFrame:
    """``path, content`` of listed files, read by tasks of about ``TASK_BYTES``. A file that is gone by now is left out."""
    cost = listing.agg(F.coalesce(F.sum(F.col("size") + FILE_COST), F.lit(0))).first()[0]
    parts = max(1, -(-cost // TASK_BYTES))

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(root)
        held, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _FILES, strict=True)], schema=_FILES)

        for listed in batches:
            for path in listed["path"].to_pylist():
                try:
                    with system.open_input_stream(f"{base}/{path}") as source:
                        content = source.read()
                except FileNotFoundError:
                    continue
                if held and size + len(content) > BATCH_BYTES:
                    yield batch()
                    held, size = [], 0
                held.append((path, content))
                size += len(content)
        if held:
            yield batch()

    return listing.select("path").repartition(parts, F.xxhash64("path")).mapInArrow(contents, "path string, content binary")
