"""Versioned tables: a snapshot or a log of changes, each version committed after its data is complete.

``root/data/v=N`` holds the rows and ``root/commits/v=N`` is written last, so a reader never sees half
a version and a replayed run overwrites exactly its own one.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codecatalog.sources.tree import is_folder, list_folder, read_files

STATE_SCHEMA = "path string, sha256 string"
#: A state map of more bytes is read in splits.
LARGE_STATE = 1 << 20
#: Names that the file sources skip.
HIDDEN = ("_*", ".*")
_COMPRESSED = r"\.(gz|bz2|lz4|zst|snappy|deflate)$"


def _read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_data(df: DataFrame, root: str, version: int) -> None:
    df.write.mode("overwrite").parquet(f"{root}/data/v={version}")


def commit(spark: SparkSession, root: str, version: int) -> None:
    spark.range(1).select(F.lit(version).cast("bigint").alias("version")).write.mode("overwrite").parquet(
        f"{root}/commits/v={version}"
    )


def current_version(spark: SparkSession, root: str) -> int | None:
    commits = _read_or_none(spark, f"{root}/commits")
    return None if commits is None else commits.agg(F.max("version")).first()[0]


def read_version(spark: SparkSession, root: str, schema: str, version: int | None = None) -> DataFrame:
    """The last committed snapshot, or an empty table."""
    version = current_version(spark, root) if version is None else version
    if version is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/data/v={version}")


def write_state(state: DataFrame, root: str, version: int) -> None:
    write_data(state.select("path", "sha256"), root, version)
    commit(state.sparkSession, root, version)


def read_state(spark: SparkSession, root: str) -> DataFrame:
    return read_version(spark, root, STATE_SCHEMA)


#: A piece of a state map up to the end of a hash: the map's beginning or not, a path, a hash, the map's end or not.
_ENTRY = r'^\s*(\{\s*"hashes"\s*:\s*\{)?\s*"((?:[^"\\]++|\\.)*+)"\s*:\s*"([^"\\]*+)("\s*\}\s*\}\s*)?$'


def read_state_json(spark: SparkSession, path: str) -> DataFrame:
    """Import ``{"hashes": {path: hash}}``; a missing or corrupt file is an empty state.

    A folder is listed and its files are read by tasks, so the driver holds no list of them. Files too large for a row, and
    a path that is no folder, are left to the text source.
    """
    if not is_folder(path):
        return _entries_of_splits(spark, [path])
    listed = list_folder(spark, path, (), HIDDEN).where("NOT is_dir")
    by_spark = (F.col("size") > LARGE_STATE) | F.col("path").rlike(_COMPRESSED)
    # The text source takes some characters for patterns.
    large = [re.sub(r"([{}\[\]*?\\])", r"\\\1", f"{path.rstrip('/')}/{r.path}") for r in listed.where(by_spark).select("path").toLocalIterator()]
    small = _entries_of_files(read_files(listed.where(~by_spark), path))
    return small.unionByName(_entries_of_splits(spark, large)) if large else small


def _entry_columns(piece: Column) -> dict[str, Column]:
    part = lambda n: F.regexp_extract(piece, _ENTRY, n)
    return {
        "fits": piece.rlike(_ENTRY),
        "begins": part(1) != "",
        "ends": part(4) != "",
        "path": F.from_json(F.concat(F.lit('["'), part(2), F.lit('"]')), "array<string>")[0],
        "sha256": part(3),
    }


def _entries_of_files(files: DataFrame) -> DataFrame:
    """Entries of files that are each one value: no shuffle."""
    text = files.select(F.col("content").cast("string").alias("value"))
    # The text source drops a byte order mark, and no piece follows the last separator.
    pieces = F.split(F.regexp_replace(F.regexp_replace("value", r"^\uFEFF", ""), r'",\z', ""), '",')
    cut = text.withColumn("entries", F.transform(pieces, lambda x: F.struct(*(c.alias(n) for n, c in _entry_columns(x).items()))))
    whole = (
        F.forall("entries", lambda e: e["fits"] & e["path"].isNotNull())
        & (F.size(F.filter("entries", lambda e: e["begins"])) == 1)
        & (F.size(F.filter("entries", lambda e: e["ends"])) == 1)
    )
    plain = F.transform("entries", lambda e: F.struct(e["path"].alias("path"), e["sha256"].alias("sha256")))
    return cut.select(F.explode(F.when(whole, plain).otherwise(_odd_entries(F.col("value")))).alias("e")).select("e.path", "e.sha256")


def _odd_entries(value: Column) -> Column:
    """Entries of a file whose pieces don't add up. The parser would take what begins as a map and go no further."""
    entries = F.map_entries(F.from_json(value, "hashes map<string,string>")["hashes"])
    return F.when(value.rlike(r"\}\s*$"), F.transform(entries, lambda e: F.struct(e["key"].alias("path"), e["value"].alias("sha256"))))


def _entries_of_splits(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The text source cuts files into entries, in as many tasks as there are splits. Files whose entries don't add up to one
    map (they are corrupt, empty, or a path holds a quotation mark and a comma) are read whole, each by a task.
    """
    try:
        pieces = spark.read.option("lineSep", '",').text(paths).select("value", F.col("_metadata.file_path").alias("file"))
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STATE_SCHEMA)
    entries = pieces.select("file", *(c.alias(n) for n, c in _entry_columns(F.col("value")).items()))
    files = entries.groupBy("file").agg(
        (F.every("fits") & (F.count_if("begins") == 1) & (F.count_if("ends") == 1) & F.every(F.col("path").isNotNull())).alias("whole")
    )
    plain = entries.join(files.where("whole"), "file", "left_semi").select("path", "sha256")
    rest = spark.read.text(paths, wholetext=True).withColumn("file", F.col("_metadata.file_path")).join(files.where("NOT whole"), "file", "left_semi")
    odd = rest.select(F.explode(_odd_entries(F.col("value"))).alias("e")).select("e.path", "e.sha256")
    return plain.unionByName(odd)


def read_log(spark: SparkSession, root: str, schema: str, last: int | None) -> DataFrame:
    """All rows of a change log up to version ``last``, with their version ``v``."""
    full = f"{schema}, v bigint"
    if last is None:
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(f"{root}/data").where(F.col("v") <= last)
