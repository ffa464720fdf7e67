"""Snapshots of a corpus by content hash: what changed, and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_diff(
    current: DataFrame, state: DataFrame, key: str = "path", hash: str = "sha256"
) -> DataFrame:
    """``(key, status)`` with status added, modified, unchanged or deleted.

    Only key and hash travel through the join.
    """
    new = current.select(key, F.col(hash).alias("new_hash"))
    old = state.select(key, F.col(hash).alias("old_hash"))
    status = (
        F.when(F.col("new_hash").isNull(), "deleted")
        .when(F.col("old_hash").isNull(), "added")
        .when(F.col("new_hash") == F.col("old_hash"), "unchanged")
        .otherwise("modified")
    )
    return new.join(old, key, "full_outer").select(key, status.alias("status"))


def changed_files(files: DataFrame, diff: DataFrame) -> DataFrame:
    return files.join(diff.where("status IN ('added','modified')"), "path", "left_semi")


def deleted_files(current: DataFrame, state: DataFrame) -> DataFrame:
    return state.join(current.select("path"), "path", "left_anti")


def touched_paths(diff: DataFrame) -> DataFrame:
    return diff.where("status <> 'unchanged'").select("path")


def merge_catalog(old: DataFrame, new: DataFrame, diff: DataFrame) -> DataFrame:
    """Drop the rows of touched files and add the re-extracted ones."""
    return old.join(touched_paths(diff), "path", "left_anti").unionByName(new)


def next_state(files: DataFrame) -> DataFrame:
    return files.select("path", "sha256")


def update_state(state: DataFrame, files: DataFrame, diff: DataFrame) -> DataFrame:
    """State after a run that saw only the touched files: removed and replaced rows out, new rows in."""
    kept = state.join(touched_paths(diff), "path", "left_anti").select("path", "sha256")
    return kept.unionByName(next_state(changed_files(files, diff)))


def file_status_counts(diff: DataFrame) -> DataFrame:
    def n(*status: str):
        return F.count_if(F.col("status").isin(*status))

    return diff.agg(
        F.count("*").alias("files_scanned"),
        n("added", "modified").alias("files_changed"),
        n("unchanged").alias("files_unchanged"),
        n("deleted").alias("files_deleted"),
    )


def latest_change(changes: DataFrame, by: str = "ts", tie: str | None = None) -> DataFrame:
    """The last change of each path. Maxima combine before the shuffle, so a hot path is one row per task."""
    order = F.struct(by, tie) if tie else F.struct(by)
    return changes.groupBy("path").agg(
        F.max_by(F.struct("change", by), order).alias("last")
    ).select("path", "last.change", F.col(f"last.{by}").alias(by))
