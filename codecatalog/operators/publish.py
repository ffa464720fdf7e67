"""Publish manifests of rendered pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecatalog.functions.text import content_type, sha1_hex


def publish_manifest(pages: DataFrame) -> DataFrame:
    """``(path, sha1, content_type, n_bytes)`` of each page."""
    return pages.select(
        F.concat(F.lit("/"), "page_path").alias("path"),
        sha1_hex(F.col("content")).alias("sha1"),
        content_type(F.col("page_path")).alias("content_type"),
        F.octet_length("content").cast("bigint").alias("n_bytes"),
    )


def required_uploads(manifest: DataFrame, required: DataFrame) -> DataFrame:
    """Pages whose hash the remote asks for; pages of equal content are all kept."""
    return manifest.join(required.select("sha1").distinct(), "sha1", "left_semi")


def publish_delta(new: DataFrame, old: DataFrame) -> DataFrame:
    """``upload`` for hashes the old manifest lacks, ``remove`` for paths that are gone."""
    uploads = new.join(old.select("sha1").distinct(), "sha1", "left_anti").select("path", "sha1", F.lit("upload").alias("action"))
    removals = old.join(new.select("path"), "path", "left_anti").select("path", "sha1", F.lit("remove").alias("action"))
    return uploads.unionByName(removals)


def publish_bundle(pages: DataFrame) -> DataFrame:
    """``(file, data)`` as JSON rows; undecodable bytes become the replacement character."""
    return pages.select(
        F.col("page_path").alias("file"),
        F.to_json(
            F.struct(
                F.col("page_path").alias("file"),
                F.make_valid_utf8(F.col("content").cast("string")).alias("data"),
            )
        ).alias("body"),
    )
