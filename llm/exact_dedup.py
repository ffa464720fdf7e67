"""Exact copies by deterministic block naming, with DataFrame functions only.

Texts whose length and 64-bit hash no other text has are unique. All others are cut into blocks of a fixed
number of bytes. The distinct blocks are sorted and numbered, so equal numbers mean equal blocks; then the
numbers of neighbouring blocks are paired, the distinct pairs are sorted and numbered, and so on until each
document has one number. Documents are equal exactly if they end at the same level with the same number: no
hash collision can join different texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.batches import text_of
from llm.tables import written

BLOCK_BYTES = 1024


def numbered(keys: DataFrame, *columns: str) -> DataFrame:
    """Distinct keys, sorted, each with a number of its own (partition and position of a global sort).

    The order is that of a short hash, then of the keys themselves, so that what a range exchange samples to the
    driver doesn't hold whole blocks; keys with equal hashes still get different numbers.
    """
    short = F.xxhash64(*columns)
    distinct = keys.select(*columns).distinct()
    placed = distinct.repartitionByRange(short).sortWithinPartitions(short, *columns)
    return placed.withColumn("number", F.monotonically_increasing_id())


def block_names(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, sha, level, number`` for documents ``doc_id, sha, text``: equal texts have equal level and number."""
    body = F.col("text").cast("binary")
    size = F.octet_length("text")
    blocks = docs.select(
        "doc_id",
        "sha",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.greatest(F.ceil(size / block_bytes).cast("int") - 1, F.lit(0))),
                lambda i: F.substring(body, i * block_bytes + 1, F.lit(block_bytes)),
            )
        ).alias("pos", "block"),
    )
    named = blocks.join(numbered(blocks, "block"), "block").select("doc_id", "sha", "pos", "number")
    level, done = 0, []
    while True:
        named = written(named, "block-names")
        # A document is done when its first block is its only one.
        last = named.groupBy("doc_id", "sha").agg(F.max("pos").alias("last"), F.max("number").alias("number"))
        done.append(last.where("last = 0").select("doc_id", "sha", F.lit(level).alias("level"), "number"))
        if last.where("last > 0").isEmpty():
            break
        pairs = (
            named.groupBy("doc_id", "sha", F.expr("pos div 2").cast("int").alias("pos"))
            .agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("number"))).alias("left"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("number"))), F.lit(-1)).alias("right"),
                F.max("pos").alias("top"),
            )
            .where("top > 0")  # leaves out the documents that are done
        )
        named = pairs.join(numbered(pairs, "left", "right"), ["left", "right"]).select("doc_id", "sha", "pos", "number")
        level += 1
    names = done[0]
    for more in done[1:]:
        names = names.unionByName(more)
    return names


def exact_copies(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Null counts as the empty text. Of equal texts the largest ``doc_id`` stays; of repeated rows (same
    ``doc_id``, same text) one stays. A null ``doc_id`` is smaller than any other. ``group_size`` counts rows.
    Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).select(
        "doc_id",
        "text",
        F.octet_length("text").alias("size"),
        F.xxhash64("text").alias("hash"),
        F.sha2("text", 256).alias("sha"),
    )
    # A row per document and text; copies of a row are counted in n.
    single = rows.groupBy("doc_id", "sha").agg(F.count("*").alias("n"))
    shared = rows.groupBy("size", "hash").agg(F.count("*").alias("rows")).where("rows > 1")
    alike = rows.join(shared, ["size", "hash"], "left_semi").select("doc_id", "sha", "text")
    names = written(block_names(alike, block_bytes), "document-names")
    weighted = names.alias("a").join(single.alias("s"), F.expr("a.doc_id <=> s.doc_id AND a.sha = s.sha"))
    weighted = weighted.select("a.doc_id", "a.sha", "level", "number", "n")
    groups = weighted.groupBy("level", "number").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    found = names.join(groups, ["level", "number"]).select("doc_id", "sha", "keep_id", "group_size")
    result = single.alias("s").join(found.alias("f"), F.expr("s.doc_id <=> f.doc_id AND s.sha = f.sha"), "left")
    keep_id = F.when(F.col("f.sha").isNull(), F.col("s.doc_id")).otherwise(F.col("f.keep_id"))
    return result.select(
        "s.doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("f.group_size", F.lit(1)).cast("long").alias("group_size"),
        F.explode(F.sequence(F.lit(1), F.col("s.n").cast("int"))).alias("copy"),
        F.col("s.sha").alias("text_sha256"),
    ).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        "text_sha256",
    )
