"""A pipeline over ``documents``: low quality goes, copies go, near copies go, repeated passages go, the rest is packed.

Each stage works on all rows that the one before it kept, and is written as Parquet and read again for the next.
All but the last return the columns of ``documents``, other columns of the input included.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import exact_dedup, jaccard, packing, quality, suffix_dedup
from llm.batches import text_of
from llm.labels import training_sample
from llm.queries import tokenizer_file
from llm.registry import query
from llm.tables import written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose quality score is below one half. The network learns from the labelled rows that are
    not held out, among those that reach the stage; word vectors cover all of them."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, training_sample(docs, labels, "quality", 1, 3))
    name = "score" + "_" * max((len(c) for c in docs.columns), default=0)  # longer than any column's name
    return quality.with_score(docs, model, name).where(F.col(name) >= 0.5).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of equal texts, that with the largest ``doc_id``."""
    kept = exact_dedup.exact_copies(docs).where("kept").select(F.col("doc_id").alias("kept_id"), "text_sha256")
    return one_of_each(docs, kept, F.sha2(text_of(), 256), "text_sha256")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of each group of linked near copies, that with the smallest ``doc_id``. Documents without an id stay."""
    found = jaccard.join(docs)
    kept = found.where("doc_id IS NULL OR doc_id = class_id").groupBy("doc_id", "hash").agg(F.count("*").alias("n"))
    return one_of_each(docs, kept.select(F.col("doc_id").alias("kept_id"), F.col("hash").alias("kept_hash")), F.xxhash64(text_of()), "kept_hash")


def one_of_each(docs: DataFrame, kept: DataFrame, name: Column, key: str) -> DataFrame:
    """The rows of ``docs`` with the id and text name of a row of ``kept``; of repeated rows one.

    The join and the grouping have the same plain keys, so whole rows travel once.
    """
    own_id, kept_id = F.col("doc_id").cast("long"), F.col("kept_id")
    rows = docs.select(
        F.struct("*").alias("row"), F.coalesce(own_id, F.lit(0)).alias("id"), own_id.isNull().alias("none"), name.alias("name")
    )
    wanted = kept.select(F.coalesce(kept_id, F.lit(0)).alias("id"), kept_id.isNull().alias("none"), F.col(key).alias("name"))
    keys = ["id", "none", "name"]
    return rows.join(wanted, keys, "left_semi").groupBy(*keys).agg(F.first("row").alias("row")).select("row.*")


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 100 bytes and more that stood earlier out of the texts; characters stay whole. Every document
    stays, with what is left of its text, and ``n_chars`` counts that."""
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    done = suffix_dedup.without_repeats(docs, others)
    columns = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return done.select(*(columns[c].alias(c) if c in columns else F.col("carried").getField(c).alias(c) for c in docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 2048 tokens."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("suffix_dedup", suffix_stage),
    ("packing", packing_stage),
]

#: The first stage is a trained network, which SQL can't express; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
