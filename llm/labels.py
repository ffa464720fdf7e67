"""Labelled rows for the classifiers, and what their training shares."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.batches import text_of

#: Labelled rows that a model is fitted on, at most. All other statistics cover all rows.
TRAIN_ROWS = 20_000


def held_out(remainder: int, modulus: int) -> Column:
    """Rows that training never sees: by the CRC-32 of the id as text. A null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, remainder: int, modulus: int, rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, text, label`` of labelled rows that aren't held out: all, or as many as ``rows`` with the smallest hash.

    The hash spreads the choice over all ids, and the bound is on labels alone, so the sample needs no sort of texts.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where("doc_id IS NOT NULL AND label IS NOT NULL")
        .where(~held_out(remainder, modulus))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    # The chosen side has at most ``rows`` rows of two numbers.
    return texts.join(F.broadcast(chosen), "doc_id")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def class_weights(y: np.ndarray) -> np.ndarray:
    """Weights that give both classes the same sum; ones if a class is missing."""
    positive = y.mean() if len(y) else 0
    return np.ones(len(y)) if positive in (0, 1) else np.where(y == 1, 0.5 / positive, 0.5 / (1 - positive))
