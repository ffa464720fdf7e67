"""Document fingerprints of closed syncmers.

A k-mer of the UTF-8 bytes is an anchor if the smallest of its s-mers, by hash, is its first or its last one.
That depends on the k-mer alone, so equal passages have equal anchors wherever they stand, and at least one of
any k - s + 1 neighbouring k-mers is an anchor. A fingerprint is the list of anchors in order: 32-bit hashes,
and the distance of each from the one before (a byte is enough for it).
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.batches import blocks, text_of

K, S = 24, 6
RANGES_PER_PARTITION = 4
_BASE = 0x9E3779B97F4A7C15

FINGERPRINT_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def windows_hash(values: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash of each run of ``size`` values, from hashes of runs of powers of two."""
    n = len(values) - size + 1
    power, length, out, held = values, 1, None, 0
    rest = size
    while True:
        if rest & 1:
            part = power[held : held + n]
            if out is None:
                out = part.copy()
            else:
                out = out * np.uint64(pow(_BASE, length, 1 << 64)) + part
            held += length
        rest >>= 1
        if not rest:
            return out
        power = power[:-length] * np.uint64(pow(_BASE, length, 1 << 64)) + power[length:]
        length *= 2


def scrambled(hashes: np.ndarray) -> np.ndarray:
    hashes = hashes ^ (hashes >> np.uint64(31))
    hashes = hashes * np.uint64(0xBF58476D1CE4E5B9)
    return hashes ^ (hashes >> np.uint64(29))


def sliding_minimum(values: np.ndarray, size: int) -> np.ndarray:
    length, low = 1, values
    while 2 * length <= size:
        low = np.minimum(low[:-length], low[length:])
        length *= 2
    n = len(values) - size + 1
    return np.minimum(low[:n], low[size - length : size - length + n])


def anchors(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the closed syncmers of a text. It is padded with k - 1 zero bytes at both ends, so
    that short texts and the ends of long ones have anchors too; an empty text has none."""
    data = text.encode()
    if not data:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    padded = np.zeros(len(data) + 2 * (k - 1), np.uint64)
    padded[k - 1 : k - 1 + len(data)] = np.frombuffer(data, np.uint8)
    padded += np.uint64(1)
    inner = scrambled(windows_hash(padded, s))
    low = sliding_minimum(inner, k - s + 1)
    at = np.flatnonzero((low == inner[: len(low)]) | (low == inner[k - s :]))
    return (scrambled(windows_hash(padded, k))[at] >> np.uint64(32)).astype(np.uint32), at


def fingerprint(hashes: np.ndarray, at: np.ndarray) -> str:
    gaps = np.diff(at, prepend=0).astype(np.uint8)
    return base64.b64encode(hashes.astype("<u4").tobytes()).decode() + "." + base64.b64encode(gaps.tobytes()).decode()


def anchors_of(print_: str) -> tuple[np.ndarray, np.ndarray]:
    """The anchors that a fingerprint lists."""
    hashes, gaps = (base64.b64decode(part) for part in print_.split("."))
    return np.frombuffer(hashes, "<u4"), np.cumsum(np.frombuffer(gaps, np.uint8), dtype=np.int64)


def matched_positions(one: str, other: str) -> list[tuple[int, int]]:
    """Pairs of positions of anchors that both fingerprints have; the n-th of equal ones matches the n-th."""
    (a, at_a), (b, at_b) = anchors_of(one), anchors_of(other)

    def numbered(hashes: np.ndarray, at: np.ndarray) -> dict[tuple[int, int], int]:
        seen: dict[int, int] = {}
        out = {}
        for value, place in zip(hashes.tolist(), at.tolist()):
            seen[value] = seen.get(value, 0) + 1
            out[value, seen[value]] = place
        return out

    left, right = numbered(a, at_a), numbered(b, at_b)
    return sorted((left[key], right[key]) for key in left.keys() & right.keys())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Twice the number of common anchors, repeated ones as often as both have them, by the number of all. Two
    empty fingerprints are alike."""
    if not len(a) and not len(b):
        return 1.0
    a_values, a_counts = np.unique(a, return_counts=True)
    b_values, b_counts = np.unique(b, return_counts=True)
    _, at_a, at_b = np.intersect1d(a_values, b_values, assume_unique=True, return_indices=True)
    return float(2 * np.minimum(a_counts[at_a], b_counts[at_b]).sum() / (len(a) + len(b)))


def edited_text(text: str, following: str) -> str:
    """The last third of the characters replaced by the first as many, or all, of the following text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def fingerprints(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """One row per document: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``.

    The next document is the one with the next smaller ``doc_id``, after the last the first; equal ids are in the
    order of their texts' hashes, null ids come last. A document alone is its own next one. Null counts as the
    empty text: no anchors, likeness 1 to another empty text and 0 to others. Other columns are ignored; an
    empty table gives no rows.

    Documents are dealt to ranges of this order. The first key of each range is found on ids and hashes alone;
    then each text travels once, and the first text of each range also goes to the range before it.
    """
    spark = docs.sparkSession
    order = ["no_id", "minus_id", "hash"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).select(
        "doc_id",
        "text",
        F.col("doc_id").isNull().cast("long").alias("no_id"),
        F.coalesce(-F.col("doc_id"), F.lit(0)).alias("minus_id"),
        F.xxhash64("text").alias("hash"),
    )

    def first_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.slice(0, 1)
                return

    keys = rows.select(*order)
    # Some ranges for each partition of an exchange, whose number is set by the size of the data; keys are too small to
    # tell it. The driver gets one key per range.
    ranges = RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    heads = [
        tuple(row)
        for row in keys.repartitionByRange(ranges, *order)
        .sortWithinPartitions(*order)
        .mapInArrow(first_key, keys.schema)
        .collect()
    ]
    heads = sorted(set(heads))
    first_of = {head: at for at, head in enumerate(heads)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*(batch.column(name).to_pylist() for name in order)))
            own = [bisect_right(heads, key) - 1 for key in found]
            false = pa.array([False] * len(own), pa.bool_())
            yield batch.append_column("range", pa.array(own, pa.int64())).append_column("guest", false)
            guests = [at for at, key in enumerate(found) if key in first_of]
            if guests:
                sent = batch.take(pa.array(guests))
                before = pa.array([(first_of[found[at]] - 1) % len(heads) for at in guests], pa.int64())
                yield sent.append_column("range", before).append_column("guest", pa.array([True] * len(guests)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [field.split()[0] for field in FINGERPRINT_SCHEMA.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        waiting, current = None, None

        def row(doc_id, text, hashes, at, following, next_hashes) -> tuple:
            other = edited_text(text, following)
            other_hashes, other_at = anchors(other, k, s)
            return (
                doc_id,
                len(text),
                hashlib.sha256(other.encode()).hexdigest(),
                fingerprint(hashes, at),
                fingerprint(other_hashes, other_at),
                likeness(hashes, other_hashes),
                likeness(hashes, next_hashes),
            )

        for batch in batches:
            for block in blocks(batch):
                out = []
                columns = (block.column(name).to_pylist() for name in ("doc_id", "text", "range", "guest"))
                for doc_id, text, where, guest in zip(*columns):
                    if where != current:
                        waiting, current = None, where
                    hashes, at = anchors(text, k, s)
                    if waiting is not None:
                        out.append(row(*waiting, text, hashes))
                    waiting = None if guest else (doc_id, text, hashes, at)
                columns = zip(*out) if out else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    dealt = rows.mapInArrow(deal, "doc_id long, text string, no_id long, minus_id long, hash long, range long, guest boolean")
    inner = dealt.repartition("range").sortWithinPartitions("range", "guest", *order, "text")
    return inner.mapInArrow(compare, FINGERPRINT_SCHEMA)
