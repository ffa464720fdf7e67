"""Similarity join on word shingles with a MinHash LSH forest.

Each of ``trees`` tries holds the prefixes of a signature of its own, sorted by prefix. Starting from the longest
prefix, the matched length is shortened until pairs of the threshold's similarity meet in some trie with the
target recall. Texts that share a prefix of that length in any trie are candidates; the shingle sets of each
connected group of candidates then meet, group by group, and every candidate pair is verified exactly.

Texts with equal shingle sets are one class from the start. Groups are cut into tiles of a fixed number of
classes; each pair of tiles is a unit of work of bounded size, and only counts and a spanning forest of the
verified links leave it, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.batches import blocks, text_of
from llm.components import components
from llm.shingles import WORDS, Shingler
from llm.syncmers import scrambled
from llm.tables import written

TREES, LONGEST = 32, 8
#: Classes and shingles of one tile, about.
TILE, TILE_SHINGLES = 512, 1 << 19

SET_SCHEMA = "doc_id long, hash long, class long, check long, n_shingles long, keys array<long>"
FOUND_SCHEMA = "class long, other long, n long"


def matched_length(threshold: float, recall: float, trees: int = TREES, longest: int = LONGEST) -> int:
    """Shorten the matched prefix until a pair of the threshold's similarity is found with the target recall."""
    length = longest
    while length > 1 and 1 - (1 - threshold**length) ** trees < recall:
        length -= 1
    return length


def _multipliers(count: int) -> np.ndarray:
    return np.random.default_rng(6).integers(1, 1 << 63, count, dtype=np.uint64) | np.uint64(1)


def signature(shingles: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """The smallest hash of the set under each hash function."""
    return np.concatenate(
        [
            scrambled(shingles[None, :] * part[:, None]).min(axis=1)
            for part in np.split(multipliers, range(16, len(multipliers), 16))
        ]
    )


def prefix_keys(sig: np.ndarray, trees: int, length: int) -> np.ndarray:
    """One hash per trie of the first ``length`` values of its signature."""
    parts = sig.reshape(trees, -1)[:, :length]
    keys = np.zeros(trees, np.uint64)
    for column in range(length):
        keys = scrambled(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, column] + np.uint64(1))
    return keys


def _hashed(rows: DataFrame, trees: int, longest: int, length: int, words: int) -> DataFrame:
    multipliers = _multipliers(trees * longest)
    names = [field.split()[0] for field in SET_SCHEMA.split(", ")]
    types = [pa.int64()] * 5 + [pa.list_(pa.int64())]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for block in blocks(batch):
                shingler.known.room()
                out = []
                for doc_id, own, text in zip(*(block.column(c).to_pylist() for c in ("doc_id", "hash", "text"))):
                    found = shingler(text)
                    if len(found):
                        # Two sums over the set name it: 128 bits.
                        name = np.array([found.sum(), scrambled(found * np.uint64(3)).sum()], np.uint64).view(np.int64)
                        keys = prefix_keys(signature(found, multipliers), trees, length).view(np.int64)
                        out.append((doc_id, own, int(name[0]), int(name[1]), len(found), keys))
                    else:
                        out.append((doc_id, own, None, None, 0, None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return rows.mapInArrow(sign, SET_SCHEMA)


def _shingled(texts: DataFrame, words: int) -> DataFrame:
    """``node, shingles``: sorted 64-bit hashes as bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for block in blocks(batch):
                shingler.known.room()
                found = [shingler(text).tobytes() for text in block.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([block.column("node"), pa.array(found, pa.binary())], names=["node", "shingles"])

    return texts.mapInArrow(cut, "node long, shingles binary")


def _verified(sides: DataFrame, threshold: float) -> DataFrame:
    """Links inside units of work. ``sides`` has ``unit, cross, part, class, weight, keys, shingles``: a unit compares
    the classes of one tile or, if it is a cross unit, those of part 0 with those of part 1. Returns rows ``class, null, n`` (documents
    linked to the class) and ``class, other, null`` (a spanning forest)."""
    types = [pa.int64()] * 3

    def links(rows: list[dict]) -> pa.RecordBatch:
        rows.sort(key=lambda r: (r["part"], r["class"]))
        sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows]
        sizes = np.array([len(s) for s in sets])
        weight = np.array([r["weight"] for r in rows])
        keys = np.array([r["keys"] for r in rows], np.int64)
        first = sum(r["part"] == 0 for r in rows)
        split = rows[0]["cross"]
        # Incidence lists: for each shingle, the classes that hold it.
        owner = np.repeat(np.arange(len(rows)), sizes)
        order = np.argsort(np.concatenate(sets), kind="stable")
        starts = np.cumsum(sizes) - sizes
        flat = np.concatenate(sets)[order]
        run = np.cumsum(np.concatenate(([False], flat[1:] != flat[:-1])))
        run_start = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
        run_size = np.diff(np.append(run_start, len(flat)))
        sorted_owner = owner[order]
        place = np.empty(len(flat), np.int64)
        place[order] = run
        counts = np.zeros(len(rows), np.int64)
        root = list(range(len(rows)))
        forest = []

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a in range(first if split else len(rows)):
            low = first if split else a + 1
            if low >= len(rows):
                break
            candidate = (keys[low:] == keys[a]).any(axis=1)
            # No pair whose sizes alone rule it out needs its shingles compared.
            smaller, larger = np.minimum(sizes[low:], sizes[a]), np.maximum(sizes[low:], sizes[a])
            candidate &= smaller >= threshold * larger
            if not candidate.any():
                continue
            runs = place[starts[a] : starts[a] + sizes[a]]
            length = run_size[runs]
            ends = np.cumsum(length)
            at = np.arange(ends[-1]) + np.repeat(run_start[runs] - (ends - length), length)
            common = np.bincount(sorted_owner[at], minlength=len(rows))[low:]
            linked = candidate & (common >= threshold * (sizes[a] + sizes[low:] - common) - 1e-9)
            for b in (np.flatnonzero(linked) + low).tolist():
                counts[a] += weight[b]
                counts[b] += weight[a]
                if top(a) != top(b):
                    root[top(b)] = top(a)
                    forest.append((rows[a]["class"], rows[b]["class"], None))
        out = [(row["class"], None, int(n)) for row, n in zip(rows, counts) if n] + forest
        columns = zip(*out) if out else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["class", "other", "n"])

    def run_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["unit"] != unit:
                    if len(held) > 1:
                        yield links(held)
                    unit, held = row["unit"], []
                held.append(row)
        if len(held) > 1:
            yield links(held)

    return sides.repartition("unit").sortWithinPartitions("unit").mapInArrow(run_units, FOUND_SCHEMA)


def join(
    docs: DataFrame, threshold: float = 0.8, recall: float = 0.9999, words: int = WORDS, trees: int = TREES, longest: int = LONGEST
) -> DataFrame:
    """One row per document: ``doc_id, hash, class_id, n_links, set_id``.

    ``n_links`` counts the other documents whose shingle sets have a Jaccard similarity of at least ``threshold``
    with its own, copies included. ``class_id`` is the smallest ``doc_id`` of the documents that links connect, its own
    if it has none. ``set_id`` is equal for equal shingle sets, ``hash`` is the text's. Null counts as empty; a text
    without words has no shingles, no links, and is a class alone. Repeated rows are linked copies. A null ``doc_id`` is
    larger than any other. Other columns are ignored; an empty table gives no rows.
    """
    length = matched_length(threshold, recall, trees, longest)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("hash", F.xxhash64("text"))
    signed = written(_hashed(rows, trees, longest, length, words), "signatures")

    # Classes of equal sets; aggregated before the exchange, so copies don't pile up.
    one = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    classes = (
        signed.where("n_shingles > 0")
        .groupBy("class", "check")
        .agg(F.min(one).alias("first"), F.count("*").alias("weight"), F.first("keys").alias("keys"), F.max("n_shingles").alias("n_shingles"))
        .withColumn("node", F.xxhash64("class", "check"))
    )
    classes = written(classes, "classes")
    # Candidates: every member of a bucket is tied to the bucket's smallest.
    buckets = classes.select("node", F.posexplode("keys").alias("tree", "key"))
    shared = buckets.groupBy("tree", "key").agg(F.min("node").alias("low"), F.count("*").alias("n")).where("n > 1")
    ties = buckets.join(shared.select("tree", "key", "low"), ["tree", "key"]).select(F.col("node").alias("a"), F.col("low").alias("b"))
    groups = written(components(ties.distinct()), "candidate-groups").withColumnRenamed("root", "candidates")

    # Tiles of a bounded number of classes: the group's members are dealt by hash, after their number.
    sized = groups.join(classes.select("node", "n_shingles"), "node")
    counts = (
        sized.groupBy("candidates")
        .agg(F.count("*").alias("size"), F.sum("n_shingles").alias("volume"))
        .where("size > 1")
        .select("candidates", F.ceil(F.greatest(F.col("size") / TILE, F.col("volume") / TILE_SHINGLES)).cast("int").alias("tiles"))
    )
    dealt = (
        groups.join(counts, "candidates")
        .withColumn("tile", F.pmod(F.xxhash64("node", F.lit(1)), F.col("tiles")).cast("int"))
    )
    members = written(
        dealt.join(classes, "node").select("node", "candidates", "tiles", "tile", "weight", "keys", "first"), "members"
    )

    # One text of each class gives the shingles.
    wanted = members.select(F.col("first.doc_id").alias("first_id"), F.col("first.hash").alias("first_hash"), "node")
    texts = rows.join(wanted, F.expr("doc_id <=> first_id AND hash = first_hash")).select("node", "text")
    shingled = _shingled(texts.dropDuplicates(["node"]), words)
    sides = members.join(shingled, "node").withColumn(
        "pair",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.col("tiles") - 1),
                lambda other: F.struct(
                    F.least("tile", other).alias("x"),
                    F.greatest("tile", other).alias("y"),
                    (F.col("tile") > other).cast("int").alias("part"),
                ),
            )
        ),
    )
    sides = sides.select(
        F.xxhash64("candidates", "pair.x", "pair.y").alias("unit"),
        (F.col("pair.x") < F.col("pair.y")).alias("cross"),
        F.col("pair.part").alias("part"),
        F.col("node").alias("class"),
        "weight",
        "keys",
        "shingles",
    )
    found = written(_verified(sides, threshold), "links")
    linked = found.where("n IS NOT NULL").groupBy(F.col("class").alias("node")).agg(F.sum("n").alias("n"))
    roots = components(found.where("n IS NULL").select(F.col("class").alias("a"), F.col("other").alias("b")))
    named = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min(F.struct("first.none", "first.doc_id")).alias("low"))
    named = named.join(smallest, "root").join(linked, "node", "left")
    per_class = named.select(
        "class", "check", "node", F.col("low.doc_id").alias("class_id"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links")
    )
    return signed.join(per_class, ["class", "check"], "left").select(
        "doc_id",
        "hash",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.col("node").alias("set_id"),
    )
