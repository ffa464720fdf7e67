"""Quality scores from random-indexing word vectors and a small network.

Every term (a word, or the shape of a word) has a sparse random index vector, made from its own 64-bit hash. A term's
context vector is the sum of the index vectors of its neighbours over all documents. The table of context vectors is a
DataFrame with a row per term, so it grows with the vocabulary. A document is the mean of its terms' index and context
vectors; texts are dealt into blocks, and each block is joined with the vectors of the terms in it. A network with one
hidden layer turns the mean into a logit, and a temperature fitted on rows that its weights haven't seen turns that
into a probability.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.batches import Cache, blocks, id_and_text, text_of
from llm.labels import class_weights, held_out, sigmoid, training_sample
from llm.tables import written

SIZE, NONZERO = 64, 4
#: Bytes of text whose context vectors a task adds up before it passes them on, and of text that is joined at a time.
SUM_BYTES, JOIN_BYTES = 16 << 20, 32 << 20
#: Terms whose neighbours are added up at a time, and rows of sums in a batch.
SUM_TERMS, SUM_ROWS = 1 << 16, 1 << 14
#: Terms on either side that count as neighbours.
REACH = 2
HIDDEN, EPOCHS, RATE = 24, 60, 0.01
#: Every so many training rows one is kept for the temperature.
CALIBRATION = 5

_UPPER, _LOWER, _DIGIT = re.compile(r"[^\W\d_a-zß-öø-ÿ]+"), re.compile(r"[a-zß-öø-ÿ]+"), re.compile(r"\d+")


def shape_of(word: str) -> str:
    """Runs of capitals, small letters and digits as one sign each; other signs stay, runs of one of them as two."""
    core = word.rstrip(".,;:!?")
    if core.isascii() and core.isalpha() and len(word) - len(core) < 3:  # most words
        tail = word[len(core) :]
        if core.islower():
            return "a" + tail
        if core.isupper():
            return "A" + tail
        if core[0].isupper() and core[1:].islower():
            return "Aa" + tail
    signs = _DIGIT.sub("0", _LOWER.sub("a", _UPPER.sub("A", word)))
    return re.sub(r"(.)\1+", r"\1\1", signs)


class Keys:
    """Keys of the terms of a text: a row of those of its words in small letters, and a row of those of their shapes."""

    def __init__(self) -> None:
        self.known, self.shapes, self.of_shapes = Cache(250_000), Cache(250_000), {}

    def room(self) -> None:
        if len(self.known) > self.known.limit:
            self.known.clear()
            self.shapes.clear()
            self.of_shapes.clear()

    def __call__(self, text: str) -> np.ndarray:
        return self.of_words(text.split())

    def of_words(self, words: list[str] | set[str]) -> np.ndarray:
        known, shapes = self.known, self.shapes
        for word in [word for word in set(words) if word not in known]:
            shape = shape_of(word)
            if (key := self.of_shapes.get(shape)) is None:
                key = self.of_shapes[shape] = self.key("s" + shape)
            known[word], shapes[word] = self.key("w" + word.lower().strip(".,;:!?")), key
        return np.array([np.fromiter(map(part.__getitem__, words), np.int64, len(words)) for part in (known, shapes)])

    @staticmethod
    def key(term: str) -> int:
        return int.from_bytes(blake2b(term.encode(), digest_size=8).digest(), "little", signed=True)


def index_vectors(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of each key's index vector, from different bits of the key."""
    bits = keys.astype(np.uint64)
    places = np.zeros((len(keys), 0), np.int64)
    for i in range(NONZERO):
        place = ((bits >> np.uint64(12 * i)) & np.uint64(0xFFF)).astype(np.int64) % (SIZE - i)
        for taken in np.sort(places, axis=1).T:
            place += place >= taken
        places = np.column_stack([places, place])
    signs = 1 - 2 * ((bits[:, None] >> np.arange(48, 48 + NONZERO, dtype=np.uint64)) & np.uint64(1)).astype(np.int64)
    return places, signs


def encode(rows: np.ndarray) -> pa.Array:
    """Rows of whole numbers in three forms: entries that are not zero in a byte each, place and number together, if all
    numbers are from -2 to 2; else all entries in two bytes each, or in eight. The length tells the form."""
    most = np.abs(rows).max(axis=1, initial=0)
    small, large = most <= 2, most >= 1 << 15
    at, places = np.nonzero(np.where(small[:, None], rows, 0))
    sizes = np.where(small, np.bincount(at, minlength=len(rows)), np.where(large, 8 * SIZE, 2 * SIZE))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    data = np.zeros(ends[-1], np.uint8)
    first = np.searchsorted(at, np.arange(len(rows)))
    numbers = rows[at, places]
    data[ends[at] + np.arange(len(at)) - first[at]] = places | np.where(numbers > 0, numbers - 1, 1 - numbers) << 6
    for form, kind in ((~small & ~large, "<i2"), (large, "<i8")):
        own = np.flatnonzero(form)
        width = SIZE * np.dtype(kind).itemsize
        data[ends[own][:, None] + np.arange(width)] = rows[own].astype(kind).view(np.uint8).reshape(-1, width)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def decode(values: list[bytes], kind: type = np.int64) -> np.ndarray:
    out, sizes = np.zeros((len(values), SIZE), kind), np.array([len(v) for v in values], np.int64)
    small = np.flatnonzero(sizes <= SIZE)
    data = np.frombuffer(b"".join([values[i] for i in small]), np.uint8)
    out[np.repeat(small, sizes[small]), data & 63] = np.array([1, 2, -1, -2], kind)[data >> 6]
    for width, form in ((2, "<i2"), (8, "<i8")):
        own = np.flatnonzero(sizes == width * SIZE)
        out[own] = np.frombuffer(b"".join([values[i] for i in own]), form).reshape(-1, SIZE)
    return out


def context_sums(runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The different keys of some runs of terms, and the sums of their neighbours' index vectors."""
    known, found = np.unique(np.concatenate(runs), return_inverse=True)
    places, signs = index_vectors(known)
    # Places without a term, whose vector is zero, part the runs.
    index = np.zeros((len(known) + 1, SIZE), np.int8)
    np.put_along_axis(index[:-1], places, signs, axis=1)
    lengths = np.array([len(run) for run in runs])
    at = np.full(len(found) + REACH * (len(runs) + 1), len(known), np.int32)
    at[np.arange(len(found)) + REACH * (1 + np.repeat(np.arange(len(runs)), lengths))] = found
    table = np.zeros((len(known) + 1, SIZE), np.int32)
    for start in range(REACH, len(at) - REACH, SUM_TERMS):
        end = min(start + SUM_TERMS, len(at) - REACH)
        near = index.take(at[start - REACH : end + REACH], axis=0)
        sums = np.zeros((end - start, SIZE), np.int8)  # at most 2 * REACH of either sign
        for step in range(2 * REACH + 1):
            if step != REACH:
                sums += near[step : step + end - start]
        own = at[start:end]
        order = np.argsort(own, kind="stable")
        own = own[order]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        table[own[first]] += np.add.reduceat(sums.take(order, axis=0), first, axis=0, dtype=np.int32)
    return known, table[:-1]


def merged(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sums of two tables of ``context_sums``, by key."""
    known = np.union1d(one[0], other[0])
    table = np.zeros((len(known), SIZE), np.int32)
    for keys, rows in (one, other):
        table[np.searchsorted(known, keys)] += rows
    return known, table


VECTORS = "key long, vector binary"


def context_vectors(docs: DataFrame) -> DataFrame:
    """``key, vector``: the context vector of every term of all documents, as whole numbers, so that the order of sums
    doesn't matter. Tasks add up what they can hold; sums of one term meet in one exchange."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, found, held = Keys(), None, 0

        def sums() -> Iterator[pa.RecordBatch]:
            known, table = found
            for at in range(0, len(known), SUM_ROWS):
                part = slice(at, at + SUM_ROWS)
                yield pa.RecordBatch.from_arrays([pa.array(known[part]), encode(table[part])], names=["key", "vector"])

        for batch in batches:
            for block in blocks(batch):
                keys.room()
                texts = block.column("text").to_pylist()
                more = context_sums([run for text in texts for run in keys(text)])
                found = merged(found, more) if found else more
                held += sum(map(len, texts))
                if held >= SUM_BYTES:
                    yield from sums()
                    found, held = None, 0
        if found:
            yield from sums()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by key; the sum of a batch's last key waits for the next batch."""
        last, waiting = np.zeros(0, np.int64), np.zeros((0, SIZE), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.concatenate([last, batch.column("key").to_numpy()])
            rows = np.concatenate([waiting, decode(batch.column("vector").to_pylist())])
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            sums, keys = np.add.reduceat(rows, first, axis=0), keys[first]
            last, waiting = keys[-1:], sums[-1:]
            yield pa.RecordBatch.from_arrays([pa.array(keys[:-1]), encode(sums[:-1])], names=["key", "vector"])
        yield pa.RecordBatch.from_arrays([pa.array(last), encode(waiting)], names=["key", "vector"])

    found = id_and_text(docs).mapInArrow(add, VECTORS).repartition("key").sortWithinPartitions("key")
    return written(found.mapInArrow(total, VECTORS), "vectors")


def pooled_by_key(keys: np.ndarray, known: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Means of index and context vectors over words, then over shapes, and the logarithm of the number of words; zeros
    for a text without words. A term that isn't known has its index vector alone."""
    n, out = keys.shape[1], np.zeros(4 * SIZE + 1, np.float32)
    if not n:
        return out
    for part in (0, 1):
        own, counts = np.unique(keys[part], return_counts=True)
        places, signs = index_vectors(own)
        mean = out[2 * part * SIZE : 2 * (part + 1) * SIZE]
        mean[:SIZE] = np.bincount(places.ravel(), (signs * counts[:, None]).ravel(), SIZE) / n
        at = np.searchsorted(known, own)
        there = at < len(known)
        there[there] = known[at[there]] == own[there]
        mean[SIZE:] = counts[there].astype(np.float32) @ vectors[at[there]] / n
    out[-1] = np.log1p(n)
    return out


def with_pooled(docs: DataFrame, vectors: DataFrame, schema: T.StructType | str, output: Callable[[pa.StructArray, np.ndarray], pa.RecordBatch]) -> DataFrame:
    """Deals the rows of ``docs`` into blocks, joins the different terms of each block with their vectors, and gives
    what ``output`` makes of rows (a batch of ``row``) and their pooled vectors."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_of()))).first()[0] or 0
    n_blocks = max(-(-size // JOIN_BYTES), spark.sparkContext.defaultParallelism)
    number = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), text_of()), F.lit(n_blocks))
    # The texts travel once: the exchange serves both uses.
    dealt = docs.select(F.struct("*").alias("row"), number.alias("block")).repartition("block")

    def texts_of(part: pa.RecordBatch) -> pa.Array:
        return pc.fill_null(pc.struct_field(part.column("row"), "text").cast(pa.string()), "")

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, found, held = Keys(), {}, 0

        def requests() -> Iterator[pa.RecordBatch]:
            for block, words in found.items():
                keys.room()
                own = np.unique(keys.of_words(words))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block)), pa.array(own)], names=["block", "key"])
            found.clear()

        for batch in batches:
            batch = pa.RecordBatch.from_arrays([batch.column("block"), texts_of(batch)], names=["block", "text"])
            for part in blocks(batch):
                for block, text in zip(part.column("block").to_pylist(), part.column("text").to_pylist()):
                    found.setdefault(block, set()).update(text.split())
                    held += len(text)
                if held >= JOIN_BYTES:
                    yield from requests()
                    held = 0
        yield from requests()

    def pool(rows: pa.Table, answers: pa.Table) -> pa.Table:
        known, order = answers["key"].to_numpy(), np.argsort(answers["key"].to_numpy(), kind="stable")
        known, values = known[order], answers["vector"].take(pa.array(order)).combine_chunks()
        keys, out = Keys(), []
        for batch in rows.to_batches():
            batch = pa.RecordBatch.from_arrays([batch.column("row"), texts_of(batch)], names=["row", "text"])
            for part in blocks(batch):
                keys.room()
                terms = [keys(text) for text in part.column("text").to_pylist()]
                # Only the vectors that these texts need are unpacked.
                own = known[np.isin(known, np.concatenate([np.unique(t) for t in terms]))]
                table = decode(values.take(pa.array(np.searchsorted(known, own))).to_pylist(), np.float32)
                table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)
                out.append(output(part.column("row"), np.array([pooled_by_key(t, own, table) for t in terms])))
        return pa.Table.from_batches(out)

    # A task that holds much text asks twice; answers to both requests are the same.
    requests = dealt.mapInArrow(wanted, "block long, key long")
    answers = requests.join(vectors, "key").select("block", "key", "vector")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(pool, schema)


@dataclass
class QualityModel:
    vectors: DataFrame | None
    mean: np.ndarray
    spread: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, float]
    temperature: float

    def logits(self, rows: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((rows - self.mean) / self.spread @ w1 + b1) @ w2 + b2

    def probability(self, rows: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(rows) / self.temperature)


def fit(rows: np.ndarray, y: np.ndarray, vectors: DataFrame) -> QualityModel:
    """Adam on the weighted log loss; then the temperature by golden section on the rows kept for it."""
    rng = np.random.default_rng(9)
    mean, spread = rows.mean(axis=0), rows.std(axis=0) + 1e-3
    x = (rows - mean) / spread
    kept = np.arange(len(y)) % CALIBRATION == 0
    width = x.shape[1]
    parts = [rng.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    weights, learn = class_weights(y), np.flatnonzero(~kept)
    step = 0
    for _ in range(EPOCHS):
        rng.shuffle(learn)
        for start in range(0, len(learn), 256):
            at = learn[start : start + 256]
            hidden = np.tanh(x[at] @ parts[0] + parts[1])
            wrong = weights[at] * (sigmoid(hidden @ parts[2] + parts[3]) - y[at]) / len(at)
            back = np.outer(wrong, parts[2]) * (1 - hidden**2)
            slopes = [x[at].T @ back + 1e-3 * parts[0], back.sum(axis=0), hidden.T @ wrong, np.array([wrong.sum()])]
            step += 1
            for i, slope in enumerate(slopes):
                first[i] = 0.9 * first[i] + 0.1 * slope
                second[i] = 0.999 * second[i] + 0.001 * slope**2
                parts[i] = parts[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    model = QualityModel(vectors, mean, spread, (parts[0], parts[1], parts[2], float(parts[3][0])), 1.0)
    if kept.any():
        logits, target = model.logits(rows[kept]), y[kept]

        def loss(log_t: float) -> float:
            p = np.clip(sigmoid(logits / np.exp(log_t)), 1e-9, 1 - 1e-9)
            return -(target * np.log(p) + (1 - target) * np.log(1 - p)).sum()

        low, high, ratio = -2.0, 3.0, (5**0.5 - 1) / 2
        for _ in range(40):
            a, b = high - ratio * (high - low), low + ratio * (high - low)
            low, high = (low, b) if loss(a) < loss(b) else (a, high)
        model.temperature = float(np.exp((low + high) / 2))
    return model


def train(docs: DataFrame, sample: DataFrame) -> QualityModel:
    """Vectors from all of ``docs``, the network from ``sample`` (``doc_id, text, label``). Without rows of both
    classes every score is that of the class there is, or one half."""
    vectors = context_vectors(docs)

    def output(rows: pa.StructArray, means: np.ndarray) -> pa.RecordBatch:
        packed = pa.array([row.astype("<f4").tobytes() for row in means], pa.binary())
        return pa.RecordBatch.from_arrays([rows.field("doc_id"), rows.field("label"), packed], names=["doc_id", "label", "row"])

    # At most as many rows as the sample has, of 1 kB each.
    found = with_pooled(sample.select("doc_id", "text", "label"), vectors, "doc_id long, label int, row binary", output)
    table = found.toArrow()
    packed, y, ids = table["row"].to_pylist(), table["label"].to_numpy(), table["doc_id"].to_numpy()
    order = sorted(range(len(y)), key=lambda i: (zlib.crc32(str(ids[i]).encode()), ids[i], packed[i]))
    rows = np.frombuffer(b"".join(packed[i] for i in order), "<f4").reshape(len(y), 4 * SIZE + 1).astype(np.float64)
    y = y[order].astype(float)
    if len(set(y.tolist())) < 2:
        width, sure = 4 * SIZE + 1, float(np.sign(y.mean() - 0.5)) * 5 if len(y) else 0.0
        flat = (np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), sure)
        return QualityModel(vectors, np.zeros(width), np.ones(width), flat, 1.0)
    return fit(rows, y, vectors)


def with_score(docs: DataFrame, model: QualityModel, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and a score, which replaces a column of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(replace(model, vectors=None))
    row = docs.select(F.struct("*").alias("row")).schema["row"]

    def output(rows: pa.StructArray, means: np.ndarray) -> pa.RecordBatch:
        scores = pa.array(shared.value.probability(means), pa.float64())
        return pa.RecordBatch.from_arrays([rows, scores], names=["row", "score"])

    rows = with_pooled(docs, model.vectors, T.StructType([row, T.StructField("score", T.DoubleType())]), output)
    kept = [c for c in docs.columns if c != name]
    return rows.select(*(F.col("row").getField(c).alias(c) for c in kept), F.col("score").alias(name))


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``doc_id, score, predicted`` for each document, from its whole text alone.

    Null counts as empty; texts without words get the score of a vector of zeros. Repeated rows give repeated
    results, a null ``doc_id`` stays null, other columns are ignored, an empty table gives no rows.
    """
    scored = with_score(docs.select("doc_id", "text"), model)
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def quality(docs: DataFrame, labels: DataFrame, remainder: int = 1, modulus: int = 3) -> DataFrame:
    """Train on labelled rows that aren't held out, then score all: ``doc_id, held_out, score, predicted``."""
    model = train(docs, training_sample(docs, labels, "quality", remainder, modulus))
    return score(docs, model).select("doc_id", held_out(remainder, modulus).alias("held_out"), "score", "predicted")
