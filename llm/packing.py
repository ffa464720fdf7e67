"""Retrieval packing: documents that share rare words fill the same training window.

1. Texts become token ids once. Whole windows of a long document are pieces at once; only the rest of each
   document (less than a window) is kept with its ids. Document frequencies of token ids are summed over all
   documents; there is one counter per token of the vocabulary, whatever the input.
2. Rests are range-partitioned by their heaviest BM25 term, so that likely neighbours meet. Each run of about
   ``shard_tokens`` tokens in a partition is one shard of the index: bounded memory, and no shard waits for another.
3. In a shard every unused rest in turn seeds a window. The inverted index scores the unused rests against it,
   and they fill the window in the order of their scores; the last one is cut to fit and its tail stays unused.

Windows are full but for the last of each partition, which is cut into windows whose lengths are powers of
two; such windows need no padding.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecatalog.session import new_run_dir
from llm.batches import Cache, blocks, id_and_text
from llm.segments import LETTERS, MARKS, VISIBLE, encoded_in_batches, load_tokenizer, plain_ids

TOKEN_SCHEMA = (
    "doc_id long, doc_tokens long, start long, length long, ids_crc32 long, ids binary, "
    "terms array<int>, counts array<long>"
)
PIECE_SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_tokens long"
)
K1, B = 1.2, 0.75
#: Bytes of text that are encoded together.
ENCODE_BYTES = 8 << 20


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def gathered(flat: np.ndarray, first: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs ``flat[first : first + size]`` of the numbers ``at``, one behind the other."""
    size, first = size[at], first[at]
    shift = first - (np.cumsum(size) - size)
    place = np.repeat(shift, size)
    place += np.arange(len(place))
    return flat[place]


def runs(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids behind one another, and the length of each."""
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum())), size


class Merges:
    """The merges of a byte-level BPE model, applied to many words at a time.

    A word is a row of symbols. In each step every row merges the leftmost of its pairs of the lowest rank; places are
    linked, so that a merge looks up two new pairs and moves nothing.
    """

    NONE = np.iinfo(np.int32).max
    ROWS = 8192

    def __init__(self, tokenizer):
        model = json.loads(tokenizer.to_str())["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        shown = [VISIBLE[byte] for byte in range(256)]
        pairs = [pair if isinstance(pair, list) else pair.split(" ") for pair in model.get("merges", [])]
        #: Models with other rules, or without a symbol for each byte, are left to the library.
        self.usable = (
            model["type"] == "BPE"
            and not any(model.get(rule) for rule in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
            and all(c in vocab and c + suffix in vocab for c in shown)
        )
        if not self.usable:
            return
        self.inner = np.array([vocab[c] for c in shown], np.int32)
        self.last = np.array([vocab[c + suffix] for c in shown], np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs] + [-1], np.int32)
        self.width = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        # The pairs of a left symbol stand together; few symbols begin many.
        self.bits = max(len(pairs), 1).bit_length() + 4
        self.slots = np.full(1 << self.bits, self.NONE, np.int32)
        self.tag = np.full(1 << self.bits, -1, np.int64)
        place = self._slot(self.keys)
        self.slots[place], self.tag[place] = self.ranks, self.keys
        lost = self.tag[place] != self.keys  # met another pair in their slot
        self.shared = np.zeros(1 << self.bits, bool)
        self.shared[place[lost]] = True
        self.keys, self.ranks = np.append(self.keys[lost], np.iinfo(np.int64).max), np.append(self.ranks[lost], self.NONE)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, ``NONE`` where there is no merge; a symbol below 0 has none."""
        keys = left.astype(np.int64) * self.width + right
        keys[(left < 0) | (right < 0)] = -2
        place = self._slot(keys)
        out = np.where(self.tag[place] == keys, self.slots[place], self.NONE)
        if len(other := np.flatnonzero(self.shared[place] & (out == self.NONE))):
            at = np.searchsorted(self.keys, keys[other])
            out[other] = np.where(self.keys[at] == keys[other], self.ranks[at], self.NONE)
        return out

    def __call__(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words ``data[begin : begin + size]`` behind one another, and the number of each."""
        order = np.argsort(size, kind="stable")
        ids, numbers = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for low in range(0, len(order), self.ROWS):
            some = order[low : low + self.ROWS]
            symbols = self._merged(data, begin[some], size[some])
            held = symbols >= 0
            ids.append(symbols[held])
            numbers.append(held.sum(1))
        ids, number = np.concatenate(ids), np.empty(len(size), np.int64)
        sorted_number = np.concatenate(numbers)
        number[order] = sorted_number
        first = np.empty(len(size), np.int64)
        first[order] = np.cumsum(sorted_number) - sorted_number
        return gathered(ids, first, number, np.arange(len(size))).astype(np.uint32), number

    def _merged(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Symbols of words in rows; -1 stands where none is left."""
        n, longest = len(size), int(size.max(initial=0))
        columns, rows = np.arange(longest), np.arange(n)
        # One column more, which holds no symbol, stands for the places behind the end and before the start.
        symbols = np.full((n, longest + 1), -1, np.int32)
        inside = columns < size[:, None]
        symbols[:, :longest][inside] = self.inner[data[(begin[:, None] + columns)[inside]]]
        full = np.flatnonzero(size)
        symbols[full, size[full] - 1] = self.last[data[begin[full] + size[full] - 1]]
        if longest < 2:
            return symbols
        ranks = self._rank(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(n, longest)
        after = np.broadcast_to(np.arange(1, longest + 2, dtype=np.int32), (n, longest + 1)).copy()
        after[:, longest] = longest
        prior = np.broadcast_to(np.arange(-1, longest, dtype=np.int32), (n, longest + 1)).copy()
        prior[:, 0] = longest
        out = symbols.copy()
        while n:
            best = ranks.argmin(1)
            at = np.arange(n)
            rank = ranks[at, best]
            on = rank < self.NONE
            if (left := int(on.sum())) < n:
                out[rows[~on]] = symbols[~on]
                if not left:
                    break
                symbols, ranks, after, prior, rows, best, rank = (v[on] for v in (symbols, ranks, after, prior, rows, best, rank))
                n, at = left, np.arange(left)
            gone = after[at, best]
            behind, ahead = after[at, gone], prior[at, best]
            made = self.made[rank]
            symbols[at, best], symbols[at, gone] = made, -1
            after[at, best], prior[at, behind] = behind, best
            prior[:, longest] = longest
            ranks[at, np.minimum(gone, longest - 1)] = self.NONE
            ranks[at, best] = self._rank(made, symbols[at, behind])
            some = np.flatnonzero(ahead < longest)
            ranks[some, ahead[some]] = self._rank(symbols[some, ahead[some]], made[some])
        return out


@lru_cache(maxsize=2)
def load_merges(path: str) -> Merges:
    """The merges of a tokenizer file, once per Python worker."""
    return Merges(load_tokenizer(path))


class WordEncoder:
    """Ids of whole texts for a tokenizer that drops white space: those of the words between it, in order.

    The different words of a block, and the letters and punctuation that they are made of, are each encoded once; what a
    text holds is then gathered by numbers.
    """

    #: Parts in a block from which merging them together costs less than a call for each, and bytes of one so merged.
    TOGETHER, LONG = 64, 64
    #: Parts that are kept for later blocks, packed; beyond them those of the last block stay.
    KNOWN = 1 << 20

    def __init__(self, path: str):
        self.path, self.tokenizer = path, load_tokenizer(path)
        self.others = Cache()
        self.known = pa.array([], pa.string()), np.empty(0, np.uint32), np.empty(0, np.int64)

    def __call__(self, texts: pa.Array | list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        ids, ends = self.encoded(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        packed = ids.astype("<u4").tobytes()
        return [packed[4 * a : 4 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts behind one another, and where each begins and the last ends."""
        # A split also cuts at the four separators 28 to 31, which tokenizers don't count as white space.
        marked = pc.match_substring_regex(texts, "[\x1c-\x1f]")
        words = pc.utf8_split_whitespace(pc.if_else(marked, "", texts))
        held = words.flatten().dictionary_encode()
        ids, size = self._words(held.dictionary)
        number = held.indices.to_numpy()
        places = np.concatenate(([0], np.cumsum(size[number])))
        offsets = words.offsets.to_numpy()
        ends = places[offsets - offsets[0]]
        ids = gathered(ids, np.cumsum(size) - size, size, number)
        at = np.flatnonzero(marked.to_numpy(zero_copy_only=False))
        if len(at):
            whole, lengths = runs([*encoded_in_batches(self.tokenizer, texts.take(pa.array(at)).to_pylist())])
            size, first = np.diff(ends), ends[:-1].copy()
            size[at], first[at] = lengths, len(ids) + np.cumsum(lengths) - lengths
            ids = gathered(np.concatenate((ids, whole)), first, size, np.arange(len(size)))
            ends = np.concatenate(([0], np.cumsum(size)))
        return ids, ends

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words behind one another, and the number of each."""
        found = pc.extract_regex(words, rf"\A(?P<letters>{LETTERS})(?P<tail>{MARKS})\z")
        plain = found.is_valid().to_numpy(zero_copy_only=False)
        letters, tails = (pc.struct_field(found, name).filter(pa.array(plain)) for name in ("letters", "tail"))
        # Letters and punctuation come with other partners too; an empty part has no ids.
        parts = pa.concat_arrays([pc.utf8_lower(letters), tails]).dictionary_encode()
        ids, size = self._kept_parts(parts.dictionary)
        at, n = parts.indices.to_numpy(), len(letters)
        others = words.filter(pa.array(~plain)).to_pylist()
        self.others.room()
        missing = [word for word in others if word not in self.others]
        self.others.update(zip(missing, encoded_in_batches(self.tokenizer, missing)))
        more, lengths = runs([self.others[word] for word in others])
        # Each word is two pieces; the second of one that isn't plain is empty.
        pieces = np.full((len(words), 2), len(size) + len(others), np.int64)
        pieces[plain, 0], pieces[plain, 1] = at[:n], at[n:]
        pieces[~plain, 0] = len(size) + np.arange(len(others))
        size = np.concatenate((size, lengths, [0]))
        flat = gathered(np.concatenate((ids, more)), np.cumsum(size) - size, size, pieces.ravel())
        return flat, size[pieces].sum(1)

    def _kept_parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``_parts``, which sees only those that earlier blocks didn't have."""
        known, ids, size = self.known
        at = pc.index_in(parts, value_set=known)
        new = parts.filter(at.is_null())
        more, lengths = self._parts(new)
        ids, size = np.concatenate((ids, more)), np.concatenate((size, lengths))
        place = at.fill_null(-1).to_numpy().astype(np.int64)
        place[place < 0] = len(known) + np.arange(len(new))
        flat, number = gathered(ids, np.cumsum(size) - size, size, place), size[place]
        fits = len(known) + len(new) <= self.KNOWN
        self.known = (pa.concat_arrays([known, new]), ids, size) if fits else (parts, flat, number)
        return flat, number

    def _parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different parts behind one another, and the number of each."""
        size = pc.binary_length(parts).to_numpy().astype(np.int64)
        merges = load_merges(self.path) if (size > 0).sum() >= self.TOGETHER else None
        together = size <= self.LONG if merges is not None and merges.usable else np.zeros(len(size), bool)
        together &= size > 0
        alone = np.flatnonzero(~together)
        single = parts.take(pa.array(alone)).to_pylist()
        some, lengths = runs([plain_ids(self.tokenizer, text) if text else [] for text in single])
        if not together.any():
            return some, lengths
        begin = np.frombuffer(parts.buffers()[1], np.int32)[parts.offset :][: len(parts)].astype(np.int64)
        at = np.flatnonzero(together)
        ids, numbers = merges(np.frombuffer(parts.buffers()[2], np.uint8), begin[at], size[at])
        number = np.empty(len(size), np.int64)
        number[at], number[alone] = numbers, lengths
        first = np.empty(len(size), np.int64)
        first[at], first[alone] = np.cumsum(numbers) - numbers, len(ids) + np.cumsum(lengths) - lengths
        return gathered(np.concatenate((ids, some)), first, number, np.arange(len(size))), number


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int, window: int) -> DataFrame:
    """Pieces of whole windows (no ids), one rest per document (with ids), and one row of document frequencies
    per task (``terms``, ``counts``)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = WordEncoder(tokenizer_path), np.asarray([end_id], "<u4").tobytes()
        seen = np.zeros(encoder.tokenizer.get_vocab_size() + 1, np.int64)
        place = np.zeros(len(seen), np.int64)
        names = ["doc_id", "doc_tokens", "start", "length", "ids_crc32", "ids", "terms", "counts"]
        types = [pa.int64()] * 5 + [pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]

        def rows(out: list[tuple]) -> pa.RecordBatch:
            columns = zip(*out) if out else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for batch in batches:
            for block in blocks(batch, limit=ENCODE_BYTES):
                out = []
                for doc_id, packed in zip(block.column("doc_id").to_pylist(), encoder(block.column("text"))):
                    packed += end
                    ids = np.frombuffer(packed, "<u4")
                    at = np.arange(len(ids))
                    place[ids] = at
                    seen[ids[place[ids] == at]] += 1  # each id where it comes last
                    for start in range(0, len(ids) - window + 1, window):
                        crc = zlib.crc32(packed[4 * start : 4 * (start + window)])
                        out.append((doc_id, len(ids), start, window, crc, None, None, None))
                    if rest := len(ids) % window:
                        out.append((doc_id, len(ids), len(ids) - rest, rest, None, packed[-4 * rest :], None, None))
                yield rows(out)
        terms = np.flatnonzero(seen)
        yield rows([(None, None, None, None, None, None, terms, seen[terms])] if len(terms) else [])

    return id_and_text(docs).mapInArrow(encode, TOKEN_SCHEMA)


class Shard:
    """Rests of documents with an inverted index of their BM25 weights."""

    def __init__(self, rows: list[tuple], idf: np.ndarray, mean_length: float):
        self.rows = rows
        self.left = [np.frombuffer(row[3], "<u4") for row in rows]
        self.start = [row[2] for row in rows]
        lengths = np.array([len(ids) for ids in self.left])
        owner = np.repeat(np.arange(len(rows), dtype=np.int64), lengths)
        pairs, counts = np.unique((np.concatenate(self.left).astype(np.int64) << 24) | owner, return_counts=True)
        term, doc = pairs >> 24, pairs & 0xFFFFFF
        kept = idf[term] > 0
        term, doc, counts = term[kept], doc[kept], counts[kept]
        norm = K1 * (1 - B + B * lengths / mean_length)
        self.weight = idf[term] * counts * (K1 + 1) / (counts + norm[doc])
        self.doc = doc
        known, first = np.unique(term, return_index=True)
        self.first, self.size = first, np.diff(np.append(first, len(term)))
        slot = np.searchsorted(known, term)
        order = np.argsort(doc, kind="stable")
        self.slots = np.split(slot[order], np.searchsorted(doc[order], np.arange(1, len(rows))))

    def ranked(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents, best BM25 score for the seed's terms first; equal scores in the order of the rows."""
        slots = self.slots[seed]
        first, size = self.first[slots], self.size[slots]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)
        scores = np.bincount(self.doc[at], self.weight[at], minlength=len(self.rows))
        left = np.flatnonzero(unused)
        return left[np.argsort(-scores[left], kind="stable")]

    def windows(self, size: int) -> Iterator[list[tuple]]:
        """Lists of (row, start, ids). All are full but perhaps the last."""
        unused = np.ones(len(self.rows), bool)
        for seed in range(len(self.rows)):
            while unused[seed]:
                window, room = [], size
                for at in self._order(seed, unused):
                    taken = self.left[at][:room]
                    window.append((self.rows[at], self.start[at], taken))
                    self.left[at], self.start[at] = self.left[at][len(taken) :], self.start[at] + len(taken)
                    unused[at] = len(self.left[at]) > 0
                    room -= len(taken)
                    if not room:
                        break
                yield window

    def _order(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        yield seed
        yield from (at for at in self.ranked(seed, unused) if at != seed)


def powers_of_two(window: list[tuple]) -> Iterator[list[tuple]]:
    """Cut a window that isn't full into windows whose lengths are powers of two, the longest first."""
    held = sum(len(ids) for _, _, ids in window)
    rest = list(window)
    for bit in range(held.bit_length() - 1, -1, -1):
        room = held & (1 << bit)
        part = []
        while room:
            row, start, ids = rest.pop(0)
            part.append((row, start, ids[:room]))
            if len(ids) > room:
                rest.insert(0, (row, start + room, ids[room:]))
            room -= len(part[-1][2])
        if part:
            yield part


def pack(
    docs: DataFrame, tokenizer_path: str, end_id: int = 1, window: int = 2048, shard_tokens: int = 1 << 18
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens``.

    A null or empty text is the end token alone. Repeated rows are packed each for itself, a null ``doc_id``
    stays null, other columns are ignored, and an empty table gives no rows. Sequence ids are unique. The order
    of rows with equal weights is that of ``doc_id`` and text, so results repeat.
    """
    if window & (window - 1) or window > 1 << 20:
        raise ValueError("window must be a power of two")
    spark = docs.sparkSession
    path = new_run_dir(spark, "packing")
    tokenized(docs, tokenizer_path, end_id, window).write.parquet(path)
    table = spark.read.schema(TOKEN_SCHEMA).parquet(path)
    # One row per token of the vocabulary, so what is collected and sent to tasks doesn't grow with the data.
    frequencies = (
        table.where("terms IS NOT NULL")
        .select(F.explode(F.arrays_zip("terms", "counts")).alias("t"))
        .groupBy(F.col("t.terms").alias("term"))
        .agg(F.sum("t.counts").alias("n"))
        .toArrow()
    )
    pieces = table.where("terms IS NULL").drop("terms", "counts")
    n_docs, total = (
        pieces.where(F.col("start") + F.col("length") == F.col("doc_tokens"))
        .agg(F.count("*"), F.sum(F.col("doc_tokens")))
        .first()
    )
    terms, found = frequencies["term"].to_numpy(), frequencies["n"].to_numpy()
    idf = np.zeros(int(terms.max(initial=0)) + 1)
    # The usual BM25 weight; terms of more than half of all documents get none and stay out of the index.
    idf[terms] = np.maximum(np.log((n_docs - found + 0.5) / (found + 0.5)), 0)
    mean_length = min((total or 1) / max(n_docs, 1), window / 2)
    shared = spark.sparkContext.broadcast(idf)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The heaviest term of each rest, the smallest of equals; a whole window goes with its place in the document."""
        weights = shared.value
        counts = np.zeros(len(weights), np.int64)
        for batch in batches:
            heaviest = []
            for ids, start in zip(batch.column("ids").to_pylist(), batch.column("start").to_pylist()):
                if ids is None:
                    heaviest.append(start % len(weights))
                    continue
                terms = np.frombuffer(ids, "<u4")
                np.add.at(counts, terms, 1)
                own = counts[terms]
                found = weights[terms] * own / (own + K1)
                heaviest.append(int(terms[found == found.max()].min()))
                counts[terms] = 0
            yield batch.append_column("route", pa.array(heaviest, pa.int64()))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, number = shared.value, TaskContext.get().partitionId() << 33
        types = [pa.int64()] * 8
        names = [field.split()[0] for field in PIECE_SCHEMA.split(", ")]

        def table_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        def placed(window_pieces: list[tuple]) -> list[tuple]:
            nonlocal number
            offset, rows = 0, []
            total = sum(len(ids) for _, _, ids in window_pieces)
            for (doc_id, doc_tokens, _, _), start, ids in window_pieces:
                rows.append((doc_id, start, len(ids), crc_of(ids), doc_tokens, number, offset, total))
                offset += len(ids)
            number += 1
            return rows

        waiting: list[tuple] = []

        def packed(last: bool) -> pa.RecordBatch:
            """Fill windows with what waits; the one that isn't full goes on to the next shard."""
            rows, rest = [], []
            if waiting:
                for found in Shard(waiting, weights, mean_length).windows(window):
                    if sum(len(ids) for _, _, ids in found) == window:
                        rows += placed(found)
                    else:
                        rest = found
            waiting[:] = []
            if last:
                for part in powers_of_two(rest):
                    rows += placed(part)
            else:
                waiting[:] = [((r[0], r[1], start, ids.tobytes())) for r, start, ids in rest]
            return table_of(rows)

        held = 0
        for batch in batches:
            whole = []
            for row in batch.to_pylist():
                if row["ids"] is None:
                    whole.append((row["doc_id"], row["start"], window, row["ids_crc32"], row["doc_tokens"], number, 0, window))
                    number += 1
                    continue
                waiting.append((row["doc_id"], row["doc_tokens"], row["start"], row["ids"]))
                held += row["length"]
                if held >= shard_tokens:
                    yield packed(False)
                    held = 0
            yield table_of(whole)
        yield packed(True)

    routed = pieces.mapInArrow(route, "doc_id long, doc_tokens long, start long, length long, ids_crc32 long, ids binary, route long")
    # Without the ids themselves: the keys of a range exchange are sampled to the driver.
    order = ["route", F.xxhash64("doc_id", "start"), "doc_id", "start", F.xxhash64("ids")]
    return routed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(fill, PIECE_SCHEMA)
