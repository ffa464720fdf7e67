"""Phrase collocations by stripes: each prefix keys an associative counter of the words that follow it.

A pass for each length k of phrases. A task turns blocks of text into stripes ``(lang, prefix of k - 1 words) -> {next
word: count}``, where the empty entry (null) counts the occurrences without a next word that matters; so a stripe's sum is
the count of its prefix. Stripes are merged elementwise. From the merged stripes follow the frequent extensions of each
prefix (the candidates), the counts of prefixes (for the parts of a candidate) and the largest extension of each phrase
(for subsumption).

A phrase is at most as frequent as its parts, so pass k only counts phrases whose two parts of k - 1 words are frequent.
Tasks know these by a Bloom filter of fixed size: what it lets through by mistake is counted in vain and falls to the
least count; nothing frequent is lost, and a filter that is full costs time, not results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.batches import blocks, text_of
from llm.syncmers import scrambled
from llm.tables import written

LONGEST, LEAST = 4, 30
#: A longer phrase takes a shorter one's place if it has this share of its occurrences, in percent.
SUBSUMED = 80
SCALE, TOP = 2_000_000, 2000
#: Text that a task turns into stripes at a time.
BLOCK_BYTES = 4 << 20
#: Entries of a stripe that travel in a row, so that a batch of rows is bounded.
ROW_ENTRIES = 64
#: The stripes of the empty prefix and of common prefixes are dealt to tasks in shards, by next word. A prefix is common that
#: makes up more than one in ``COMMON`` words of the corpus, so there are fewer than that.
SHARDS, COMMON = 256, 1000
#: Bits of a filter; as many, whatever the corpus.
FILTER_BITS = 1 << 25

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 0 for bytes of words, 1 for what parts words, 2 for what parts pieces.
_KINDS = np.zeros(256, np.uint8)
_KINDS[[0x20, 0x09]] = 1
_KINDS[[*b".,;:!?\n\x0b\x0c\r"]] = 2
#: How stripes travel: their words one to a line, the empty entry as an empty line, and the counts as 32-bit numbers.
SENT = "lang string, prefix string, shard int, words string, counts binary"
_KEY = [("lang", pa.string()), ("prefix", pa.string()), ("shard", pa.int32())]
_SENT = pa.schema([*_KEY, ("words", pa.string()), ("counts", pa.binary())])
_STRIPES = pa.schema([*_KEY, ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def extended(prefix_hashes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Hashes of phrases, from those of the prefix (at first of the language) and of the next word."""
    return scrambled(prefix_hashes * np.uint64(0x9E3779B97F4A7C15) + hashes)


class Filter:
    """A Bloom filter with two bits for a phrase."""

    def __init__(self, words: np.ndarray, common: np.ndarray | None = None):
        """``words`` has the bits; ``common`` hashes of those phrases that are common."""
        self.words, self.mask = words, np.uint64(len(words) * 64 - 1)
        self.common = np.zeros(0, np.uint64) if common is None else common

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return hashes & self.mask, (hashes >> np.uint64(32)) & self.mask

    def add(self, hashes: np.ndarray) -> None:
        for place in self.places(hashes):
            np.bitwise_or.at(self.words, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for place in self.places(hashes):
            found &= (self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found


class Block:
    """The words of a run of texts: ``tokens`` numbers (language, word) of each in order, ``piece`` numbers the piece it is in.

    ``data`` are the bytes, a line feed after each text; ``ends`` where texts end. Words from byte ``own`` on are there
    only to follow those before; phrases that start with them belong to the next block.
    """

    def __init__(self, data: np.ndarray, ends: np.ndarray, lang_of: np.ndarray, langs: list[str], own: int | None = None):
        kind = _KINDS[data]
        inside = np.zeros(len(data) + 2, bool)
        np.equal(kind, 0, out=inside[1:-1])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, offsets = edges[::2], np.zeros(len(edges) // 2 + 1, np.int32)
        np.cumsum(edges[1::2] - starts, out=offsets[1:])
        strings = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[inside[1:-1]]]))
        coded = strings.dictionary_encode()
        words, distinct = coded.indices.to_numpy(), len(coded.dictionary)

        def numbered_between(ends: np.ndarray) -> np.ndarray:
            """For each word how many of the ends come before it."""
            places = np.searchsorted(starts, ends)
            return np.repeat(np.arange(len(ends) + 1), np.diff(places, prepend=0, append=len(starts)))

        self.piece = numbered_between(np.flatnonzero(kind == 2)).astype(np.int32)
        self.langs, self.own = langs, len(starts) if own is None else int(np.searchsorted(starts, own))
        # Words are numbered anew by language: those that occur, in the order of (language, word).
        pairs = lang_of[numbered_between(ends)].astype(np.int64) * distinct + words
        occurs = np.zeros(len(langs) * distinct, bool)
        occurs[pairs] = True
        present = np.flatnonzero(occurs)
        numbers = np.cumsum(occurs, dtype=np.int32) - 1
        self.tokens = numbers[pairs].astype(np.int64)
        self.lang, word = np.divmod(present, max(distinct, 1))
        self.words = coded.dictionary.take(pa.array(word))
        self.word_hashes = word_hashes(coded.dictionary.cast(pa.binary()).to_pylist())[word]
        self.hashes = extended(word_hashes([x.encode() for x in langs])[self.lang], self.word_hashes)

    def stripes(self, length: int, filters: list[Filter]) -> pa.RecordBatch:
        """The stripes of all prefixes of ``length - 1`` words that the filters let through."""
        tokens, size = self.tokens, len(self.words)
        if length == 1:
            # The empty prefix: one stripe for each language.
            present, counts = np.unique(tokens[: self.own], return_counts=True)
            return self.batch(self.lang[present], self.lang[present], None, present, counts, np.ones(len(self.langs), bool))
        # grams: number of the phrase that starts at a word, -1 if there is none or one of its parts is rare.
        grams = np.where(filters[0].has(self.hashes)[tokens], tokens, -1)
        texts, hashes, langs = self.words, self.hashes, self.lang
        for step, known in enumerate(filters[1 : length - 1], 1):
            at = np.flatnonzero((grams[:-1] >= 0) & (grams[1:] >= 0) & (self.piece[:-1] == self.piece[1:]))
            at = at[at + step < len(tokens)]
            following = tokens[at + step]
            keys, inverse = np.unique(grams[at] * size + following, return_inverse=True)
            prefix, word = np.divmod(keys, size)
            hashes, langs = extended(hashes[prefix], self.word_hashes[word]), langs[prefix]
            texts = pc.binary_join_element_wise(texts.take(pa.array(prefix)), self.words.take(pa.array(word)), " ")
            grams = np.full(len(tokens), -1)
            grams[at] = np.where(known.has(hashes), np.arange(len(keys)), -1)[inverse]
        at = np.flatnonzero(grams[: self.own] >= 0)
        # Two phrases that overlap in all but a word lie in one piece, except where they overlap in none.
        after = np.minimum(at + 1, len(tokens) - 1)
        follows = (at + length - 1 < len(tokens)) & (grams[after] >= 0) & (self.piece[after] == self.piece[at])
        following = np.where(follows, tokens[np.minimum(at + length - 1, len(tokens) - 1)] + 1, 0)
        keys, counts = np.unique(grams[at] * (size + 1) + following, return_counts=True)
        prefix, word = np.divmod(keys, size + 1)
        return self.batch(langs[prefix], prefix, texts, word - 1, counts, np.isin(hashes, filters[length - 2].common))

    def batch(self, lang: np.ndarray, prefix: np.ndarray, texts, word: np.ndarray, counts: np.ndarray, common: np.ndarray) -> pa.RecordBatch:
        """Entries (prefix, word, count) as one row for each prefix and shard; word -1 is the empty entry."""
        shard = np.where(common[prefix] & (word >= 0), (self.word_hashes[word] % np.uint64(SHARDS)).astype(np.int64), 0)
        order = np.lexsort((shard, prefix))
        lang, prefix, word, counts, shard = (x[order] for x in (lang, prefix, word, counts, shard))
        new = np.ones(len(prefix), bool)
        new[1:] = (prefix[1:] != prefix[:-1]) | (shard[1:] != shard[:-1])
        # A long stripe travels in several rows.
        within = np.arange(len(prefix)) - np.maximum.accumulate(np.where(new, np.arange(len(prefix)), 0))
        first = np.flatnonzero(within % ROW_ENTRIES == 0)
        offsets = np.concatenate([first, [len(prefix)]]).astype(np.int32)
        entries = self.words.take(pa.array(word, mask=word < 0)).fill_null("")
        columns = [
            pa.array(self.langs, pa.string()).take(pa.array(lang[first])),
            pa.array([""], pa.string()).take(pa.array(np.zeros(len(first), np.int64))) if texts is None else texts.take(pa.array(prefix[first])),
            pa.array(shard[first].astype(np.int32)),
            pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), entries), "\n"),
            pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets * 4), pa.py_buffer(counts.astype("<i4"))]),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=_SENT)


def received(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Stripes as they are from rows as they travel."""
    words, sent = pc.split_pattern(batch["words"], "\n"), batch["counts"]
    start, end = (np.frombuffer(sent.buffers()[1], np.int32)[sent.offset + at] for at in (0, len(sent)))
    counts = np.frombuffer(sent.buffers()[2], np.uint8)[start:end].view("<i4").astype(np.int64)
    entries = pc.if_else(pc.equal(words.flatten(), ""), None, words.flatten())
    offsets = pa.array(np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy())]).astype(np.int32))
    columns = [*(batch[name] for name, _ in _KEY), pa.ListArray.from_arrays(offsets, entries), pa.ListArray.from_arrays(offsets, pa.array(counts))]
    return pa.RecordBatch.from_arrays(columns, schema=_STRIPES)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, a line feed after each, and where each ends."""
    ended = pc.binary_join_element_wise(texts, pa.scalar(""), "\n")
    offsets = np.frombuffer(ended.buffers()[1], np.int32)[ended.offset : ended.offset + len(ended) + 1]
    return np.frombuffer(ended.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], (offsets[1:] - offsets[0]).astype(np.int64)


def parts_of(data: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, int]]:
    """A long text in parts that no phrase crosses: cut after the last end of a piece within ``limit`` bytes. A piece longer
    than that is cut between words, each part with the next words after it; the number is where those start."""
    start = 0
    while len(data) - start > limit:
        ends = np.flatnonzero(_KINDS[data[start : start + limit]] == 2)
        if len(ends):
            cut = start + int(ends[-1]) + 1
            yield data[start:cut], cut - start
            start = cut
            continue
        look = 4096
        while True:  # up to the end of the word at the cut, and then of LONGEST - 1 words or of the piece
            kind = _KINDS[data[start + limit : start + limit + look]]
            parts = np.flatnonzero(kind > 0)
            whole = start + limit + look >= len(data)
            if len(parts):
                cut = int(parts[0])
                inside = np.concatenate([[False], kind[cut:] == 0, [False]])
                over = np.flatnonzero(inside[:-1] & ~inside[1:])[: LONGEST - 1]
                piece = np.flatnonzero(kind[cut:] == 2)
                if whole or len(piece) or len(over) == LONGEST - 1 and cut + over[-1] < len(kind):
                    break
            elif whole:
                cut = len(kind)
                break
            look *= 4
        yield data[start : start + limit + len(kind)], limit + cut
        start += limit + cut
    yield data[start:], len(data) - start


def text_blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[Block]:
    """Blocks of about ``limit`` bytes from batches ``lang, text``; a longer text is cut."""

    def block(parts: list[pa.RecordBatch]) -> Block:
        table = pa.Table.from_batches(parts).combine_chunks()
        langs = table["lang"].combine_chunks().dictionary_encode()
        data, ends = bytes_of(table["text"].combine_chunks())
        return Block(data, ends, langs.indices.to_numpy(), langs.dictionary.to_pylist())

    held, size = [], 0
    for batch in batches:
        for part in blocks(batch, "text", limit):
            part_size = pc.sum(pc.binary_length(part["text"])).as_py() or 0
            if part_size > limit:
                data, _ = bytes_of(part["text"])
                for piece, own in parts_of(data, limit):
                    yield Block(piece, np.array([len(piece)]), np.zeros(2, np.int64), part["lang"].to_pylist(), own)
                continue
            if held and size + part_size > limit:
                yield block(held)
                held, size = [], 0
            held.append(part)
            size += part_size
    if held:
        yield block(held)


def stripes_of(texts: DataFrame, length: int, filters: list, block_bytes: int) -> DataFrame:
    """Merged stripes of prefixes of ``length - 1`` words: ``lang, prefix, shard, total, words, counts``. ``total`` sums the
    stripe; ``words`` and ``counts`` are its entries of ``LEAST`` and more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Filter(*(np.frombuffer(part, np.uint64) for part in f.value)) for f in filters]
        for block in text_blocks(batches, block_bytes):
            if len(block.words):
                stripes = block.stripes(length, known)
                for at in range(0, stripes.num_rows, 20_000):
                    yield stripes.slice(at, 20_000)
                del stripes
                pa.default_memory_pool().release_unused()

    # The order is that of a hash, which sorts fast; equal keys still are neighbours.
    key = ["lang", "prefix", "shard"]
    dealt = texts.mapInArrow(count, SENT).repartition(*key).sortWithinPartitions(F.xxhash64(*key), *key)
    return written(dealt.mapInArrow(merged, MERGED), f"stripes-{length}")


MERGED = "lang string, prefix string, shard int, total long, words array<string>, counts array<long>"
_MERGED = pa.schema([*_KEY, ("total", pa.int64()), *list(_STRIPES)[3:]])


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stripes that follow one another with the same key, merged elementwise. Of the sum stays every entry of ``LEAST`` and more."""
    held = None
    for batch in batches:
        if batch.num_rows:
            batch = received(batch)
            done, held = merge(batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0])
            yield kept_of(done)
    if held is not None:
        yield kept_of(held)


def merge(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """The merged stripes of a batch, and apart from them the last, which may go on in the next batch."""
    new = np.ones(batch.num_rows, bool)
    for name in ("lang", "prefix", "shard"):
        column = batch[name]
        changed = pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        new[1:] = changed if name == "lang" else new[1:] | changed
    group = np.cumsum(new) - 1
    lists, counts = batch["words"], batch["counts"].flatten().to_numpy()
    coded = lists.flatten().dictionary_encode()
    size = len(coded.dictionary) + 1
    codes = coded.indices.fill_null(size - 1).to_numpy()
    keys = np.repeat(group, lists.value_lengths().to_numpy()) * size + codes
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sums = np.add.reduceat(counts[order], first) if len(first) else counts
    of, word = np.divmod(keys[first], size)
    words = coded.dictionary.take(pa.array(word, mask=word == size - 1))
    rows, ends = np.flatnonzero(new), np.searchsorted(of, np.arange(group[-1] + 2))
    columns = [batch[name].take(pa.array(rows)) for name in ("lang", "prefix", "shard")]
    offsets = pa.array(ends.astype(np.int32))
    columns += [pa.ListArray.from_arrays(offsets, words), pa.ListArray.from_arrays(offsets, pa.array(sums.astype(np.int64)))]
    out = pa.RecordBatch.from_arrays(columns, schema=_STRIPES)
    return out.slice(0, out.num_rows - 1), out.slice(out.num_rows - 1)


def kept_of(stripes: pa.RecordBatch) -> pa.RecordBatch:
    """``lang, prefix, shard, total, words, counts``: ``total`` sums the stripe, its entries are the frequent ones."""
    counts = stripes["counts"].flatten().to_numpy()
    sizes = stripes["counts"].value_lengths().to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    sums = np.concatenate([[0], np.cumsum(counts)])
    words = stripes["words"].flatten()
    kept = np.flatnonzero((counts >= LEAST) & words.is_valid().to_numpy(zero_copy_only=False))
    offsets = pa.array(np.searchsorted(row[kept], np.arange(len(sizes) + 1)).astype(np.int32))
    columns = [stripes[name] for name in ("lang", "prefix", "shard")] + [
        pa.array((sums[ends[1:]] - sums[ends[:-1]]).astype(np.int64)),
        pa.ListArray.from_arrays(offsets, words.take(pa.array(kept))),
        pa.ListArray.from_arrays(offsets, pa.array(counts[kept].astype(np.int64))),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_MERGED)


def extensions(stripes: DataFrame, length: int) -> DataFrame:
    """Frequent phrases of a table of stripes: ``lang, phrase, size, a``."""
    each = stripes.select("lang", "prefix", F.explode(F.arrays_zip("words", "counts")).alias("e"))
    phrase = F.when(F.col("prefix") == "", F.col("e.words")).otherwise(F.concat_ws(" ", "prefix", "e.words"))
    return each.select("lang", phrase.alias("phrase"), F.lit(length).alias("size"), F.col("e.counts").alias("a"))


def hashes_of(langs: list[str], phrases: list[str]) -> np.ndarray:
    """Hashes of phrases of one length."""
    rows = [phrase.split(" ") for phrase in phrases]
    hashes = word_hashes([lang.encode() for lang in langs])
    for n in range(len(rows[0]) if rows else 0):
        hashes = extended(hashes, word_hashes([row[n].encode() for row in rows]))
    return hashes


def filter_of(phrases: DataFrame, total: int, bits: int):
    """A broadcast Bloom filter of the phrases: ``bits`` bits, made from one row at most for each 64 of them, and the hashes
    of those that make up more than one in ``COMMON`` of ``total`` words."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filter(np.zeros(bits // 64, np.uint64))
        for batch in batches:
            own.add(hashes_of(batch["lang"].to_pylist(), batch["phrase"].to_pylist()))
        at = np.flatnonzero(own.words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own.words[at].view(np.int64))], ["place", "bits"])

    parts = phrases.select("lang", "phrase").mapInArrow(fill, "place long, bits long")
    found = parts.groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[found["place"].to_numpy()] = found["bits"].to_numpy()
    common = phrases.where(F.col("a") > total // COMMON).select("lang", "phrase").toArrow()
    hashes = hashes_of(common["lang"].to_pylist(), common["phrase"].to_pylist())
    return phrases.sparkSession.sparkContext.broadcast((words.tobytes(), hashes.tobytes()))


def collocations(docs: DataFrame, block_bytes: int = BLOCK_BYTES, filter_bits: int = FILTER_BITS) -> DataFrame:
    """All candidates of ``docs(text, lang)``: ``lang, phrase, size, a, k, l, r, n, score, longest``.

    Words are what spaces and tabs part within pieces, pieces what ``.,;:!?`` and line ends part; A-Z are made small. A
    candidate has 2 to 4 words and ``a`` >= 30 occurrences in its language, all of which count. Its lowest-scoring cut
    (after ``k`` words, the first of equal ones) gives ``l`` and ``r``, the counts of its parts, and ``score`` = floor(2000000
    a / (l + r)); ``n`` counts the words of the language; ``longest`` is the largest count of a candidate that has one word
    more at either end (0 if there is none). A candidate within a longer one with that count also lies in one with one word more,
    which has at least that count.

    A null text is empty, a null language ``und``. Repeated rows count again. Other columns are ignored; an empty table
    gives no rows.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of().alias("text"))
    tables, phrases, filters = [], [], []
    for length in range(1, LONGEST + 1):
        tables.append(stripes_of(texts, length, filters, block_bytes))
        phrases.append(extensions(tables[-1], length))
        if length < LONGEST:
            total = tables[0].agg(F.sum("total")).first()[0] or 0
            filters.append(filter_of(phrases[-1], total, filter_bits))
    candidates, prefixes, longer = phrases[1], tables[1], []
    for length in range(2, LONGEST):
        candidates, prefixes = candidates.unionByName(phrases[length]), prefixes.unionByName(tables[length])
        right = tables[length].select("lang", F.col("prefix").alias("phrase"), F.array_max("counts").alias("a"))
        left = phrases[length].select("lang", F.expr("substring(phrase, instr(phrase, ' ') + 1)").alias("phrase"), "a")
        longer += [right.where("a IS NOT NULL"), left]
    totals = prefixes.groupBy("lang", "prefix").agg(F.sum("total").alias("total"))
    maxima = longer[0]
    for more in longer[1:]:
        maxima = maxima.unionByName(more)
    maxima = maxima.groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    words = tables[0].groupBy("lang").agg(F.sum("total").alias("n"))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)"))
    cuts = cuts.withColumn("rest", F.expr("substring(phrase, char_length(first) + 2)"))
    first = totals.select("lang", F.col("prefix").alias("first"), F.col("total").alias("l"))
    rest = totals.select("lang", F.col("prefix").alias("rest"), F.col("total").alias("r"))
    score = F.expr(f"(CAST({SCALE} AS DECIMAL(8, 0)) * CAST(a AS DECIMAL(20, 0))) div (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))")
    scored = cuts.join(first, ["lang", "first"]).join(rest, ["lang", "rest"]).withColumn("score", score)
    best = scored.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    joined = best.join(maxima, ["lang", "phrase"], "left").join(words, "lang")
    return joined.select("lang", "phrase", "size", "a", "cut.k", "cut.l", "cut.r", "n", "cut.score", F.coalesce("longest", F.lit(0).cast("long")).alias("longest"))


def top_phrases(found: DataFrame, top: int = TOP) -> DataFrame:
    """Of the candidates that no longer one subsumes each language's first ``top``, by score, count (both descending) and phrase:
    ``lang, rank, phrase, a, l, r, n, score``. A language is ranked in parts first, so that none is one task's."""
    small = found.where(F.expr(f"100 * CAST(longest AS DECIMAL(20, 0)) < {SUBSUMED} * CAST(a AS DECIMAL(20, 0))"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    parts = small.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    ranked = parts.where(F.col("rank") <= top).withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
