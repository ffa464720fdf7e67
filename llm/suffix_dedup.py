"""Removal of repeated byte strings by suffix arrays of a difference cover, distributed by content.

1. Every window of ``length`` bytes names an anchor: the leftmost of its 20-byte strings with the smallest hash.
   Equal windows have equal anchors at the same place, so neighbouring windows with one anchor form a span, and
   spans of different anchors share no window. Spans travel as hashes and places, without text.
2. Spans with the same windows as an earlier span are repeats as a whole. An anchor with a single span has no
   repeats. Only what is left, different spans of one anchor, needs its bytes.
3. These spans meet anchor by anchor. Whole anchors are put together to texts of bounded size; their suffixes are
   sorted by a difference cover (sampled triples, recursion on names, the rest merged), and neighbours in
   that order whose first ``length`` bytes agree are repeats.
4. An anchor with more different spans than one suffix array takes (``HOT``) has its windows counted by DataFrame
   aggregation over 128-bit hashes instead: no group is ever gathered whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.batches import blocks, text_of
from llm.difference_cover import repeated_windows
from llm.syncmers import scrambled, sliding_minimum, windows_hash
from llm.tables import written

LENGTH, ANCHOR = 100, 20
#: Bytes of one suffix array, and spans of one anchor that go into it.
ARRAY_BYTES, HOT = 3 << 19, 8192
#: Bytes of text whose windows are hashed together, few enough for a processor's cache; places in it must fit 24 bits.
HASH_BYTES = 1 << 17

#: A document: its id or 0, whether that is null, and the hash of its text.
KEY = ["id", "no_id", "hash"]
SPAN_SCHEMA = "anchor long, span long, id long, no_id int, hash long, start int, windows int, done boolean"
FOUND_SCHEMA = "anchor long, id long, no_id int, hash long, start int, windows int, kind int"
REPEAT, UNSURE, CROWDED = 0, 1, 2
BYTES_SCHEMA = "anchor long, other long, id long, no_id int, hash long, start int, windows int, bytes binary"
RANGE_SCHEMA = "id long, no_id int, hash long, start int, windows int"


def spans_of(texts: list[bytes], length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Text number, start, number of windows, anchor hash and hash of the windows of each span of some texts."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    if len(data) < length:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    values = scrambled(data.astype(np.uint64) + np.uint64(1))
    hashes = scrambled(windows_hash(values, anchor))
    whole = windows_hash(values, length)
    # The upper 40 bits choose the anchor, the place makes the leftmost win.
    ranked = (hashes & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(hashes), dtype=np.uint64)
    place = sliding_minimum(ranked, length - anchor + 1) & np.uint64(0xFFFFFF)
    owner = np.repeat(np.arange(len(texts)), sizes)
    ends = np.cumsum(sizes)
    valid = np.arange(len(place)) + length <= ends[owner[: len(place)]]
    change = np.concatenate(([True], (place[1:] != place[:-1]) | (valid[1:] != valid[:-1]) | (owner[1 : len(place)] != owner[: len(place) - 1])))
    first = np.flatnonzero(change)
    windows = np.diff(np.append(first, len(place)))
    sums = np.concatenate(([np.uint64(0)], np.cumsum(scrambled(whole))))
    names = sums[first + windows] - sums[first]
    kept = valid[first]
    first, windows, names = first[kept], windows[kept], names[kept]
    text = owner[first]
    return text, first - (ends - sizes)[text], windows, hashes[place[first]], names


def _spans(rows: DataFrame, length: int, anchor: int) -> DataFrame:
    """Spans of all documents. Within a batch the later ones of equal spans are marked as done: they are repeats
    whatever else is found, and are dealt out evenly instead of to their anchor."""
    names = [field.split()[0] for field in SPAN_SCHEMA.split(", ")]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for block in blocks(batch, limit=HASH_BYTES):
                texts = [t.encode() for t in block.column("text").to_pylist()]
                keys = [block.column(c).to_numpy() for c in KEY]
                # A text that alone is longer is hashed in pieces that overlap by less than a window.
                pieces, where = [], []
                for at, text in enumerate(texts):
                    for start in range(0, max(len(text) - length + 1, 1), HASH_BYTES * 8):
                        pieces.append(text[start : start + HASH_BYTES * 8 + length - 1])
                        where.append((at, start))
                at, offset = np.array(where, np.int64).reshape(-1, 2).T
                # More than one call only for a single text in several pieces.
                step = len(pieces) if len(texts) > 1 else 1
                for low in range(0, len(pieces), step):
                    text, start, windows, anchors, spans = spans_of(pieces[low : low + step], length, anchor)
                    own = at[low + text]
                    parts.append(
                        (anchors.view(np.int64), spans.view(np.int64), *(k[own] for k in keys), start + offset[low + text], windows)
                    )
            if not parts:
                continue
            anchors, spans, ids, no_ids, hashes, start, windows = (np.concatenate(c) for c in zip(*parts))
            # Most anchors have one span here, which needs no place among others.
            order = np.argsort(anchors)
            tied = anchors[order][1:] == anchors[order][:-1]
            some = order[np.concatenate((tied, [False])) | np.concatenate(([False], tied))]
            order = some[np.lexsort((start[some], hashes[some], ids[some], no_ids[some], spans[some], anchors[some]))]
            again = (anchors[order][1:] == anchors[order][:-1]) & (spans[order][1:] == spans[order][:-1])
            same = again & (ids[order][1:] == ids[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
            same &= (no_ids[order][1:] == no_ids[order][:-1]) & (start[order][1:] == start[order][:-1])
            done = np.zeros(len(anchors), bool)
            done[order[1:]] = again
            kept = np.ones(len(anchors), bool)
            kept[order[1:]] = ~same  # repeated rows
            anchors = np.where(done, hashes ^ (start * 0x9E3779B1), anchors)
            columns = [anchors, spans, ids, no_ids, hashes, start, windows, done]
            types = [pa.int64()] * 3 + [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c[kept], t) for c, t in zip(columns, types)], names=names)

    return rows.mapInArrow(find, SPAN_SCHEMA)


def _sorted_out(spans: DataFrame, hot: int) -> DataFrame:
    """Repeated spans, and those that need their bytes. Spans come sorted, anchor by anchor; a group is followed
    across batches, and at most ``hot`` spans of it are held back."""
    names = [field.split()[0] for field in FOUND_SCHEMA.split(", ")]
    order = ["anchor", "done", "span", "no_id", "id", "hash", "start"]

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        held: list[np.ndarray] | None = None
        crowded = False  # the group that is held back has given spans away as crowded before

        def out(c: list[np.ndarray], rows: np.ndarray, kinds: np.ndarray) -> pa.RecordBatch:
            columns = [c[0], c[2], c[3], c[4], c[5], c[6]]
            return pa.RecordBatch.from_arrays(
                [pa.array(v[rows], t) for v, t in zip(columns, types)] + [pa.array(kinds[rows].astype(np.int32))], names=names
            )

        def sort_out(c: list[np.ndarray], last: bool) -> tuple[pa.RecordBatch, list[np.ndarray] | None]:
            nonlocal crowded
            anchor, span, ids, no_ids, hashes, start, _, done = c
            n = len(anchor)
            group = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (done[1:] != done[:-1])))
            again = ~group
            again[1:] &= span[1:] == span[:-1]
            same = again.copy()
            for v in (ids, no_ids, hashes, start):
                same[1:] &= v[1:] == v[:-1]
            heads = np.flatnonzero(group)
            end = n if last else heads[-1]
            number = np.cumsum(group) - 1
            different = np.bincount(number, ~again)
            kinds = np.where(again | done, REPEAT, np.where(different[number] > hot, CROWDED, UNSURE))
            lone = ~again & ~done & (different[number] == 1)
            if crowded and len(heads):
                mine = number == 0
                kinds[mine & ~again & ~done] = CROWDED
                lone &= ~mine
            send = ~same & ~lone
            if not last and different[-1] > hot:
                # The last group is too large to wait for: its spans go now; the last one stays to compare with.
                crowded, end = True, n - 1
            elif end:
                crowded = False
            rows = np.flatnonzero(send[:end])
            rest = [v[end:] for v in c] if end < n else None
            return out(c, rows, kinds), rest

        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "span", "id", "no_id", "hash", "start", "windows", "done")]
            columns = new if held is None else [np.concatenate(pair) for pair in zip(held, new)]
            found, held = sort_out(columns, False)
            yield found
        if held is not None:
            yield sort_out(held, True)[0]

    return spans.repartition("anchor").sortWithinPartitions(*order).mapInArrow(follow, FOUND_SCHEMA)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of strings or bytes without nulls, and where each value begins and the last ends."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return data, ends - ends[0]


def _column(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The opposite of ``_bytes``, as a binary column."""
    buffers = [None, pa.py_buffer(np.ascontiguousarray(ends, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, buffers).cast(pa.binary())


def _listed(column: pa.Array, *names: str) -> tuple[np.ndarray, ...]:
    """Of a column of lists of structs: the row of each struct, and its fields."""
    number = pc.list_value_length(column).fill_null(0).to_numpy()
    flat = column.flatten()
    return np.repeat(np.arange(len(column)), number), *(pc.struct_field(flat, name).to_numpy() for name in names)


def _places(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of the ranges ``begin`` to ``begin + size - 1``, one range behind the other."""
    return np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)


def _bytes_of(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the spans in question: whole for ``UNSURE``; window by window, named by hashes, for ``CROWDED``."""
    lists = wanted.groupBy(*KEY).agg(F.collect_list(F.struct("anchor", "start", "windows", "kind")).alias("spans"))
    joined = rows.where("copy = 1").join(lists, KEY).select(*KEY, "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [field.split()[0] for field in BYTES_SCHEMA.split(", ")]
        types = [pa.int64()] * 3 + [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            for block in blocks(batch):
                data, ends = _bytes(block.column("text"))
                keys = [block.column(c).to_numpy() for c in KEY]
                owner, anchor, start, windows, kind = _listed(block.column("spans"), "anchor", "start", "windows", "kind")
                whole = np.flatnonzero(kind == UNSURE)
                for low in range(0, len(whole), 20_000):
                    at = whole[low : low + 20_000]
                    size = windows[at].astype(np.int64) + length - 1
                    held = data[_places(ends[owner[at]] + start[at], size)]
                    columns = [anchor[at], np.zeros(len(at), np.int64), *(k[owner[at]] for k in keys), start[at], windows[at]]
                    texts = _column(held, np.concatenate(([0], np.cumsum(size))))
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types)), texts], names=names)
                out = []
                for s in np.flatnonzero(kind != UNSURE):
                    row, first = owner[s], int(ends[owner[s]])
                    for at in range(start[s], start[s] + windows[s]):
                        name = hashlib.blake2b(data[first + at : first + at + length], digest_size=16).digest()
                        a, b = (int.from_bytes(part, "little", signed=True) for part in (name[:8], name[8:]))
                        out.append((a, b, *(k[row] for k in keys), at, 1, None))
                for low in range(0, len(out), 20_000):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out[low : low + 20_000]), types)], names=names
                    )

    return joined.mapInArrow(cut, BYTES_SCHEMA)


def _with_equals(anchor: np.ndarray, windows: np.ndarray, data: np.ndarray, length: int) -> np.ndarray:
    """Spans that may share a window with others of their anchor: the hash of one of theirs comes twice. The others have no
    repeats and need no place in a suffix array, which compares the bytes of those that are left."""
    n = windows.astype(np.int64)
    size = n + length - 1
    places = _places(np.cumsum(size) - size, n)
    owner = np.repeat(np.arange(len(n)), n)
    values = windows_hash(scrambled(data.astype(np.uint64) + np.uint64(1)), length)[places]
    # The place is in the lower bits, so that one sort finds both equals and whose they are.
    bits = np.uint64(max(len(places) - 1, 1).bit_length())
    mixed = scrambled(values ^ scrambled(anchor.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[owner])
    mixed = (mixed >> bits << bits) | np.arange(len(places), dtype=np.uint64)
    mixed.sort()
    again = np.diff(mixed >> bits) == 0
    at = (mixed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    kept = np.zeros(len(n), bool)
    kept[owner[at[1:][again]]] = kept[owner[at[:-1][again]]] = True
    return kept


def _array_repeats(cut: DataFrame, length: int, array_bytes: int) -> DataFrame:
    """Repeated windows of the spans that have their bytes, as ranges."""
    names = [field.split()[0] for field in RANGE_SCHEMA.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]

    def search(anchor: np.ndarray, keys: list[np.ndarray], windows: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
        """Spans of whole anchors, in the order of documents within each; ``keys`` are id, no_id, hash and start."""
        kept = _with_equals(anchor, windows, data, length)
        size = windows.astype(np.int64) + length - 1
        text = data[np.repeat(kept, size)]
        keys, windows, size = [k[kept] for k in keys], windows[kept].astype(np.int64), size[kept]
        begin = np.cumsum(size) - size
        found = repeated_windows(text, _places(begin, windows), length)
        span = np.searchsorted(begin, found, side="right") - 1
        head = np.flatnonzero(np.concatenate(([True], (np.diff(found) != 1) | (np.diff(span) != 0)))) if len(found) else np.empty(0, int)
        count = np.diff(np.append(head, len(found)))
        own = span[head]
        columns = [*(k[own] for k in keys[:3]), keys[3][own] + (found[head] - begin[own]), count]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        waiting = 0

        def ready(last: bool) -> Iterator[pa.RecordBatch]:
            """Arrays of whole anchors from what is held; the last anchor is held back while more of it may come."""
            nonlocal held, waiting
            anchor, *keys, windows, data = (np.concatenate(c) for c in zip(*held))
            ends = np.concatenate(([0], np.cumsum(windows.astype(np.int64) + length - 1)))
            heads = np.append(np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1]))), len(anchor))
            at, full = 0, len(heads) - 1 if last else len(heads) - 2
            while at < full:
                # Up to the first anchor that ends beyond the limit.
                to = min(int(np.searchsorted(ends[heads], ends[heads[at]] + array_bytes, side="right")), full)
                if to == full and not last and ends[heads[to]] - ends[heads[at]] <= array_bytes:
                    break
                low, high = heads[at], heads[to]
                yield search(anchor[low:high], [k[low:high] for k in keys], windows[low:high], data[ends[low] : ends[high]])
                at = to
            low = heads[at]
            held = [(anchor[low:], *(k[low:] for k in keys), windows[low:], data[ends[low] :])]
            waiting = len(data) - int(ends[low])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((*(batch.column(c).to_numpy() for c in ("anchor", "id", "no_id", "hash", "start", "windows")), _bytes(batch.column("bytes"))[0]))
            waiting += len(held[-1][-1])
            if waiting > array_bytes:
                yield from ready(False)
        if held:
            yield from ready(True)

    # A span of a repeated document row would meet itself; each key has one row here.
    order = ["anchor", "no_id", "id", "hash", "start"]
    return cut.repartition("anchor").sortWithinPartitions(*order).mapInArrow(run, RANGE_SCHEMA)


def _counted_repeats(windows: DataFrame) -> DataFrame:
    """Windows, named by 128-bit hashes, that also stand earlier: all but the first of each name."""
    rank = F.struct("no_id", "id", "hash", "start")
    firsts = windows.groupBy("anchor", "other").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1")
    return windows.join(firsts, ["anchor", "other"]).where(rank > F.col("first")).select(*KEY, "start", "windows")


def keyed(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``id, no_id, hash, text, doc_id, carried``: documents with a key of their own and the columns to carry along."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(
        F.coalesce(doc_id, F.lit(0)).alias("id"),
        doc_id.isNull().cast("int").alias("no_id"),
        F.xxhash64(text_of()).alias("hash"),
        text_of().alias("text"),
        F.struct(F.lit(0).alias("_"), *(F.col(c) for c in carry)).alias("carried"),
    )


def repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, array_bytes: int = ARRAY_BYTES, hot: int = HOT) -> DataFrame:
    """``id, no_id, hash, start, windows``: every window of ``length`` bytes that also starts earlier, as ranges."""
    if not anchor < length or length < 16:
        raise ValueError("windows must have 16 bytes at least, and more than an anchor")
    rows = keyed(docs, []).drop("carried")
    found = written(_sorted_out(_spans(rows, length, anchor), hot), "spans")
    numbered = rows.withColumn("copy", F.row_number().over(Window.partitionBy(*KEY).orderBy("hash")))
    # Texts are read once for both kinds, so that the work doesn't change in kind where the first anchor is crowded.
    cut = written(_bytes_of(numbered, found.where(F.col("kind") != REPEAT), length), "span-bytes")
    ranges = found.where(F.col("kind") == REPEAT).select(*KEY, "start", "windows")
    ranges = ranges.unionByName(_array_repeats(cut.where("bytes IS NOT NULL"), length, array_bytes))
    ranges = ranges.unionByName(_counted_repeats(cut.where("bytes IS NULL")))
    return ranges


def _without(data: np.ndarray, ends: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some texts without the ranges ``start`` to ``stop``, which don't overlap, and their new ends."""
    change = np.zeros(len(data) + 1, np.int8)
    # One range may end where the next begins, but no two begin or end at one place.
    full = stop > start
    change[start[full]] += 1
    change[stop[full]] -= 1
    left = np.cumsum(change[:-1], dtype=np.int8) == 0
    return data[left], np.concatenate(([0], np.cumsum(left)))[ends]


def without_repeats(docs: DataFrame, carry: list[str], length: int = LENGTH, **options: int) -> DataFrame:
    """One row per document without the bytes that ``length``-byte strings with an earlier start cover.

    Columns: the ``carry`` columns of ``docs`` in a struct ``carried``, so that names can't clash, then ``n_bytes,
    n_removed, n_spans, kept`` (the remaining bytes) and ``kept_text`` (the same, with characters kept whole that
    removal would split).
    A document with a smaller ``doc_id`` is earlier, null ids come last, equal ids go by the hash of the text, and of
    repeated rows one is first and the others repeat it as a whole. Texts shorter than ``length`` stay; null counts as
    empty. An empty table gives no rows.
    """
    rows = keyed(docs, carry)
    numbered = rows.withColumn("copy", F.row_number().over(Window.partitionBy(*KEY).orderBy("hash")))
    lists = repeats(docs, length, **options).groupBy(*KEY).agg(F.collect_list(F.struct("start", "windows")).alias("ranges"))
    joined = numbered.join(lists, KEY, "left").select("text", "copy", "ranges", "carried")
    schema = T.StructType(
        [
            joined.schema["carried"],
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("n_spans", T.LongType()),
            T.StructField("kept", T.BinaryType()),
            T.StructField("kept_text", T.StringType()),
        ]
    )

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                data, ends = _bytes(block.column("text"))
                size, copy = np.diff(ends), block.column("copy").to_numpy()
                owner, start, windows = _listed(block.column("ranges"), "start", "windows")
                own = copy[owner] == 1
                again = np.flatnonzero((copy > 1) & (size >= length))
                owner = np.concatenate((owner[own], again))
                start = np.concatenate((start[own], np.zeros(len(again), np.int64)))
                stop = np.concatenate((start[: own.sum()] + windows[own] + length - 1, size[again]))
                # Places in all texts, with one between two texts, so that their ranges don't touch.
                start, stop = (np.minimum(p, size[owner]) + ends[owner] + owner for p in (start, stop))
                order = np.argsort(start)
                start, stop, owner = start[order], np.maximum.accumulate(stop[order]), owner[order]
                head = np.concatenate(([True], start[1:] > stop[:-1])) if len(start) else np.empty(0, bool)
                tail = np.append(head[1:], True) if len(start) else head
                owner, start, stop = owner[head], start[head] - owner[head], stop[tail] - owner[head]
                removed = np.bincount(owner, stop - start, len(size)).astype(np.int64)
                kept, kept_ends = _without(data, ends, start, stop)
                # A character that a range splits stays whole: its other bytes have 0x80 to 0xBF at most.
                inner = np.append(data & 0xC0, 0) == 0x80
                for _ in range(3):
                    start = start + ((start < stop) & inner[start])
                for _ in range(3):
                    stop = stop - ((stop > start) & (stop < ends[owner + 1]) & inner[stop])
                shown = _column(*_without(data, ends, start, stop)).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [
                        block.column("carried"),
                        pa.array(size),
                        pa.array(removed),
                        pa.array(np.bincount(owner, minlength=len(size))),
                        _column(kept, kept_ends),
                        shown,
                    ],
                    names=["carried", "n_bytes", "n_removed", "n_spans", "kept", "kept_text"],
                )

    return joined.mapInArrow(remove, schema)


def digests(docs: DataFrame, **options: int) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of ``without_repeats``."""
    return without_repeats(docs, ["doc_id"], **options).select(
        F.col("carried.doc_id").cast("long").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
