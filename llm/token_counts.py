"""Token counts of whole texts, without keeping the tokens.

Texts are cut at safe boundaries: places where the pre-tokenizer starts a new word whatever stands before.
The segments of a block that aren't known yet are encoded together, in batches balanced by bytes, and only
their lengths are kept. A text is then the sum of its segments' lengths.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from llm.batches import Cache, blocks, id_and_text
from llm.segments import load_tokenizer, segment_ids, special_strings

#: White space of two or more characters, or at an end: such texts are cut with more care.
_UNEVEN = re.compile(r"\s\s|^\s|\s$")
#: A space that a visible character follows always begins a word of a byte-level pre-tokenizer.
_SAFE = re.compile(r"(?= \S)")
COUNT_SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def cut(text: str) -> tuple[list[str], list[str], int]:
    """Segments that begin a line or the text, segments that follow one space (without it), and the number of
    line feeds that stand alone between visible characters. Other white space stays inside the segments."""
    if not _UNEVEN.search(text):
        first, rest = [], []
        for line in text.split("\n"):
            head, *tail = line.split(" ")
            first.append(head)
            rest += tail
        return first, rest, len(first) - 1
    head, *tail = _SAFE.split(text)
    return [head], [segment[1:] for segment in tail], 0


class SegmentCounter:
    """Counts for a byte-level tokenizer. A text with a special string in it is encoded as a whole, since the
    tokenizer takes such strings out before it looks at white space."""

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        self.special = special_strings(self.tokenizer)
        self.known: dict[bool, Cache] = {False: Cache(), True: Cache()}
        self.memo = Cache()
        self.line_feed = len(self.tokenizer.encode("\n", add_special_tokens=False).ids)

    def _learn(self, wanted: set[str], spaced: bool) -> None:
        known = self.known[spaced]
        missing = [segment for segment in wanted if segment not in known]
        for segment, ids in zip(missing, segment_ids(self.tokenizer, missing, self.memo, " " if spaced else "")):
            known[segment] = len(ids)

    def __call__(self, texts: list[str]) -> list[int]:
        whole = [any(mark in text for mark in self.special) for text in texts]
        parts = [([], [], 0) if kept else cut(text) for text, kept in zip(texts, whole)]
        self.memo.room()
        for spaced in (False, True):
            self.known[spaced].room()
            self._learn({segment for part in parts for segment in part[spaced]}, spaced)
        first, rest = self.known[False].__getitem__, self.known[True].__getitem__
        counts = [sum(map(first, a)) + sum(map(rest, b)) + feeds * self.line_feed for a, b, feeds in parts]
        for at, kept in enumerate(whole):
            if kept:
                counts[at] = len(self.tokenizer.encode(texts[at], add_special_tokens=False).ids)
        return counts


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_tokens, over_limit`` (more tokens than ``limit``).

    Null and empty texts have 0 bytes and 0 tokens. A null ``doc_id`` stays null, repeated rows give repeated
    results, other columns are ignored, and an empty table gives no rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = SegmentCounter(tokenizer_path)
        for batch in batches:
            for block in blocks(batch):
                texts = block.column("text")
                counts = counter(texts.to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        block.column("doc_id"),
                        pc.binary_length(texts).cast(pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array([n > limit for n in counts], pa.bool_()),
                    ],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return id_and_text(docs).mapInArrow(count, COUNT_SCHEMA)
