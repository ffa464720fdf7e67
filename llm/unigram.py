"""SentencePiece encoding and decoding with a unigram model: Viterbi over a double-array trie of pieces.

The lattice falls apart where no piece reaches across: before white space that follows a visible character,
and around characters that no piece contains, such as line feeds. The segments between are encoded once per
block and worker.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from llm.batches import Cache, blocks, id_and_text

MARK = "▁"  # stands for a space
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # kinds of pieces in a model file
UNKNOWN_PENALTY = 10.0

CODEC_SCHEMA = (
    "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean"
)


def double_array(keys: list[bytes]) -> tuple[list[int], list[int], list[int]]:
    """Base, check and value arrays of a trie; the value of a node is the index of its key or -1."""
    children: list[dict[int, int]] = [{}]
    ends: list[int] = [-1]
    for index, key in enumerate(keys):
        node = 0
        for byte in key:
            if byte not in children[node]:
                children[node][byte] = len(children)
                children.append({})
                ends.append(-1)
            node = children[node][byte]
        ends[node] = index
    size = 2 * len(children) + 512
    base, check, value = [0] * size, [-1] * size, [-1] * size
    used = bytearray(size)
    used[0] = 1
    free, top, queue = 1, 1, [(0, 0)]
    for node, slot in queue:
        value[slot] = ends[node]
        codes = sorted(children[node])
        if not codes:
            continue
        while used[free]:
            free += 1
        # Some places from the first free slot on are tried; then the node goes behind all others.
        start = max(free - codes[0], 1)
        places = (at for at in range(start, min(start + 64, top)) if not any(used[at + code] for code in codes))
        at = next(places, max(top - codes[0], 1))
        if at + 512 > len(used):
            grown = len(used)
            base += [0] * grown
            check += [-1] * grown
            value += [-1] * grown
            used += bytearray(grown)
        top = max(top, at + codes[-1] + 1)
        base[slot] = at
        for code in codes:
            used[at + code] = 1
            check[at + code] = slot
            queue.append((children[node][code], at + code))
    return base, check, value


@dataclass
class UnigramModel:
    base: list[int]
    check: list[int]
    value: list[int]
    ids: list[int]
    scores: list[float]
    surface: list[bytes]
    byte_ids: list[int]
    unknown_id: int
    unknown_score: float
    dummy_prefix: bool
    breaks: str

    @classmethod
    def load(cls, path: str) -> UnigramModel:
        """Pieces and scores of a model file whose normaliser changes nothing; other normalisers are refused."""
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        rules = proto.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models with an identity normaliser and white space as prefix are supported")
        pieces = list(proto.pieces)
        plain = [i for i, p in enumerate(pieces) if p.type in (NORMAL, USER_DEFINED, UNUSED)]
        if any(MARK in pieces[i].piece.lstrip(MARK) for i in plain):
            raise ValueError("pieces across white space are not supported")
        order = sorted(plain, key=lambda i: pieces[i].piece.encode())
        base, check, value = double_array([pieces[i].piece.encode() for i in order])
        byte_ids = [-1] * 256
        surface = [p.piece.replace(MARK, " ").encode() for p in pieces]
        for i, p in enumerate(pieces):
            if p.type == BYTE:
                byte_ids[int(p.piece[3:5], 16)] = i
                surface[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type == CONTROL:
                surface[i] = b""
            elif p.type == UNKNOWN:
                surface[i] = proto.trainer_spec.unk_surface.encode()
        known = set("".join(pieces[i].piece for i in plain))
        return cls(
            base,
            check,
            value,
            order,
            [pieces[i].score for i in order],
            surface,
            byte_ids,
            next(i for i, p in enumerate(pieces) if p.type == UNKNOWN),
            min(pieces[i].score for i in order) - UNKNOWN_PENALTY,
            rules.add_dummy_prefix,
            "\n" if "\n" not in known else "",
        )

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best path; of equal scores the path found first, from left to right, stays."""
        data = text.replace(" ", MARK).encode()
        base, check, value, scores = self.base, self.check, self.value, self.scores
        n, worst = len(data), self.unknown_score
        best: list[float | None] = [None] * (n + 1)
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        best[0] = 0.0
        at = 0
        while at < n:
            first = data[at]
            width = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            here, node, end, single = best[at], 0, at, False
            while end < n:
                step = base[node] + data[end]
                if check[step] != node:
                    break
                node = step
                end += 1
                found = value[node]
                if found >= 0:
                    score = here + scores[found]
                    if best[end] is None or score > best[end]:
                        best[end], back[end] = score, (at, found)
                    single = single or end == at + width
            if not single and (best[at + width] is None or here + worst > best[at + width]):
                best[at + width], back[at + width] = here + worst, (at, -1)
            at += width
        ids: list[int] = []
        while n:
            start, found = back[n]
            if found >= 0:
                ids.append(self.ids[found])
            elif self.byte_ids[0] >= 0:
                ids += [self.byte_ids[byte] for byte in reversed(data[start:n])]
            else:
                ids.append(self.unknown_id)
            n = start
        return ids[::-1]

    def decode(self, ids) -> str:
        """Pieces joined, byte pieces as bytes, marks as spaces, without the space of the prefix."""
        body = b"".join(map(self.surface.__getitem__, ids))
        if self.dummy_prefix and body.startswith(b" "):
            body = body[1:]
        return body.decode("utf-8", "replace")


_RUNS = re.compile(r" +[^ ]*|[^ ]+")


class Encoder:
    """Whole texts to ids, by segments that are known already or encoded now."""

    def __init__(self, model: UnigramModel):
        self.model, self.known = model, Cache()

    def _segments(self, text: str) -> list[str]:
        """Cut before white space that follows a visible character."""
        if "  " not in text and text[-1:] != " ":
            head, *tail = text.split(" ")
            return ([head] if head else []) + [" " + word for word in tail]
        return _RUNS.findall(text)

    def __call__(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, "<u4")
        known, out = self.known, []
        marked = (" " + text if self.model.dummy_prefix else text).replace(MARK, " ")  # the mark itself is a space, too
        feed = self._ids(self.model.breaks) if self.model.breaks else b""
        for number, line in enumerate(marked.split(self.model.breaks) if self.model.breaks else [marked]):
            if number:
                out.append(feed)
            for segment in self._segments(line):
                ids = known.get(segment)
                out.append(self._ids(segment) if ids is None else ids)
        return np.frombuffer(b"".join(out), "<u4")

    def _ids(self, segment: str) -> bytes:
        ids = self.known.get(segment)
        if ids is None:
            ids = self.known[segment] = np.asarray(self.model.viterbi(segment), "<u4").tobytes()
        return ids


def encoded(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, ids`` for each document: the ids of its whole text. Null counts as empty and has no ids."""
    model = docs.sparkSession.sparkContext.broadcast(UnigramModel.load(model_path))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model.value)
        for batch in batches:
            for block in blocks(batch):
                encoder.known.room()
                ids = [encoder(text) for text in block.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [block.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"]
                )

    return id_and_text(docs).mapInArrow(encode, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``. Null ids give a null text, empty ids an empty one."""
    model = rows.sparkSession.sparkContext.broadcast(UnigramModel.load(model_path))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if ids is None else model.value.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")


def codec_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Encode each whole text, decode the ids again, and return digests of both.

    ``n_pieces`` and ``n_byte_pieces`` count all ids and those of single bytes; ``ids_crc32`` is over the ids as
    little-endian unsigned 32-bit numbers; ``round_trip`` tells whether the decoded text is the text (it isn't if
    the text holds the white-space mark itself). Null counts as empty. Repeated rows give repeated results, a
    null ``doc_id`` stays null, other columns are ignored, an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(UnigramModel.load(model_path))

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model.value)
        single = np.zeros(len(model.value.surface) + 1, bool)
        single[[i for i in model.value.byte_ids if i >= 0]] = True
        for batch in batches:
            for block in blocks(batch):
                encoder.known.room()
                rows = []
                for doc_id, text in zip(block.column("doc_id").to_pylist(), block.column("text").to_pylist()):
                    ids = encoder(text)
                    back = model.value.decode(ids.tolist())
                    digest = hashlib.sha256(back.encode()).hexdigest()
                    rows.append((doc_id, len(ids), int(single[ids].sum()), zlib.crc32(ids.tobytes()), digest, back == text))
                types = [pa.int64()] * 4 + [pa.string(), pa.bool_()]
                names = ["doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "decoded_sha256", "round_trip"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return id_and_text(docs).mapInArrow(both, CODEC_SCHEMA)
