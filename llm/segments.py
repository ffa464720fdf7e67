"""Encoding single segments of text with a public byte-level tokenizer file."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

#: Bytes of text in one call of the encoder.
ENCODE_BYTES = 1 << 20

#: Latin letters, then ASCII punctuation but the apostrophe: for byte-level tokenizers these are exactly two
#: words, whatever their splitting pattern does with numbers, contractions or white space.
LETTERS, MARKS = r"[A-Za-zÀ-ÖØ-öø-įĲ-ɏ]+", r"[!-&(-/:-@\[-`{-~]*"
PLAIN = re.compile(f"({LETTERS})({MARKS})")


@lru_cache(maxsize=2)
def load_tokenizer(path: str):
    """The tokenizer of a file, once per Python worker, without truncation or padding."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def special_strings(tokenizer) -> list[str]:
    return [token.content for token in tokenizer.get_added_tokens_decoder().values()]


def _visible_bytes() -> dict[int, str]:
    """The character that stands for each byte: itself if printable, else the next free one from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    table = {byte: chr(byte) for byte in shown}
    for byte in range(256):
        if byte not in table:
            table[byte] = chr(256 + len(table) - len(shown))
    return table


VISIBLE = _visible_bytes()


def encoded_in_batches(tokenizer, segments: list[str], limit: int = ENCODE_BYTES) -> Iterator[list[int]]:
    """Token ids in the order of ``segments``; each call of the encoder gets about ``limit`` bytes."""
    start, held = 0, 0
    for at, segment in enumerate(segments):
        held += len(segment)
        if held >= limit or at == len(segments) - 1:
            for encoding in tokenizer.encode_batch_fast(segments[start : at + 1], add_special_tokens=False):
                yield encoding.ids
            start, held = at + 1, 0


def plain_ids(tokenizer, text: str, lead: str = "") -> list[int]:
    """Token ids of the letters or the punctuation of a plain word, straight from the merge model."""
    shown = text if text.isascii() else text.encode().decode("latin-1").translate(VISIBLE)
    return [token.id for token in tokenizer.model.tokenize(lead + shown)]


def segment_ids(
    tokenizer, segments: list[str], memo: dict[str, list[int]], prefix: str = "", lower: bool = False
) -> Iterator[list[int]]:
    """Token ids of ``prefix + segment`` for each segment, in order.

    Plain words skip the pre-tokenizer, whose outcome is known for them, and go to the tokenizer's merge model;
    ``memo`` keeps their ids.
    """
    merge, match_plain = tokenizer.model.tokenize, PLAIN.fullmatch
    lead = "".join(VISIBLE[b] for b in prefix.encode())
    plain = [match_plain(segment) for segment in segments]
    others = encoded_in_batches(
        tokenizer, [prefix + segment for segment, match in zip(segments, plain) if match is None]
    )
    for match in plain:
        if match is None:
            yield next(others)
            continue
        word, tail = match.groups()
        key = lead + (word.lower() if lower else word)
        ids = memo.get(key)
        if ids is None:
            shown = key if key.isascii() else lead + key[len(lead) :].encode().decode("latin-1").translate(VISIBLE)
            ids = memo[key] = [token.id for token in merge(shown)]
        if tail:
            last = memo.get(tail)
            if last is None:
                last = memo[tail] = [token.id for token in merge(tail)]
            ids = ids + last
        yield ids
