"""Phrase mining against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from llm import phrases

LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def awkward_texts() -> list[tuple]:
    """Frequent and rare words, every separator, other white space, nulls, repeated rows, and one piece of many blocks."""
    rng = random.Random(12)
    words = ["The", "of", "É", "ÉCOLE", "new", "york", "city", "a b", "x\x1cy", "ß", "日本", "it's"]
    marks = [" ", "  ", "\t", " ", " ", ".", ", ", "\n", "\r\n", "\x0b", "!", "?;:", " \x0c "]
    rows = []
    for i in range(300):
        body = "".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randint(0, 40)))
        rows.append((i, body + rng.choice(["", "New York City of the dead.", "new york city of", "In New York"]), rng.choice(["en", "en", "fr", None])))
    rows += [(300, None, "en"), (301, "", None), (302, "word", "xx"), (303, ";;;", "en")] + [(304, "a b c d e", "de")] * 40
    return rows + [(305, " ".join(rng.choice(words[:4]) for _ in range(4000)), "long"), (306, "of the new. " * 900, "long")]


def by_force(rows):
    counts, words = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LETTERS)):
            found = re.findall("[^ \t]+", piece)
            words[lang] += len(found)
            for size in range(1, 5):
                counts[lang].update(tuple(found[i : i + size]) for i in range(len(found) - size + 1))
    expected = []
    for lang, own in counts.items():
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= 30}
        best = []
        for phrase, a in candidates.items():
            if any(
                100 * candidates[longer] >= 80 * a and phrase in [longer[i : i + len(phrase)] for i in range(len(longer) - len(phrase) + 1)]
                for longer in candidates
                if len(longer) > len(phrase)
            ):
                continue
            cuts = [(2_000_000 * a // (own[phrase[:k]] + own[phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            best.append((-score, -a, " ".join(phrase).encode(), own[phrase[:k]], own[phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:2000], 1):
            expected.append((lang, rank, phrase.decode(), -a, left, right, words[lang], -score))
    return sorted(expected)


# Small blocks cut pieces and texts; a filter of 128 bits lets nearly everything through.
@pytest.mark.parametrize("block_bytes, filter_bits", [(16 << 20, 1 << 20), (700, 128), (40, 1 << 20)])
def test_phrases(spark, block_bytes, filter_bits):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(awkward_texts(), "doc_id long, text string, lang string").repartition(3)
    docs = docs.withColumns({name: F.col("lang") for name in ("prefix", "words", "shard", "phrase", "n")})
    found = phrases.collocations(docs, block_bytes, filter_bits)
    assert sorted(map(tuple, phrases.top_phrases(found).collect())) == by_force(awkward_texts())


def test_top_is_per_language(spark):
    rows = [(lang, f"p {i}", 2, 30 + i, 1, 50, 50, 100, i // 3, 0) for lang in ("a", "b") for i in range(400)]
    found = spark.createDataFrame(rows, "lang string, phrase string, size int, a long, k int, l long, r long, n long, score long, longest long")
    top = phrases.top_phrases(found, 25).collect()
    assert sorted((r["lang"], r["rank"], r["a"]) for r in top) == [(lang, i + 1, 429 - i) for lang in ("a", "b") for i in range(25)]


def test_parts_of_a_long_text():
    """Cut anywhere, the words that parts own are the words of the text, each with three more to follow."""
    rng = np.random.default_rng(2)
    for _ in range(200):
        text = "".join(rng.choice(["a", "bb", "c" * 30, " ", "  ", " ", "\t", "."], rng.integers(1, 400), p=[0.3, 0.15, 0.05, 0.3, 0.05, 0.1, 0.04, 0.01]))
        data = np.frombuffer(text.encode() + b"\n", np.uint8)
        got = []
        for part, own in phrases.parts_of(data, 60):
            block = phrases.Block(part, np.array([len(part)]), np.zeros(2, np.int64), ["x"], own)
            spelled = block.words.take(pa.array(block.tokens)).to_pylist()
            for i in range(block.own):
                got.append(tuple(w for w, p in zip(spelled[i : i + 4], block.piece[i : i + 4], strict=True) if p == block.piece[i]))
        expected = []
        for piece in text.split("."):
            words = piece.split()
            expected += [tuple(words[i : i + 4]) for i in range(len(words))]
        assert got == expected


def test_stripes_merge_over_batches():
    """Rows of one key in one batch or over several, and in several rows of one block."""
    rng = random.Random(3)
    for size in (1, 2, 7, 100):
        keys = sorted((rng.choice("ab"), rng.choice(["", "p", "q r"]), rng.randint(0, 1)) for _ in range(60))
        rows = [(*key, words := rng.sample(["x", "y", "z", None, "w"], rng.randint(1, 5)), [rng.randint(1, 20) for _ in words]) for key in keys]
        expected = defaultdict(Counter)
        for lang, prefix, shard, words, counts in rows:
            expected[lang, prefix, shard].update(dict(zip(words, counts, strict=True)))
        sent = [(*key, "\n".join(w or "" for w in words), np.array(counts, "<i4").tobytes()) for *key, words, counts in rows]
        batches = [pa.RecordBatch.from_pylist([dict(zip(phrases._SENT.names, row, strict=True)) for row in sent[i : i + size]], phrases._SENT) for i in range(0, 60, size)]
        got = [row for batch in phrases.merged(iter(batches)) for row in batch.to_pylist()]
        assert [(r["lang"], r["prefix"], r["shard"]) for r in got] == sorted(expected)
        for r in got:
            own = expected[r["lang"], r["prefix"], r["shard"]]
            assert r["total"] == sum(own.values())
            assert dict(zip(r["words"], r["counts"], strict=True)) == {w: n for w, n in own.items() if w is not None and n >= 30}


def test_phrases_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert phrases.top_phrases(phrases.collocations(docs)).count() == 0
