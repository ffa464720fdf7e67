"""Toxicity by fuzzy lexicon matches in their context.

The lexicon is learned: words that occur in many toxic and hardly any clean labelled documents. Its trie is
intersected with the Levenshtein automata of its terms, which finds the terms within one edit (two for long
ones) of each different word without comparing the word with every term. Matches inside quotation marks are counted
apart from others, and a logistic model weighs the counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.batches import Cache, blocks, id_and_text
from llm.labels import class_weights, held_out, sigmoid, training_sample

#: A term needs this share of the toxic documents, five at least, and this share of its documents must be toxic.
LEAST_SHARE, LEAST_PRECISION = 0.005, 0.9
#: Terms of the lexicon at most, the most frequent first.
LEXICON_TERMS = 5_000
#: Shortest term, and the length from which two edits are allowed.
SHORTEST, LONG = 4, 9
#: Words on either side of a match that are searched for quotation marks.
CONTEXT = 6

_EDGES = ".,;:!?()[]{}<>\"'`´‘’“”„«»…*_~|/\\#%&$-–—"
_OPEN, _CLOSE, _EITHER = "“„«‘", "”»’", "\"`"

SCORE_SCHEMA = "doc_id long, score double, predicted int, terms array<string>, quoted int, direct int"


class FuzzyTrie:
    """A lexicon trie intersected with the Levenshtein automata of its terms, made deterministic as words need it.

    A state says which trie nodes are reached, and with how few edits each. Its transitions are worked out once
    and kept; most words reach the empty state after a few letters. A term of ``LONG`` letters allows two edits,
    a shorter one allows one.
    """

    def __init__(self, terms: list[str], states: int = 50_000):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.allowed: list[int] = [0]  # the most edits that a term at or below a node allows
        for term in terms:
            node, edits = 0, self.edits_of(term)
            self.allowed[0] = max(self.allowed[0], edits)
            for letter in term:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.allowed.append(0)
                node = self.children[node][letter]
                self.allowed[node] = max(self.allowed[node], edits)
            self.term[node] = term
        self.limit = states
        self._forget()

    @staticmethod
    def edits_of(term: str) -> int:
        return 2 if len(term) >= LONG else 1

    def _forget(self) -> None:
        self.numbers: dict[tuple, int] = {(): 0}
        self.reached: list[tuple] = [()]
        self.steps: list[dict[str, int]] = [{}]
        self.accepts: list[tuple[int, str] | None] = [None]
        self.start = self._number(self._closed({0: 0}))

    def _closed(self, nodes: dict[int, int]) -> dict[int, int]:
        """Adds what is reached by leaving out letters of terms."""
        queue = list(nodes.items())
        for node, edits in queue:
            if nodes[node] < edits:
                continue
            for child in self.children[node].values():
                if edits + 1 <= self.allowed[child] and edits + 1 < nodes.get(child, 99):
                    nodes[child] = edits + 1
                    queue.append((child, edits + 1))
        return nodes

    def _number(self, nodes: dict[int, int]) -> int:
        key = tuple(sorted(nodes.items()))
        if key not in self.numbers:
            self.numbers[key] = len(self.reached)
            self.reached.append(key)
            self.steps.append({})
            ends = [(e, self.term[n]) for n, e in key if self.term[n] is not None and e <= self.edits_of(self.term[n])]
            self.accepts.append(min(ends) if ends else None)
        return self.numbers[key]

    def _step(self, state: int, letter: str) -> int:
        found: dict[int, int] = {}
        for node, edits in self.reached[state]:
            if edits < self.allowed[node]:  # the word has a letter too many
                found[node] = min(found.get(node, 99), edits + 1)
            for own, child in self.children[node].items():
                cost = edits + (own != letter)
                if cost <= self.allowed[child]:
                    found[child] = min(found.get(child, 99), cost)
        after = self.steps[state][letter] = self._number(self._closed(found))
        return after

    def nearest(self, word: str) -> tuple[int, str] | None:
        """Edits and term closest to ``word``, the alphabetically first of equally close terms; none if too far."""
        if len(self.reached) > self.limit:
            self._forget()
        state = self.start
        for letter in word:
            after = self.steps[state].get(letter)
            state = self._step(state, letter) if after is None else after
            if not state:
                return None
        return self.accepts[state]


class Matcher:
    def __init__(self, terms: list[str]):
        self.trie = FuzzyTrie(terms)
        self.known: Cache = Cache()

    def find(self, word: str) -> tuple[int, str] | None:
        return self.trie.nearest(word.strip(_EDGES))

    def matches(self, text: str) -> tuple[list[str], list[tuple[int, int, str]]]:
        """The words, and place, edits and term of those that match."""
        words, known = text.lower().split(), self.known
        for word in [word for word in set(words) if word not in known]:
            known[word] = self.find(word)
        return words, [(at, *found) for at, found in enumerate(map(known.__getitem__, words)) if found is not None]


def is_quoted(words: list[str], at: int) -> bool:
    """Whether quotation marks open before the word and close after it, within the context window."""
    before, after = " ".join(words[max(0, at - CONTEXT) : at]), " ".join(words[at + 1 : at + 1 + CONTEXT])
    own = words[at]
    head = own[: len(own) - len(own.lstrip(_EDGES))]
    tail = own[len(own.rstrip(_EDGES)) :]
    opened = any((before + head).rfind(mark) > max((before + head).rfind(c) for c in _CLOSE) for mark in _OPEN)
    opened = opened or any((before + head).count(mark) % 2 for mark in _EITHER)
    closed = any(mark in tail + after for mark in _CLOSE + _EITHER)
    return opened and closed


FEATURES = 8


def features(matcher: Matcher, text: str) -> tuple[list[float], list[str], int, int]:
    """Logarithms of the counts of matches (exact, inexact of a short term, inexact of a longer one; direct, then
    quoted), of the share of exact ones among the words, and of the number of different terms that match exactly."""
    words, found = matcher.matches(text)
    counts = [0] * 6
    for at, edits, term in found:
        counts[3 * is_quoted(words, at) + (0 if not edits else 1 if len(term) < 6 else 2)] += 1
    share = 1000 * (counts[0] + counts[2]) / max(len(words), 1)
    exact = len({term for _, edits, term in found if not edits})
    row = [*np.log1p(counts).tolist(), float(np.log1p(share)), float(np.log1p(exact))]
    return row, sorted({term for _, _, term in found}), sum(counts[3:]), sum(counts[:3])


@dataclass
class ToxicityModel:
    terms: list[str]
    weights: np.ndarray

    def probability(self, rows: np.ndarray) -> np.ndarray:
        return sigmoid(rows @ self.weights[:-1] + self.weights[-1])


def learn_lexicon(sample: DataFrame) -> list[str]:
    """Words of the sample that mark toxic documents. Copies of a text count once."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                out, labels = [], []
                for text, label in zip(block.column("text").to_pylist(), block.column("label").to_pylist()):
                    own = {word.strip(_EDGES) for word in text.lower().split()}
                    own = [word for word in own if len(word) >= SHORTEST]
                    out += own
                    labels += [label] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(labels, pa.int32())], names=["word", "label"])

    texts = sample.groupBy("text").agg(F.max("label").alias("label"))
    toxic = max(texts.where("label = 1").count(), 1)
    counted = (
        texts.mapInArrow(words, "word string, label int")
        .groupBy("word")
        .agg(F.sum("label").alias("toxic"), F.count("*").alias("all"))
    )
    chosen = counted.where(
        (F.col("toxic") >= F.lit(max(LEAST_SHARE * toxic, 5))) & (F.col("toxic") >= LEAST_PRECISION * F.col("all"))
    )
    return sorted(row["word"] for row in chosen.orderBy(F.desc("toxic"), "word").limit(LEXICON_TERMS).collect())


def train(sample: DataFrame) -> ToxicityModel:
    """Lexicon and weights from ``text, label``. Without labels every score is one half."""
    terms = learn_lexicon(sample)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms)
        for batch in batches:
            for block in blocks(batch):
                matcher.known.room()
                found = [features(matcher, text)[0] for text in block.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found, pa.list_(pa.float64())), block.column("label")], names=["row", "label"]
                )

    # At most as many short rows as the sample has.
    table = sample.mapInArrow(rows, "row array<double>, label int").toArrow()
    y = table["label"].to_numpy().astype(float)
    x = np.array(table["row"].to_pylist()).reshape(len(y), FEATURES)
    order = np.lexsort((*x.T, y))  # rows come in any order; sums must not depend on it
    x, y = np.column_stack([x[order], np.ones(len(y))]), y[order]
    share, weights = class_weights(y), np.zeros(FEATURES + 1)
    for _ in range(50):  # Newton steps with a little ridge
        p = sigmoid(x @ weights)
        gradient = x.T @ (share * (p - y)) + 1e-2 * weights
        curvature = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(FEATURES + 1)
        step = np.linalg.solve(curvature, gradient)
        weights = weights - step
        if np.abs(step).max() < 1e-8:
            break
    return ToxicityModel(terms, weights)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, score, predicted, terms, quoted, direct`` for each document, from its whole text alone.

    Null counts as empty; an empty text gets the score of a text without matches. Repeated rows give repeated
    results, a null ``doc_id`` stays null, other columns are ignored, an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.terms)
        for batch in batches:
            for block in blocks(batch):
                matcher.known.room()
                found = [features(matcher, text) for text in block.column("text").to_pylist()]
                scores = model.probability(np.array([row for row, *_ in found]))
                yield pa.RecordBatch.from_arrays(
                    [
                        block.column("doc_id"),
                        pa.array(scores, pa.float64()),
                        pa.array((scores >= 0.5).astype(np.int32)),
                        pa.array([terms for _, terms, _, _ in found], pa.list_(pa.string())),
                        pa.array([quoted for _, _, quoted, _ in found], pa.int32()),
                        pa.array([direct for _, _, _, direct in found], pa.int32()),
                    ],
                    names=["doc_id", "score", "predicted", "terms", "quoted", "direct"],
                )

    return id_and_text(docs).mapInArrow(run, SCORE_SCHEMA)


def toxicity(docs: DataFrame, labels: DataFrame, remainder: int = 0, modulus: int = 5) -> DataFrame:
    """Train on labelled rows that aren't held out, then score all: ``doc_id, held_out, score, predicted``."""
    model = train(training_sample(docs, labels, "toxic", remainder, modulus))
    return score(docs, model).select("doc_id", held_out(remainder, modulus).alias("held_out"), "score", "predicted")
