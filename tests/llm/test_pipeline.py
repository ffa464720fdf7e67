"""The pipeline stage by stage against brute force, and the registered queries against their SQL twins."""

from collections import Counter, defaultdict

import pytest
from test_operators import links_by_force, repeats_by_force

import __spark_entry__ as entry
import corpus_pipeline
from check import compare
from llm import quality, suffix_dedup
from llm.labels import training_sample
from llm.registry import ORACLES, QUERIES
from llm.tables import written


def rows_of(df):
    return Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_stages_by_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    after = {}
    current = docs
    for name, stage in corpus_pipeline.STAGES:
        current = written(stage(spark, current, sf_dir), name)
        if name != "packing":
            assert current.columns == docs.columns
        after[name] = current

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.score(docs, quality.train(docs, training_sample(docs, labels, "quality", 1, 3)))
    good = {r["doc_id"] for r in scored.where("predicted = 1").collect()}
    expected = Counter({k: n for k, n in rows_of(docs).items() if k[0] in good})
    assert rows_of(after["quality"]) == expected and 0 < len(expected) < docs.count()

    largest = {}
    for doc_id, text in sorted(expected):
        largest[text] = doc_id
    expected = Counter((i, t) for t, i in largest.items())
    assert rows_of(after["exact_dedup"]) == expected

    links = {doc_id: root for doc_id, root, _ in links_by_force(sorted(expected))}
    expected = Counter({k: n for k, n in expected.items() if links[k[0]] == k[0]})
    assert rows_of(after["near_dedup"]) == expected

    forced = {r[0]: r[4] for r in repeats_by_force(sorted(expected), 100)}
    digests = suffix_dedup.digests(after["near_dedup"])
    assert {r["doc_id"]: r["kept_sha256"] for r in digests.collect()} == forced
    left = after["suffix_dedup"]
    assert {r["doc_id"] for r in left.select("doc_id").collect()} == set(forced)
    assert left.where("n_chars <> char_length(text)").isEmpty()

    lengths = defaultdict(int)
    for r in after["packing"].collect():
        lengths[r["sequence_id"]] += r["length"]
    assert all(n == 2048 or n & (n - 1) == 0 for n in lengths.values())
    tokens = after["packing"].groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert {r["doc_id"] for r in tokens} == set(forced) and all(r[1] == r[2] for r in tokens)


def test_run_is_the_stages(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert [number for number, _ in enumerate(corpus_pipeline.STAGES)] == list(range(5))


def test_stages_of_awkward_rows(spark, awkward, nothing, sf_dir):
    """Nulls, empty texts, repeated rows, clashing columns and an empty table pass every stage but the first unharmed."""
    for rows in (awkward, nothing):
        current = rows
        for _, stage in corpus_pipeline.STAGES[1:4]:
            current = written(stage(spark, current, sf_dir), "stage")
            assert current.columns == rows.columns
        assert (current.count() > 0) == (rows is awkward)
    kept = corpus_pipeline.exact_stage(spark, awkward, sf_dir)
    assert sorted(r["doc_id"] for r in kept.where("text = '' OR text IS NULL").collect()) == [3]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, sf_dir, name):
    assert compare(spark, sf_dir, name).startswith("ok")


def test_registered():
    assert set(QUERIES) <= set(entry.queries()) and "pipeline" in QUERIES
    assert sorted(n.split("_")[0] for n in QUERIES if n != "pipeline") == sorted(f"op{i}" for i in range(1, 11))
