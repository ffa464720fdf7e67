"""Named queries over the given tables and the SQL twin of each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codecatalog import corpus, specs
from codecatalog.operators import symbols
from codecatalog.session import new_run_dir
from codecatalog.sources import files as source_files

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def wrap(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


def with_files(sql: str) -> str:
    return f"WITH {corpus.files_sql()} {sql}"


def with_base(sql: str) -> str:
    return f"WITH base AS MATERIALIZED ({corpus.BASE_SQL}) {sql}"


def tagged(spark: SparkSession, sf: str) -> DataFrame:
    return source_files.tag_language(corpus.corpus_files(spark, sf))


def kept_files(spark: SparkSession, sf: str, langs: tuple[str, ...] = ()) -> DataFrame:
    """Corpus files that extraction looks at."""
    chosen = {n: specs.SPECS[n] for n in langs} if langs else specs.SPECS
    rows = source_files.tag_language(corpus.corpus_files(spark, sf), chosen)
    rows = source_files.skip_test_files(source_files.exclude_dirs(rows), chosen)
    return source_files.quarantine_syntax(rows, chosen)[0]


def written_files(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The files of ``kept_files`` and the quarantine of all corpus files, made and checked once, for queries that read
    them several times."""
    checked = source_files.with_syntax_problem(tagged(spark, sf))
    path = new_run_dir(spark, "corpus-files")
    checked.write.parquet(path)
    rows = spark.read.schema(checked.schema).parquet(path)
    good = rows.where("problem IS NULL").drop("problem")
    bad = rows.where("problem IS NOT NULL").select("path", F.col("problem").alias("reason"))
    return source_files.skip_test_files(source_files.exclude_dirs(good)), bad


def catalog(spark: SparkSession, sf: str, *langs: str) -> DataFrame:
    chosen = {n: specs.SPECS[n] for n in langs} if langs else specs.SPECS
    return symbols.extract_symbols(kept_files(spark, sf, langs), chosen)


def expected_symbols(langs: list[str] | None = None) -> str:
    return f"(SELECT * FROM ({corpus.expected_sql(langs)}) e WHERE NOT nested)"
