"""Shape of the physical plans."""

import re

from codecatalog.operators import diff as d
from codecatalog.operators import fill, modules, render, symbols
from codecatalog.sources import files as src

SCHEMA = "path string, content string, lang string, ext string"


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def executed(spark, df_fn):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df_fn()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_extraction_has_one_exchange(spark):
    files = spark.createDataFrame([], SCHEMA)
    text = executed(spark, lambda: symbols.extract_symbols(files))
    assert len(re.findall(r"Exchange hashpartitioning\(path", text)) == 1
    assert text.count("Exchange ") == 1
    assert len(re.findall(r"\bSort \[", text)) == 3
    assert "Python" not in text and "ArrowEval" not in text


def test_rendering_adds_no_python_and_reuses_the_partitioning(spark):
    files = spark.createDataFrame([], SCHEMA)

    def pages():
        syms = symbols.extract_symbols(files)
        mods = modules.modules(modules.module_docs(files), syms)
        return render.page_bodies(syms, "markdown").join(mods, "path")

    text = executed(spark, lambda: render.page_bodies(symbols.extract_symbols(files), "html"))
    assert text.count("Exchange ") == 1
    assert "ArrowEval" not in executed(spark, pages)


def test_diff_moves_only_path_and_hash(spark, tmp_path):
    spark.createDataFrame([("a", "text", "h")], "path string, content string, sha256 string").write.parquet(str(tmp_path / "f"))
    files = spark.read.parquet(str(tmp_path / "f"))
    text = d.snapshot_diff(files, files)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in text


def test_doc_diff_filters_before_the_join(spark):
    files = spark.createDataFrame([], "path string, content string")
    text = executed(spark, lambda: fill.doc_diff_report(files, files))
    join = text.index("LeftAnti")
    assert text.count("RLIKE", join) >= 2


def test_exclusion_needs_no_shuffle(spark):
    files = spark.createDataFrame([], SCHEMA)
    text = executed(spark, lambda: src.quarantine_syntax(src.exclude_dirs(files))[0])
    assert "Exchange" not in text
