"""Source trees as a table of files."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codecatalog import fixed_values as fv
from codecatalog.functions.layout import layout_problem
from codecatalog.functions.predicates import in_excluded_dir
from codecatalog.functions.text import let, path_ext, sha256_hex
from codecatalog.operators.lines import masked_struct, per_specs
from codecatalog.sources.tree import list_tree, read_files
from codecatalog.specs import SPECS, LangSpec


def language_dim(spark: SparkSession, specs: Mapping[str, LangSpec] = SPECS) -> DataFrame:
    """One row per suffix; its size is the number of suffixes, never the data."""
    rows = [(ext, s.name) for s in specs.values() for ext in s.extensions]
    return spark.createDataFrame(rows, "ext string, lang string")


def tag_language(files: DataFrame, specs: Mapping[str, LangSpec] = SPECS) -> DataFrame:
    """Keep files with a known suffix and add ``ext`` and ``lang``."""
    dim = F.broadcast(language_dim(files.sparkSession, specs))
    ext = path_ext(F.col("path"))
    # The filter, unlike the join, is moved to before the content is read or made.
    known = files.where(ext.isin(*[e for s in specs.values() for e in s.extensions]))
    return known.drop("ext", "lang").withColumn("ext", ext).join(dim, "ext")


def exclude_dirs(files: DataFrame, names: Sequence[str] = tuple(fv.DEFAULT_EXCLUDES)) -> DataFrame:
    return files.where(~in_excluded_dir(F.col("path"), names))


def skip_test_files(files: DataFrame, specs: Mapping[str, LangSpec] = SPECS) -> DataFrame:
    for spec in specs.values():
        if spec.skip_path_suffix:
            files = files.where(~F.endswith(F.col("path"), F.lit(spec.skip_path_suffix)))
    return files


def read_source_tree(
    spark: SparkSession,
    root: str,
    extensions: Iterable[str] | None = None,
    exclude: Sequence[str] = tuple(fv.DEFAULT_EXCLUDES),
) -> DataFrame:
    """``(path, content BINARY)`` of every matching file, with paths relative to ``root``: a folder that all executors mount, or
    a URI of a remote store. Both are listed and read by tasks, empty files and all names included."""
    wanted = sorted(extensions or [e for s in SPECS.values() for e in s.extensions])
    return read_files(list_tree(spark, root, wanted, exclude), root)


def decode_text(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split ``(path, content BINARY)`` into text files and a quarantine of undecodable ones."""
    text = F.col("content").cast("string")
    valid = F.is_valid_utf8(text)
    decoded = files.where(valid).select(
        "path", text.alias("content"), sha256_hex(F.col("content")).alias("sha256")
    )
    bad = files.where(~F.coalesce(valid, F.lit(False))).select(
        "path", F.lit("not valid UTF-8").alias("reason")
    )
    return decoded, bad


@per_specs
def _syntax_problem(strict: Mapping[str, LangSpec]) -> Column:
    def problem(masked: Column) -> Column:
        code, text = masked["code"], masked["text"]
        open_quote = (F.regexp_count(text, F.lit('"""')) % 2 == 1) | (F.regexp_count(text, F.lit("'''")) % 2 == 1)
        bad_header = code.rlike(
            r"(?m)^[ \t]*(?:async[ \t]+)?def[ \t]+\w+[ \t]*(?:[^\s(\w\[]|$)"
        ) | code.rlike(r"(?m)^[ \t]*class[ \t]*(?:[^\w\s]|$)")
        # Headers and strings only tell what is wrong where brackets and lines are right.
        return let(
            layout_problem(code),
            lambda layout: F.when(layout == "unbalanced brackets", layout)
            .when(open_quote, "unclosed string")
            .when(bad_header, "illegal header")
            .otherwise(layout),
        )

    return let(masked_struct(F.col("content"), strict, over_lines=True), problem)


def with_syntax_problem(files: DataFrame, specs: Mapping[str, LangSpec] = SPECS) -> DataFrame:
    """Add ``problem``: why an indentation-scoped file cannot be parsed, else null.

    The test reads one file value at a time, so nothing shuffles.
    """
    strict = {n: s for n, s in specs.items() if s.scope == "indent"}
    if not strict:
        return files.withColumn("problem", F.lit(None).cast("string"))
    return files.withColumn("problem", F.when(F.col("lang").isin(*strict), _syntax_problem(strict)))


def quarantine_syntax(files: DataFrame, specs: Mapping[str, LangSpec] = SPECS) -> tuple[DataFrame, DataFrame]:
    """``(parsable files, quarantine(path, reason))``."""
    checked = with_syntax_problem(files, specs)
    good = checked.where("problem IS NULL").drop("problem")
    return good, checked.where("problem IS NOT NULL").select("path", F.col("problem").alias("reason"))
