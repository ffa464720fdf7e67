"""Whole-corpus and incremental builds, made of the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codecatalog import fixed_values as fv
from codecatalog.functions.text import sha256_hex
from codecatalog.operators import diff as d
from codecatalog.operators import modules as m
from codecatalog.operators import fill, render, report
from codecatalog.operators.fill import Completer
from codecatalog.operators.symbols import catalog_rows, extract_symbols
from codecatalog.session import new_run_dir
from codecatalog.sources import files as src
from codecatalog.sources import sinks, state
from codecatalog.specs import SPECS, LangSpec

SYMBOL_SCHEMA = (
    "path string, module_name string, lang string, kind string, name string, parent_name string, "
    "signature string, args array<struct<name:string,type_hint:string,default:string>>, return_type string, "
    "bases array<string>, decorators array<string>, docstring string, is_method boolean, is_async boolean, "
    "is_deprecated boolean, line_number bigint"
)
PLACED_SCHEMA = "path string, page_path string"
MODULE_SCHEMA = "path string, lang string, module_name string, docstring string, n_functions bigint, n_classes bigint"


@dataclass(frozen=True)
class BuildOptions:
    title: str = "Project Documentation"
    format: str = "markdown"
    exclude: Sequence[str] = tuple(fv.DEFAULT_EXCLUDES)
    exclude_private: bool = False
    specs: Mapping[str, LangSpec] = field(default_factory=lambda: dict(SPECS))
    completer: Completer | None = None  # fills missing documentation before the extraction
    style: str = fv.DEFAULT_STYLE


def select_files(files: DataFrame, options: BuildOptions) -> DataFrame:
    """Known languages outside excluded directories, with a content hash."""
    rows = src.exclude_dirs(src.tag_language(files, options.specs), options.exclude)
    if "sha256" not in rows.columns:
        rows = rows.withColumn("sha256", sha256_hex(F.col("content")))
    return rows


def extract(files: DataFrame, options: BuildOptions) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(symbols, modules, quarantine)`` of selected files."""
    good, bad = src.quarantine_syntax(src.skip_test_files(files, options.specs), options.specs)
    symbols = extract_symbols(good, options.specs, private=not options.exclude_private)
    return symbols, m.all_modules(m.module_docs(good, options.specs), symbols), bad


def _publish(
    spark: SparkSession, out: str, version: int, options: BuildOptions, diff: DataFrame, bad: DataFrame, incremental: bool,
    suggestions: DataFrame | None = None,
) -> DataFrame:
    """Pages, index, navigation and report from the written tables of ``version``; returns the report.

    Only pages of touched modules are rendered, and of those whose page has moved. Everything is written under its version,
    so until the state is committed readers see the site as it was.
    """
    symbols = spark.read.schema(SYMBOL_SCHEMA).parquet(f"{out}/symbols/data/v={version}")
    all_modules = spark.read.schema(MODULE_SCHEMA).parquet(f"{out}/modules/data/v={version}")
    modules = all_modules.where("n_functions > 0 OR n_classes > 0 OR docstring <> ''")
    suffix = ".md" if options.format == "markdown" else ".html"
    counts = m.project_counts(modules)
    last = state.current_version(spark, f"{out}/state")
    known = state.read_version(spark, f"{out}/placed", PLACED_SCHEMA, last) if last is not None else spark.createDataFrame([], PLACED_SCHEMA)
    placed = _written(m.module_order(m.with_page_path(modules, suffix)), "placed")
    fresh = placed
    if incremental:
        before = known.withColumnRenamed("page_path", "old_page")
        touched = d.touched_paths(diff).select("path").distinct().withColumn("touched", F.lit(True))
        marked = placed.join(before, "path", "left").join(touched, "path", "left")
        fresh = marked.where("touched OR old_page IS NULL OR old_page <> page_path").drop("old_page", "touched")
    pages = render.render_pages(symbols.join(fresh.select("path"), "path", "left_semi"), fresh, options.format)
    sinks.write_page_log(pages, known.join(placed, "page_path", "left_anti"), out, version)
    state.write_data(placed.select("path", "page_path"), f"{out}/placed", version)
    sinks.write_index(render.render_index(placed, counts, options.format, options.title), f"{out}/index/v={version}")
    state.write_data(render.navigation(placed), f"{out}/nav", version)
    report.change_feed(diff if incremental else None, symbols, suggestions).write.mode("overwrite").parquet(f"{out}/changes")
    summary = report.build_report(
        spark.read.parquet(f"{out}/changes"),
        counts,
        d.file_status_counts(diff),
        source="corpus",
        output=out,
        format=options.format,
        incremental=incremental,
        errors=bad,
    )
    sinks.write_report(summary, f"{out}/build_report")
    return summary


def _written(df: DataFrame, name: str) -> DataFrame:
    """Written once to the shared folder, so that all later reads see the same rows."""
    path = new_run_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _frozen(files: DataFrame, options: BuildOptions) -> tuple[DataFrame, DataFrame]:
    """``(files with content and hash, undecodable files)`` as they are now: content and hash come from one read, so
    an edit during the build can't be recorded as built."""
    if dict(files.dtypes)["content"] == "binary":
        raw = _written(files.select("path", "content"), "raw-files")
        decoded, bad = src.decode_text(raw)
        return select_files(decoded, options), bad
    none = files.sparkSession.createDataFrame([], "path string, reason string")
    plain = files.drop("sha256") if "sha256" in files.columns else files
    return _written(select_files(plain, options), "files"), none


def _filled(files: DataFrame, options: BuildOptions) -> tuple[DataFrame, DataFrame | None]:
    """Files with documentation filled in, and the suggestions; as they are without a completer."""
    if options.completer is None:
        return files, None
    python = {n: s for n, s in options.specs.items() if s.doc_style == "string"}
    good = src.quarantine_syntax(src.skip_test_files(files, options.specs), options.specs)[0]
    wanted = good.where(F.col("lang").isin(*python))
    prompts = fill.doc_prompts(fill.doc_candidates(wanted, catalog_rows(wanted, python), python), options.style)
    suggestions = fill.clean_completions(fill.complete(prompts.where("insert_line IS NOT NULL"), options.completer))
    patched = fill.apply_doc_patches(wanted, suggestions).join(suggestions.select("path").distinct(), "path", "left_semi")
    prompts = fill.generic_prompts(good, options.specs)
    other = fill.generic_fill(good, fill.complete(prompts, options.completer), options.specs)
    changed = patched.unionByName(other).withColumnRenamed("content", "new_content")
    merged = files.join(changed, "path", "left").withColumn("content", F.coalesce("new_content", "content"))
    return _written(merged.drop("new_content"), "filled-files"), suggestions


def _extract_written(spark: SparkSession, files: DataFrame, out: str, name: str, options: BuildOptions) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Symbols, extracted once and read back; the modules they make; the quarantine."""
    symbols, _, bad = extract(files, options)
    symbols = _written(symbols, name)
    good = src.quarantine_syntax(src.skip_test_files(files, options.specs), options.specs)[0]
    return symbols, m.all_modules(m.module_docs(good, options.specs), symbols), bad


def full_build(spark: SparkSession, files: DataFrame, out: str, version: int, options: BuildOptions = BuildOptions()) -> None:
    """Build everything from one snapshot; the state is committed last, so a crash never hides a pending rebuild.

    With a completer, filled files are the table ``{out}/filled``; writing them back is the caller's decision, so the
    state keeps the hashes of the files as they were read.
    """
    frozen, undecodable = _frozen(files, options)
    filled, suggestions = _filled(frozen, options)
    symbols, modules, bad = _extract_written(spark, filled, out, "symbols", options)
    state.write_data(symbols, f"{out}/symbols", version)
    state.write_data(modules, f"{out}/modules", version)
    if suggestions is not None:
        state.write_data(filled.select("path", "content"), f"{out}/filled", version)
    now = d.next_state(frozen)
    diff = now.select("path", F.lit("added").alias("status"))
    _publish(spark, out, version, options, diff, bad.unionByName(undecodable), incremental=False, suggestions=suggestions)
    state.write_state(now, f"{out}/state", version)


def incremental_build(
    spark: SparkSession, files: DataFrame, out: str, version: int, options: BuildOptions = BuildOptions()
) -> bool:
    """Re-extract changed files only and merge; returns False, writing nothing, if nothing changed.

    One scan hashes all files; a second one reads the changed files and hashes them again as they are read. The
    state gets these hashes, so a file that is edited in between is built as read and found changed next time.
    """
    last = state.current_version(spark, f"{out}/state")
    known = state.read_state(spark, f"{out}/state")
    tagged = src.exclude_dirs(src.tag_language(files, options.specs), options.exclude)
    hashes = _written(tagged.select("path", sha256_hex(F.col("content")).alias("sha256")), "hashes")
    diff = _written(d.snapshot_diff(hashes, known), "diff")
    if d.touched_paths(diff).isEmpty():
        return False
    frozen, undecodable = _frozen(d.changed_files(files, diff), options)
    filled, suggestions = _filled(frozen, options)
    symbols, modules, bad = _extract_written(spark, filled, out, "symbols", options)
    old_symbols = state.read_version(spark, f"{out}/symbols", SYMBOL_SCHEMA, last) if last is not None else spark.createDataFrame([], SYMBOL_SCHEMA)
    old_modules = state.read_version(spark, f"{out}/modules", MODULE_SCHEMA, last) if last is not None else spark.createDataFrame([], MODULE_SCHEMA)
    state.write_data(d.merge_catalog(old_symbols, symbols, diff), f"{out}/symbols", version)
    state.write_data(d.merge_catalog(old_modules, modules, diff), f"{out}/modules", version)
    if suggestions is not None:
        state.write_data(filled.select("path", "content"), f"{out}/filled", version)
    _publish(spark, out, version, options, diff, bad.unionByName(undecodable), incremental=True, suggestions=suggestions)
    unchanged = hashes.join(d.touched_paths(diff), "path", "left_anti")
    state.write_state(unchanged.unionByName(d.next_state(frozen)), f"{out}/state", version)
    return True
