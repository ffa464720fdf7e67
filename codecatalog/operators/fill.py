"""Filling missing documentation: candidates, prompts, completions, patches and their report."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codecatalog import fixed_values as fv
from codecatalog.functions.predicates import lacks_docs
from codecatalog.functions.text import path_ext, strip
from codecatalog.session import new_run_dir
from codecatalog.operators.diff import changed_files
from codecatalog.operators.lines import (
    before,
    code_alone,
    code_lines,
    explode_lines,
    line_window,
    row_kind,
    up_to_here,
    with_depth,
    with_heads,
)
from codecatalog.specs import SPECS, LangSpec

Completer = Callable[[Iterator[pd.Series]], Iterator[pd.Series]]


def missing_docs(rows: DataFrame) -> DataFrame:
    """Declarations without documentation, nested ones included; single-underscore names are exempt."""
    return rows.where(lacks_docs(F.col("docstring"), F.col("name")))


def _normal(content: Column) -> Column:
    return F.regexp_replace(content, r"\r\n?", "\n")


def block_ends(files: DataFrame, specs: Mapping[str, LangSpec]) -> DataFrame:
    """Where each logical line's indented block ends, for indentation-scoped files.

    ``(path, line_number, end_line, first_char, end_char, insert_line)``. A line at indent i closes
    the levels from i up to the indent of the line before it. Emitting one row per closed level makes
    the end of a block the next row of its own level.
    """
    strict = {n: s for n, s in specs.items() if s.scope == "indent"}
    lines = code_lines(files.where(F.col("lang").isin(*strict)), strict).withColumn("kind0", row_kind(strict))
    indent = F.length(F.regexp_extract("code", r"^(\s*)", 1))
    rows = (
        with_heads(with_depth(lines))
        .withColumn("size", F.length("line"))
        .withColumn("first_char", F.coalesce(F.sum(F.col("size") + 1).over(before()), F.lit(0)))
        .withColumn("end_char", F.col("first_char") + F.col("size"))
    )
    starts = F.col("kind").isin("H", "A")
    solid = ~F.col("kind").isin("B", "M")
    rows = rows.withColumn("indent", F.when(starts, indent)).withColumns(
        {
            "last_solid": F.last(F.when(solid, F.struct("line_no", "end_char")), ignorenulls=True).over(before()),
            "file_end": F.max(F.when(solid, F.struct("line_no", "end_char"))).over(Window.partitionBy("path")),
            "indent_before": F.last("indent", ignorenulls=True).over(before()),
        }
    )
    statements = rows.where(F.col("kind").isin("H", "A", "T")).withColumns(
        {
            "next_line": F.lead("line_no").over(line_window()),
            "next_kind": F.lead("kind").over(line_window()),
            "next_indent": F.lead("indent").over(line_window()),
        }
    )
    at_level = Window.partitionBy("path", "level").orderBy("line_no")
    top = F.greatest("indent", F.coalesce("indent_before", "indent"))
    ended = (
        statements.where(starts)
        .withColumn("level", F.explode(F.sequence("indent", top)))
        .withColumn("end", F.coalesce(F.lead("last_solid").over(at_level), F.col("file_end")))
        .where("kind = 'H' AND level = indent")
    )
    inside = (F.col("next_kind") == "T") | (F.col("next_indent") > F.col("indent"))
    return ended.select(
        "path",
        F.col("line_no").alias("line_number"),
        F.col("end.line_no").alias("end_line"),
        "first_char",
        F.col("end.end_char").alias("end_char"),
        F.when(inside, F.col("next_line")).alias("insert_line"),
    )


def doc_candidates(files: DataFrame, rows: DataFrame, specs: Mapping[str, LangSpec] = SPECS) -> DataFrame:
    """Undocumented declarations of indentation-scoped files with their whole source text."""
    missing = missing_docs(rows).select(
        "path",
        "name",
        F.when(F.col("kind") == "class", "class").otherwise("function").alias("kind"),
        "signature",
        "line_number",
        "indent",
    )
    placed = missing.join(block_ends(files, specs), ["path", "line_number"])
    return placed.join(files.select("path", _normal(F.col("content")).alias("content")), "path").select(
        "path",
        "name",
        "kind",
        "signature",
        F.col("line_number").alias("line"),
        "end_line",
        "insert_line",
        "indent",
        F.substring(
            "content",
            (F.col("first_char") + 1).cast("int"),
            (F.col("end_char") - F.col("first_char")).cast("int"),
        ).alias("body"),
    )


def doc_prompts(candidates: DataFrame, style: str = fv.DEFAULT_STYLE) -> DataFrame:
    """Add ``system_text`` and ``prompt`` with the whole body; an unknown style falls back to the default one."""
    guide = fv.STYLE_GUIDES.get(style, fv.STYLE_GUIDES[fv.DEFAULT_STYLE])
    prompt = F.concat(
        F.lit(f"{guide}\n\nSignature:\n```python\n"),
        "signature",
        F.lit("\n```\n"),
        F.when(
            F.col("body") != "",
            F.concat(F.lit("\nBody:\n```python\n"), "body", F.lit("\n\n```\n")),
        ).otherwise(""),
        F.lit("\nWrite the docstring now:"),
    )
    return candidates.withColumn("system_text", F.lit(fv.DOCSTRING_SYSTEM_TEXT)).withColumn("prompt", prompt)


def prompt_languages(files: DataFrame) -> DataFrame:
    """One row per suffix."""
    return files.sparkSession.createDataFrame(
        fv.PROMPT_LANGUAGES, "ext string, language string, comment string, style string"
    )


#: Characters of source in one prompt, about. A longer file is asked for in parts.
PART_CHARS = 200_000


def source_parts(files: DataFrame, specs: Mapping[str, LangSpec] = SPECS, part_chars: int = PART_CHARS) -> DataFrame:
    """``path, lang, part, source``: files as they are, or cut before declarations (with the comments above them) into parts of
    about ``part_chars`` characters. The parts of a file, joined by line feeds, are the file; one declaration stays whole."""
    whole = files.select("path", "lang", _normal(F.col("content")).alias("content"))
    lines = code_lines(whole.where(F.length("content") > part_chars), specs).withColumn("kind0", row_kind(specs))
    rows = with_heads(with_depth(lines)).withColumn(
        "chars", F.coalesce(F.sum(F.length("line") + 1).over(before()), F.lit(0))
    )
    # A segment begins with the comments and annotations of its declaration; those of bodies are no place to cut.
    first_of_segment = F.row_number().over(Window.partitionBy("path", "seg").orderBy("line_no")) == 1
    closes = F.coalesce(F.col("code"), F.lit("")).rlike(r"^\s*[)}\]]")
    cut = F.when(first_of_segment & ~closes & (F.col("depth") <= 1) & (F.col("open_round") <= 0), F.floor(F.col("chars") / part_chars))
    parts = rows.withColumn("cut", cut).withColumn("part", F.coalesce(F.last("cut", ignorenulls=True).over(up_to_here()), F.lit(0)).cast("int"))
    cut_up = parts.groupBy("path", "part").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda r: r["line"]), "\n")
    return whole.join(cut_up, "path", "left").select(
        "path",
        "lang",
        F.coalesce("part", F.lit(0)).alias("part"),
        F.when(F.col("lines").isNull(), F.col("content")).otherwise(text).alias("source"),
    )


def generic_prompts(files: DataFrame, specs: Mapping[str, LangSpec] = SPECS, part_chars: int = PART_CHARS) -> DataFrame:
    """Prompts for the non-Python files that are not blank: one for each part of a file, with the whole of it."""
    system = F.lit(fv.GENERIC_SYSTEM_TEXT)
    for column in ("language", "style", "comment"):
        system = F.replace(system, F.lit("{" + column + "}"), F.col(column))
    parts = source_parts(files.where(F.col("lang") != "python"), specs, part_chars)
    return (
        parts.where(strip("source") != "")
        .withColumn("ext", F.lower(path_ext(F.col("path"))))
        .join(F.broadcast(prompt_languages(files)), "ext")
        .select(
            "path",
            "part",
            "language",
            system.alias("system_text"),
            F.concat(
                F.lit("Add documentation comments to this "),
                "language",
                F.lit(" code:\n\n"),
                "source",
            ).alias("prompt"),
        )
    )


#: Characters of prompts that a completer gets at a time, about. One longer prompt is a batch of its own.
BATCH_CHARS = 4 << 20
#: Prompts that Spark sends to a Python worker at a time.
BATCH_ROWS = 512


def in_pieces(batches: Iterator[pd.Series], limit: int = BATCH_CHARS) -> Iterator[pd.Series]:
    """Batches cut into runs of at most ``limit`` characters, one prompt at least. Spark counts rows, and ten thousand
    files with the copies that a completer makes of them don't fit beside an executor."""
    for batch in batches:
        start, held = 0, 0
        for at, size in enumerate(batch.str.len().fillna(0)):
            if at > start and held + size > limit:
                yield batch.iloc[start:at].reset_index(drop=True)
                start, held = at, 0
            held += size
        yield batch.iloc[start:].reset_index(drop=True)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of few rows for Python functions that run meanwhile; a smaller limit that is set already stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, "10000")
    spark.conf.set(name, str(BATCH_ROWS if int(before) <= 0 else min(int(before), BATCH_ROWS)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def complete(prompts: DataFrame, completer: Completer) -> DataFrame:
    """Add ``completion``. The completer sees a stream of batches of bounded size and sets itself up once per task.

    The answers are written to the shared folder and read from there, so that each prompt is put once, however
    often the result is used.
    """

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from completer(in_pieces(batches))

    completed = prompts.withColumn("completion", run.asNondeterministic()("prompt"))
    path = new_run_dir(prompts.sparkSession, "completions")
    with small_batches(prompts.sparkSession):
        completed.write.parquet(path)
    return prompts.sparkSession.read.schema(completed.schema).parquet(path)


def clean_docstring_completion(completion: Column) -> Column:
    bare = F.btrim(strip(F.coalesce(completion, F.lit(""))), F.lit("`\"'"))
    return F.regexp_replace(bare, r"^python\n", "")


def clean_source_completion(completion: Column) -> Column:
    bare = strip(F.coalesce(completion, F.lit("")))
    opened = F.regexp_replace(bare, r"^```[^\n]*(?:\n|$)", "")
    return F.when(opened.endswith("```"), F.regexp_replace(opened, r"\s*```$", "")).otherwise(opened)


def clean_completions(completed: DataFrame) -> DataFrame:
    """Docstring suggestions; a failed or empty completion is none."""
    return completed.withColumn("docstring", clean_docstring_completion(F.col("completion"))).where(
        "docstring <> ''"
    )


def _patch_text(margin: Column) -> Column:
    """The docstring as a literal at the margin of the statement before which it goes."""
    escaped = F.replace(F.replace(F.col("docstring"), F.lit("\\"), F.lit("\\\\")), F.lit('"""'), F.lit('\\"\\"\\"'))
    lines = F.split(escaped, "\n")
    joined = F.array_join(F.transform(lines, lambda x, i: F.when(i == 0, x).otherwise(F.concat(margin, x))), "\n")
    return F.concat(
        margin,
        F.lit('"""'),
        joined,
        F.when((F.size(lines) > 1) | escaped.endswith('"'), F.concat(F.lit("\n"), margin)).otherwise(""),
        F.lit('"""'),
    )


def patch_targets(files: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Each suggestion with the source line it documents."""
    return suggestions.join(
        explode_lines(files).select("path", F.col("line_no").alias("line"), F.col("line").alias("source_line")),
        ["path", "line"],
        "left",
    )


def apply_doc_patches(files: DataFrame, suggestions: DataFrame) -> DataFrame:
    """New ``files(path, content)`` with each docstring put before the first statement of its body.

    Files without a suggestion stay byte for byte; the others keep their line ends (those of the first line).
    """
    usable = suggestions.where("insert_line IS NOT NULL AND docstring <> ''").select(
        "path", F.col("insert_line").alias("line_no"), "docstring"
    )
    touched = usable.select("path").distinct()
    changed = files.select("path", "content").join(touched, "path", "left_semi")
    lines = explode_lines(changed.select("path", _normal(F.col("content")).alias("content")))
    margin = F.regexp_extract("line", r"^([ \t]*)", 1)
    patches = usable.join(lines, ["path", "line_no"]).select(
        "path", "line_no", F.lit(0).alias("sub_no"), _patch_text(margin).alias("text")
    )
    ends = changed.select("path", F.coalesce(F.nullif(F.regexp_extract("content", r"(\r\n|\r|\n)", 1), F.lit("")), F.lit("\n")).alias("end"))
    rebuilt = (
        lines.select("path", "line_no", F.lit(1).alias("sub_no"), F.col("line").alias("text"))
        .unionByName(patches)
        .groupBy("path")
        .agg(F.array_sort(F.collect_list(F.struct("line_no", "sub_no", "text"))).alias("rows"))
        .join(ends, "path")
        .select("path", F.replace(F.array_join(F.transform("rows", lambda r: r["text"]), "\n"), F.lit("\n"), F.col("end")).alias("content"))
    )
    return files.select("path", "content").join(touched, "path", "left_anti").unionByName(rebuilt)


def _looks_like_doc(line: Column) -> Column:
    text = strip(line)
    return text.rlike(fv.DOC_LINE_PATTERN) & ~text.isin(*fv.BARE_DOC_MARKS)


def new_lines(old_files: DataFrame, new_files: DataFrame) -> DataFrame:
    """Lines of the new text that occur nowhere in the old text of the same file."""
    old = explode_lines(old_files).select("path", "line")
    return explode_lines(new_files).join(old, ["path", "line"], "left_anti").where(strip(F.col("line")) != "")


def group_consecutive(rows: DataFrame) -> DataFrame:
    """Runs of consecutive lines as one row ``(path, line, docstring)``."""
    island = F.col("line_no") - F.row_number().over(line_window())
    return (
        rows.withColumn("island", island)
        .groupBy("path", "island")
        .agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("rows"))
        .select(
            "path",
            F.col("rows")[0]["line_no"].alias("line"),
            F.array_join(F.transform("rows", lambda r: r["text"]), "\n").alias("docstring"),
        )
    )


def doc_diff_report(old_files: DataFrame, new_files: DataFrame) -> DataFrame:
    """Documentation added between two versions of each file, one row per run of lines.

    Lines that cannot be documentation are dropped on both sides before the join.
    """
    old = explode_lines(old_files).where(_looks_like_doc(F.col("line"))).select("path", "line")
    added = (
        explode_lines(new_files)
        .where(_looks_like_doc(F.col("line")))
        .join(old, ["path", "line"], "left_anti")
        .select("path", "line_no", strip(F.col("line")).alias("text"))
    )
    return group_consecutive(added)


def generic_fill(
    files: DataFrame, completions: DataFrame, specs: Mapping[str, LangSpec] = SPECS, part_chars: int = PART_CHARS
) -> DataFrame:
    """``(path, content)`` of files whose completions add documentation.

    A completion counts only if its code, without comments, is that of its part: an answer that was cut off or that
    changes code leaves the part as it is. ``part_chars`` must be that of the prompts; completions without ``part`` are
    for whole files.
    """
    if "part" not in completions.columns:
        completions = completions.withColumn("part", F.lit(0))
    answers = completions.select("path", "part", clean_source_completion(F.col("completion")).alias("result")).where("result <> ''")
    asked = files.join(completions.select("path").distinct(), "path", "left_semi")
    parts = source_parts(asked, specs, part_chars).join(answers, ["path", "part"], "left")
    # An answer comes without the margin of its first line.
    margin = F.regexp_extract("source", r"^([ \t]*)", 1)
    parts = parts.withColumn("result", F.when(F.col("result").rlike(r"^\S"), F.concat(margin, "result")).otherwise(F.col("result")))
    parts = parts.withColumns({"code": code_alone(F.col("source"), specs), "new_code": code_alone(F.col("result"), specs)})
    taken = F.when(F.col("code") == F.col("new_code"), F.col("result")).otherwise(F.col("source"))
    ordered = lambda text: F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("part", text.alias("text")))), lambda r: r["text"]), "\n"
    )
    merged = parts.groupBy("path").agg(ordered(F.col("source")).alias("content"), ordered(taken).alias("result"))
    merged = merged.where(strip(F.col("result")) != strip(F.col("content")))
    added = doc_diff_report(
        merged.select("path", "content"), merged.select("path", F.col("result").alias("content"))
    ).select("path").distinct()
    return merged.join(added, "path", "left_semi").select("path", F.col("result").alias("content"))


def fill_scope(files: DataFrame, diff: DataFrame | None = None) -> DataFrame:
    """Files to document: the changed ones of an incremental run, else all."""
    return files if diff is None else changed_files(files, diff)
