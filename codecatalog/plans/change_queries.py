"""Queries over snapshots, change feeds and documentation fill."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codecatalog import corpus, fixed_values as fv, specs
from codecatalog.functions.text import sha256_hex
from codecatalog.operators import diff as d
from codecatalog.operators import fill, modules, report, symbols
from codecatalog.plans.catalog_queries import MODULES_SQL
from codecatalog.plans.registry import catalog, expected_symbols, kept_files, query, with_base, written_files
from codecatalog.session import new_run_dir
from codecatalog.sources import sinks, state

# Two snapshots of the documents as files; the text is the same in both engines.
V1 = "SELECT 'doc_' || CAST(doc_id AS STRING) AS path, text AS content FROM documents"
V2 = (
    "SELECT 'doc_' || CAST(doc_id AS STRING) AS path, CASE WHEN doc_id % 7 = 0 THEN text || ' edited' ELSE text END AS content "
    "FROM documents WHERE doc_id % 10 <> 0 UNION ALL "
    "SELECT 'doc_' || CAST(doc_id + 1000000 AS STRING), text FROM documents WHERE doc_id % 25 = 1"
)
STATUS_SQL = (
    f"(SELECT coalesce(n.path, o.path) AS path, CASE WHEN n.path IS NULL THEN 'deleted' WHEN o.path IS NULL THEN 'added' "
    f"WHEN sha256(n.content) = sha256(o.content) THEN 'unchanged' ELSE 'modified' END AS status "
    f"FROM ({V2}) n FULL OUTER JOIN ({V1}) o ON n.path = o.path)"
)
CHANGED = "status IN ('added','modified')"


def snapshot(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = spark.sql(sql.replace("FROM documents", "FROM {docs}"), docs=docs)
    return rows.withColumn("sha256", sha256_hex(F.col("content")))


def document_diff(spark: SparkSession, sf: str) -> DataFrame:
    return d.snapshot_diff(snapshot(spark, sf, V2), d.next_state(snapshot(spark, sf, V1)))


@query("snapshot_diff", f"SELECT path, status FROM {STATUS_SQL} s")
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    return document_diff(spark, sf)


@query("changed_files", f"SELECT path, sha256(content) AS sha256 FROM ({V2}) n WHERE path IN (SELECT path FROM {STATUS_SQL} s WHERE {CHANGED})")
def changed_files(spark: SparkSession, sf: str) -> DataFrame:
    return d.changed_files(snapshot(spark, sf, V2), document_diff(spark, sf)).select("path", "sha256")


@query("deleted_files", f"SELECT path, sha256(content) AS sha256 FROM ({V1}) o WHERE path NOT IN (SELECT path FROM ({V2}) n)")
def deleted_files(spark: SparkSession, sf: str) -> DataFrame:
    return d.deleted_files(snapshot(spark, sf, V2), d.next_state(snapshot(spark, sf, V1)))


@query("update_state", f"SELECT path, sha256(content) AS sha256 FROM ({V2}) n")
def update_state(spark: SparkSession, sf: str) -> DataFrame:
    return d.update_state(d.next_state(snapshot(spark, sf, V1)), snapshot(spark, sf, V2), document_diff(spark, sf))


@query(
    "file_status_counts",
    "SELECT count(*) AS files_scanned, count(*) FILTER (WHERE status IN ('added','modified')) AS files_changed, "
    "count(*) FILTER (WHERE status = 'unchanged') AS files_unchanged, count(*) FILTER (WHERE status = 'deleted') AS files_deleted "
    f"FROM {STATUS_SQL} s",
)
def file_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return d.file_status_counts(document_diff(spark, sf))


@query("read_state", f"SELECT path, sha256(content) AS sha256 FROM ({V1}) o")
def read_state(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON state file per document, and a corrupt one beside each."""
    root = new_run_dir(spark, "states")
    rows = snapshot(spark, sf, V1)
    good = rows.select(
        F.concat(F.col("path"), F.lit(".json")).alias("page_path"),
        F.to_json(F.struct(F.create_map("path", "sha256").alias("hashes")), {"pretty": "true"}).alias("content"),
    )
    bad = rows.select(F.concat(F.col("path"), F.lit(".broken.json")).alias("page_path"), F.lit('{"hashes": [').alias("content"))
    sinks.write_page_files(good.unionByName(bad), root)
    return state.read_state_json(spark, root)


@query("state_roundtrip", f"SELECT path, sha256(content) AS sha256 FROM ({V2}) n")
def state_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    root = new_run_dir(spark, "state")
    for version, sql in enumerate((V1, V2)):
        state.write_state(d.next_state(snapshot(spark, sf, sql)), root, version)
    return state.read_state(spark, root)


# Corpus snapshots: files gone, files shifted by one line, files copied to a new directory.
GONE = "doc_id % 10 = 0"
SHIFTED = "doc_id % 7 = 0"
COPIED = "doc_id % 25 = 1"
V2_SYMBOLS = (
    "(SELECT path, module_name, kind, name, parent_name, is_deprecated, docstring, "
    f"line_number + CASE WHEN {SHIFTED} THEN 1 ELSE 0 END AS line_number FROM {expected_symbols()} a WHERE NOT ({GONE}) UNION ALL "
    "SELECT 'added/' || path, 'added.' || module_name, kind, name, parent_name, is_deprecated, docstring, line_number "
    f"FROM {expected_symbols()} b WHERE {COPIED})"
)


def corpus_snapshot(spark: SparkSession, sf: str, version: int) -> DataFrame:
    base = corpus.corpus_base(spark, sf).selectExpr("doc_id", "path", f"{corpus._CONTENT} AS content")
    if version == 1:
        rows = base.select("path", "content")
    else:
        kept = base.where(f"NOT ({GONE})").selectExpr(
            "path", f"CASE WHEN {SHIFTED} THEN chr(10) || content ELSE content END AS content"
        )
        rows = kept.unionByName(base.where(COPIED).selectExpr("'added/' || path AS path", "content"))
    return rows.withColumn("sha256", sha256_hex(F.col("content")))


@query("merge_catalog", with_base(f"SELECT path, module_name, kind, name, parent_name, line_number FROM {V2_SYMBOLS} m"))
def merge_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Extract the first snapshot, then only what changed, and merge."""
    from codecatalog.plans.build import BuildOptions, extract, select_files

    old_files, new_files = corpus_snapshot(spark, sf, 1), corpus_snapshot(spark, sf, 2)
    changes = d.snapshot_diff(new_files, old_files)
    options = BuildOptions()
    old = extract(select_files(old_files, options), options)[0]
    new = extract(select_files(d.changed_files(new_files, changes), options), options)[0]
    return d.merge_catalog(old, new, changes).select("path", "module_name", "kind", "name", "parent_name", "line_number")


# Change feed from events

EVENT_CHANGE = "CASE event_type WHEN 'signup' THEN 'added' WHEN 'error' THEN 'deleted' ELSE 'modified' END"
EVENT_PATH = "'doc_' || CAST(user_id AS STRING) || CASE WHEN event_id % 8 = 0 THEN '.txt' ELSE '.py' END"


def event_changes(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").selectExpr(
        "event_id", f"{EVENT_PATH} AS path", f"{EVENT_CHANGE} AS change", "ts"
    )


@query(
    "latest_change",
    f"SELECT path, change, CAST(epoch_us(ts) AS BIGINT) AS ts_us FROM (SELECT {EVENT_PATH} AS path, {EVENT_CHANGE} AS change, ts, "
    f"row_number() OVER (PARTITION BY {EVENT_PATH} ORDER BY ts DESC, event_id DESC) AS rn FROM events) e WHERE rn = 1",
)
def latest_change(spark: SparkSession, sf: str) -> DataFrame:
    latest = d.latest_change(event_changes(spark, sf), "ts", "event_id")
    return latest.select("path", "change", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))


# Reports

def stub_docstrings(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Stands for a model: answers from the prompt alone."""
    for prompts in batches:
        names = prompts.str.extract(r"```python\n(?:async )?(?:def|class) (\w+)", expand=False).fillna("")
        yield " ```python\nDocuments " + names + ".```\n"


MISSING_PY = (
    f"(SELECT * FROM ({corpus.expected_sql(['python'])}) e WHERE docstring = '' "
    "AND NOT (starts_with(name, '_') AND NOT starts_with(name, '__')))"
)
STEM = "regexp_replace(regexp_replace(path, '^.*/', ''), '[.][^.]+$', '')"


def python_candidates(spark: SparkSession, sf: str, files: DataFrame | None = None) -> DataFrame:
    files = kept_files(spark, sf, ("python",)) if files is None else files.where("lang = 'python'")
    py = {"python": specs.PYTHON}
    return fill.doc_candidates(files, symbols.catalog_rows(files, py), py)


def python_suggestions(spark: SparkSession, sf: str, files: DataFrame | None = None) -> DataFrame:
    """Suggestions for the Python files of the corpus, or of ``files`` where they are at hand."""
    prompts = fill.doc_prompts(python_candidates(spark, sf, files))
    return fill.clean_completions(fill.complete(prompts, stub_docstrings))


FEED_SQL = (
    f"(SELECT CASE WHEN kind = 'method' THEN parent_name || '.' || name ELSE name END AS name, module_name AS module, kind, "
    f"'deprecated' AS action, line_number AS line FROM {expected_symbols()} s WHERE is_deprecated UNION ALL "
    "SELECT path, path, 'file', CASE status WHEN 'deleted' THEN 'removed' ELSE status END, 0 "
    f"FROM {STATUS_SQL} t WHERE status <> 'unchanged' UNION ALL "
    f"SELECT name, {STEM}, CASE kind WHEN 'class' THEN 'class' ELSE 'function' END, 'added', line_number FROM {MISSING_PY} m)"
)


def full_feed(spark: SparkSession, sf: str) -> DataFrame:
    return report.change_feed(document_diff(spark, sf), catalog(spark, sf), python_suggestions(spark, sf))


@query("change_feed", with_base(f"SELECT name, module, kind, action, line FROM {FEED_SQL} f"))
def change_feed(spark: SparkSession, sf: str) -> DataFrame:
    return full_feed(spark, sf)


@query("changes_by_action", with_base(f"SELECT name, module, kind, action, line FROM {FEED_SQL} f WHERE action IN ('modified','removed')"))
def changes_by_action(spark: SparkSession, sf: str) -> DataFrame:
    feed = full_feed(spark, sf)
    return report.changes_with(feed, "modified").unionByName(report.changes_with(feed, "removed"))


@query("change_counts", with_base(f"SELECT action, count(*) AS n_changes FROM {FEED_SQL} f GROUP BY action"))
def change_counts(spark: SparkSession, sf: str) -> DataFrame:
    return report.change_counts(full_feed(spark, sf))


_STATUS_COUNTS = (
    "count(*) AS files_scanned, count(*) FILTER (WHERE status IN ('added','modified')) AS files_changed, "
    "count(*) FILTER (WHERE status = 'deleted') AS files_deleted, count(*) FILTER (WHERE status = 'unchanged') AS files_unchanged"
)
_NON_EMPTY = "n_functions > 0 OR n_classes > 0 OR docstring <> ''"
REPORT_SQL = with_base(
    "SELECT 'summary' AS section, CAST(to_json(struct_pack(source := 'documents', output := 'docs', format := 'markdown', incremental := true, "
    "summary := struct_pack(files_scanned := files_scanned, files_changed := files_changed, files_deleted := files_deleted, "
    "files_unchanged := files_unchanged, files_generated := n_modules + 1, modules := n_modules, functions := n_functions, "
    "classes := n_classes, deprecated := n_deprecated, ai_filled := n_filled))) AS VARCHAR) AS body FROM "
    f"(SELECT {_STATUS_COUNTS} FROM {STATUS_SQL} s) a, "
    "(SELECT count(*) AS n_modules, CAST(sum(n_functions) AS BIGINT) AS n_functions, CAST(sum(n_classes) AS BIGINT) AS n_classes "
    f"FROM {MODULES_SQL} m WHERE {_NON_EMPTY}) b, "
    f"(SELECT count(*) AS n_deprecated FROM {FEED_SQL} f WHERE action = 'deprecated') c, (SELECT count(*) AS n_filled FROM {MISSING_PY} p) e "
    "UNION ALL SELECT 'change', CAST(to_json(struct_pack(name := name, module := module, kind := kind, action := action, line := line)) AS VARCHAR) "
    f"FROM {FEED_SQL} g UNION ALL SELECT 'error', CAST(to_json(struct_pack(path := path, reason := {corpus.BREAK_REASON})) AS VARCHAR) "
    f"FROM base WHERE lang = 'python' AND {corpus.BROKEN} AND NOT ({corpus.EMPTY})"
)


def corpus_report(spark: SparkSession, sf: str) -> DataFrame:
    run = new_run_dir(spark, "report-tables")
    files, broken = written_files(spark, sf)
    symbols.extract_symbols(files).write.parquet(f"{run}/symbols")
    syms = spark.read.parquet(f"{run}/symbols")
    diff = document_diff(spark, sf)
    report.change_feed(diff, syms, python_suggestions(spark, sf, files)).write.parquet(f"{run}/changes")
    return report.build_report(
        spark.read.parquet(f"{run}/changes"),
        modules.project_counts(modules.modules(modules.module_docs(files), syms)),
        d.file_status_counts(diff),
        source="documents", output="docs", format="markdown", incremental=True,
        errors=broken,
    )


@query("build_report", REPORT_SQL)
def build_report(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_report(spark, sf)


@query("build_report_json", REPORT_SQL)
def build_report_json(spark: SparkSession, sf: str) -> DataFrame:
    """The report written and read back."""
    out = new_run_dir(spark, "report")
    sinks.write_report(corpus_report(spark, sf), out)
    summary = spark.read.text(f"{out}/summary").select(F.lit("summary").alias("section"), F.col("value").alias("body"))
    details = spark.read.schema("value string, section string").text(f"{out}/details")
    return summary.unionByName(details.select("section", F.col("value").alias("body")))


# Documentation fill

_LINES = "string_split(content, chr(10))"


def _block_rows() -> str:
    """Where each Python declaration's block ends, from the template."""
    template = corpus.TEMPLATES["python"]
    starts = template.starts()
    indents = [len(t) - len(t.lstrip()) for t in (_plain(line.text) for line, _ in starts)]
    out = []
    for i, (line, start) in enumerate(starts):
        if line.sym is None:
            continue
        ends = []
        for j in range(i, len(starts)):
            other, other_start = starts[j]
            if j > i and other.kind in "HA" and indents[j] <= indents[i] and not (other.when == corpus.MULTI and line.when == f"NOT ({corpus.MULTI})"):
                break
            if other.kind in "BM":
                continue
            ends.append(f"CASE WHEN {other.when or 'TRUE'} THEN {other_start} + {other.n} - 1 ELSE 0 END")
        multi = line.when == f"NOT ({corpus.MULTI})"
        header = f"CASE WHEN {corpus.MULTI} THEN 4 ELSE 1 END" if multi else "1"
        out.append(
            f"SELECT path, {corpus.sql_text(line.sym.name)} AS name, {indents[i]} AS indent, CAST({start} AS BIGINT) AS line, "
            f"CAST({start} + {header} AS BIGINT) AS insert_line, CAST(greatest({', '.join(ends)}) AS BIGINT) AS end_line FROM base "
            f"WHERE lang = 'python' AND {corpus.KEPT} AND ({line.sym.when})"
        )
    return " UNION ALL ".join(out)


def _plain(sql: str) -> str:
    """The literal start of a template line."""
    return sql[1:].split("'")[0] if sql.startswith("'") else ""


_SIGNATURES = f"(SELECT path, line_number, signature, kind, docstring FROM {MISSING_PY} q)"
CANDIDATES_SQL = (
    "(SELECT b.path, b.name, CASE s.kind WHEN 'class' THEN 'class' ELSE 'function' END AS kind, s.signature, b.line, b.end_line, b.insert_line, "
    f"b.indent, array_to_string(list_slice(string_split(f.content, chr(10)), b.line, b.end_line), chr(10)) AS body FROM ({_block_rows()}) b "
    f"JOIN {_SIGNATURES} s ON b.path = s.path AND b.line = s.line_number JOIN files f ON b.path = f.path)"
)


def with_files(sql: str) -> str:
    return f"WITH {corpus.files_sql()} {sql}"


@query("doc_candidates", with_files(f"SELECT path, name, kind, signature, line, end_line, insert_line, body FROM {CANDIDATES_SQL} c"))
def doc_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return python_candidates(spark, sf).select("path", "name", "kind", "signature", "line", "end_line", "insert_line", "body")


def _chars(text: str) -> str:
    return corpus._chars(text)


@query(
    "doc_prompts",
    with_files(
        f"SELECT path, line, {_chars(fv.STYLE_GUIDES['numpy'] + chr(10) + chr(10) + 'Signature:' + chr(10) + '```python' + chr(10))} || signature || "
        f"{_chars(chr(10) + '```' + chr(10) + chr(10) + 'Body:' + chr(10) + '```python' + chr(10))} || body || chr(10) || "
        f"{_chars(chr(10) + '```' + chr(10) + chr(10) + 'Write the docstring now:')} AS prompt FROM {CANDIDATES_SQL} c"
    ),
)
def doc_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return fill.doc_prompts(python_candidates(spark, sf), "numpy").select("path", "line", "prompt")


_LANGUAGE_CASES = " ".join(f"WHEN '{ext}' THEN '{name}'" for ext, name, _, _ in fv.PROMPT_LANGUAGES)
_COMMENT_CASES = " ".join(f"WHEN '{ext}' THEN '{comment}'" for ext, _, comment, _ in fv.PROMPT_LANGUAGES)
_STYLE_CASES = " ".join(f"WHEN '{ext}' THEN '{style}'" for ext, _, _, style in fv.PROMPT_LANGUAGES)


@query(
    "generic_prompts",
    with_files(
        "SELECT path, language, replace(replace(replace("
        + _chars(fv.GENERIC_SYSTEM_TEXT).replace("language", "'{language}'").replace("style ||", "'{style}' ||").replace("|| comment ||", "|| '{comment}' ||")
        + ", '{language}', language), '{style}', style), '{comment}', comment) AS system_text, "
        "'Add documentation comments to this ' || language || ' code:' || chr(10) || chr(10) || content AS prompt FROM ("
        f"SELECT *, CASE ext {_LANGUAGE_CASES} END AS language, CASE ext {_STYLE_CASES} END AS style, CASE ext {_COMMENT_CASES} END AS comment "
        f"FROM files WHERE lang <> 'python' AND {corpus.KEPT}) g"
    ),
)
def generic_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return fill.generic_prompts(kept_files(spark, sf)).drop("part")


@query("complete_docs", with_base(f"SELECT path, line_number AS line, 'Documents ' || name || '.' AS docstring FROM {MISSING_PY} m"))
def complete_docs(spark: SparkSession, sf: str) -> DataFrame:
    return python_suggestions(spark, sf).select("path", "line", "docstring")


@query(
    "clean_completions",
    "SELECT conv_id, turn, docstring FROM (SELECT conv_id, turn, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t, "
    "regexp_replace(trim(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '`' || chr(34) || chr(39)), '^python\\n', '') AS docstring "
    "FROM conversations) c WHERE docstring <> ''",
)
def clean_completions(spark: SparkSession, sf: str) -> DataFrame:
    """Assistant turns, wrapped as models like to wrap their answers."""
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    wrapped = turns.select(
        "conv_id", "turn",
        F.when(F.col("turn") % 4 == 1, F.concat(F.lit(" ```python\n"), F.btrim("text", F.lit(" \t\r\n")), F.lit("```\n")))
        .otherwise(F.concat(F.lit('"""'), F.btrim("text", F.lit(" \t\r\n")), F.lit('"""')))
        .alias("completion"),
    )
    return fill.clean_completions(wrapped).select("conv_id", "turn", "docstring")


@query(
    "patch_targets",
    with_files(
        "SELECT c.path, c.line, 'Documents ' || c.name || '.' AS docstring, string_split(f.content, chr(10))[c.line] AS source_line "
        f"FROM {CANDIDATES_SQL} c JOIN files f ON c.path = f.path"
    ),
)
def patch_targets(spark: SparkSession, sf: str) -> DataFrame:
    files = kept_files(spark, sf, ("python",))
    return fill.patch_targets(files, python_suggestions(spark, sf)).select("path", "line", "docstring", "source_line")


@query(
    "apply_doc_patches",
    with_files(
        "SELECT f.path, coalesce(p.content, f.content) AS content FROM files f LEFT JOIN (SELECT path, string_agg(text, chr(10) ORDER BY line_no, sub_no) AS content FROM ("
        "SELECT path, unnest(range(1, len(arr) + 1)) AS line_no, 1 AS sub_no, unnest(arr) AS text FROM "
        "(SELECT path, string_split(content, chr(10)) AS arr FROM files WHERE lang = 'python') x UNION ALL "
        f"SELECT path, insert_line, 0, repeat(' ', indent + 4) || '\"\"\"Documents ' || name || '.\"\"\"' FROM {CANDIDATES_SQL} c) u GROUP BY path) p "
        f"ON f.path = p.path WHERE f.lang = 'python' AND NOT ({corpus.EXCLUDED}) AND (({corpus.EMPTY}) OR NOT ({corpus.BROKEN}))"
    ),
)
def apply_doc_patches(spark: SparkSession, sf: str) -> DataFrame:
    files = kept_files(spark, sf, ("python",))
    return fill.apply_doc_patches(files, python_suggestions(spark, sf))


@query(
    "fill_scope",
    f"SELECT 'full' AS mode, path FROM ({V2}) n UNION ALL SELECT 'incremental', path FROM {STATUS_SQL} s WHERE {CHANGED}",
)
def fill_scope(spark: SparkSession, sf: str) -> DataFrame:
    files = snapshot(spark, sf, V2)
    full = fill.fill_scope(files).select(F.lit("full").alias("mode"), "path")
    part = fill.fill_scope(files, document_diff(spark, sf)).select(F.lit("incremental").alias("mode"), "path")
    return full.unionByName(part)


# Line differences: documents as files against copies with comment runs put in.
_BODY = "coalesce(text, '')"
NOTED = "doc_id % 7 = 0"


def _edited() -> str:
    body = _BODY
    note = (
        "'# note ' || CAST(doc_id AS STRING) || chr(10) || '// second ' || CAST(doc_id AS STRING) || chr(10) || "
        "'extra line' || chr(10) || '*/' || chr(10) || '/// third' || chr(10) || "
    )
    return (
        f"SELECT 'doc_' || CAST(doc_id AS STRING) || '.py' AS path, doc_id, {body} AS old_content, "
        f"CASE WHEN {NOTED} THEN {note}{body} || chr(10) || '# last' ELSE {body} END AS new_content FROM documents"
    )


_SPLIT = "string_split({0}, chr(10))"
NEW_LINES_SQL = (
    "(SELECT n.path, n.line_no, n.line FROM (SELECT path, CAST(unnest(range(1, len(arr) + 1)) AS BIGINT) AS line_no, unnest(arr) AS line FROM "
    f"(SELECT path, string_split(new_content, chr(10)) AS arr FROM ({_edited()}) e) a) n "
    "WHERE trim(n.line, ' ' || chr(9)) <> '' AND NOT EXISTS (SELECT 1 FROM (SELECT path, unnest(string_split(old_content, chr(10))) AS line "
    f"FROM ({_edited()}) e2) o WHERE o.path = n.path AND o.line = n.line))"
)
GROUPS_SQL = (
    "SELECT path, min(line_no) AS line, string_agg(trim(line, ' ' || chr(9)), chr(10) ORDER BY line_no) AS docstring FROM ("
    "SELECT *, line_no - row_number() OVER (PARTITION BY path ORDER BY line_no) AS island FROM "
    f"{NEW_LINES_SQL} w WHERE regexp_matches(trim(line, ' ' || chr(9)), '^(/[*][*]|///|//!|// |#|\"\"\"|[*])') "
    "AND trim(line, ' ' || chr(9)) NOT IN ('*', '*/', '/**', '\"\"\"')) i GROUP BY path, island"
)


def edited_files(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.repartition(spark.sparkContext.defaultParallelism)
    both = spark.sql(_edited().replace("FROM documents", "FROM {docs}"), docs=docs)
    return tuple(both.select("path", F.col(c).alias("content")) for c in ("old_content", "new_content"))


@query("new_lines", f"SELECT path, line_no, line FROM {NEW_LINES_SQL} w")
def new_lines(spark: SparkSession, sf: str) -> DataFrame:
    return fill.new_lines(*edited_files(spark, sf)).select("path", "line_no", "line")


@query("doc_diff_report", GROUPS_SQL)
def doc_diff_report(spark: SparkSession, sf: str) -> DataFrame:
    return fill.doc_diff_report(*edited_files(spark, sf))


@query("doc_diff_groups", GROUPS_SQL)
def doc_diff_groups(spark: SparkSession, sf: str) -> DataFrame:
    old, new = edited_files(spark, sf)
    added = fill.new_lines(old, new).where(fill._looks_like_doc(F.col("line")))
    return fill.group_consecutive(added.select("path", "line_no", F.btrim("line", F.lit(" \t")).alias("text")))


def stub_sources(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Stands for a model: gives the prompted source back with a comment on top, fenced."""
    for prompts in batches:
        body = prompts.str.replace(r"^[^\n]*\n\n", "", n=1, regex=True)
        mark = prompts.str.contains(r"^[^\n]* Ruby code:\n", regex=True).map({True: "#", False: "//"})
        yield "```\n" + mark + " Added by a stub.\n" + body.str.rstrip() + "\n```"


@query(
    "generic_fill",
    with_files(
        "SELECT path, CASE WHEN lang = 'ruby' THEN '#' ELSE '//' END || ' Added by a stub.' || chr(10) || rtrim(content, ' ' || chr(10)) AS content "
        f"FROM files WHERE lang <> 'python' AND {corpus.KEPT}"
    ),
)
def generic_fill(spark: SparkSession, sf: str) -> DataFrame:
    files = written_files(spark, sf)[0]
    return fill.generic_fill(files, fill.complete(fill.generic_prompts(files), stub_sources))
