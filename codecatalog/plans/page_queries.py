"""Queries over rendered pages and publish manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codecatalog import corpus
from codecatalog.functions import text
from codecatalog.operators import modules, publish, render, symbols
from codecatalog.plans.catalog_queries import MODULES_SQL
from codecatalog.plans.registry import expected_symbols, kept_files, query, with_base
from codecatalog.session import new_run_dir
from codecatalog.sources import sinks

NL = "chr(10)"
S = expected_symbols()
MODS = f"(SELECT *, replace(module_name, '.', '/') AS page_base FROM {MODULES_SQL} m WHERE n_functions > 0 OR n_classes > 0 OR docstring <> '')"
ORDERED = f"(SELECT *, row_number() OVER (ORDER BY lang, path) AS module_ord FROM {MODS} o)"


def esc(col: str) -> str:
    for char, entity in (("'&'", "&amp;"), ("'<'", "&lt;"), ("'>'", "&gt;"), ("chr(34)", "&#34;"), ("chr(39)", "&#39;")):
        col = f"replace({col}, {char}, '{entity}')"
    return col


def _cat(*parts: str) -> str:
    return " || ".join(parts)


def _q(value: str) -> str:
    return corpus._chars(value)


def _page_sql(parts: dict[str, str], methods: tuple[str, str], class_end: str) -> str:
    """``(path, classes, functions)`` fragments per file."""
    return (
        f"(SELECT path, coalesce(string_agg(class_text, '' ORDER BY line_number), '') AS classes, "
        f"coalesce(string_agg(function_text, '' ORDER BY line_number), '') AS functions, coalesce(string_agg(toc, '' ORDER BY rank, line_number), '') AS toc FROM ("
        f"SELECT c.path, c.line_number, 0 AS rank, {parts['toc_class']} AS toc, {parts['class']} || CASE WHEN m.body IS NULL THEN '' ELSE {_q(methods[0])} || m.body || {_q(methods[1])} END || {_q(class_end)} AS class_text, NULL AS function_text "
        f"FROM {S} c LEFT JOIN (SELECT path, parent_name, string_agg({parts['method']}, '' ORDER BY line_number) AS body FROM {S} c WHERE kind = 'method' GROUP BY path, parent_name) m "
        f"ON c.path = m.path AND c.name = m.parent_name WHERE c.kind = 'class' UNION ALL "
        f"SELECT c.path, c.line_number, 1, {parts['toc_function']}, NULL, {parts['function']} FROM {S} c WHERE c.kind = 'function') p GROUP BY path)"
    )


_dep = "CASE WHEN c.is_deprecated THEN ' ⚠️ DEPRECATED' ELSE '' END"
_decs = "CASE WHEN c.decorators_text = '' THEN '' ELSE '`@' || replace(c.decorators_text, '|', '`' || chr(10) || '`@') || '`' || chr(10) END"
_doc = "CASE WHEN c.docstring = '' THEN '' ELSE c.docstring || chr(10) END"
_line = "'**Line:** ' || CAST(c.line_number AS VARCHAR) || chr(10) || chr(10)"
MD_PARTS = {
    "class": _cat("'### '", "c.signature", _dep, NL, _decs, NL, _doc, NL, _line),
    "method": _cat("'##### `'", "c.signature", "'`'", _dep, NL, _decs.replace("c.", "c."), NL, _doc, NL),
    "function": _cat("'### `'", "c.signature", "'`'", _dep, NL, _decs, NL, _doc, NL, _line, "'---'", NL, NL),
    "toc_class": "''", "toc_function": "''",
}
MD_SQL = with_base(
    "SELECT page_base || '.md' AS page_path, '# `' || module_name || '`' || chr(10) || chr(10) || "
    "CASE WHEN docstring = '' THEN '' ELSE docstring || chr(10) END || chr(10) || '**Source:** `' || m.path || '`' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || "
    "CASE WHEN coalesce(classes, '') = '' THEN '' ELSE '## Classes' || chr(10) || chr(10) || classes END || chr(10) || "
    "CASE WHEN coalesce(functions, '') = '' THEN '' ELSE '## Functions' || chr(10) || chr(10) || functions END || chr(10) || "
    f"'*Generated by codecatalog*' AS content FROM {MODS} m LEFT JOIN "
    + _page_sql(MD_PARTS, ("#### Methods\n\n", ""), "\n---\n\n") + " p ON m.path = p.path"
)


def _html_block(css: str, badge: str, word: str, anchor: str, tail: str) -> str:
    return _cat(
        f"'<div class=\"{css}'", "CASE WHEN c.is_deprecated THEN ' deprecated' ELSE '' END", "'\"'", anchor,
        f"'>' || chr(10) || '<span class=\"type-badge {badge}\">{word}</span>' || chr(10)",
        "CASE WHEN c.is_deprecated THEN '<span class=\"badge-deprecated\">DEPRECATED</span>' || chr(10) ELSE '' END",
        "CASE WHEN c.decorators_text = '' THEN '' ELSE '<span class=\"decorator\">@' || replace("
        + esc("c.decorators_text") + ", '|', '</span>' || chr(10) || '<span class=\"decorator\">@') || '</span>' || chr(10) END",
        "'<div class=\"signature\">' || " + esc("c.signature") + " || '</div>' || chr(10)",
        "CASE WHEN c.docstring = '' THEN '' ELSE '<div class=\"docstring\">' || " + esc("c.docstring") + " || '</div>' || chr(10) END",
        tail,
    )


_html_line = "'<div class=\"meta\">📍 Line ' || CAST(c.line_number AS VARCHAR) || '</div>' || chr(10)"
_sm = "CASE WHEN c.is_deprecated THEN ' <span class=\"badge-deprecated-sm\">deprecated</span>' ELSE '' END || '</a>' || chr(10)"
HTML_PARTS = {
    "class": _html_block("doc-block", "class", "class", "' id=\"class-' || " + esc("c.name") + " || '\"'", _html_line),
    "method": _html_block("doc-block method-block", "method", "def", "''", "'</div>' || chr(10)"),
    "function": _html_block("doc-block", "func", "def", "' id=\"func-' || " + esc("c.name") + " || '\"'", _html_line + " || '</div>' || chr(10)"),
    "toc_class": "'<a href=\"#class-' || c.name || '\" class=\"toc-item toc-class\">C ' || c.name || " + _sm,
    "toc_function": "'<a href=\"#func-' || c.name || '\" class=\"toc-item toc-func\">F ' || c.name || " + _sm,
}
HTML_SQL = with_base(
    "SELECT page_base || '.html' AS page_path, '<div class=\"module-header\">' || chr(10) || '<div class=\"breadcrumb\"><a href=\"' || "
    "repeat('../', length(page_base) - length(replace(page_base, '/', ''))) || 'index.html\">Index</a> › <span>' || module_name || "
    "'</span></div>' || chr(10) || '<h1>' || module_name || '</h1>' || chr(10) || "
    "CASE WHEN docstring = '' THEN '' ELSE '<p class=\"module-desc\">' || " + esc("docstring") + " || '</p>' || chr(10) END || "
    "'<p class=\"meta-line\">📄 <code>' || m.path || '</code></p>' || chr(10) || '</div>' || chr(10) || "
    "CASE WHEN coalesce(toc, '') = '' THEN '' ELSE '<div class=\"toc-card\">' || chr(10) || '<h3>Contents</h3>' || chr(10) || toc || '</div>' || chr(10) END || "
    "CASE WHEN coalesce(classes, '') = '' THEN '' ELSE '<h2>Classes</h2>' || chr(10) || classes END || "
    f"CASE WHEN coalesce(functions, '') = '' THEN '' ELSE '<h2>Functions</h2>' || chr(10) || functions END AS content FROM {MODS} m LEFT JOIN "
    + _page_sql(HTML_PARTS, ('<div class="methods-section">\n<h4>Methods</h4>\n', "</div>\n"), "</div>\n") + " p ON m.path = p.path"
)


def _catalog(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    files = kept_files(spark, sf)
    syms = symbols.extract_symbols(files)
    # Pages and modules both need the symbols: they are extracted once.
    run = new_run_dir(spark, "symbols")
    syms.write.parquet(run)
    syms = spark.read.schema(syms.schema).parquet(run)
    return syms, modules.modules(modules.module_docs(files), syms)


def _pages(spark: SparkSession, sf: str, fmt: str) -> DataFrame:
    syms, mods = _catalog(spark, sf)
    return render.render_pages(syms, modules.with_page_path(mods, render._FRAMES[fmt]["suffix"]), fmt)


@query("render_markdown", MD_SQL)
def render_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return _pages(spark, sf, "markdown")


@query("render_html", HTML_SQL)
def render_html(spark: SparkSession, sf: str) -> DataFrame:
    return _pages(spark, sf, "html")


def _index(spark: SparkSession, sf: str, fmt: str) -> DataFrame:
    _, mods = _catalog(spark, sf)
    placed = modules.module_order(modules.with_page_path(mods, render._FRAMES[fmt]["suffix"]))
    return render.render_index(placed, modules.project_counts(placed), fmt)


_COUNTS = f"(SELECT CAST(count(*) AS VARCHAR) AS nm, CAST(sum(n_functions) AS VARCHAR) AS nf, CAST(sum(n_classes) AS VARCHAR) AS nc FROM {MODS} k)"


@query("render_markdown_index", with_base(
    "SELECT 0 AS part, CAST(0 AS BIGINT) AS module_ord, '# Project Documentation' || chr(10) || chr(10) || '> Auto-generated documentation' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || "
    "'**Stats:** ' || nm || ' modules · ' || nf || ' functions · ' || nc || ' classes' || chr(10) || chr(10) || '## Modules' || chr(10) || chr(10) AS content "
    f"FROM {_COUNTS} c UNION ALL SELECT 1, module_ord, '- [' || module_name || '](' || page_base || '.md)' || chr(10) || "
    "CASE WHEN docstring = '' THEN '' ELSE '  — ' || string_split(docstring, chr(10))[1] || chr(10) END || chr(10) "
    f"FROM {ORDERED} o UNION ALL SELECT 2, 0, chr(10) || '---' || chr(10) || chr(10) || '*Generated by codecatalog*'"))
def render_markdown_index(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf, "markdown")


@query("render_html_index", with_base(
    "SELECT 0 AS part, CAST(0 AS BIGINT) AS module_ord, '<div class=\"hero\">' || chr(10) || '<h1>Project Documentation</h1>' || chr(10) || "
    "'<p class=\"hero-sub\">Auto-generated API documentation</p>' || chr(10) || '</div>' || chr(10) || '<div class=\"stats\">' || chr(10) || "
    + " || ".join(
        f"'<div class=\"stat-card\"><span class=\"stat-value\">' || {c} || '</span><span class=\"stat-label\">{label}</span></div>' || chr(10)"
        for c, label in (("nm", "modules"), ("nf", "functions"), ("nc", "classes"))
    )
    + f" || '</div>' || chr(10) || '<h2>Modules</h2>' || chr(10) || '<div class=\"module-grid\">' || chr(10) AS content FROM {_COUNTS} c UNION ALL "
    "SELECT 1, module_ord, '<div class=\"module-card\">' || chr(10) || '<a href=\"' || page_base || '.html\">' || module_name || '</a>' || chr(10) || "
    "CASE WHEN docstring = '' THEN '<div class=\"description muted\">No description available</div>' || chr(10) "
    "ELSE '<div class=\"description\">' || string_split(docstring, chr(10))[1] || '</div>' || chr(10) END || "
    "'<div class=\"module-meta\"><span>' || CAST(n_functions AS VARCHAR) || ' functions</span><span>·</span><span>' || CAST(n_classes AS VARCHAR) || ' classes</span></div>' || chr(10) || '</div>' || chr(10) "
    f"FROM {ORDERED} o UNION ALL SELECT 2, 0, '</div>' || chr(10)"))
def render_html_index(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf, "html")


@query("navigation", with_base(
    "SELECT module_ord, module_name, page_base || '.html' AS href, repeat('../', length(page_base) - length(replace(page_base, '/', ''))) AS root_prefix "
    f"FROM {ORDERED} o"))
def navigation(spark: SparkSession, sf: str) -> DataFrame:
    _, mods = _catalog(spark, sf)
    return render.navigation(modules.module_order(modules.with_page_path(mods, ".html")))


# Publishing, on the given web pages. A page keeps its text; a third of the pages share one other text.

_EXT = "CASE page_id % 5 WHEN 0 THEN '.html' WHEN 1 THEN '.md' WHEN 2 THEN '.json' WHEN 3 THEN '.css' ELSE '.bin' END"
PAGES = f"SELECT 'p/' || CAST(page_id AS STRING) || {_EXT} AS page_path, coalesce(html, '') AS content FROM pages"
OLD_PAGES = (
    f"SELECT 'p/' || CAST(page_id AS STRING) || {_EXT} AS page_path, CASE WHEN page_id % 4 = 1 THEN 'before ' || CAST(page_id AS STRING) ELSE html END AS content FROM pages "
    f"UNION ALL SELECT 'gone/' || CAST(page_id AS STRING) || '.html', html FROM pages WHERE page_id % 6 = 0"
)


def web_pages(spark: SparkSession, sf: str, sql: str = PAGES) -> DataFrame:
    given = spark.read.parquet(f"{sf}/pages.parquet")
    return spark.sql(sql.replace("FROM pages", "FROM {given}"), given=given)


_TYPE = "CASE WHEN ends_with({0}, '.html') THEN 'text/html' WHEN ends_with({0}, '.md') THEN 'text/markdown' WHEN ends_with({0}, '.json') THEN 'application/json' WHEN ends_with({0}, '.css') THEN 'text/css' ELSE 'application/octet-stream' END"


@query("content_types", f"SELECT page_path, {_TYPE.format('page_path')} AS content_type FROM ({PAGES}) p")
def content_types(spark: SparkSession, sf: str) -> DataFrame:
    return web_pages(spark, sf).select("page_path", text.content_type(F.col("page_path")).alias("content_type"))


@query(
    "publish_manifest",
    f"SELECT '/' || page_path AS path, sha1(content) AS sha1, {_TYPE.format('page_path')} AS content_type, CAST(strlen(content) AS BIGINT) AS n_bytes FROM ({PAGES}) p",
)
def publish_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return publish.publish_manifest(web_pages(spark, sf))


@query(
    "required_uploads",
    f"SELECT '/' || page_path AS path, sha1(content) AS sha1 FROM ({PAGES}) p WHERE sha1(content) NOT IN (SELECT sha1(content) FROM ({OLD_PAGES}) o)",
)
def required_uploads(spark: SparkSession, sf: str) -> DataFrame:
    """The remote asks for the hashes it does not hold."""
    manifest = publish.publish_manifest(web_pages(spark, sf))
    held = publish.publish_manifest(web_pages(spark, sf, OLD_PAGES))
    required = manifest.select("sha1").distinct().join(held, "sha1", "left_anti")
    return publish.required_uploads(manifest, required).select("path", "sha1")


@query(
    "publish_delta",
    f"SELECT '/' || page_path AS path, sha1(content) AS sha1, 'upload' AS action FROM ({PAGES}) p WHERE sha1(content) NOT IN (SELECT sha1(content) FROM ({OLD_PAGES}) o) UNION ALL "
    f"SELECT '/' || page_path, sha1(content), 'remove' FROM ({OLD_PAGES}) o WHERE page_path NOT IN (SELECT page_path FROM ({PAGES}) p)",
)
def publish_delta(spark: SparkSession, sf: str) -> DataFrame:
    return publish.publish_delta(
        publish.publish_manifest(web_pages(spark, sf)), publish.publish_manifest(web_pages(spark, sf, OLD_PAGES))
    )


@query(
    "publish_bundle",
    f"SELECT page_path AS file, CAST(to_json(struct_pack(file := page_path, data := content || chr(65533))) AS VARCHAR) AS body FROM ({PAGES}) p",
)
def publish_bundle(spark: SparkSession, sf: str) -> DataFrame:
    """Each page ends in a byte that is no UTF-8."""
    broken = web_pages(spark, sf).withColumn("content", F.concat(F.encode("content", "UTF-8"), F.unhex(F.lit("FF"))))
    return publish.publish_bundle(broken)


@query("write_pages", f"SELECT page_path, sha1(content) AS sha1 FROM ({PAGES}) p")
def write_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as a table and as single files; what is read back must agree in both."""
    out = new_run_dir(spark, "pages")
    pages = web_pages(spark, sf)
    sinks.write_pages(pages, out)
    sinks.write_page_files(pages, f"{out}/site")
    table = spark.read.parquet(f"{out}/pages").select("page_path", text.sha1_hex(F.col("content")).alias("sha1"))
    single = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{out}/site").select(
        F.regexp_extract("path", "(p/[^/]+)$", 1).alias("page_path"), F.sha1("content").alias("sha1")
    )
    return table.intersectAll(single)
