"""Queries over the code corpus: files, lines, symbols, documentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codecatalog import corpus, fixed_values as fv, specs
from codecatalog.functions import predicates, text
from codecatalog.operators import fill, lines, modules, symbols
from codecatalog.plans.registry import (
    catalog, expected_symbols, kept_files, query, tagged, with_base, with_files,
)
from codecatalog.session import new_run_dir
from codecatalog.sources import files as src
from codecatalog.sources import sinks

K = corpus.KEPT
SYM = expected_symbols()
NOT_EMPTY_DIR = f"NOT ({corpus.EXCLUDED})"


def _flat(df: DataFrame) -> DataFrame:
    return df.select(
        "path", "module_name", "lang", "kind", "name", "parent_name", "signature", "return_type",
        F.array_join("bases", ", ").alias("bases_text"),
        F.array_join("decorators", "|").alias("decorators_text"),
        "docstring", "is_async", "is_deprecated", "line_number",
    )


FLAT = (
    "path, module_name, lang, kind, name, parent_name, signature, return_type, bases_text, decorators_text, "
    "docstring, is_async, is_deprecated, line_number"
)

for _lang in corpus.LANGUAGES:
    query(f"symbols_{_lang}", with_base(f"SELECT {FLAT} FROM {expected_symbols([_lang])} s"))(
        lambda spark, sf, lang=_lang: _flat(catalog(spark, sf, lang))
    )
    query(
        f"params_{_lang}",
        with_base(corpus.expected_lists_sql("args", [_lang])),
    )(
        lambda spark, sf, lang=_lang: catalog(spark, sf, lang).select(
            "path", "name", "line_number", F.posexplode("args").alias("pos", "a")
        ).select(
            "path", "name", "line_number", F.col("pos").cast("bigint").alias("pos"),
            F.col("a.name").alias("arg_name"), F.col("a.type_hint").alias("type_hint"),
            F.col("a.default").alias("default_value"),
        )
    )


# Sources

@query("scan_source_tree", with_files(f"SELECT path, sha256(content) AS sha256 FROM files WHERE {NOT_EMPTY_DIR}"))
def scan_source_tree(spark: SparkSession, sf: str) -> DataFrame:
    root = new_run_dir(spark, "tree")
    sinks.write_page_files(corpus.corpus_files(spark, sf).withColumnRenamed("path", "page_path"), root)
    return src.read_source_tree(spark, root).select("path", text.sha256_hex(F.col("content")).alias("sha256"))


@query(
    "decode_text",
    with_files(
        f"SELECT path, CASE WHEN {corpus.UNDECODABLE} THEN 'not valid UTF-8' ELSE 'decoded' END AS outcome, "
        f"CASE WHEN {corpus.UNDECODABLE} THEN 0 ELSE CAST(length(content) AS BIGINT) END AS n_chars FROM files"
    ),
)
def decode_text(spark: SparkSession, sf: str) -> DataFrame:
    raw = corpus.corpus_base(spark, sf).selectExpr(
        "path",
        f"CASE WHEN {corpus.UNDECODABLE} THEN concat(unhex('FF'), encode({corpus._CONTENT}, 'UTF-8')) "
        f"ELSE encode({corpus._CONTENT}, 'UTF-8') END AS content",
    )
    good, bad = src.decode_text(raw)
    return good.select(
        "path", F.lit("decoded").alias("outcome"), F.length("content").cast("bigint").alias("n_chars")
    ).unionByName(bad.select("path", F.col("reason").alias("outcome"), F.lit(0).cast("bigint").alias("n_chars")))


# Projections and filters

@query("tag_language", with_base("SELECT path, ext, lang FROM base"))
def tag_language(spark: SparkSession, sf: str) -> DataFrame:
    return tagged(spark, sf).select("path", "ext", "lang")


@query("exclude_dirs", with_base(f"SELECT path FROM base WHERE {NOT_EMPTY_DIR}"))
def exclude_dirs(spark: SparkSession, sf: str) -> DataFrame:
    return src.exclude_dirs(corpus.corpus_files(spark, sf)).select("path")


@query("module_names", with_base(f"SELECT path, {corpus.module_sql()} AS module_name FROM base"))
def module_names(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.corpus_files(spark, sf).select("path", text.module_name(F.col("path")).alias("module_name"))


_COPIES = "regexp_replace(path, '[.][a-z]+$', '.zz')"


@query(
    "page_paths",
    with_base(
        "SELECT path, page_path, repeat('../', length(page_path) - length(replace(page_path, '/', ''))) AS root_prefix FROM ("
        f"SELECT path, replace({corpus.module_sql()}, '.', '/') || '.md' AS page_path FROM base UNION ALL "
        f"SELECT {_COPIES}, replace({corpus.module_sql()}, '.', '/') || '~zz.md' FROM base) p"
    ),
)
def page_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Every file has a twin of another suffix, which must not overwrite its page."""
    base = corpus.corpus_base(spark, sf)
    paths = base.select("path").unionByName(base.selectExpr(f"{_COPIES} AS path"))
    placed = modules.with_page_path(paths.withColumn("module_name", text.module_name(F.col("path"))), ".md")
    return placed.select("path", "page_path", text.root_prefix(F.col("page_path")).alias("root_prefix"))


@query("exclude_private", with_base(f"SELECT path, name, line_number FROM {SYM} s WHERE NOT starts_with(name, '_') AND NOT hidden"))
def exclude_private(spark: SparkSession, sf: str) -> DataFrame:
    return symbols.extract_symbols(kept_files(spark, sf), private=False).select("path", "name", "line_number")


@query(
    "exported_only",
    with_base(f"SELECT path, name, kind, line_number FROM {expected_symbols(['go'])} s WHERE regexp_matches(name, '^[A-Z]')"),
)
def exported_only(spark: SparkSession, sf: str) -> DataFrame:
    return catalog(spark, sf, "go").select("path", "name", "kind", "line_number")


@query("skip_test_files", with_base(f"SELECT path FROM base WHERE NOT {corpus.GO_TEST}"))
def skip_test_files(spark: SparkSession, sf: str) -> DataFrame:
    return src.skip_test_files(corpus.corpus_files(spark, sf)).select("path")


@query(
    "keyword_filter",
    with_base(
        "SELECT lang, kind, count(*) AS n_symbols, "
        "count(*) FILTER (WHERE name IN ('if','for','while','switch','return','sizeof','typedef','get','set')) AS n_control_words, "
        "count(*) FILTER (WHERE return_type IN ('return','else','new','throw')) AS n_false_types "
        f"FROM {SYM} s GROUP BY lang, kind"
    ),
)
def keyword_filter(spark: SparkSession, sf: str) -> DataFrame:
    return catalog(spark, sf).groupBy("lang", "kind").agg(
        F.count("*").alias("n_symbols"),
        F.count_if(predicates.is_control_word(F.col("name"))).alias("n_control_words"),
        F.count_if(F.col("return_type").isin(*fv.NOT_A_TYPE)).alias("n_false_types"),
    )


@query("macro_filter", with_base(f"SELECT path, name FROM {expected_symbols(['cpp'])} s WHERE kind = 'function'"))
def macro_filter(spark: SparkSession, sf: str) -> DataFrame:
    return catalog(spark, sf, "cpp").where("kind = 'function'").select("path", "name")


MODULE_DOC = "CASE WHEN lang IN ('python','typescript','rust') THEN 'Module ' || sid || ' from ' || source || '.' ELSE '' END"
MODULES_SQL = (
    f"(SELECT b.path, b.lang, {corpus.module_sql('b.path')} AS module_name, {MODULE_DOC} AS docstring, "
    "coalesce(n_functions, 0) AS n_functions, coalesce(n_classes, 0) AS n_classes FROM base b LEFT JOIN "
    "(SELECT path, count(*) FILTER (WHERE kind = 'function') AS n_functions, "
    f"count(*) FILTER (WHERE kind = 'class') AS n_classes FROM {SYM} s GROUP BY path) c ON b.path = c.path WHERE {K})"
)


def corpus_modules(spark: SparkSession, sf: str) -> DataFrame:
    files = kept_files(spark, sf)
    return modules.modules(modules.module_docs(files), symbols.extract_symbols(files))


@query(
    "non_empty_modules",
    with_base(f"SELECT path, module_name, docstring, n_functions, n_classes FROM {MODULES_SQL} m "
              "WHERE n_functions > 0 OR n_classes > 0 OR docstring <> ''"),
)
def non_empty_modules(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_modules(spark, sf).select("path", "module_name", "docstring", "n_functions", "n_classes")


@query("deprecated_symbols", with_base(f"SELECT path, kind, name, parent_name, line_number FROM {SYM} s WHERE is_deprecated"))
def deprecated_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return catalog(spark, sf).where("is_deprecated").select("path", "kind", "name", "parent_name", "line_number")


@query(
    "missing_docs",
    with_base(
        f"SELECT path, kind, name, line_number FROM ({corpus.expected_sql()}) e "
        "WHERE docstring = '' AND NOT (starts_with(name, '_') AND NOT starts_with(name, '__'))"
    ),
)
def missing_docs(spark: SparkSession, sf: str) -> DataFrame:
    rows = symbols.catalog_rows(kept_files(spark, sf))
    return fill.missing_docs(rows).select("path", "kind", "name", F.col("line_number"))


@query(
    "search_modules",
    with_base(f"SELECT path, module_name FROM {MODULES_SQL} m WHERE contains(lower(module_name), 'src1') "
              "AND (n_functions > 0 OR n_classes > 0 OR docstring <> '')"),
)
def search_modules(spark: SparkSession, sf: str) -> DataFrame:
    return modules.search_modules(corpus_modules(spark, sf), "SRC1").select("path", "module_name")


# Extraction

@query(
    "explode_lines",
    with_files(
        "SELECT path, CAST(unnest(range(1, len(arr) + 1)) AS BIGINT) AS line_no, unnest(arr) AS line "
        "FROM (SELECT path, string_split(content, chr(10)) AS arr FROM files) f"
    ),
)
def explode_lines(spark: SparkSession, sf: str) -> DataFrame:
    return lines.explode_lines(corpus.corpus_files(spark, sf))


@query(
    "package_names",
    with_base(
        "SELECT path, CASE lang WHEN 'java' THEN 'com.' || source || '.p' || sid WHEN 'go' THEN 'p' || sid "
        "WHEN 'csharp' THEN 'Acme.' || source || '.P' || sid ELSE 'org.' || source || '.p' || sid END AS package_name "
        f"FROM base WHERE lang IN ('java','go','csharp','kotlin') AND {K}"
    ),
)
def package_names(spark: SparkSession, sf: str) -> DataFrame:
    return modules.package_names(kept_files(spark, sf))


@query("module_docs", with_base(f"SELECT path, {MODULE_DOC} AS docstring FROM base WHERE {K} AND lang IN ('python','typescript','rust')"))
def module_docs(spark: SparkSession, sf: str) -> DataFrame:
    return modules.module_docs(kept_files(spark, sf)).where("docstring <> ''").select("path", "docstring")


@query("class_bases", with_base(corpus.expected_lists_sql("bases")))
def class_bases(spark: SparkSession, sf: str) -> DataFrame:
    return catalog(spark, sf).where("kind = 'class'").select(
        "path", "name", "line_number", F.posexplode("bases").alias("p", "base")
    ).select("path", "name", "line_number", F.col("p").cast("bigint").alias("pos"), "base")


@query(
    "decorators",
    with_base(f"SELECT path, name, line_number, decorators_text FROM {expected_symbols(['python'])} s WHERE decorators_text <> ''"),
)
def decorators(spark: SparkSession, sf: str) -> DataFrame:
    return catalog(spark, sf, "python").where(F.size("decorators") > 0).select(
        "path", "name", "line_number", F.array_join("decorators", "|").alias("decorators_text")
    )


@query("async_symbols", with_base(f"SELECT path, lang, name, line_number FROM {SYM} s WHERE is_async"))
def async_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return catalog(spark, sf).where("is_async").select("path", "lang", "name", "line_number")


@query("signatures", with_base(f"SELECT path, line_number, signature FROM {SYM} s"))
def signatures(spark: SparkSession, sf: str) -> DataFrame:
    return catalog(spark, sf).select("path", "line_number", "signature")


@query(
    "quarantine_syntax",
    with_base(
        f"SELECT path, {corpus.BREAK_REASON} AS reason FROM base WHERE lang = 'python' AND {corpus.BROKEN} AND NOT ({corpus.EMPTY})"
    ),
)
def quarantine_syntax(spark: SparkSession, sf: str) -> DataFrame:
    return src.quarantine_syntax(tagged(spark, sf))[1]


# Windows

@query("nesting_depth", with_base(f"SELECT path, line_no, depth FROM ({corpus.expected_lines_sql()}) l"))
def nesting_depth(spark: SparkSession, sf: str) -> DataFrame:
    return lines.nesting_depth(tagged(spark, sf), specs.SPECS)


@query("logical_lines", with_base(f"SELECT path, line_no, n_lines FROM ({corpus.expected_lines_sql('H')}) l"))
def logical_lines(spark: SparkSession, sf: str) -> DataFrame:
    return lines.logical_lines(tagged(spark, sf), specs.SPECS).select("path", "line_no", "n_lines")


@query("enclosing_scope", with_base(f"SELECT path, name, line_number, parent_name FROM {SYM} s WHERE parent_name <> ''"))
def enclosing_scope(spark: SparkSession, sf: str) -> DataFrame:
    return catalog(spark, sf).where("parent_name <> ''").select("path", "name", "line_number", "parent_name")


@query("doc_blocks", with_base(f"SELECT path, name, line_number, docstring FROM {SYM} s WHERE docstring <> ''"))
def doc_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return catalog(spark, sf).where("docstring <> ''").select("path", "name", "line_number", "docstring")


@query("go_receiver_methods", with_base(f"SELECT path, name, parent_name, line_number FROM {expected_symbols(['go'])} s WHERE kind = 'method'"))
def go_receiver_methods(spark: SparkSession, sf: str) -> DataFrame:
    return catalog(spark, sf, "go").where("kind = 'method'").select("path", "name", "parent_name", "line_number")


@query("rust_impl_methods", with_base(f"SELECT path, name, parent_name, line_number FROM {expected_symbols(['rust'])} s WHERE kind = 'method'"))
def rust_impl_methods(spark: SparkSession, sf: str) -> DataFrame:
    return catalog(spark, sf, "rust").where("kind = 'method'").select("path", "name", "parent_name", "line_number")


# Documentation text

def _docs(name: str, langs: list[str]) -> None:
    query(name, with_base(f"SELECT path, name, line_number, docstring FROM {expected_symbols(langs)} s WHERE docstring <> ''"))(
        lambda spark, sf: catalog(spark, sf, *langs).where("docstring <> ''").select("path", "name", "line_number", "docstring")
    )


_docs("clean_block_docs", ["typescript", "java", "cpp", "kotlin"])
_docs("clean_line_docs", ["go", "rust", "ruby"])
_docs("clean_xml_docs", ["csharp"])


@query("doc_summaries", with_base(f"SELECT path, name, line_number, string_split(docstring, chr(10))[1] AS summary FROM {SYM} s WHERE docstring <> ''"))
def doc_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return catalog(spark, sf).where("docstring <> ''").select(
        "path", "name", "line_number", text.first_line(F.col("docstring")).alias("summary")
    )


# Counts and order

@query("project_counts", with_base(
    "SELECT count(*) AS n_modules, CAST(sum(n_functions) AS BIGINT) AS n_functions, CAST(sum(n_classes) AS BIGINT) AS n_classes "
    f"FROM {MODULES_SQL} m WHERE n_functions > 0 OR n_classes > 0 OR docstring <> ''"))
def project_counts(spark: SparkSession, sf: str) -> DataFrame:
    return modules.project_counts(corpus_modules(spark, sf))


@query("module_counts", with_base(
    "SELECT path, count(*) FILTER (WHERE kind = 'function') AS n_functions, "
    f"count(*) FILTER (WHERE kind = 'class') AS n_classes FROM {SYM} s GROUP BY path"))
def module_counts(spark: SparkSession, sf: str) -> DataFrame:
    return modules.module_counts(catalog(spark, sf))


_DOC = "struct_pack(line_number := line_number, name := name, signature := signature, docstring := docstring)"


@query("module_documents", with_base(
    f"SELECT path, module_name, CAST(to_json(coalesce(list(cls ORDER BY line_number) FILTER (WHERE is_class), [])) AS VARCHAR) AS classes, "
    "CAST(to_json(coalesce(list(fn ORDER BY line_number) FILTER (WHERE NOT is_class), [])) AS VARCHAR) AS functions FROM ("
    "SELECT c.path, c.module_name, c.line_number, TRUE AS is_class, struct_pack(line_number := c.line_number, name := c.name, "
    "signature := c.signature, docstring := c.docstring, methods := coalesce(m.methods, [])) AS cls, NULL AS fn "
    f"FROM {SYM} c LEFT JOIN (SELECT path, parent_name, list({_DOC} ORDER BY line_number) AS methods FROM {SYM} s WHERE kind = 'method' "
    "GROUP BY path, parent_name) m ON c.path = m.path AND c.name = m.parent_name WHERE c.kind = 'class' UNION ALL "
    f"SELECT path, module_name, line_number, FALSE, NULL, {_DOC} FROM {SYM} s WHERE kind = 'function') u GROUP BY path, module_name"))
def module_documents(spark: SparkSession, sf: str) -> DataFrame:
    return modules.module_documents(catalog(spark, sf)).select(
        "path", "module_name", F.to_json("classes").alias("classes"), F.to_json("functions").alias("functions")
    )


@query("files_sorted", with_files("SELECT path, sha256(content) AS sha256 FROM files ORDER BY path"))
def files_sorted(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.corpus_files(spark, sf).select("path", text.sha256_hex(F.col("content")).alias("sha256")).orderBy("path")


@query("module_order", with_base(
    "SELECT path, lang, row_number() OVER (ORDER BY lang, path) AS module_ord "
    f"FROM {MODULES_SQL} m WHERE n_functions > 0 OR n_classes > 0 OR docstring <> ''"))
def module_order(spark: SparkSession, sf: str) -> DataFrame:
    return modules.module_order(corpus_modules(spark, sf)).select("path", "lang", "module_ord")


TOC_SQL = (
    "SELECT path, row_number() OVER (PARTITION BY path ORDER BY CASE kind WHEN 'class' THEN 0 ELSE 1 END, line_number) AS toc_pos, "
    f"kind, name, is_deprecated, line_number FROM {SYM} s WHERE kind IN ('class','function')"
)


@query("module_toc", with_base(TOC_SQL))
def module_toc(spark: SparkSession, sf: str) -> DataFrame:
    return modules.module_toc(catalog(spark, sf))


@query("truncate_fields", with_base(
    "SELECT path, line_number, substring(signature, 1, 200) AS signature_cut, substring(docstring, 1, 1500) AS body_cut, "
    "substring(docstring, 1, 6000) AS source_cut, CASE WHEN length(docstring) > 120 THEN substring(docstring, 1, 120) || '...' "
    f"ELSE docstring END AS preview FROM {SYM} s"))
def truncate_fields(spark: SparkSession, sf: str) -> DataFrame:
    doc = F.col("docstring")
    return catalog(spark, sf).select(
        "path", "line_number",
        text.truncate(F.col("signature"), fv.SIGNATURE_LIMIT).alias("signature_cut"),
        text.truncate(doc, fv.BODY_LIMIT).alias("body_cut"),
        text.truncate(doc, fv.GENERIC_SOURCE_LIMIT).alias("source_cut"),
        text.truncate(doc, fv.PREVIEW_LIMIT, "...").alias("preview"),
    )


@query("content_sha256", with_files("SELECT path, sha256(content) AS sha256 FROM files"))
def content_sha256(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.corpus_files(spark, sf).select("path", text.sha256_hex(F.col("content")).alias("sha256"))


@query("content_sha1", "SELECT page_id, sha1(html) AS sha1 FROM pages")
def content_sha1(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", text.sha1_hex(F.col("html")).alias("sha1"))


@query(
    "html_escape",
    "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), "
    "'\"', '&#34;'), chr(39), '&#39;') AS escaped FROM pages",
)
def html_escape(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", text.html_escape(F.col("html")).alias("escaped"))


# A language added as data

FLOW = specs.LangSpec(
    name="flow", extensions=(".flow",), literals=r"#[^\n]*|" + specs.DOUBLE_QUOTED, comment="^#", doc_style="line",
    doc_line=r"^\s*#", annotation="", param_style="untyped",
    decls=(
        specs.Decl("class", r"^\s*stage\s+(\w+)(?:\s+after\s+([^{]*?))?\s*\{", bases=2),
        specs.Decl("function", rf"^(\s*task\s+(\w+)\s*\(){specs.PARAMS}\)", where="any", head=1, name=2, params=3),
    ),
)
_FLOW_FILE = (
    "'# ' || replace(prose, chr(10), chr(10) || '# ') || chr(10) || 'stage S' || sid || ' after A, B {' || chr(10) || "
    "'  task run(x, y = 1) {' || chr(10) || '  }' || chr(10) || '}' || chr(10) || 'task top_' || sid || '() {' || chr(10) || '}'"
)


@query("custom_language", with_base(
    "SELECT 'f' || sid || '.flow' AS path, 'class' AS kind, 'S' || sid AS name, '' AS parent_name, "
    "'class S' || sid || '(A, B)' AS signature, prose AS docstring, nl + 1 AS line_number FROM base UNION ALL "
    "SELECT 'f' || sid || '.flow', 'method', 'run', 'S' || sid, 'def run(x, y = 1)', '', nl + 2 FROM base UNION ALL "
    "SELECT 'f' || sid || '.flow', 'function', 'top_' || sid, '', 'def top_' || sid || '()', '', nl + 5 FROM base"))
def custom_language(spark: SparkSession, sf: str) -> DataFrame:
    known = specs.register_language(FLOW)
    flow = {"flow": known["flow"]}
    files = corpus.corpus_base(spark, sf).selectExpr("'f' || sid || '.flow' AS path", f"{_FLOW_FILE} AS content")
    return symbols.extract_symbols(src.tag_language(files, known), flow).select(
        "path", "kind", "name", "parent_name", "signature", "docstring", "line_number"
    )
