"""Modules: documentation, package names, counts, nested documents and page paths."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codecatalog.functions.docs import clean_block, clean_docstring, clean_line
from codecatalog.functions.text import first_line, module_name, page_base, path_ext
from codecatalog.operators.lines import by_language, code_lines
from codecatalog.operators.ordering import with_dense_order
from codecatalog.specs import SPECS, LangSpec

# The string statement that opens an indentation-scoped file, after blank and comment lines.
_OPENING_STRING = r"^(?:\s++|#[^\n]*+\n)*+([rRuU]{0,2}(?:\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"[^\"\n]*\"|'[^'\n]*')) *(?:\n|$)"


def _module_doc(spec: LangSpec) -> Column:
    content = F.regexp_replace("content", r"\r\n?", "\n")
    if spec.doc_style == "string":
        literal = F.regexp_extract(content, _OPENING_STRING, 1)
        return F.when(literal != "", clean_docstring(literal)).otherwise("")
    if not spec.module_doc:
        return F.lit("")
    start = F.regexp_instr(content, F.lit(spec.module_doc))
    found = (start > 0) & (start <= spec.module_doc_within)
    lines = F.split(F.regexp_extract(content, spec.module_doc, 1), "\n")
    cleaned = clean_block(lines, spec.tag_marks) if spec.doc_style == "block" else clean_line(lines)
    return F.when(found, cleaned).otherwise("")


def module_docs(files: DataFrame, specs: Mapping[str, LangSpec] = SPECS) -> DataFrame:
    """``(path, lang, module_name, docstring)`` of each file; reads one file value at a time."""
    return files.select(
        "path",
        "lang",
        module_name(F.col("path")).alias("module_name"),
        by_language(specs, _module_doc, F.lit("")).alias("docstring"),
    )


def package_names(files: DataFrame, specs: Mapping[str, LangSpec] = SPECS) -> DataFrame:
    """``(path, package_name)``: the first package or namespace line of a file."""
    named = {n: s for n, s in specs.items() if s.package}
    found = code_lines(files.where(F.col("lang").isin(*named)), named).select(
        "path",
        "line_no",
        by_language(named, lambda s: F.regexp_extract("code", s.package, 1)).alias("package_name"),
    )
    return (
        found.where("package_name <> ''")
        .groupBy("path")
        .agg(F.min_by("package_name", "line_no").alias("package_name"))
    )


def module_counts(symbols: DataFrame) -> DataFrame:
    """Top-level functions and classes of each file."""
    return symbols.groupBy("path").agg(
        F.count_if(F.col("kind") == "function").alias("n_functions"),
        F.count_if(F.col("kind") == "class").alias("n_classes"),
    )


def all_modules(docs: DataFrame, symbols: DataFrame) -> DataFrame:
    counts = module_counts(symbols)
    return docs.join(counts, "path", "left").fillna(0, ["n_functions", "n_classes"])


def modules(docs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Modules that hold a function, a class or documentation."""
    return all_modules(docs, symbols).where("n_functions > 0 OR n_classes > 0 OR docstring <> ''")


def project_counts(modules_: DataFrame) -> DataFrame:
    return modules_.agg(
        F.count("*").alias("n_modules"),
        F.coalesce(F.sum("n_functions"), F.lit(0)).alias("n_functions"),
        F.coalesce(F.sum("n_classes"), F.lit(0)).alias("n_classes"),
    )


def with_page_path(modules_: DataFrame, suffix: str) -> DataFrame:
    """Give every module a page of its own.

    The first file by path keeps the plain page path; files that would overwrite it get ``~ext``, and
    ``~ext~n`` if even that is taken twice. Only files of one dotted name share a window group.
    """
    base = page_base(F.col("module_name"))
    ext = F.ltrim(path_ext(F.col("path")), F.lit("."))
    by_page = Window.partitionBy("_base").orderBy("path")
    by_ext = Window.partitionBy("_base", "_ext", "_moved").orderBy("path")
    ranked = (
        modules_.withColumns({"_base": base, "_ext": ext})
        .withColumn("_moved", (F.row_number().over(by_page) > 1) | (F.col("_base") == "index"))
        .withColumn("_nth", F.row_number().over(by_ext))
    )
    mark = F.when(
        F.col("_moved"),
        F.concat(
            F.lit("~"), F.col("_ext"), F.when(F.col("_nth") > 1, F.concat(F.lit("~"), F.col("_nth"))).otherwise("")
        ),
    ).otherwise("")
    return ranked.withColumn("page_path", F.concat("_base", mark, F.lit(suffix))).drop(
        "_base", "_ext", "_moved", "_nth"
    )


def module_order(modules_: DataFrame) -> DataFrame:
    """Add ``module_ord``: position by language, then path."""
    return with_dense_order(modules_, "lang", "path", name="module_ord")


def search_modules(modules_: DataFrame, text: str) -> DataFrame:
    return modules_.where(F.contains(F.lower("module_name"), F.lit(text.lower())))


def module_summaries(modules_: DataFrame) -> DataFrame:
    return modules_.withColumn("summary", first_line(F.col("docstring")))


def with_class_line(symbols: DataFrame) -> DataFrame:
    """Add ``class_line``: the line of the class a row is or belongs to."""
    key = F.when(F.col("kind") == "method", F.col("parent_name")).otherwise(F.col("name"))
    line = F.min(F.when(F.col("kind") == "class", F.col("line_number"))).over(
        Window.partitionBy("path", "_key")
    )
    return (
        symbols.withColumn("_key", key)
        .withColumn(
            "class_line",
            F.when(F.col("kind") == "class", F.col("line_number")).when(F.col("kind") == "method", line),
        )
        .drop("_key")
    )


def module_documents(symbols: DataFrame) -> DataFrame:
    """``(path, module_name, classes, functions)`` with methods inside their class, in source order."""
    method = F.struct("line_number", "name", "signature", "docstring")
    classes = (
        with_class_line(symbols.where("kind IN ('class','method')"))
        .where("class_line IS NOT NULL")
        .groupBy("path", "module_name", "class_line")
        .agg(
            *[
                F.max(F.when(F.col("kind") == "class", F.col(c))).alias(c)
                for c in ("name", "signature", "docstring")
            ],
            F.array_sort(F.collect_list(F.when(F.col("kind") == "method", method))).alias("methods"),
        )
        .select(
            "path",
            "module_name",
            F.struct(
                F.col("class_line").alias("line_number"), "name", "signature", "docstring", "methods"
            ).alias("class_doc"),
            F.lit(None).cast("struct<line_number:bigint,name:string,signature:string,docstring:string>").alias("function_doc"),
        )
    )
    functions = symbols.where("kind = 'function'").select(
        "path", "module_name", F.lit(None).alias("class_doc"), method.alias("function_doc")
    )
    return (
        classes.unionByName(functions)
        .groupBy("path", "module_name")
        .agg(
            F.array_sort(F.collect_list("class_doc")).alias("classes"),
            F.array_sort(F.collect_list("function_doc")).alias("functions"),
        )
    )


def module_toc(symbols: DataFrame) -> DataFrame:
    """Contents of each module: classes, then functions, in source order."""
    order = Window.partitionBy("path").orderBy("kind_rank", "line_number")
    return (
        symbols.where("kind IN ('class','function')")
        .withColumn("kind_rank", F.when(F.col("kind") == "class", 0).otherwise(1))
        .withColumn("toc_pos", F.row_number().over(order).cast("bigint"))
        .select("path", "toc_pos", "kind", "name", "is_deprecated", "line_number")
    )
