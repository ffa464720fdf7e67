"""Scalar expressions over paths and text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from codecatalog import fixed_values as fv

BLANKS = " \t\r\n"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, wherever the optimizer moves the expression."""
    return F.transform(F.array(value), body)[0]


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(BLANKS))


def is_blank(col: Column) -> Column:
    return strip(col) == ""


def collapse_spaces(col: Column) -> Column:
    return strip(F.regexp_replace(col, r"\s+", " "))


def path_ext(path: Column) -> Column:
    """Suffix from the last dot of the file name, case-sensitive; '' when there is none."""
    return F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)


def path_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]+$", "")


def module_name(path: Column) -> Column:
    """Dotted corpus-relative path; a final ``__init__`` or ``index`` part is dropped.

    A package file in the corpus root has no directory to be named after and keeps its stem.
    """
    bare = F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", "")
    return F.translate(F.regexp_replace(bare, r"/(?:__init__|index)$", ""), "/", ".")


def page_base(module: Column) -> Column:
    return F.translate(module, ".", "/")


def page_path(module: Column, suffix: str) -> Column:
    return F.concat(page_base(module), F.lit(suffix))


def root_prefix(page: Column) -> Column:
    return F.repeat(F.lit("../"), F.size(F.split(page, "/")) - 1)


def first_line(doc: Column) -> Column:
    return F.substring_index(doc, "\n", 1)


def html_escape(col: Column) -> Column:
    for char, entity in fv.HTML_ENTITIES:
        col = F.replace(col, F.lit(char), F.lit(entity))
    return col


def truncate(col: Column, limit: int, mark: str = "") -> Column:
    if not mark:
        return F.substring(col, 1, limit)
    return F.when(
        F.length(col) > limit, F.concat(F.substring(col, 1, limit), F.lit(mark))
    ).otherwise(col)


def content_type(path: Column) -> Column:
    ext = F.lower(path_ext(path))
    chain = F
    for suffix, mime in fv.CONTENT_TYPES.items():
        chain = chain.when(ext == suffix, mime)
    return chain.otherwise(F.lit(fv.DEFAULT_CONTENT_TYPE))


def sha256_hex(content: Column) -> Column:
    return F.coalesce(F.sha2(content.cast("binary"), 256), F.lit(""))


def sha1_hex(content: Column) -> Column:
    return F.sha1(content.cast("binary"))


def normalise_quotes(col: Column) -> Column:
    """``"x"`` becomes ``'x'`` when the literal holds no quote or backslash of its own."""
    return F.regexp_replace(col, "\"([^\"'\\\\]*)\"", "'$1'")
