"""Row filters of the catalog as boolean expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from codecatalog import fixed_values as fv
from codecatalog.functions.text import strip


def glob_to_regex(glob: str) -> str:
    escaped = "".join("\\" + c if c in ".+()[]{}^$|\\" else c for c in glob)
    return "^" + escaped.replace("*", ".*").replace("?", ".") + "$"


def in_excluded_dir(path: Column, names: Sequence[str] = tuple(fv.DEFAULT_EXCLUDES)) -> Column:
    """True if any part of the corpus-relative path equals a name or matches a glob."""
    parts = F.split(path, "/")
    plain = [n for n in names if "*" not in n and "?" not in n]
    globs = [glob_to_regex(n) for n in names if n not in plain]
    test = F.lit(False)
    if plain:
        test = test | F.arrays_overlap(parts, F.array(*[F.lit(n) for n in plain]))
    if globs:
        any_glob = "|".join(globs)
        test = test | F.exists(parts, lambda p: p.rlike(any_glob))
    return test


def is_private(name: Column) -> Column:
    """One leading underscore; two mark a special name and stay public."""
    return name.startswith("_") & ~name.startswith("__")


def is_exported(name: Column) -> Column:
    return name.rlike("^[A-Z]")


def is_control_word(name: Column) -> Column:
    return name.isin(*fv.CONTROL_WORDS)


def is_macro_name(name: Column) -> Column:
    return (F.upper(name) == name) & name.rlike("[A-Z]")


def deprecated_expr(docstring: Column, decorators: Column) -> Column:
    """A decorator or attribute says so, or the documentation has the word."""
    marked = F.exists(
        decorators, lambda d: F.contains(F.lower(d), F.lit("deprecated")) | d.contains("[Obsolete")
    )
    return marked | docstring.rlike(r"(?i)\bdeprecated\b")


def lacks_docs(docstring: Column, name: Column) -> Column:
    return (strip(docstring) == "") & ~is_private(name)
