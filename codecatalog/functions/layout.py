"""Syntax of files whose blocks are indented, by a stack of open brackets and one of indentations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codecatalog.functions.folds import CLOSING, OPENING

#: Brackets, joined lines, the beginnings of lines that hold something, and colons that end a line.
_TOKENS = r"[\[\](){}]|\\\n|\n[ \t\f\n]*+(?=\S)|:(?=[ \t\f]*+(?:\n|$))"


def layout_problem(code: Column) -> Column:
    """Why the lines of ``code`` can't be blocks, else null. Comments must be blank and strings without line feeds."""
    tokens = F.regexp_extract_all(F.concat(F.lit("\n"), F.rtrim(code)), F.lit(_TOKENS), F.lit(0))
    start = F.struct(
        F.lit("").alias("brackets"),
        F.array(F.lit(0)).alias("margins"),
        F.lit(False).alias("opens"),  # the line before ended with a colon
        F.lit("").alias("problem"),
    )

    def bracket(acc: Column, token: Column) -> Column:
        opening = F.translate(token, CLOSING, OPENING)
        held = acc["brackets"]
        return (
            F.when(token == opening, F.concat(token, held))
            .when(F.left(held, F.lit(1)) == opening, F.substring(held, F.lit(2), F.length(held)))
            .otherwise("!")
        )

    def line(acc: Column, token: Column) -> Column:
        width = F.length(F.replace(F.substring_index(token, "\n", -1), F.lit("\t"), F.lit(" " * 8)))
        margins, last = acc["margins"], F.element_at(acc["margins"], -1)
        left = F.filter(margins, lambda m: m <= width)
        problem = (
            F.when(acc["opens"] & (width <= last), "missing body")
            .when(~acc["opens"] & (width > last), "unexpected indent")
            .when((width < last) & (F.element_at(left, -1) != width), "unindent to an unknown level")
            .otherwise("")
        )
        return F.struct(
            acc["brackets"].alias("brackets"),
            F.when(width > last, F.array_append(margins, width)).otherwise(left).alias("margins"),
            F.lit(False).alias("opens"),
            problem.alias("problem"),
        )

    def step(acc: Column, token: Column) -> Column:
        same = lambda **new: F.struct(*(new.get(n, acc[n]).alias(n) for n in ("brackets", "margins", "opens", "problem")))
        outside = acc["brackets"] == ""
        return (
            F.when((acc["problem"] != "") | token.startswith("\\"), acc)
            .when(token.startswith("\n"), F.when(outside, line(acc, token)).otherwise(acc))
            .when(token == ":", same(opens=acc["opens"] | outside))
            .otherwise(same(brackets=bracket(acc, token)))
        )

    def verdict(acc: Column) -> Column:
        return (
            F.when(acc["problem"] != "", acc["problem"])
            .when(acc["brackets"] != "", "unbalanced brackets")
            .when(acc["opens"], "missing body")
        )

    return F.aggregate(tokens, start, step, verdict)
