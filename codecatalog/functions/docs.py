"""Cleaning of documentation comments. Each function takes the raw lines of one comment block."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codecatalog.functions.text import let, strip


def _join(lines: Column) -> Column:
    return strip(F.array_join(lines, "\n"))


def clean_block(lines: Column, tag_marks: str = "@") -> Column:
    """``/** … */``: drop the frame and leading stars, then every line that starts with a tag mark."""
    body = F.regexp_replace(
        F.regexp_replace(F.array_join(lines, "\n"), r"^\s*/\*+!?", ""), r"\*+/\s*$", ""
    )
    plain = F.transform(
        F.split(strip(body), "\n"), lambda x: strip(F.regexp_replace(strip(x), r"^\* ?", ""))
    )
    return _join(F.filter(plain, lambda x: ~x.rlike(f"^[{tag_marks}]")))


def clean_line(lines: Column) -> Column:
    """``//``, ``///``, ``//!`` and ``#`` runs: drop the mark and one blank."""
    return _join(F.transform(lines, lambda x: F.regexp_replace(strip(x), r"^(?:///|//!|//|#) ?", "")))


def clean_xml(lines: Column) -> Column:
    """``///`` runs with tags: keep summary text and untagged lines; other tag lines go.

    A summary that opens and closes on one line is closed there. Lines inside a summary that itself
    starts with another tag are kept, so the block is cut into before, inside and after.
    """
    text = F.array_join(F.transform(lines, lambda x: F.regexp_replace(strip(x), r"^/// ?", "")), "\n")
    def outside(part: Column) -> Column:
        return F.filter(F.split(part, "\n"), lambda x: (x != "") & ~strip(x).startswith("<"))

    def piece(part: Column, i: Column) -> Column:
        inside = F.substring_index(part, "</summary>", 1)
        after = strip(F.substring(part, F.length(inside) + len("</summary>") + 1, F.length(part)))
        return F.when(i == 0, outside(strip(part))).otherwise(
            F.concat(F.split(strip(inside), "\n"), outside(after))
        )

    kept = F.flatten(F.transform(F.split(text, "<summary>"), piece))
    return _join(kept)


def clean_docstring(text: Column) -> Column:
    """A quoted docstring: drop prefix and quotes, then dedent the lines after the first."""
    literal = F.regexp_extract(
        text, r"^\s*[rRuUbBfF]{0,2}(?:\"\"\"([\s\S]*?)\"\"\"|'''([\s\S]*?)'''|\"([^\n]*?)\"|'([^\n]*?)')", 0
    )
    inner = F.regexp_replace(
        F.regexp_replace(strip(literal), r"^[rRuUbBfF]{0,2}(?:\"\"\"|'''|\"|')", ""), r"(?:\"\"\"|'''|\"|')$", ""
    )

    def dedent(lines: Column, margin: Column) -> Column:
        return F.transform(
            lines,
            lambda x, i: F.when(i == 0, strip(x)).otherwise(
                F.rtrim(F.substring(x, F.coalesce(margin, F.lit(0)) + 1, F.length(x)))
            ),
        )

    def body(lines: Column) -> Column:
        rest = F.filter(lines, lambda x, i: (i > 0) & (strip(x) != ""))
        margin = F.array_min(F.transform(rest, lambda x: F.length(x) - F.length(F.ltrim(x))))
        return strip(F.array_join(let(margin, lambda m: dedent(lines, m)), "\n"))

    return let(F.split(F.replace(inner, F.lit("\t"), F.lit("        ")), "\n"), body)


def clean_docs(lines: Column, style: str, tag_marks: str = "@") -> Column:
    if style == "line":
        return clean_line(lines)
    if style == "xml":
        return clean_xml(lines)
    if style == "string":
        return clean_docstring(F.array_join(lines, "\n"))
    first = F.element_at(lines, 1)
    return F.when(first.rlike(r"^\s*/\*"), clean_block(lines, tag_marks)).otherwise(clean_line(lines))
