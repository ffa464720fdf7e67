"""Files to numbered lines, with comments and literals blanked.

Masking looks at one file value at a time and needs no shuffle: the literals of a file are cut out by
one regular expression, blanked to equal length, and put back between the gaps.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from codecatalog.functions.folds import flat_brackets
from codecatalog.functions.text import let, strip
from codecatalog.lexers import lexed
from codecatalog.specs import LangSpec


def line_window() -> WindowSpec:
    return Window.partitionBy("path").orderBy("line_no")


def before() -> WindowSpec:
    """All earlier lines of the file."""
    return line_window().rowsBetween(Window.unboundedPreceding, -1)


def up_to_here() -> WindowSpec:
    return line_window().rowsBetween(Window.unboundedPreceding, 0)


_RUBY_OPEN = r"^\s*(?:class|module|def|if|unless|while|until|for|case|begin)\b"
_RUBY_DO = r"\bdo\b\s*(?:\|[^|]*\|)?\s*$"
_RUBY_LOOP = r"^\s*(?:while|until|for)\b"
_RUBY_ONE_LINE = r"\bend\s*$|^\s*def\s+[^=]*\)\s*=\s|^\s*def\s+\w+\s+=\s"
_RUBY_CLOSE = r"^\s*end\b"


def by_language(
    specs: Mapping[str, LangSpec], expr: Callable[[LangSpec], Column], default: Column | None = None
) -> Column:
    """One literal expression per language; only the row's own branch is evaluated."""
    default = F.lit(None) if default is None else default
    chain = F
    for spec in specs.values():
        chain = chain.when(F.col("lang") == spec.name, expr(spec))
    return chain.otherwise(default) if specs else default


def per_specs(build: Callable[[Mapping[str, LangSpec]], object]) -> Callable[[Mapping[str, LangSpec]], object]:
    """Build the expressions of a set of languages once per JVM; they only name columns."""
    built: dict = {}

    def cached(specs: Mapping[str, LangSpec]):
        key = (id(SparkContext._gateway), tuple(specs.values()))
        if key not in built:
            built[key] = build(specs)
        return built[key]

    return cached


def explode_lines(files: DataFrame) -> DataFrame:
    """``(path, line_no, line)``, numbered from 1."""
    return files.select(
        "path", F.posexplode(F.split("content", r"\r\n|\r|\n")).alias("pos", "line")
    ).select("path", (F.col("pos") + 1).cast("bigint").alias("line_no"), "line")


# Stands for each character of a blanked string, so that the string still counts as code.
FILLER = "\u0001"


def _filled(literal: Column, char: str, over_lines: bool = False) -> Column:
    """The literal with every character replaced; line feeds stay unless it is to be one line."""
    if over_lines:
        return F.repeat(F.lit(char), F.length(literal))
    return F.array_join(
        F.transform(F.split(literal, "\n"), lambda x: F.repeat(F.lit(char), F.length(x))), "\n"
    )


def masked_pieces(content: Column, specs: Mapping[str, LangSpec]) -> Column:
    """A file (with line feeds for line ends) in pieces ``struct<t, k>``: text, and its kind c (code), s (string) or m (comment).

    Flat literals are cut out by one pattern. Files whose literals may nest go through the lexer of their language.
    """

    def flat(c: Column) -> Column:
        def parts(c: Column) -> Column:
            return F.struct(
                by_language(
                    specs, lambda s: F.regexp_extract_all(c, F.lit(s.literals), F.lit(0))
                ).alias("literals"),
                by_language(specs, lambda s: F.split(c, s.literals, -1)).alias("gaps"),
            )

        def kinds(p: Column) -> Column:
            return F.transform(
                p["literals"], lambda t: F.when(by_language(specs, lambda s: t.rlike(s.comment)), "m").otherwise("s")
            )

        def pairs(p: Column) -> Column:
            literal = lambda t, k: F.struct(t.alias("t"), k.alias("k"))
            both = F.zip_with(p["literals"], kinds(p), literal)
            gap = lambda g, x: F.array(F.struct(g.alias("t"), F.lit("c").alias("k")), x)
            return F.filter(F.flatten(F.zip_with(p["gaps"], both, gap)), lambda x: x.isNotNull())

        return let(parts(c), pairs)

    def nested(c: Column, spec: LangSpec) -> Column:
        return let(lexed(c, spec.lexer), lambda x: F.zip_with(x["tokens"], x["kinds"], lambda t, k: F.struct(t.alias("t"), k.alias("k"))))

    chain = F
    for spec in specs.values():
        if spec.lexer is not None:
            chain = chain.when((F.col("lang") == spec.name) & content.rlike(spec.lexer.needed), nested(content, spec))
    return chain.otherwise(flat(content)) if chain is not F else flat(content)


def masked_struct(content: Column, specs: Mapping[str, LangSpec], over_lines: bool = False) -> Column:
    """``struct<line, code, text>`` of one file: as it is, and with literals blanked to equal length.

    ``code`` has comments and strings blanked, ``text`` only comments. With ``over_lines`` a string is blanked with its line
    feeds, so that ``code`` has a line for each line that isn't within one.
    """

    def blanked(x: Column) -> Column:
        string = F.when(x["k"].isNull() | (x["k"] != "c"), _filled(x["t"], FILLER, over_lines))
        filled = F.when(x["k"] == "m", _filled(x["t"], " ")).otherwise(string)
        return F.struct(x["t"].alias("t"), x["k"].alias("k"), filled.alias("filled"))

    def woven(c: Column, p: Column) -> Column:
        code = F.transform(p, lambda x: F.when(x["k"] == "c", x["t"]).otherwise(x["filled"]))
        text = F.transform(p, lambda x: F.when(x["k"] == "m", x["filled"]).otherwise(x["t"]))
        return F.struct(c.alias("line"), F.array_join(code, "").alias("code"), F.array_join(text, "").alias("text"))

    normal = F.regexp_replace(content, r"\r\n?", "\n")
    return let(normal, lambda c: let(F.transform(masked_pieces(c, specs), blanked), lambda p: woven(c, p)))


def code_alone(content: Column, specs: Mapping[str, LangSpec]) -> Column:
    """What a compiler reads of a file: its code without comments, with runs of white space as one, and none where it parts
    nothing. Line ends stay, as they end statements in some languages; strings stay as they are."""
    blanks, kept = " \t\n", "\u0010\u0011\u0012"

    def unread(text: Column) -> Column:
        return by_language(specs, lambda s: ~text.rlike(s.directive) if s.directive else F.lit(True))

    def pieces(p: Column) -> Column:
        plain = lambda x: F.when((x["k"] == "m") & unread(x["t"]), F.lit(" ")).otherwise(F.translate(x["t"], blanks, kept))
        return F.transform(p, lambda x: F.when(x["k"] == "c", x["t"]).otherwise(plain(x)))

    normal = F.regexp_replace(content, r"\r\n?", "\n")
    joined = let(normal, lambda c: let(masked_pieces(c, specs), lambda p: F.array_join(pieces(p), "")))
    lines = F.regexp_replace(joined, r"\s*\n\s*", "\n")
    return F.btrim(F.regexp_replace(F.regexp_replace(lines, r"[ \t\f]+", " "), r"(?<!\w) | (?!\w)", ""), F.lit(blanks))


def _count(col: Column, char: str) -> Column:
    return F.octet_length(col) - F.octet_length(F.replace(col, F.lit(char), F.lit("")))


def _net(spec: LangSpec, code: Column) -> Column:
    """Change of nesting depth made by one line."""
    if spec.scope == "brace":
        return _count(code, "{") - _count(code, "}")
    if spec.scope == "end":
        opens = (code.rlike(_RUBY_OPEN) & ~code.rlike(_RUBY_ONE_LINE)).cast("int") + (
            code.rlike(_RUBY_DO) & ~code.rlike(_RUBY_LOOP)
        ).cast("int")
        return opens - code.rlike(_RUBY_CLOSE).cast("int")
    return F.lit(0)


def _round_net(spec: LangSpec, code: Column) -> Column:
    if spec.scope == "indent":
        return sum((_count(code, c) for c in "([{"), F.lit(0)) - sum((_count(code, c) for c in ")]}"), F.lit(0))
    return _count(code, "(") - _count(code, ")")


@per_specs
def _line_rows(specs: Mapping[str, LangSpec]) -> Column:
    return let(
        masked_struct(F.col("content"), specs),
        lambda m: F.arrays_zip(*[F.split(m[part], "\n").alias(part) for part in ("line", "code", "text")]),
    )


@per_specs
def _net_columns(specs: Mapping[str, LangSpec]) -> dict[str, Column]:
    # Most lines are text of comments, whose code is spaces: a cheap test spares them the patterns.
    bare = F.trim("code") == ""
    return {
        "net": F.when(bare, 0).otherwise(by_language(specs, lambda s: _net(s, F.col("code")))),
        "round_net": F.when(bare, 0).otherwise(by_language(specs, lambda s: _round_net(s, F.col("code")))),
    }


def code_lines(files: DataFrame, specs: Mapping[str, LangSpec]) -> DataFrame:
    """``(path, lang, line_no, line, code, text, net, round_net)``: one row per line, still unshuffled."""
    rows = files.select("path", "lang", F.posexplode(_line_rows(specs)).alias("pos", "r"))
    return rows.select(
        "path",
        "lang",
        (F.col("pos") + 1).cast("bigint").alias("line_no"),
        F.col("r.line").alias("line"),
        F.col("r.code").alias("code"),
        F.col("r.text").alias("text"),
    ).withColumns(_net_columns(specs))


def with_depth(lines: DataFrame) -> DataFrame:
    """Nesting depth and open round brackets before each line."""
    return lines.withColumns(
        {
            "depth": F.coalesce(F.sum("net").over(before()), F.lit(0)),
            "open_round": F.coalesce(F.sum("round_net").over(before()), F.lit(0)),
        }
    )


@per_specs
def row_kind(specs: Mapping[str, LangSpec]) -> Column:
    """Blank, Message (comment only), Text (string only), Annotation or Head (code)."""
    code_blank = (F.trim("code") == "") | ~F.col("code").rlike(rf"[^\s{FILLER}]")
    text_blank = (F.trim("text") == "") | ~F.col("text").rlike(r"\S")
    annotation = let(
        flat_brackets(F.col("code")),
        lambda code: by_language(specs, lambda s: code.rlike(s.annotation) if s.annotation else F.lit(False)),
    )
    return (
        F.when(~F.col("line").rlike(r"\S"), "B")
        .when(code_blank, F.when(text_blank, "M").otherwise("T"))
        .when(annotation, "A")
        .otherwise("H")
    )


def with_heads(lines: DataFrame) -> DataFrame:
    """Number the logical lines of each file.

    A line that starts while a round bracket is open continues the logical line (or annotation)
    before it. ``seg`` ties comments and annotations to the code line that follows, and continuation
    lines and string-only lines to the one before.
    """
    kinds = lines.withColumn("kind", F.when(F.col("open_round") > 0, "C").otherwise(F.col("kind0")))
    is_head = F.col("kind") == "H"
    starts = kinds.withColumns(
        {
            "heads_before": F.coalesce(F.sum(is_head.cast("bigint")).over(before()), F.lit(0)),
            "started_by": F.last(
                F.when(F.col("kind").isin("H", "A"), F.col("kind")), ignorenulls=True
            ).over(before()),
            "head_before": F.last(F.when(is_head, F.col("line_no")), ignorenulls=True).over(before()),
            "blank_before": F.last(F.when(F.col("kind") == "B", F.col("line_no")), ignorenulls=True).over(
                before()
            ),
        }
    )
    belongs_back = ((F.col("kind") == "C") & (F.col("started_by") == "H")) | (F.col("kind") == "T")
    return starts.withColumn(
        "seg", F.col("heads_before") - F.coalesce(belongs_back, F.lit(False)).cast("int")
    )


def nesting_depth(files: DataFrame, specs: Mapping[str, LangSpec]) -> DataFrame:
    return with_depth(code_lines(files, specs)).select(
        "path", "line_no", F.col("depth").cast("bigint").alias("depth")
    )


def logical_lines(files: DataFrame, specs: Mapping[str, LangSpec]) -> DataFrame:
    """``(path, line_no, n_lines, code)``: declarations that span lines become one line."""
    lines = code_lines(files, specs).withColumn("kind0", row_kind(specs))
    rows = with_heads(with_depth(lines))
    return (
        rows.where((F.col("kind") == "H") | ((F.col("kind") == "C") & (F.col("started_by") == "H")))
        .groupBy("path", "seg")
        .agg(
            F.min("line_no").alias("line_no"),
            F.count("*").alias("n_lines"),
            F.array_sort(F.collect_list(F.struct("line_no", "code"))).alias("parts"),
        )
        .select(
            "path",
            "line_no",
            "n_lines",
            strip(
                F.regexp_replace(F.array_join(F.transform("parts", lambda r: r["code"]), " "), r"\s+", " ")
            ).alias("code"),
        )
    )
