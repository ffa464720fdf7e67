"""Patterns and tests that spare most characters and lines must find what the plain ones find."""

import random

from pyspark.sql import functions as F

from codecatalog import specs
from codecatalog.operators import lines, ordering, render
from codecatalog.plans import page_queries
from codecatalog.sources import files

PIECES = ["/", "*", "//", "/*", "*/", '"', "'", '"""', "'''", "\\", "`", "#", "=begin", "=end", "\n", "\r", "\u0085", " ", " ", "\t", "a", "r", "R", "$", "@", "(", ")", "x{}", 'R"(', 'r#"', '"#', "= "]
LONG = r'"""[\s\S]*?(?:(?<!\\)"""|$)|' + r"'''[\s\S]*?(?:(?<!\\)'''|$)|"
SLASH = r"//[^\n]*|/\*[\s\S]*?\*/"
PLAIN = {
    "python": LONG + specs.DOUBLE_QUOTED + "|" + specs.SINGLE_QUOTED + r"|#[^\n]*",
    "java": SLASH + "|" + specs.TEXT_BLOCK + "|" + specs.DOUBLE_QUOTED + "|" + specs.CHAR,
    "ruby": specs.DOUBLE_QUOTED + "|" + specs.SINGLE_QUOTED + r"|(?m:^=begin[\s\S]*?^=end)|#[^\n]*",
    "rust": SLASH + r'|r#"[\s\S]*?"#|"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"|' + specs.CHAR,
    "cpp": SLASH + r'|R"([^()\\\s"]{0,16})\([\s\S]*?\)\1"|' + specs.DOUBLE_QUOTED + "|" + specs.CHAR + r"|(?m:^[ \t]*#[^\n\\]*+(?:\\[\s\S][^\n\\]*+)*+)",
    "go": SLASH + "|" + specs.DOUBLE_QUOTED + "|" + specs.CHAR + "|`[^`]*`",
    "csharp": SLASH + "|" + specs.TEXT_BLOCK + r'|\$?@\$?"(?:[^"]|"")*+"|' + specs.DOUBLE_QUOTED + "|" + specs.CHAR + r"|(?m:^[ \t]*#[^\n]*)",
    "kotlin": SLASH + "|" + specs.TEXT_BLOCK + "|" + specs.DOUBLE_QUOTED + "|" + specs.CHAR,
}


def test_literals_are_those_of_the_plain_patterns(spark):
    rnd = random.Random(7)
    texts = ["".join(rnd.choices(PIECES, k=rnd.randint(0, 40))) for _ in range(3000)] + ["/*" + "* \n" * 50_000 + "*/ a", '"""' + "a\n" * 50_000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for lang, plain in PLAIN.items():
        now = specs.SPECS[lang].literals
        assert now.startswith("(?="), lang
        found = rows.select(F.regexp_extract_all("t", F.lit(now), F.lit(0)), F.split("t", now, -1))
        # The long texts exhaust the stack of no pattern.
        short = rows.where(F.length("t") < 1000).select(F.regexp_extract_all("t", F.lit(plain), F.lit(0)), F.split("t", plain, -1))
        assert found.collect()[:3000] == short.collect(), lang


def test_kinds_and_nets_of_blank_lines(spark):
    codes = ["", " ", "\t", "  \u0001 ", "\u0001", "   x", "{", "(", " }", " ", "\u0085"]
    rows = spark.createDataFrame([(lang, a, b, c) for lang in specs.SPECS for a in codes for b in codes for c in codes], "lang string, line string, code string, text string")
    blank = ~F.col("code").rlike(r"[^\s\u0001]")
    told = F.when(~F.col("line").rlike(r"\S"), "B").when(blank & ~F.col("text").rlike(r"\S"), "M").when(blank, "T")
    got = rows.select(lines.row_kind(specs.SPECS).alias("kind"), told.alias("told"))
    assert got.where("coalesce(told, 'H') <> CASE kind WHEN 'A' THEN 'H' ELSE kind END").count() == 0
    nets = rows.select("lang", "code").distinct().withColumns(lines._net_columns(specs.SPECS))
    plain = lines.by_language(specs.SPECS, lambda s: lines._net(s, F.col("code"))), lines.by_language(specs.SPECS, lambda s: lines._round_net(s, F.col("code")))
    assert nets.where((F.col("net") != plain[0]) | (F.col("round_net") != plain[1]) | F.col("net").isNull()).count() == 0


def test_other_languages_are_dropped_before_their_content_is_made(spark):
    """The broadcast join alone would make the content of every file first; here only that of Python files can be made."""
    paths = spark.range(20).selectExpr("id", "concat('f', id, CASE WHEN id % 2 = 0 THEN '.py' ELSE '.go' END) AS path")
    made = paths.selectExpr("path", "CASE WHEN id % 2 = 0 THEN 'x = 1' ELSE CAST(CAST(concat('bad', id) AS INT) AS STRING) END AS content")
    rows = files.tag_language(made, {"python": specs.PYTHON}).collect()
    assert len(rows) == 10 and {(r.ext, r.lang, r.content) for r in rows} == {(".py", "python", "x = 1")}


def test_input_of_an_order_is_computed_once(spark):
    """A sort by ranges would compute it for the ranges, too."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(100, numPartitions=4).mapInArrow(count, "id bigint")
    ordered = ordering.with_dense_order(rows, "id").collect()
    assert [r["ord"] for r in sorted(ordered)] == list(range(1, 101)) and seen.value == 100


def test_symbols_of_pages_are_extracted_once(spark, sf_dir):
    """Pages and module counts need them; only the documentation of modules reads the files again."""
    syms, mods = page_queries._catalog(spark, sf_dir)
    plan = render.render_pages(syms, page_queries.modules.with_page_path(mods, ".html"), "html")._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan
