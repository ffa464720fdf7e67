"""Extraction on small sources written for the test."""

import pytest
from pyspark.sql import functions as F

from codecatalog import specs
from codecatalog.functions.docs import clean_docs
from codecatalog.functions.params import parse_params, split_top_level
from codecatalog.operators import fill, lines, modules, symbols
from codecatalog.sources import files as src

PY = '''"""Shapes.

More about shapes.
"""
# a comment: def not_this():
from dataclasses import dataclass

TEXT = """
def inside_text(a):
"""


def area(w: float, h: float = 1.0, *rest, unit: str = "cm", **kw) -> "Area":
    """Area of a box.

        Indented more.
    Back.
    """
    def helper(q):
        return q
    return w * h


@dataclass(
    frozen=True,
)
class Box(Base, metaclass=Meta):
    size: int = 0

    if True:
        def conditional(self):
            pass

    @property
    @cached
    async def volume(self, /, scale: dict[str, int] = {"a": 1}, *, deep=False):
        """.. deprecated:: 2"""
        return 1

    def _hidden(self): return 2

    class Inner:
        def lost(self):
            pass


if TYPE_CHECKING:
    def never(): ...


def last(
    a,  # first
    b=")",
):
    pass
'''

TS = '''/** File doc. */
import x from "y";

/**
 * Makes a box.
 * @param a dropped
 *
 * Second part.
 */
export default async function make<T extends Map<K, V>>(a?: T, { b, c }: Opts, cb: (n: number) => void = () => {}): Promise<Record<string, T>> {
    const re = /[({]/;
    return call(a);
}
// plain
export abstract class Box<T> extends Base<T> implements A, B {
    private size = 1;
    get width(): number { return 1; }
    /* not a doc */
    static async open(path: string): Promise<void>
    {
        if (path) {
        }
    }
}
const pick = async (k) => k;
export type Alias = string;
'''

CS = '''namespace Acme;
/// <summary>
/// Runs.
/// </summary>
/// <returns>x</returns>
public class Runner {
    /// <summary>Goes.</summary> trailing
    [Obsolete("no")]
    public static void Go(params string[] a) { while (a) { b(a); } }
    public int P { get { return x(1); } }
}
'''


def extract(spark, *pairs, **kw):
    files = src.tag_language(spark.createDataFrame(list(pairs), "path string, content string"))
    return {(r.parent_name, r.name): r for r in symbols.extract_symbols(files, **kw).collect()}


def test_python(spark):
    got = extract(spark, ("a/shapes.py", PY))
    assert set(got) == {
        ("", "area"), ("", "Box"), ("Box", "volume"), ("Box", "_hidden"), ("", "last"),
    }
    area = got["", "area"]
    assert area.signature == "def area(w: float, h: float = 1.0, *rest, unit: str = 'cm', **kw) -> 'Area'"
    assert area.docstring == "Area of a box.\n\n    Indented more.\nBack."
    assert area.line_number == 13
    box = got["", "Box"]
    assert (box.bases, box.decorators) == (["Base"], ["dataclass( frozen=True, )"])
    volume = got["Box", "volume"]
    assert volume.decorators == ["property", "cached"]
    assert volume.is_async and volume.is_deprecated and volume.is_method
    assert [tuple(a) for a in volume.args] == [
        ("self", "", ""), ("scale", "dict[str, int]", "{'a': 1}"), ("deep", "", "False"),
    ]
    assert [tuple(a) for a in got["", "last"].args] == [("a", "", ""), ("b", "", "')'")]
    assert area.module_name == "a.shapes"


def test_private_names(spark):
    got = extract(spark, ("a.py", "def _x():\n    pass\ndef __y():\n    pass\n"), private=False)
    assert set(got) == {("", "__y")}


def test_typescript(spark):
    got = extract(spark, ("a.ts", TS))
    assert set(got) == {("", "make"), ("", "Box"), ("Box", "width"), ("Box", "open"), ("", "pick")}
    make = got["", "make"]
    assert make.is_async and make.return_type == "Promise<Record<string, T>>"
    assert make.docstring == "Makes a box.\n\nSecond part."
    assert [tuple(a) for a in make.args] == [
        ("a", "T | undefined", ""), ("{ b, c }", "object", ""), ("cb", "(n: number) => void", "() => {}"),
    ]
    assert got["", "Box"].bases == ["Base<T>", "A", "B"]
    assert got["", "Box"].docstring == "" and got["Box", "open"].docstring == ""
    assert got["Box", "open"].is_async and got["", "pick"].is_async


def test_csharp(spark):
    got = extract(spark, ("a.cs", CS))
    assert set(got) == {("", "Runner"), ("Runner", "Go")}
    assert got["", "Runner"].docstring == "Runs."
    assert got["Runner", "Go"].docstring == "Goes.\ntrailing"
    assert got["Runner", "Go"].is_deprecated


def test_crlf_and_unclosed_bracket_in_lenient_language(spark):
    got = extract(spark, ("a.java", "/** Doc. */\r\nclass A {\r\n    int f(int x) { }\r\n}\r\nbroken(\r\n"))
    assert got["", "A"].docstring == "Doc." and ("A", "f") in got


def test_bodyless_kotlin_class_has_no_methods(spark):
    got = extract(spark, ("a.kt", "class A\n\nfun top(x: Int) {\n}\n"))
    assert set(got) == {("", "A"), ("", "top")}


def test_long_comment_and_string_do_not_overflow(spark):
    text = "/*" + "x\n" * 60000 + "*/\nconst char* s = \"" + "\\x00" * 30000 + "\";\nint f(int a);\n"
    got = extract(spark, ("a.cpp", text))
    assert set(got) == {("", "f")} and got["", "f"].line_number == 60003


@pytest.mark.parametrize("lang", list(specs.SPECS))
def test_masking_keeps_length(spark, lang):
    text = 'a "b{" /* c\n{ */ // d\n# e\n\'f\' `g\nh` """i\n""" é "j'
    df = spark.createDataFrame([(lang, text)], "lang string, content string")
    row = df.select(lines.masked_struct(F.col("content"), specs.SPECS).alias("m")).first().m
    assert len(row.code) == len(row.text) == len(text)
    assert row.code.count("\n") == text.count("\n")


@pytest.mark.parametrize(
    "raw,expected",
    [
        ("", []),
        ("a: Map<string, number> = {}, b?: [int, int], c", ["a: Map<string, number> = {}", "b?: [int, int]", "c"]),
        ("f: (x: A, y: B) => C, g = ',', h", ["f: (x: A, y: B) => C", "g = ','", "h"]),
        ("a,,b,", ["a", "b"]),
    ],
)
def test_split(spark, raw, expected):
    df = spark.createDataFrame([(raw,)], "raw string")
    assert df.select(split_top_level(F.col("raw")).alias("x")).first().x == expected


@pytest.mark.parametrize(
    "lang,raw,expected",
    [
        ("rust", "&mut self, mut total: i32", [("total", "i32", "")]),
        ("cpp", "void", []),
        ("cpp", "int *p, const T& r = T(), ...", [("p", "int*", ""), ("r", "const T&", "T()"), ("...", "variadic", "")]),
        ("go", "a, b int, m map[string]int", [("a", "", ""), ("b", "int", ""), ("m", "map[string]int", "")]),
        ("java", "@A(x) final List<A, B> l, int... n", [("l", "final List<A, B>", ""), ("n", "int[]", "")]),
        ("csharp", "this string s, out int n, int k = 3", [("s", "string", ""), ("n", "int", ""), ("k", "int", "3")]),
        ("kotlin", "vararg xs: Int, f: (Int, Int) -> Int = { a, b -> a }", [("xs", "Int", ""), ("f", "(Int, Int) -> Int", "{ a, b -> a }")]),
        ("ruby", "a, b = [1, 2], *rest, key:, &blk", [("a", "", ""), ("b", "", "[1, 2]"), ("*rest", "", ""), ("key", "", ""), ("&blk", "", "")]),
    ],
)
def test_params(spark, lang, raw, expected):
    df = spark.createDataFrame([(raw,)], "raw string")
    got = df.select(parse_params(F.col("raw"), specs.SPECS[lang]).alias("x")).first().x
    assert [tuple(a) for a in got] == expected


def test_clean_xml_keeps_summary_lines(spark):
    raw = ["/// <summary>", "/// <c>A</c> b", "///", "/// c", "/// </summary>", "/// <x/>", "/// tail"]
    df = spark.createDataFrame([(raw,)], "raw array<string>")
    assert df.select(clean_docs(F.col("raw"), "xml").alias("x")).first().x == "<c>A</c> b\n\nc\ntail"


def test_quarantine(spark):
    rows = [("bad.py", "def f(:\n"), ("open.py", 'x = """abc\n'), ("good.py", "x = '('\n"), ("bad.ts", "f(\n")]
    good, bad = src.quarantine_syntax(src.tag_language(spark.createDataFrame(rows, "path string, content string")))
    assert {r.path for r in bad.collect()} == {"bad.py", "open.py"}
    assert {r.path for r in good.collect()} == {"good.py", "bad.ts"}


def test_module_docs(spark):
    rows = [
        ("a.py", "#!/bin/sh\n# x\n'''Doc.\n\n   In.\n'''\n"), ("b.py", "x = 1\n'''no'''\n"), ("c.ts", " " * 60 + "/** late */"),
        ("d.rs", "//! One.\n//! Two.\nfn f() {}\n"),
    ]
    got = modules.module_docs(src.tag_language(spark.createDataFrame(rows, "path string, content string")))
    assert {r.path: r.docstring for r in got.collect()} == {"a.py": "Doc.\n\nIn.", "b.py": "", "c.ts": "", "d.rs": "One.\nTwo."}


def test_patched_symbols_are_documented(spark):
    """After the patches nothing that got one is missing documentation."""
    files = src.tag_language(spark.createDataFrame([("a.py", PY.replace('"""Area of a box.\n\n        Indented more.\n    Back.\n    """', "pass"))], "path string, content string"))
    py = {"python": specs.PYTHON}
    candidates = fill.doc_candidates(files, symbols.catalog_rows(files, py), py)
    suggestions = candidates.withColumn("docstring", F.lit("One.\nTwo."))
    patched = src.tag_language(fill.apply_doc_patches(files, suggestions))
    left = {r.name for r in fill.missing_docs(symbols.catalog_rows(patched, py)).collect()}
    done = {r.name for r in suggestions.where("insert_line IS NOT NULL").collect()}
    assert {"area", "helper", "Box", "Inner", "lost", "last", "conditional"} <= done
    assert not left & done
    area = {r.name: r.docstring for r in symbols.extract_symbols(patched, py).collect()}["area"]
    assert area == "One.\nTwo."
