"""Literals in literals, deep brackets, many modifiers, and lines that can't be blocks."""

import pytest
from pyspark.sql import functions as F

from codecatalog import specs
from codecatalog.functions.folds import flat_brackets, restored
from codecatalog.operators.lines import masked_struct
from codecatalog.operators.symbols import extract_symbols
from codecatalog.sources.files import quarantine_syntax, tag_language

FILES = {
    "a.ts": "class K {\n  m(a) {\n    return `x ${b ? `c {` : ''} y`;\n  }\n  n(b) {\n    return a / b / `${ {x: `}`}.x }`.length;\n  }\n}\nfunction u(c) {\n}\n",
    "r.ts": "class K {\n  m(a) {\n    const r = /[`{\"]/; const s = `${a}`; // `{\n    return 'it`s {';\n  }\n  n(b) {\n  }\n}\n",
    "a.kt": 'class K {\n  fun m(b: Boolean) = "x ${if (b) "{" else ""} y"\n  /* a /* b */ { */\n  fun n(b: Int) {\n  }\n}\nfun u(c: Int) {\n}\n',
    "a.rs": "/* a /* b */ {  */\npub fn f(a: u8) -> u8 {\n    let s = r##\"{\"# fn no() {\"##;\n    a\n}\npub fn g() {}\n",
    "a.rb": "class K\n  def m\n    x = <<~A + <<-'B'\n      def fake\n      #{y.map { |z| \"end\" }} do\n    A\n  class Other\n    B\n    x << y\n  end\n  def n(a)\n  end\nend\ndef u\nend\n",
    "e.rb": "class K\n  T = <<~A\n  A\n  def n(a)\n  end\nend\n",
    "a.cs": 'class K {\n  void M(bool b) {\n    var s = $"{(b ? "{" : "")}" + $"{{";\n    var p = @"a\\"; var q = $@"{s}""{{";\n    var r = """"{ """ """";\n  }\n  void N(int a) { }\n}\n',
    "a.py": 'class K:\n    def m(self, a=f"{d["def x(): {"]}"):\n        return f"{{" + rf\'{a["}"]!r:>{10}}\'\n\n    def n(self):\n        pass\n',
    "a.cpp": 'class K {\n  const char* s = R"x({)" )x";\n  int m(int a);\n};\nint f(int a);\n',
}
FILES["long.kt"] = "/**\n" + " * x / y *\n" * 50_000 + " */\nfun u(c: Int) {\n}\n"
FILES["long.rs"] = "/* " + "* / " * 50_000 + "/* fn f() { */ */\npub fn g() {}\n"
EXPECTED = {
    "a.ts": {("", "K"), ("K", "m"), ("K", "n"), ("", "u")},
    "r.ts": {("", "K"), ("K", "m"), ("K", "n")},
    "a.kt": {("", "K"), ("K", "m"), ("K", "n"), ("", "u")},
    "a.rs": {("", "f"), ("", "g")},
    "a.rb": {("", "K"), ("K", "m"), ("K", "n"), ("", "u")},
    "e.rb": {("", "K"), ("K", "n")},
    "a.cs": {("", "K"), ("K", "M"), ("K", "N")},
    "a.py": {("", "K"), ("K", "m"), ("K", "n")},
    "a.cpp": {("", "K"), ("K", "m"), ("", "f")},
    "long.kt": {("", "u")},
    "long.rs": {("", "g")},
}
HEADERS = {
    "py": ("def f(a={}, b=2):\n    pass\n", "f"),
    "ts": ("function f(a = {}, b = 2): number {{\n}}\n", "f"),
    "java": ("class K {{\n  @A(x = {}) void f(int a) {{\n  }}\n}}\n", None),
    "go": ("package p\n\nfunc F(a func({}), b int) int {{\n}}\n", "F"),
    "rs": ("fn f(a: [u8; {}], b: u8) -> u8 {{\n}}\n", "f"),
    "cs": ("class K {{\n  int f(int a = {}, int b = 2) {{ }}\n}}\n", "f"),
    "cpp": ("int f(int a = {}, int b = 2);\n", "f"),
    "rb": ("def f(a = {}, b = 2)\nend\n", "f"),
    "kt": ("fun f(a: Int = {}, b: Int = 2): Int {{\n}}\n", "f"),
}
LEVELS = (1, 41, 200, 5000)
MANY = {
    "many.java": "@A " * 5_000 + "class J {\n  " + "final " * 500 + "void m(int a) {\n  }\n}\n",
    "many.kt": "class K {\n  " + "@A " * 300 + "override " * 90 + "fun m(a: Int) {\n  }\n}\n",
    "many.cpp": "inline " * 90 + "unsigned f(int a);\nclass " + "EXPORT " * 90 + "K : B {\n};\n",
    "many.ts": "class K {\n  " + "static " * 90 + "m(a) {\n  }\n  override (a) {\n  }\n}\n",
}


def table(spark, pairs):
    return tag_language(spark.createDataFrame(list(pairs), "path string, content string"))


@pytest.fixture(scope="module")
def found(spark):
    deep = {f"d{n}.{ext}": text.format("(" * n + "1" + ")" * n) for n in LEVELS for ext, (text, _) in HEADERS.items()}
    braces = {f"b{n}.ts": "class K {\n  x = " + "{a:" * n + "1" + "}" * n + ";\n  m(a) {\n  }\n}\n" for n in LEVELS}
    rows = extract_symbols(table(spark, (FILES | deep | braces | MANY).items())).collect()
    out = {}
    for r in rows:
        out.setdefault(r["path"], {})[r["parent_name"], r["name"]] = r
    return out


@pytest.mark.parametrize("path", list(FILES))
def test_no_declaration_is_lost_after_a_nested_literal(found, path):
    assert set(found[path]) == EXPECTED[path]


@pytest.mark.parametrize("levels", LEVELS)
def test_brackets_of_any_depth(found, levels):
    for ext, (_, name) in HEADERS.items():
        rows = {n: r for (_, n), r in found[f"d{levels}.{ext}"].items()}
        if name is None:
            assert "f" in rows
            continue
        args = rows[name]["args"]
        assert len(args) == 2, ext
        deep = "(" * levels + "1" + ")" * levels
        assert deep in args[0]["default"] + args[0]["type_hint"], ext
    assert set(found[f"b{levels}.ts"]) == {("", "K"), ("K", "m")}


def test_any_number_of_modifiers(found):
    assert set(found["many.java"]) == {("", "J"), ("J", "m")}
    assert set(found["many.kt"]) == {("", "K"), ("K", "m")}
    assert set(found["many.cpp"]) == {("", "f"), ("", "K")}
    assert found["many.cpp"]["", "K"]["bases"] == ["B"]
    assert set(found["many.ts"]) == {("", "K"), ("K", "m"), ("K", "override")}


def test_return_types_and_bases_keep_their_brackets(spark):
    text = "function f(): { a: { b: (c: (d) => e) => g } } {\n}\nclass K extends mix(A, B(C)) {\n  m(): { x: { y: number } } { return {}; }\n}\n"
    rows = {r["name"]: r for r in extract_symbols(table(spark, [("a.ts", text)])).collect()}
    assert rows["f"]["return_type"] == "{ a: { b: (c: (d) => e) => g } }"
    assert rows["K"]["bases"] == ["mix(A, B(C))"]
    assert rows["m"]["return_type"] == "{ x: { y: number } }"


def test_flat_brackets(spark):
    cases = ["", "a", "f(a)", "f(a(b)c)d(e)", "((((", "))((", "{a{b}c}(d(e){f{g}})", "(" * 3000 + ")" * 3000, "x(" * 600 + "{" * 600]
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    for c, flat, back in df.select("c", flat_brackets(F.col("c")), restored(flat_brackets(F.col("c")))).collect():
        depth, expected = {"(": 0, "{": 0}, ""
        for x in c:
            kind = {"(": "(", ")": "(", "{": "{", "}": "{"}.get(x)
            if x in "({":
                expected += x if depth[kind] == 0 else "?"
                depth[kind] += 1
            elif x in ")}":
                expected += x if depth[kind] <= 1 else "?"
                depth[kind] = max(depth[kind] - 1, 0)
            else:
                expected += x
        assert "".join("?" if ch in "\x03\x04\x05\x06" else ch for ch in flat) == expected
        assert back == c


@pytest.mark.parametrize("lang", [name for name, spec in specs.SPECS.items() if spec.lexer])
def test_lexed_text_keeps_its_length(spark, lang):
    """Long and unclosed input, more tokens than a fold takes at a time."""
    texts = ["`${" * 400 + "}`" * 400, "/* " * 900, '$"{' * 300 + "\n" * 700, 'f"{x}" ' * 900 + "'", "<<~A #{ \n" * 300 + "A\n", 'r#"' + "{ \\ é😀\n" * 500]
    df = spark.createDataFrame([(lang, t) for t in texts], "lang string, content string")
    for (row,) in df.select(masked_struct(F.col("content"), specs.SPECS)).collect():
        assert len(row.code) == len(row.text) == len(row.line)
        assert row.code.count("\n") == row.line.count("\n")


BROKEN = {
    "order.py": ("x = ([)]\n", "unbalanced brackets"),
    "closed.py": ("x = 1)\n", "unbalanced brackets"),
    "open.py": ("x = (1,\n", "unbalanced brackets"),
    "string.py": ('x = """abc\n', "unclosed string"),
    "header.py": ("def f:\n    pass\n", "illegal header"),
    "unindent.py": ("if a:\n        x = 1\n    y = 2\n", "unindent to an unknown level"),
    "empty.py": ("def f():\n    # nothing\n\n\nx = 1\n", "missing body"),
    "end.py": ("class K:\n    def f(self):\n", "missing body"),
    "indent.py": ("x = 1\n    y = 2\n", "unexpected indent"),
    "first.py": ("  x = 1\n", "unexpected indent"),
}
FINE = {
    "good.py": 'if a:\n\tx = """\nnot code (\n"""\n\ty = [\n1,\n  2]\nelif b: pass\nelse:  # why\n    for c in (\n  d\n    ):\n        z = 1 + \\\n2\n\n# back\n    w = {"a": 1,\n"b": lambda: 2}\nlast = "("\n\n\n',
    "nested.py": "class A:\n    class B:\n        def c(self):\n            if d:\n                pass\n\n        e = 1\n\nf = 2",
    "blank.py": "\n\n   \n# only a comment\n      # another\n",
    "empty2.py": "",
    "format.py": "x = f\"{d['(']}\" f'{{'\nif x:\n    y = f\"{d[\"(\"]}\"\n",
    "bad.ts": "f(\n",
}


def test_syntax_quarantine(spark):
    rows = [(path, text) for path, (text, _) in BROKEN.items()] + list(FINE.items())
    good, bad = quarantine_syntax(table(spark, rows))
    assert {r["path"]: r["reason"] for r in bad.collect()} == {path: reason for path, (_, reason) in BROKEN.items()}
    assert {r["path"] for r in good.collect()} == set(FINE)
