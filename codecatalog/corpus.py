"""Test corpus: one source file per row of ``documents``, and what the catalog must say about it.

The whole text of a document becomes the documentation of a class. A template lists the lines of a
file in one language, each with the condition under which it is present. From the same list come the
file content, computed by Spark, and the expected rows, as SQL that derives them from the document
columns by arithmetic and never parses anything.

The SQL text is common to both engines except for the global-replace option, see ``_base``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from codecatalog import fixed_values as fv

LANGUAGES = list(fv.EXTENSIONS)

# Every text is in a documented file. Some have a second file without documentation, some an empty one.
HAS_DOC = "copy <> 'U'"
MULTI = "doc_id % 7 = 0"
PRIVATE = "doc_id % 8 = 3"
BRACES = "doc_id % 11 = 0"
NESTED = "doc_id % 13 = 0"
SECOND = "doc_id % 2 = 1"
EXCLUDED = "doc_id % 17 = 0"
GO_TEST = "(lang = 'go' AND doc_id % 19 = 0)"
BROKEN = "doc_id % 23 = 0"
EMPTY = "copy = 'E'"
# Files with literals that nest.
LITERALS = "doc_id % 10 IN (4, 8)"
INDEXED = "(doc_id % 50 = 0 AND lang IN ('python', 'typescript'))"
UNDECODABLE = "doc_id % 31 = 0"
# What is wrong with a broken Python file: lines at its end, and the reason given for them. Other languages get the first.
_BREAKS = (
    (["broken("], "unbalanced brackets"),
    (["x = ([)]"], "unbalanced brackets"),
    (["if a:", "        x = 1", "    y = 2"], "unindent to an unknown level"),
    (["def without_body():"], "missing body"),
    (["x = 1", "    y = 2"], "unexpected indent"),
)
_BREAK = "CASE WHEN lang = 'python' THEN CAST(floor(doc_id / 23) AS BIGINT) % 5 ELSE 0 END"
BREAK_REASON = f"CASE {_BREAK} " + " ".join(f"WHEN {i} THEN '{reason}'" for i, (_, reason) in enumerate(_BREAKS)) + " END"
# Files that reach the extraction.
KEPT = f"NOT ({EXCLUDED}) AND NOT {GO_TEST} AND NOT ({EMPTY}) AND NOT (lang = 'python' AND {BROKEN})"


def sql_text(template: str) -> str:
    """``'def f_{id}('`` as an SQL concatenation; a name in braces is a column of the corpus."""
    parts = []
    for piece in re.split(r"(\{[a-z]+\})", template):
        if re.fullmatch(r"\{[a-z]+\}", piece):
            parts.append({"id": "sid"}.get(piece[1:-1], piece[1:-1]))
        elif piece:
            # Only one of the engines takes a backslash for an escape.
            parts.append("'" + piece.replace("'", "''").replace("\\", "' || chr(92) || '") + "'")
    return " || ".join(parts) or "''"


@dataclass
class Sym:
    kind: str
    name: str
    parent: str = ""
    args: list[tuple[str, str, str]] = field(default_factory=list)
    ret: str = ""
    bases: list[str] = field(default_factory=list)
    marker: str = ""
    decorators: list[tuple[str, str | None]] = field(default_factory=list)
    doc: str = "''"  # SQL
    is_async: str = "FALSE"  # SQL
    when: str = "TRUE"
    nested: bool = False  # declared, but no catalog symbol
    hidden: bool = False  # within a private type


@dataclass
class Line:
    text: str  # SQL
    when: str | None = None
    n: str = "1"  # number of physical lines, SQL
    kind: str = "H"  # H head, C continuation, M comment, T string, A annotation, B blank
    depth: int = 0
    span: int = 1  # physical lines of the logical line
    sym: Sym | None = None


class Template:
    def __init__(self, lang: str):
        self.lang = lang
        self.lines: list[Line] = []

    def add(self, text: str, sym: Sym | None = None, **kw) -> None:
        self.lines.append(Line(sql_text(text), sym=sym, **kw))

    def prose(self, open_: str, sep: str, close: str, depth: int = 0, kind: str = "M") -> None:
        """The document text as one comment; ``sep`` starts each further line."""
        head = open_.count("\n")
        text = f"{_chars(open_)} || replace(prose, chr(10), {_chars(chr(10) + sep)}) || {_chars(close)}"
        self.lines.append(
            Line(text, when=HAS_DOC, n=f"(nl + {head + close.count(chr(10))})", kind=kind, depth=depth)
        )

    def starts(self) -> list[tuple[Line, str]]:
        """Each line with the SQL of its first line number."""
        out, before = [], ["1"]
        for line in self.lines:
            out.append((line, " + ".join(before)))
            before.append(line.n if line.when is None else f"(CASE WHEN {line.when} THEN {line.n} ELSE 0 END)")
        return out

    def content(self) -> str:
        cells = [
            line.text if line.when is None else f"CASE WHEN {line.when} THEN {line.text} END"
            for line in self.lines
        ]
        broken = " ".join(f"WHEN {i} THEN {_chars(chr(10).join(lines))}" for i, (lines, _) in enumerate(_BREAKS))
        cells.append(f"CASE WHEN {BROKEN} THEN CASE {_BREAK} {broken} END END")
        return f"concat_ws(chr(10), {', '.join(cells)})"


def _chars(text: str) -> str:
    """SQL text that may hold line feeds."""
    return " || chr(10) || ".join(sql_text(p) for p in text.split("\n"))


CLASS_DOC = f"CASE WHEN {HAS_DOC} THEN prose ELSE '' END"
FUNC_DOC = f"CASE WHEN {HAS_DOC} THEN dep || 'Helper ' || sid || '.' ELSE '' END"
SECOND_DOC = "'Second of ' || sid || '.'"
ASYNC = "doc_id % 5 = 1"


def _header(t: Template, single: str, first: str, params: list[str], last: str, sym: Sym, depth: int = 0, inner: int | None = None) -> None:
    """A function header on one line or, for some documents, over several."""
    t.add(single, sym, when=f"NOT ({MULTI})", depth=depth)
    t.add(first, when=MULTI, depth=depth, span=len(params) + 2)
    inner = depth if inner is None else inner
    for p in params + [last]:
        t.add(p, when=MULTI, kind="C", depth=inner)


def _python() -> Template:
    t = Template("python")
    t.add('"""Module {id} from {source}."""', kind="T")
    t.add("", kind="B")
    t.add("import os")
    t.add("")
    t.lines[-1].kind = "B"
    t.add('@registry.register("{id}")', when=SECOND, kind="A")
    t.add(
        "class C{id}(Base{id}, Mixin):",
        Sym("class", "C{id}", bases=["Base{id}", "Mixin"], doc=CLASS_DOC,
            decorators=[("registry.register('{id}')", SECOND)]),
    )
    t.prose('    """', "    ", '"""', kind="T")
    t.add('    limit = "def fake(x): {{"', when=BRACES)
    t.add("""    note = f"{d["def x(): ("]}" + f'{d[f"{1}"]}'""", when=LITERALS)
    t.add("    def m_{id}_a(self, x: int) -> int:", Sym("method", "m_{id}_a", "C{id}", [("self", "", ""), ("x", "int", "")], "int"))
    t.add("        return helper(x)  # not code: def other():")
    t.add("", kind="B")
    t.add("    @staticmethod", when=SECOND, kind="A")
    t.add(
        '    def m_{id}_b(y: str = "a") -> str:',
        Sym("method", "m_{id}_b", "C{id}", [("y", "str", "'a'")], "str", doc=SECOND_DOC, when=SECOND,
            decorators=[("staticmethod", None)]),
        when=SECOND,
    )
    t.add('        """Second of {id}."""', when=SECOND, kind="T")
    t.add("        return y", when=SECOND)
    t.add("    class Inner{id}:", Sym("class", "Inner{id}", when=NESTED, nested=True), when=NESTED)
    t.add("        def deep_{id}(self):", Sym("function", "deep_{id}", args=[("self", "", "")], when=NESTED, nested=True), when=NESTED)
    t.add("            pass", when=NESTED)
    t.add("", kind="B")
    _header(
        t,
        '{asy}def f_{id}(a: int, b: str = "x") -> bool:',
        "{asy}def f_{id}(",
        ["    a: int,", '    b: str = "x",'],
        ") -> bool:",
        Sym("function", "f_{id}", args=[("a", "int", ""), ("b", "str", "'x'")], ret="bool", doc=FUNC_DOC, is_async=ASYNC),
    )
    t.add('    """{dep}Helper {id}."""', when=HAS_DOC, kind="T")
    t.add("    if a:")
    t.add("        def local_{id}():", Sym("function", "local_{id}", nested=True))
    t.add("            return 1")
    t.add("    return True")
    t.add("", kind="B")
    t.add("def _helper_{id}(z):", Sym("function", "_helper_{id}", args=[("z", "", "")], when=PRIVATE), when=PRIVATE)
    t.add("    return z", when=PRIVATE)
    return t


def _block_doc(t: Template, indent: str, text: str, depth: int, when: str | None = None) -> None:
    t.add(indent + "/**", when=when, kind="M", depth=depth)
    t.add(indent + " * " + text, when=when, kind="M", depth=depth)
    t.add(indent + " * @param x dropped", when=when, kind="M", depth=depth)
    t.add(indent + " */", when=when, kind="M", depth=depth)


def _typescript() -> Template:
    t = Template("typescript")
    t.add("/**", kind="M")
    t.add(" * Module {id} from {source}.", kind="M")
    t.add(" */", kind="M")
    t.add("", kind="B")
    t.add('import { x } from "y{";')
    t.prose("/**\n * ", " * ", "\n */")
    t.add(
        "export class C{id} extends Base{id}<string, number> implements A, B<C> {",
        Sym("class", "C{id}", bases=["Base{id}<string, number>", "A", "B<C>"], doc=CLASS_DOC),
    )
    t.add('    text = "}{{"; // }{', when=BRACES, depth=1)
    t.add("""    note = `x ${ b ? `c { ${ "}`" }` : '' } y {` + /[`"{]/.source;""", when=LITERALS, depth=1)
    t.add("    constructor(private x?: number) {", Sym("method", "constructor", "C{id}", [("private x", "number | undefined", "")]), depth=1)
    t.add("        if (x) {", depth=2)
    t.add("            return f(x);", depth=3)
    t.add("        }", depth=3)
    t.add("    }", depth=2)
    _block_doc(t, "    ", "Second of {id}.", 1, SECOND)
    t.add(
        "    {asy}m_{id}_b(cb: (a: number, b: string) => void, z = 1): Promise<Map<string, number>> {",
        Sym("method", "m_{id}_b", "C{id}", [("cb", "(a: number, b: string) => void", ""), ("z", "", "1")],
            "Promise<Map<string, number>>", doc=SECOND_DOC, is_async=ASYNC, when=SECOND),
        when=SECOND, depth=1,
    )
    t.add("    }", when=SECOND, depth=2)
    t.add("}", depth=1)
    t.add("", kind="B")
    _block_doc(t, "", "{dep}Helper {id}.", 0, HAS_DOC)
    _header(
        t,
        'export {asy}function f_{id}(a: number, b: string = "x"): boolean {',
        "export {asy}function f_{id}(",
        ["    a: number,", '    b: string = "x",'],
        "): boolean {",
        Sym("function", "f_{id}", args=[("a", "number", ""), ("b", "string", '"x"')], ret="boolean", doc=FUNC_DOC, is_async=ASYNC),
    )
    t.add("    for (const q of a) {", depth=1)
    t.add("    }", depth=2)
    t.add("}", depth=1)
    t.add("export const arrow_{id} = (a: number): number => {", Sym("function", "arrow_{id}", args=[("a", "number", "")], ret="number"))
    t.add("};", depth=1)
    t.add("export interface I{id} extends J {", Sym("class", "I{id}", bases=["J"], marker="interface"))
    t.add("    go(): void;", depth=1)
    t.add("}", depth=1)
    t.add("function _helper_{id}(z) { return z; }", Sym("function", "_helper_{id}", args=[("z", "", "")], when=PRIVATE), when=PRIVATE)
    t.add("describe({id});")
    return t


def _java() -> Template:
    t = Template("java")
    t.add("/* header { */", kind="M")
    t.add("package com.{source}.p{id};")
    t.add("", kind="B")
    t.prose("/**\n * ", " * ", "\n */")
    t.add("@Deprecated", when=PRIVATE, kind="A")
    t.add(
        "public class C{id} extends Base{id} implements A, B<C, D> {",
        Sym("class", "C{id}", bases=["Base{id}", "A", "B<C, D>"], doc=CLASS_DOC),
    )
    t.add('    String s = "}{{"; // }{', when=BRACES, depth=1)
    t.add("    public C{id}(int x) {", Sym("method", "C{id}", "C{id}", [("x", "int", "")]), depth=1)
    t.add("        if (x > 1) {", depth=2)
    t.add("            return f(x);", depth=3)
    t.add("        } else if (g(x)) {", depth=3)
    t.add("        }", depth=3)
    t.add("    }", depth=2)
    _block_doc(t, "    ", "{dep}Helper {id}.", 1, HAS_DOC)
    _header(
        t,
        "    public static boolean f_{id}(@NotNull int a, String... b) throws X {",
        "    public static boolean f_{id}(",
        ["        @NotNull int a,", "        String... b"],
        "    ) throws X {",
        Sym("method", "f_{id}", "C{id}", [("a", "int", ""), ("b", "String[]", "")], "boolean", doc=FUNC_DOC),
        depth=1,
    )
    t.add("    }", depth=2)
    t.add("    static class Inner{id} {", Sym("class", "Inner{id}", "C{id}", when=NESTED), when=NESTED, depth=1)
    t.add("        void deep_{id}() { }", Sym("method", "deep_{id}", "Inner{id}", ret="void", when=NESTED), when=NESTED, depth=2)
    t.add("    }", when=NESTED, depth=2)
    t.add("    class _P{id} {", Sym("class", "_P{id}", "C{id}", when=NESTED), when=NESTED, depth=1)
    t.add("        class Q{id} {", Sym("class", "Q{id}", "_P{id}", when=NESTED, hidden=True), when=NESTED, depth=2)
    t.add("            void low_{id}() { }", Sym("method", "low_{id}", "Q{id}", ret="void", when=NESTED, hidden=True), when=NESTED, depth=3)
    t.add("        }", when=NESTED, depth=3)
    t.add("    }", when=NESTED, depth=2)
    t.add("    private Map<String, Integer> _helper_{id}(int z);", Sym("method", "_helper_{id}", "C{id}", [("z", "int", "")], "Map<String, Integer>", when=PRIVATE), when=PRIVATE, depth=1)
    t.add("}", depth=1)
    t.add("interface I{id} extends J, K {", Sym("class", "I{id}", bases=["J", "K"], marker="interface"))
    t.add("    int size(int n);", depth=1)
    t.add("}", depth=1)
    t.add("public enum E{id} {", Sym("class", "E{id}", marker="enum"))
    t.add("    ONE, TWO;", depth=1)
    t.add("}", depth=1)
    return t


def _go() -> Template:
    t = Template("go")
    t.add("// Package p{id} is here.", kind="M")
    t.add("package p{id}")
    t.add("", kind="B")
    t.add("import (", span=3)
    t.add('    "fmt"', kind="C")
    t.add(")", kind="C")
    t.add("", kind="B")
    t.prose("// ", "// ", "")
    t.add("type C{id} struct {", Sym("class", "C{id}", marker="struct", doc=CLASS_DOC))
    t.add("    x int", depth=1)
    t.add("}", depth=1)
    t.add("type I{id} interface {", Sym("class", "I{id}", marker="interface"))
    t.add("    Size(n int) int", depth=1)
    t.add("}", depth=1)
    t.add("", kind="B")
    t.add("// {dep}Helper {id}.", when=HAS_DOC, kind="M")
    _header(
        t,
        "func F{id}(a int, b map[string]int) (int, error) {",
        "func F{id}(",
        ["    a int,", "    b map[string]int,"],
        ") (int, error) {",
        Sym("function", "F{id}", args=[("a", "int", ""), ("b", "map[string]int", "")], ret="int, error", doc=FUNC_DOC),
    )
    t.add('    s := "}{{" // }{', when=BRACES, depth=1)
    t.add("    return 1, nil", depth=1)
    t.add("}", depth=1)
    t.add("// Second of {id}.", when=SECOND, kind="M")
    t.add(
        "func (c *C{id}) M{id}(n int) error {",
        Sym("method", "M{id}", "C{id}", [("n", "int", "")], "error", when=SECOND, doc=SECOND_DOC),
        when=SECOND,
    )
    t.add("    return nil", when=SECOND, depth=1)
    t.add("}", when=SECOND, depth=1)
    t.add("func (o Other) Lost{id}(n int) {")
    t.add("}", depth=1)
    t.add("func hidden{id}(z int) {")
    t.add("}", depth=1)
    return t


def _rust() -> Template:
    t = Template("rust")
    t.add("//! Module {id} from {source}.", kind="M")
    t.add("", kind="B")
    t.add("use std::fmt;")
    t.add("/* a /* b { */ fn commented() { */", when=LITERALS, kind="M")
    t.prose("/// ", "/// ", "")
    t.add("#[derive(Debug)]", kind="A")
    t.add("pub struct C{id}<T> {", Sym("class", "C{id}", marker="struct", doc=CLASS_DOC))
    t.add("    x: T,", depth=1)
    t.add("}", depth=1)
    t.add("", kind="B")
    t.add("impl<T> C{id}<T> {")
    t.add("    /// Second of {id}.", when=SECOND, kind="M", depth=1)
    t.add(
        "    pub fn m_{id}_b(&self, mut total: Vec<(i32, u8)>) -> Option<&'a str> {",
        Sym("method", "m_{id}_b", "C{id}", [("total", "Vec<(i32, u8)>", "")], "Option<&'a str>", doc=SECOND_DOC, when=SECOND),
        when=SECOND, depth=1,
    )
    t.add("        let c = '{';", when=SECOND, depth=2)
    t.add("    }", when=SECOND, depth=2)
    t.add("}", depth=1)
    t.add("impl fmt::Display for C{id} {")
    t.add("    fn fmt(&self, w: &mut W) -> R { Ok(()) }", Sym("method", "fmt", "C{id}", [("w", "&mut W", "")], "R"), depth=1)
    t.add("}", depth=1)
    t.add("impl Lost{id} {")
    t.add("    fn gone(&self) {}", depth=1)
    t.add("}", depth=1)
    t.add("pub enum E{id} { One, Two }", Sym("class", "E{id}", marker="enum"))
    t.add("pub trait T{id} {", Sym("class", "T{id}", marker="trait"))
    t.add("    fn size(&self) -> u8;", depth=1)
    t.add("}", depth=1)
    t.add("/// {dep}Helper {id}.", when=HAS_DOC, kind="M")
    _header(
        t,
        "pub {asy}fn f_{id}(a: i32, b: &str) -> bool {",
        "pub {asy}fn f_{id}(",
        ["    a: i32,", "    b: &str,"],
        ") -> bool {",
        Sym("function", "f_{id}", args=[("a", "i32", ""), ("b", "&str", "")], ret="bool", doc=FUNC_DOC, is_async=ASYNC),
    )
    t.add('    let s = "}{{"; /* }{ */', when=BRACES, depth=1)
    t.add('    let r = r##"{"#"##;', when=LITERALS, depth=1)
    t.add("    fn local() {}", depth=1)
    t.add("    true", depth=1)
    t.add("}", depth=1)
    t.add("fn _helper_{id}(z: u8) {}", Sym("function", "_helper_{id}", args=[("z", "u8", "")], when=PRIVATE), when=PRIVATE)
    return t


def _csharp() -> Template:
    t = Template("csharp")
    t.add("using System;")
    t.add("namespace Acme.{source}.P{id}")
    t.add("{")
    t.prose("    /// <summary>\n    /// ", "    /// ", "\n    /// </summary>", depth=1)
    t.add('    /// <remarks name="x">dropped</remarks>', kind="M", depth=1)
    t.add("    [Serializable]", kind="A", depth=1)
    t.add(
        "    public sealed class C{id}<T> : Base{id}<T, int>, IThing",
        Sym("class", "C{id}", bases=["Base{id}<T, int>", "IThing"], doc=CLASS_DOC),
        depth=1,
    )
    t.add("    {", depth=1)
    t.add('        string s = "}{{"; // }{', when=BRACES, depth=2)
    t.add("""        string n = $"{(b ? "{" : "")}" + @"a\\" + $@"{ c }{{" + \"\"\"{ "" \"\"\";""", when=LITERALS, depth=2)
    t.add("        public C{id}(int x) { }", Sym("method", "C{id}", "C{id}", [("x", "int", "")]), depth=2)
    t.add("        public int Size { get; set; }", depth=2)
    t.add("        /// <summary>{dep}Helper {id}.</summary>", when=HAS_DOC, kind="M", depth=2)
    t.add('        /// <param name="a">dropped</param>', when=HAS_DOC, kind="M", depth=2)
    _header(
        t,
        '        public {asy}Task<bool> f_{id}(ref int a, string b = "x,)")',
        "        public {asy}Task<bool> f_{id}(",
        ["            ref int a,", '            string b = "x,)"'],
        "        )",
        Sym("method", "f_{id}", "C{id}", [("a", "int", ""), ("b", "string", '"x,)"')], "Task<bool>", doc=FUNC_DOC, is_async=ASYNC),
        depth=2,
    )
    t.add("        {", depth=2)
    t.add("            return g(a);", depth=3)
    t.add("        }", depth=3)
    t.add("        class Inner{id}", Sym("class", "Inner{id}", "C{id}", when=NESTED), when=NESTED, depth=2)
    t.add("        {", when=NESTED, depth=2)
    t.add("            void deep_{id}() { }", Sym("method", "deep_{id}", "Inner{id}", ret="void", when=NESTED), when=NESTED, depth=3)
    t.add("        }", when=NESTED, depth=3)
    t.add("        class _P{id}", Sym("class", "_P{id}", "C{id}", when=NESTED), when=NESTED, depth=2)
    t.add("        {", when=NESTED, depth=2)
    t.add("            class Q{id}", Sym("class", "Q{id}", "_P{id}", when=NESTED, hidden=True), when=NESTED, depth=3)
    t.add("            {", when=NESTED, depth=3)
    t.add("                void low_{id}() { }", Sym("method", "low_{id}", "Q{id}", ret="void", when=NESTED, hidden=True), when=NESTED, depth=4)
    t.add("            }", when=NESTED, depth=4)
    t.add("        }", when=NESTED, depth=3)
    t.add("        int _helper_{id}(int z) { return z; }", Sym("method", "_helper_{id}", "C{id}", [("z", "int", "")], "int", when=PRIVATE), when=PRIVATE, depth=2)
    t.add("    }", depth=2)
    t.add("    public interface I{id} : IOther { }", Sym("class", "I{id}", bases=["IOther"], marker="interface"), depth=1)
    t.add("    public struct S{id} {", Sym("class", "S{id}", marker="struct"), depth=1)
    t.add("        public int Get(int n) { return n; }", Sym("method", "Get", "S{id}", [("n", "int", "")], "int"), depth=2)
    t.add("    }", depth=2)
    t.add("    enum E{id} { One, Two }", Sym("class", "E{id}", marker="enum"), depth=1)
    t.add("}", depth=1)
    return t


def _cpp() -> Template:
    t = Template("cpp")
    t.add("#include <vector>", kind="M")
    t.add("#define MAX_{id}(a, b) ((a) > (b) ? {", kind="M")
    t.prose("/**\n * ", " * ", "\n * @brief dropped\n */")
    t.add("template <typename T>", kind="A")
    t.add(
        "class C{id} : public Base{id}, private Mixin<int, T> {",
        Sym("class", "C{id}", bases=["Base{id}", "Mixin<int, T>"], doc=CLASS_DOC),
    )
    t.add(" public:", depth=1)
    t.add('    const char* s = "}{{"; // }{', when=BRACES, depth=1)
    t.add('    const char* r = R"x({)" )x";', when=LITERALS, depth=1)
    t.add("    /// Second of {id}.", when=SECOND, kind="M", depth=1)
    t.add(
        "    virtual void m_{id}_b(std::map<int, char>& m, ...) const override;",
        Sym("method", "m_{id}_b", "C{id}", [("m", "std::map<int, char>&", ""), ("...", "variadic", "")], "void", doc=SECOND_DOC, when=SECOND),
        when=SECOND, depth=1,
    )
    t.add("    class Inner{id} {", Sym("class", "Inner{id}", "C{id}", when=NESTED), when=NESTED, depth=1)
    t.add("        void deep_{id}(void);", Sym("method", "deep_{id}", "Inner{id}", ret="void", when=NESTED), when=NESTED, depth=2)
    t.add("    };", when=NESTED, depth=2)
    t.add("};", depth=1)
    t.add("struct S{id} { int x; };", Sym("class", "S{id}", marker="struct"))
    t.add("int MACRO_{id}(int q);")
    t.add("//! {dep}Helper {id}.", when=HAS_DOC, kind="M")
    _header(
        t,
        'static bool f_{id}(int a, const char* b = "x")',
        "static bool f_{id}(",
        ["    int a,", '    const char* b = "x"'],
        ")",
        Sym("function", "f_{id}", args=[("a", "int", ""), ("b", "const char*", '"x"')], ret="bool", doc=FUNC_DOC),
    )
    t.add("{")
    t.add("    return g(a);", depth=1)
    t.add("    if (a) {", depth=1)
    t.add("    }", depth=2)
    t.add("}", depth=1)
    t.add("char *_helper_{id}(int z);", Sym("function", "_helper_{id}", args=[("z", "int", "")], ret="char *", when=PRIVATE), when=PRIVATE)
    return t


def _ruby() -> Template:
    t = Template("ruby")
    t.add("# Module of {id}.", kind="M")
    t.add("module M{id}", Sym("class", "M{id}", marker="module", doc="'Module of ' || sid || '.'"))
    t.prose("  # ", "  # ", "", depth=1)
    t.add("  class C{id} < Base{id}", Sym("class", "C{id}", "M{id}", bases=["Base{id}"], doc=CLASS_DOC), depth=1)
    t.add('    S = "if do end" # end', when=BRACES, depth=2)
    t.add("    T = [<<~ONE, <<-'TWO'].join", when=LITERALS, depth=2)
    for text in ("      def fake", '      #{x.map { |q| "#{ q } end" } } do', "    ONE", "  class Fake", "    TWO"):
        t.add(text, when=LITERALS, depth=2, kind="T")
    t.add("    # {dep}Helper {id}.", when=HAS_DOC, kind="M", depth=2)
    _header(
        t,
        '    def f_{id}?(a, b = "x", *rest)',
        "    def f_{id}?(",
        ["      a,", '      b = "x",'],
        "      *rest)",
        Sym("method", "f_{id}?", "C{id}", [("a", "", ""), ("b", "", '"x"'), ("*rest", "", "")], doc=FUNC_DOC),
        depth=2, inner=3,
    )
    t.add("      a.each do |x|", depth=3)
    t.add("        puts x if x", depth=4)
    t.add("      end", depth=4)
    t.add("      while a do", depth=3)
    t.add("      end", depth=4)
    t.add("    end", depth=3)
    t.add("    def self.make; end", Sym("method", "make", "C{id}", when=SECOND), when=SECOND, depth=2)
    t.add("    class Inner{id}", Sym("class", "Inner{id}", "C{id}", when=NESTED), when=NESTED, depth=2)
    t.add("      def deep_{id}; end", Sym("method", "deep_{id}", "Inner{id}", when=NESTED), when=NESTED, depth=3)
    t.add("    end", when=NESTED, depth=3)
    t.add("  end", depth=2)
    t.add("end", depth=1)
    t.add("def _helper_{id}(z)", Sym("function", "_helper_{id}", args=[("z", "", "")], when=PRIVATE), when=PRIVATE)
    t.add("  z", when=PRIVATE, depth=1)
    t.add("end", when=PRIVATE, depth=1)
    t.add("def top_{id}", Sym("function", "top_{id}"))
    t.add("end", depth=1)
    return t


def _kotlin() -> Template:
    t = Template("kotlin")
    t.add("package org.{source}.p{id}")
    t.prose("/**\n * ", " * ", "\n */")
    t.add("data class C{id}(", Sym("class", "C{id}", bases=["Base{id}(x)", "Iface<A, B>"], doc=CLASS_DOC), span=3)
    t.add("    val x: Int = 3", kind="C")
    t.add(") : Base{id}(x), Iface<A, B> {", kind="C")
    t.add('    val s = "}{{" // }{', when=BRACES, depth=1)
    t.add("""    val n = "x ${if (b) "{" else ""} y" + \"\"\"${ "}" } {\"\"\" """.rstrip(), when=LITERALS, depth=1)
    _block_doc(t, "    ", "Second of {id}.", 1, SECOND)
    t.add(
        '    override {sus}fun m_{id}_b(vararg n: Int, cb: (Int, Int) -> Unit = {}): Map<String, Int> {',
        Sym("method", "m_{id}_b", "C{id}", [("n", "Int", ""), ("cb", "(Int, Int) -> Unit", "{}")],
            "Map<String, Int>", doc=SECOND_DOC, is_async=ASYNC, when=SECOND),
        when=SECOND, depth=1,
    )
    t.add("    }", when=SECOND, depth=2)
    t.add("    class Inner{id} {", Sym("class", "Inner{id}", "C{id}", when=NESTED), when=NESTED, depth=1)
    t.add("        fun deep_{id}() = 1", Sym("method", "deep_{id}", "Inner{id}", when=NESTED), when=NESTED, depth=2)
    t.add("    }", when=NESTED, depth=2)
    t.add("}", depth=1)
    t.add("class Empty{id}", Sym("class", "Empty{id}"))
    t.add("interface I{id} : J {", Sym("class", "I{id}", bases=["J"], marker="interface"))
    t.add("    fun size(): Int", depth=1)
    t.add("}", depth=1)
    t.add("object O{id} {", Sym("class", "O{id}", marker="object"))
    t.add("}", depth=1)
    _block_doc(t, "", "{dep}Helper {id}.", 0, HAS_DOC)
    _header(
        t,
        '{sus}fun String.f_{id}(a: Int, b: String = "x"): Boolean {',
        "{sus}fun String.f_{id}(",
        ["    a: Int,", '    b: String = "x",'],
        "): Boolean {",
        Sym("function", "f_{id}", args=[("a", "Int", ""), ("b", "String", '"x"')], ret="Boolean", doc=FUNC_DOC, is_async=ASYNC),
    )
    t.add("    return true", depth=1)
    t.add("}", depth=1)
    t.add("fun _helper_{id}(z: Int) {}", Sym("function", "_helper_{id}", args=[("z", "Int", "")], when=PRIVATE), when=PRIVATE)
    return t


TEMPLATES = {
    t.lang: t
    for t in (_python(), _typescript(), _java(), _go(), _rust(), _csharp(), _cpp(), _ruby(), _kotlin())
}


# A text stands whole in a comment. Only these differ: control characters and other line ends are blanks, and what would
# end the comment, or make a line of it something else than text, is written in another way.
_CONTROL_CHARS = "".join(map(chr, (*range(1, 10), *range(11, 32), 127, 0x85, 0x2028, 0x2029)))
_CONTROLS = f"'{_CONTROL_CHARS}'"
_NO_END = "replace(replace(plain, '*/', '* /'), '/*', '/ *')"
_NO_TAG = f"replace({_NO_END}, chr(10) || '@', chr(10) || '(@')"
_ESCAPES = {
    "python": "replace(plain, '\"\"\"', chr(39) || chr(39) || chr(39))",
    "csharp": "replace(plain, '<', '&lt;')",
    "cpp": f"replace({_NO_TAG}, chr(10) || chr(92), chr(10) || '(' || chr(92))",
} | dict.fromkeys(("typescript", "java", "kotlin"), _NO_TAG)


def _base(replace_all: str) -> str:
    """Corpus columns that file content and expectations share. ``replace_all`` is the engine's option."""
    escapes = " ".join(f"WHEN lang = '{name}' THEN {sql}" for name, sql in _ESCAPES.items())
    lang = " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(LANGUAGES))
    ext = " ".join(
        f"WHEN {i} THEN CASE CAST(floor(doc_id / 9) AS BIGINT) % {len(exts)} "
        + " ".join(f"WHEN {j} THEN '{e}'" for j, e in enumerate(exts))
        + " END"
        for i, exts in enumerate(fv.EXTENSIONS.values())
    )
    return f"""
SELECT *, length(prose) - length(replace(prose, chr(10), '')) + 1 AS nl,
  dir || 'doc_' || sid || stem || ext AS path
FROM (
  SELECT doc_id, copy, source, nat, sid, lang, ext, prose,
    CASE WHEN doc_id % 10 = 3 THEN 'Deprecated: ' ELSE '' END AS dep,
    CASE WHEN {ASYNC} THEN 'async ' ELSE '' END AS asy,
    CASE WHEN {ASYNC} THEN 'suspend ' ELSE '' END AS sus,
    source || '/' || nat || '/' || CASE WHEN {EXCLUDED} THEN CASE WHEN doc_id % 2 = 0 THEN 'build/' ELSE 'x.egg-info/' END ELSE '' END AS dir,
    CASE WHEN {INDEXED} AND lang = 'python' THEN '/__init__' WHEN {INDEXED} THEN '/index'
         WHEN {GO_TEST} THEN '_test' ELSE '' END AS stem
  FROM (
    SELECT *, CASE {escapes} ELSE plain END AS prose
    FROM (
      SELECT doc_id, copy, source, lang AS nat, CAST(doc_id AS STRING) || copy AS sid,
        CASE doc_id % 9 {lang} END AS lang, CASE doc_id % 9 {ext} END AS ext,
        regexp_replace('Note ' || translate(text, {_CONTROLS}, '{" " * len(_CONTROL_CHARS)}') || ' end',
                       ' *\\n[ \\n]*', chr(10){replace_all}) AS plain
      FROM (
        SELECT *, '' AS copy FROM documents
        UNION ALL SELECT *, 'U' FROM documents WHERE doc_id % 4 = 0
        UNION ALL SELECT *, 'E' FROM documents WHERE doc_id % 29 = 0
      ) d0
    ) d1
  ) d2
) d3"""


_CONTENT = "CASE WHEN " + EMPTY + " THEN '' ELSE CASE lang " + " ".join(
    f"WHEN '{name}' THEN {t.content()}" for name, t in TEMPLATES.items()
) + " END END"

BASE_SQL = _base(", 'g'")


def corpus_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    # The given file has one row group; without this a single task would do all the work.
    docs = docs.repartition(spark.sparkContext.defaultParallelism)
    return spark.sql(_base("").replace("FROM documents", "FROM {docs}"), docs=docs)


def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, content)``: one source file per document, before any filter."""
    base = corpus_base(spark, sf_dir)
    return base.selectExpr("path", f"{_CONTENT} AS content")


def files_sql() -> str:
    """CTE text ``base, files`` for the checking engine."""
    return f"base AS MATERIALIZED ({BASE_SQL}), files AS (SELECT *, {_CONTENT} AS content FROM base)"


def module_sql(path: str = "path") -> str:
    bare = f"regexp_replace({path}, '[.][^./]+$', '')"
    return f"replace(regexp_replace({bare}, '/(__init__|index)$', ''), '/', '.')"


def _args_text(sym: Sym) -> str:
    return ", ".join(n + (f": {t}" if t else "") + (f" = {d}" if d else "") for n, t, d in sym.args)


def _decorators_sql(sym: Sym) -> str:
    if sym.marker:
        return sql_text(sym.marker)
    if not sym.decorators:
        return "''"
    cells = [sql_text(text) if when is None else f"CASE WHEN {when} THEN {sql_text(text)} END" for text, when in sym.decorators]
    return f"concat_ws('|', {', '.join(cells)})"


def expected_sql(langs: list[str] | None = None, kept: str = KEPT) -> str:
    """SELECT of the expected declarations, over CTE ``base``."""
    branches = []
    for lang in langs or LANGUAGES:
        for line, start in TEMPLATES[lang].starts():
            sym = line.sym
            if sym is None:
                continue
            doc = f"({sym.doc})"
            marked = PRIVATE if (lang == "java" and sym.kind == "class" and sym.name == "C{id}") else "FALSE"
            branches.append(
                f"SELECT path, doc_id, lang, '{sym.kind}' AS kind, {sql_text(sym.name)} AS name, "
                f"{sql_text(sym.parent)} AS parent_name, {sql_text(_args_text(sym))} AS args_text, "
                f"{sql_text(sym.ret)} AS return_type, {sql_text(', '.join(sym.bases))} AS bases_text, "
                f"{_decorators_sql(sym)} AS decorators_text, {doc} AS docstring, ({sym.is_async}) AS is_async, "
                f"(regexp_matches({doc}, '(?i)\\bdeprecated\\b') OR ({marked})) AS is_deprecated, "
                f"{str(sym.nested).upper()} AS nested, {str(sym.hidden).upper()} AS hidden, CAST({start} AS BIGINT) AS line_number "
                f"FROM base WHERE lang = '{lang}' AND {kept} AND ({sym.when})"
            )
    inner = " UNION ALL ".join(branches)
    signature = (
        "CASE WHEN kind = 'class' THEN 'class ' || name || CASE WHEN bases_text = '' THEN '' ELSE '(' || bases_text || ')' END "
        "ELSE CASE WHEN is_async THEN 'async def ' ELSE 'def ' END || name || '(' || args_text || ')' || "
        "CASE WHEN return_type = '' THEN '' ELSE ' -> ' || return_type END END"
    )
    return f"SELECT *, {module_sql()} AS module_name, {signature} AS signature FROM ({inner}) s"


def expected_lists_sql(what: str, langs: list[str] | None = None) -> str:
    """SELECT of the expected parameters or bases, one row each, over CTE ``base``."""
    branches = []
    for lang in langs or LANGUAGES:
        for line, start in TEMPLATES[lang].starts():
            sym = line.sym
            if sym is None or sym.nested:
                continue
            rows = sym.args if what == "args" else [(b,) for b in sym.bases]
            for i, row in enumerate(rows):
                names = ("arg_name", "type_hint", "default_value") if what == "args" else ("base",)
                cells = ", ".join(f"{sql_text(v)} AS {n}" for v, n in zip(row, names))
                branches.append(
                    f"SELECT path, {sql_text(sym.name)} AS name, CAST({start} AS BIGINT) AS line_number, "
                    f"CAST({i} AS BIGINT) AS pos, {cells} FROM base "
                    f"WHERE lang = '{lang}' AND {KEPT} AND ({sym.when})"
                )
    return " UNION ALL ".join(branches)


def expected_lines_sql(kinds: str | None = None) -> str:
    """SELECT ``(path, line_no, depth, n_lines)`` of template lines, over CTE ``base``; whole corpus."""
    branches = []
    for lang, t in TEMPLATES.items():
        scoped = lang != "python"
        for line, start in t.starts():
            if kinds and line.kind not in kinds:
                continue
            when = line.when or "TRUE"
            branches.append(
                f"SELECT path, CAST({start} + i AS BIGINT) AS line_no, CAST({line.depth if scoped else 0} AS BIGINT) AS depth, "
                f"CAST({line.span} AS BIGINT) AS n_lines FROM base, LATERAL (SELECT unnest(range(0, CAST({line.n} AS BIGINT))) AS i) u "
                f"WHERE lang = '{lang}' AND NOT ({EMPTY}) AND ({when})"
            )
        total = " + ".join(
            line.n if line.when is None else f"(CASE WHEN {line.when} THEN {line.n} ELSE 0 END)" for line in t.lines
        )
        if not kinds or "H" in kinds:
            broken = " ".join(f"WHEN {i} THEN {len(lines)}" for i, (lines, _) in enumerate(_BREAKS))
            branches.append(
                f"SELECT path, CAST(1 + {total} + i AS BIGINT), CAST(0 AS BIGINT), CAST(1 AS BIGINT) FROM base, "
                f"LATERAL (SELECT unnest(range(0, CAST(CASE {_BREAK} {broken} END AS BIGINT))) AS i) u "
                f"WHERE lang = '{lang}' AND NOT ({EMPTY}) AND {BROKEN}"
            )
    if not kinds:
        branches.append(f"SELECT path, CAST(1 AS BIGINT), CAST(0 AS BIGINT), CAST(1 AS BIGINT) FROM base WHERE {EMPTY}")
    return " UNION ALL ".join(branches)
