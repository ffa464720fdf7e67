"""Input that must neither stop the job nor lose declarations."""

import pytest

from codecatalog.operators.symbols import exclude_private, extract_symbols
from codecatalog.sources.files import tag_language

LONG = 100_000
SOURCES = {
    "deep.py": "def f(a=((((((1)))))), b=2):\n    pass\n",
    "long.js": "foo(x)" + ",a+b" * LONG + "\nclass K {\n  m(a) {\n  }\n}\n",
    "braces.js": "class K {\n  x = {a:{b:{c:{d:{}}}}};\n  m(a) {\n  }\n}\n",
    "regex.js": "function t(a) {\n  return /`/.test(a);\n}\nclass K {\n  m(b) {\n  }\n}\nfunction u(c) {\n}\n",
    "brace.ts": "function big(a: number): { x: number } {\n  return a;\n}\nfunction small(): number { return 1; }\n",
    "hidden.go": (
        "package p\n\ntype foo struct {\n}\n\nfunc (f *foo) Bar() int {\n\treturn 1\n}\n\n"
        "type Open struct {\n}\n\nfunc (o *Open) Run() struct{ X int } {\n}\n\nfunc Top() interface{} {\n}\n"
    ),
    "private.py": "class _P:\n    def run(self):\n        pass\n\n    def __init__(self):\n        pass\n\n\nclass Q:\n    def go(self):\n        pass\n",
    "many.java": "@A " * 5_000 + "class J {\n  void m(int a) {\n  }\n}\n",
}


@pytest.fixture(scope="module")
def found(spark):
    files = tag_language(spark.createDataFrame(list(SOURCES.items()), "path string, content string"))
    rows = extract_symbols(files)
    rows.cache()
    yield rows
    rows.unpersist()


def names(rows, path):
    return {(r["parent_name"], r["name"]) for r in rows.where(f"path = '{path}'").collect()}


def test_no_declaration_is_lost(found):
    assert names(found, "deep.py") == {("", "f")}
    assert {("", "K"), ("K", "m")} <= names(found, "long.js")
    assert {("", "K"), ("K", "m")} <= names(found, "braces.js")
    assert names(found, "regex.js") == {("", "t"), ("", "K"), ("K", "m"), ("", "u")}
    assert found.where("path = 'deep.py'").first()["args"][0]["default"] == "((((((1))))))"


def test_return_types_in_braces(found):
    types = {r["name"]: r["return_type"] for r in found.where("path IN ('brace.ts', 'hidden.go')").collect()}
    assert types["big"] == "{ x: number }" and types["small"] == "number"
    assert types["Run"] == "struct{ X int }" and types["Top"] == "interface{}"


def test_members_go_with_their_owner(found):
    assert names(found, "hidden.go") == {("", "Open"), ("Open", "Run"), ("", "Top")}
    assert names(exclude_private(found), "private.py") == {("", "Q"), ("Q", "go")}


def test_a_private_type_hides_what_it_holds(spark):
    sources = {
        "a.java": "class A {\n  class _B {\n    class C {\n      class D {\n        void low() { }\n      }\n      void m() { }\n    }\n  }\n  void n() { }\n}\nclass _E {\n}\nclass F {\n  void o() { }\n}\n",
        "a.cs": "class _A\n{\n    class B\n    {\n        void M() { }\n    }\n}\nclass C\n{\n    void N() { }\n}\n",
        "a.rb": "class _A\n  class B\n    def m\n    end\n  end\nend\nclass C\n  def _p\n  end\n  def n\n  end\nend\n",
        "a.py": "class _A:\n    def m(self):\n        pass\n\nclass B:\n    def n(self):\n        pass\n",
    }
    files = tag_language(spark.createDataFrame(list(sources.items()), "path string, content string"))
    rows = extract_symbols(files, private=False)
    rows.cache()
    assert names(rows, "a.java") == {("", "A"), ("A", "n"), ("", "F"), ("F", "o")}
    assert names(rows, "a.cs") == {("", "C"), ("C", "N")}
    assert names(rows, "a.rb") == {("", "C"), ("C", "n")}
    assert names(rows, "a.py") == {("", "B"), ("B", "n")}
