"""Paths, states, ordering, fill helpers, builds and streams."""

import json
import os

import pytest
from pyspark.sql import functions as F

from codecatalog import corpus
from codecatalog.functions import predicates, text
from codecatalog.operators import diff as d
from codecatalog.operators import fill, lines, modules, publish
from codecatalog.operators.ordering import with_dense_order
from codecatalog.plans import build, change_queries, registry
from codecatalog.plans.change_queries import corpus_snapshot
from codecatalog.session import new_run_dir
from codecatalog.sources import files as src
from codecatalog.sources import sinks, state, tree
from codecatalog.specs import SPECS
from codecatalog.streaming import feed, refresh


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "path,expected",
    [("a/b.py", "a.b"), ("a/__init__.py", "a"), ("a/index.ts", "a"), ("index.ts", "index"), ("a.b/c.d.ts", "a.b.c.d"), ("x/.hidden", "x..hidden")],
)
def test_module_name(spark, path, expected):
    assert one(spark, path, text.module_name) == expected


@pytest.mark.parametrize("path,expected", [("a/b.tar.gz", ".gz"), ("a.b/c", ""), (".py", ""), ("a/x.PY", ".PY")])
def test_path_ext(spark, path, expected):
    assert one(spark, path, text.path_ext) == expected


@pytest.mark.parametrize(
    "path,out", [("a/build/x.py", True), ("builds/x.py", False), ("p.egg-info/x.py", True), ("xegg-info/x.py", False), ("dist", True)]
)
def test_excluded_dirs(spark, path, out):
    assert one(spark, path, predicates.in_excluded_dir) is out


def test_page_paths_never_collide(spark):
    paths = ["a.py", "a.ts", "a/__init__.py", "a/index.ts", "index.ts", "index.py", "b.kt"]
    df = spark.createDataFrame([(p,) for p in paths], "path string").withColumn("module_name", text.module_name(F.col("path")))
    got = {r.path: r.page_path for r in modules.with_page_path(df, ".md").collect()}
    assert got == {
        "a.py": "a.md", "a.ts": "a~ts.md", "a/__init__.py": "a~py.md", "a/index.ts": "a~ts~2.md",
        "index.py": "index~py.md", "index.ts": "index~ts.md", "b.kt": "b.md",
    }


def test_scan_reads_hidden_and_empty_files(spark, tmp_path):
    for name, body in {"p/__init__.py": b"", "p/_a.py": b"x", "p/b.txt": b"", "build/c.py": b"", "d e+%41.py": b"y"}.items():
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    (tmp_path / "p" / "loop").symlink_to(tmp_path)
    for root in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}/"):
        got = {r.path: bytes(r.content) for r in src.read_source_tree(spark, root).collect()}
        assert got == {"p/__init__.py": b"", "p/_a.py": b"x", "d e+%41.py": b"y"}


def test_scan_lists_level_by_level(spark, tmp_path):
    wanted = {f"{'/'.join('abcd'[:depth])}/{name}".lstrip("/"): depth for depth in range(5) for name in ("_x.py", ".y.py", "z.go")}
    for path, size in wanted.items():
        os.makedirs((tmp_path / path).parent, exist_ok=True)
        (tmp_path / path).write_bytes(b"x" * size)
    os.makedirs(tmp_path / "a" / "node_modules" / "deep")
    (tmp_path / "a" / "node_modules" / "deep" / "no.py").write_bytes(b"")
    listed = tree.list_tree(spark, str(tmp_path), [".py", ".go"], ["node_modules"])
    assert {r.path: r["size"] for r in listed.collect()} == wanted
    os.remove(tmp_path / "z.go")
    assert {r.path for r in tree.read_files(listed, str(tmp_path)).collect()} == set(wanted) - {"z.go"}
    assert tree.read_files(listed.where("false"), str(tmp_path)).count() == 0


def test_state_missing_and_corrupt(spark, tmp_path):
    assert state.read_state(spark, str(tmp_path / "none")).count() == 0
    assert state.read_state_json(spark, str(tmp_path / "none.json")).count() == 0
    for i, text in enumerate(["{", "", "[]", '{"hashes": {"a": "1", "b": "2"', '{"hashes": {"a": "1"}} {"hashes": {"b": "2"}}x', '{"other": {"a": "1"}}']):
        (tmp_path / f"bad{i}.json").write_text(text)
        assert state.read_state_json(spark, str(tmp_path / f"bad{i}.json")).count() == 0


def test_state_is_read_in_splits(spark, tmp_path):
    odd = {'a,b "c", d.py': "1", 'q",': "2"}
    known = {f"dir, {i}/é \\ \n{i}.py": f"{i:064x}" for i in range(3000)}
    for name, hashes, indent in (("one", known, None), ("two", known, 2), ("odd", known | odd, None), ("none", {}, None)):
        (tmp_path / f"{name}.json").write_text(json.dumps({"hashes": hashes}, indent=indent))
        got = state.read_state_json(spark, str(tmp_path / f"{name}.json"))
        assert {r["path"]: r["sha256"] for r in got.collect()} == hashes
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        assert state.read_state_json(spark, str(tmp_path / "two.json")).rdd.getNumPartitions() > 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_uncommitted_state_is_not_seen(spark, tmp_path):
    root = str(tmp_path / "s")
    rows = spark.createDataFrame([("a", "1")], state.STATE_SCHEMA)
    state.write_state(rows, root, 0)
    state.write_data(rows.limit(0), root, 1)
    assert state.read_state(spark, root).count() == 1


def test_diff_with_itself_is_empty(spark, sf_dir):
    now = corpus_snapshot(spark, sf_dir, 1)
    assert d.touched_paths(d.snapshot_diff(now, now)).isEmpty()


def test_diff_statuses(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, sha256 string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, sha256 string")
    got = {r.path: r.status for r in d.snapshot_diff(new, old).collect()}
    assert got == {"a": "unchanged", "b": "modified", "c": "deleted", "d": "added"}
    diff = d.snapshot_diff(new, old)
    assert {tuple(r) for r in d.update_state(old, new, diff).collect()} == {tuple(r) for r in new.collect()}


def test_dense_order_over_many_partitions(spark):
    df = spark.range(1000).select(F.concat(F.lit("k"), F.col("id")).alias("k")).repartition(16)
    got = [r.k for r in with_dense_order(df, "k").orderBy("ord").collect()]
    assert got == sorted(got) and len(got) == 1000
    assert with_dense_order(df, "k").agg(F.min("ord"), F.max("ord")).first() == (1, 1000)


def test_hot_hash_keeps_every_page(spark):
    pages = spark.range(3000).select(
        F.concat(F.lit("p"), "id").alias("page_path"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("content")
    )
    manifest = publish.publish_manifest(pages)
    wanted = manifest.where("path = '/p0'").select("sha1").unionByName(manifest.where("path = '/p3'").select("sha1"))
    assert publish.required_uploads(manifest, wanted).count() == 1000


@pytest.mark.parametrize(
    "raw,expected",
    [("  ```python\nDoc.```", "Doc."), ('"""Doc."""', "Doc."), (None, ""), ("`x` and `y`", "x` and `y")],
)
def test_clean_docstring_completion(spark, raw, expected):
    assert one(spark, raw, fill.clean_docstring_completion) == expected


@pytest.mark.parametrize("raw,expected", [("```ts\nlet a;\n```", "let a;"), ("let a;", "let a;"), ("```", ""), (None, "")])
def test_clean_source_completion(spark, raw, expected):
    assert one(spark, raw, fill.clean_source_completion) == expected


def test_unknown_style_is_google(spark):
    row = [("s", "b")]
    df = spark.createDataFrame(row, "signature string, body string")
    assert fill.doc_prompts(df, "nope").first().prompt == fill.doc_prompts(df, "google").first().prompt


def test_generic_fill_takes_whole_files_and_skips_unchanged(spark):
    long = "int a;\n" * 1500 + "int last;"
    files = spark.createDataFrame([("a.c", "cpp", long), ("b.c", "cpp", "int b;")], "path string, lang string, content string")
    assert long in fill.generic_prompts(files).where("path = 'a.c'").first().prompt
    answers = spark.createDataFrame([("a.c", "// new\n" + long), ("b.c", "```c\nint b;\n```")], "path string, completion string")
    got = {r.path: r.content for r in fill.generic_fill(files, answers).collect()}
    assert got == {"a.c": "// new\n" + long}


JAVA_FILE = "package p;\n\n" + "".join(
    f"/** Doc {i}. */\nclass C{i} {{\n    String s = \"a  {{ // b\";\n    int m{i}(int a) {{\n        return a / {i}; // why\n    }}\n}}\n" for i in range(9000)
)


def test_long_files_are_filled_in_parts(spark):
    """A file of 1 MB comes back whole; parts whose answer changes code stay as they were."""
    assert len(JAVA_FILE) > 1_000_000
    files = spark.createDataFrame([("a.java", "java", JAVA_FILE), ("b.java", "java", "class B {\n}\n")], "path string, lang string, content string")
    prompts = fill.generic_prompts(files, part_chars=50_000)
    parts = {(r["path"], r["part"]): r["prompt"].split(":\n\n", 1)[1] for r in prompts.collect()}
    own = [text for (path, _), text in sorted(parts.items()) if path == "a.java"]
    assert len(own) > 20 and "\n".join(own) == JAVA_FILE
    assert all(text.lstrip().startswith(("/** Doc", "String", "int m")) for text in own[1:]) and max(map(len, own)) < 51_000
    number = F.col("part") % 4
    body = F.regexp_replace("prompt", r"^[\s\S]*?:\n\n", "")
    completion = (
        F.when(F.col("path") == "b.java", F.concat(F.lit("// New.\n"), body))
        .when(number == 0, F.concat(F.lit("```java\n/* New. */\n"), F.replace(body, F.lit("{"), F.lit(" { ")), F.lit("\n```")))
        .when(number == 1, F.concat(F.lit("// New.\n"), F.substring(body, 1, 20_000)))
        .when(number == 2, F.concat(F.lit("// New.\n"), F.replace(body, F.lit("a  {"), F.lit("a {"))))
        .otherwise(F.concat(F.lit("// New.\n"), body))
    )
    got = {r["path"]: r["content"] for r in fill.generic_fill(files, prompts.withColumn("completion", completion), part_chars=50_000).collect()}
    assert got["b.java"] == "// New.\nclass B {\n}"
    margins = [text[: len(text) - len(text.lstrip())] for text in own]
    expected = [text if n % 4 < 3 else margins[n] + "// New.\n" + text.rstrip() for n, text in enumerate(own)]
    # Spaces in strings are code: the first kind of answer changed some.
    assert got["a.java"] == "\n".join(expected)


@pytest.mark.parametrize(
    "lang,text,same,fits",
    [
        ("java", "int a = 1;\n", "/** A. */\nint  a=1 ;  // one\n\n", True),
        ("java", "int a = 1;\n", "int a = 2;\n", False),
        ("java", "s = \"a b\";", "s = \"a  b\";", False),
        ("java", "int a;\nint b;\n", "int a;\n", False),
        ("java", "in t", "int", False),
        ("ruby", "a\nb\n", "a # one\n# two\n\n  b\n", True),
        ("ruby", "a\nb\n", "a b\n", False),
        ("typescript", "x = `a ${b}`\n", "// d\nx = `a ${b}`\n", True),
        ("typescript", "x = `a ${b}`\n", "x = `a ${ b}`\n", False),
        ("cpp", "#define A 1\nint a;\n", "#define A 1\n/// D.\nint a;\n", True),
        ("cpp", "#define A 1\nint a;\n", "int a;\n", False),
    ],
)
def test_code_alone(spark, lang, text, same, fits):
    df = spark.createDataFrame([(lang, text, same)], "lang string, a string, b string")
    assert df.select(lines.code_alone(F.col("a"), SPECS) == lines.code_alone(F.col("b"), SPECS)).first()[0] is fits


def test_incomplete_prompts_have_no_body(spark):
    df = spark.createDataFrame([("s", ""), ("t", "b")], "signature string, body string")
    assert ["Body:" in r["prompt"] for r in fill.doc_prompts(df).orderBy("signature").collect()] == [False, True]


def symbol_rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_incremental_build_equals_full(spark, sf_dir):
    out = new_run_dir(spark, "build")
    one_, two = (corpus_snapshot(spark, sf_dir, v) for v in (1, 2))
    build.full_build(spark, one_, f"{out}/a", 0)
    assert build.incremental_build(spark, two, f"{out}/a", 1)
    assert not build.incremental_build(spark, two, f"{out}/a", 2)
    build.full_build(spark, two, f"{out}/b", 0)
    for table, schema in (("symbols", build.SYMBOL_SCHEMA), ("modules", build.MODULE_SCHEMA)):
        left = spark.read.schema(schema).parquet(f"{out}/a/{table}/data/v=1")
        right = spark.read.schema(schema).parquet(f"{out}/b/{table}/data/v=0")
        assert symbol_rows(left) == symbol_rows(right)
    site = symbol_rows(sinks.read_pages(spark, f"{out}/a"))
    assert site == symbol_rows(sinks.read_pages(spark, f"{out}/b"))
    assert symbol_rows(spark.read.parquet(f"{out}/a/nav/data/v=1")) == symbol_rows(spark.read.parquet(f"{out}/b/nav/data/v=0"))
    # The second version wrote the pages of touched modules alone.
    placed = spark.read.parquet(f"{out}/a/placed/data/v=1")
    touched = d.touched_paths(d.snapshot_diff(two, one_)).select("path")
    log = spark.read.parquet(f"{out}/a/pages/data/v=1")
    assert 0 < log.where("content IS NOT NULL").count() == placed.join(touched, "path", "left_semi").count() < placed.count()
    # What a build wrote that never came to its commit isn't there.
    sinks.write_page_log(log.limit(1).withColumn("content", F.lit("half")), log.select("page_path"), f"{out}/a", 7)
    assert symbol_rows(sinks.read_pages(spark, f"{out}/a")) == site
    assert symbol_rows(state.read_state(spark, f"{out}/a/state")) == symbol_rows(state.read_state(spark, f"{out}/b/state"))
    assert spark.read.text(f"{out}/b/index/v=0").first().value == "# Project Documentation"


def test_build_fills_once_per_prompt(spark, tmp_path):
    calls = str(tmp_path)

    def answer(batches):
        for prompts in batches:
            for prompt in prompts:
                with open(f"{calls}/{hash(prompt)}-{os.getpid()}-{os.urandom(4).hex()}", "w") as file:
                    file.write(prompt)
            yield prompts.map(lambda p: 'Says "hi" and C:\\\\path.' if "Signature" in p else "```\n// Added.\n" + p.split("\n\n", 1)[1] + "\n```")

    sources = [
        ("a.py", "def f(x):\r\n  return x\r\n"),
        ("b.py", 'def g(x):\n\t"""Known."""\n\treturn x\n'),
        ("c.go", "package c\n\nfunc Open() int {\n\treturn 1\n}\n"),
    ]
    files = spark.createDataFrame(sources, "path string, content string")
    out = new_run_dir(spark, "fill")
    options = build.BuildOptions(completer=answer)
    build.full_build(spark, files, out, 0, options)
    assert len(os.listdir(calls)) == 2
    filled = {r.path: r.content for r in spark.read.parquet(f"{out}/filled/data/v=0").collect()}
    assert filled["b.py"] == sources[1][1]
    assert filled["a.py"] == 'def f(x):\r\n  """Says \\"hi\\" and C:\\\\\\\\path."""\r\n  return x\r\n'.replace('\\"', '"')
    docs = {r.name: r.docstring for r in spark.read.schema(build.SYMBOL_SCHEMA).parquet(f"{out}/symbols/data/v=0").collect()}
    assert docs["f"].startswith("Says") and docs["g"] == "Known."
    added = spark.read.parquet(f"{out}/changes").where("action = 'added'").collect()
    assert [r.name for r in added] == ["f"]
    assert not build.incremental_build(spark, files, out, 1, options)
    assert len(os.listdir(calls)) == 2


def test_older_events_change_nothing(spark):
    out = new_run_dir(spark, "order")
    assert refresh.refresh(feed_rows(spark, [("a.py", "modified", "def new():\n    pass\n", "2024-01-05")]), out)
    assert not refresh.refresh(feed_rows(spark, [("a.py", "modified", "def old():\n    pass\n", "2024-01-04")]), out)
    assert [r.name for r in refresh.current_symbols(spark, out).collect()] == ["new"]
    ties = [("b.py", "modified", f"def {n}():\n    pass\n", "2024-01-05") for n in "pq"]
    names = set()
    for rows in (ties, ties[::-1]):
        assert refresh.refresh(feed_rows(spark, rows), out := new_run_dir(spark, "ties"))
        names.add(refresh.current_symbols(spark, out).first().name)
    assert len(names) == 1


def feed_rows(spark, rows):
    return spark.createDataFrame(
        [(p, c, x if x is None else bytearray(x.encode()), t) for p, c, x, t in rows], "path string, change string, content binary, ts string"
    ).withColumn("ts", F.col("ts").cast("timestamp"))


def test_replayed_batch_changes_nothing(spark):
    out = new_run_dir(spark, "replay")
    batch = feed_rows(spark, [("a.py", "added", "def f(): pass\n", "2024-01-01"), ("a.py", "modified", "def g():\n    pass\n", "2024-01-02"), ("b.txt", "added", "x", "2024-01-01")])
    assert refresh.refresh(batch, out)
    assert [r.name for r in refresh.current_symbols(spark, out).collect()] == ["g"]
    assert not refresh.refresh(batch, out)
    assert refresh.refresh(feed_rows(spark, [("a.py", "deleted", None, "2024-01-03")]), out)
    assert refresh.current_symbols(spark, out).count() == 0
    assert state.current_version(spark, out) == 1


def test_compacted_log_is_the_same_catalog(spark):
    out = new_run_dir(spark, "compact")
    for i, name in enumerate("fgh"):
        refresh.refresh(feed_rows(spark, [(f"{name}.py", "added", f"def {name}():\n    pass\n", "2024-01-01")]), out)
    refresh.compact(spark, out, f"{out}-new", 0)
    assert symbol_rows(refresh.current_symbols(spark, out)) == symbol_rows(refresh.current_symbols(spark, f"{out}-new"))


def test_corpus_reaches_every_suffix(spark):
    files = registry.tagged(spark, "/root/testdata/sf0.01")
    assert files.select("ext").distinct().count() == 19
    assert corpus.corpus_files(spark, "/root/testdata/sf0.01").select("path").distinct().count() == 1000


def gated_rows(spark, rows):
    schema = "repo string, path string, change string, text string, ts string, event_type string"
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({"content": F.encode("text", "UTF-8"), "ts": F.col("ts").cast("timestamp")}).drop("text")


def test_changes_wait_for_a_gated_event(spark):
    out = new_run_dir(spark, "gate")
    code = "def f_{}():\n    pass\n"
    first = [
        ("a", "a/x.py", "added", code.format("x"), "2024-01-01", "edit"),
        ("a", None, None, None, "2024-01-02", "push"),
        ("a", "a/y.py", "added", code.format("y"), "2024-01-03", "edit"),
        ("b", "b/z.py", "added", code.format("z"), "2024-01-01", "edit"),
        ("b", None, None, None, "2024-01-05", "star"),
    ]
    second = [("b", None, None, None, "2024-01-04", "push"), ("a", "a/late.py", "added", code.format("late"), "2024-01-01", "edit")]

    def names():
        return {r["name"] for r in refresh.current_symbols(spark, f"{out}/catalog").collect()}

    for _ in range(2):  # a replayed batch changes nothing
        refresh.apply_gate(gated_rows(spark, first), 0, "push", out, build.BuildOptions())
        assert names() == {"f_x"}
    for _ in range(2):
        refresh.apply_gate(gated_rows(spark, second), 1, "push", out, build.BuildOptions())
        assert names() == {"f_x", "f_z", "f_late"}
    pending = spark.read.parquet(f"{out}/pending/data/v=1").collect()
    assert [r["path"] for r in pending] == ["a/y.py"]
    ignored = spark.read.parquet(f"{out}/ignored/data").groupBy("event_type").agg(F.sum("n_ignored").alias("n")).collect()
    assert {r["event_type"]: r["n"] for r in ignored} == {"edit": 4, "star": 1}


def test_states_of_a_folder_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """The text source would list a folder's files in the driver."""
    folder = tmp_path / "{a} b"
    folder.mkdir()
    texts = {
        "bad": "{", "none": "", "cut": '{"hashes": {"z": "1"', "twice": '{"hashes": {"y": "1"}} {"hashes": {"b": "2"}}x',
        "odd": '{"hashes": {"q\\",": "2", "b, \\"c\\"": "3"}}', "pretty": json.dumps({"hashes": {"d": "4", "é": "5"}}, indent=2), "_hidden": '{"hashes": {"h": "1"}}',
        "mark": '\ufeff{"hashes": {"m": "6"}}', "more": '{"hashes": {"w": "1"}}",x', "null": '{"hashes": {"u": null}}', "large*[1]": json.dumps({"hashes": {f"l{i}": "7" for i in range(200)}}),
    }
    for name, text in texts.items():
        (folder / f"{name}.json").write_text(text)
    (folder / "inner").mkdir()
    (folder / "inner" / "i.json").write_text('{"hashes": {"i": "1"}}')
    known = {'q",': "2", 'b, "c"': "3", "d": "4", "é": "5", "m": "6", "u": None} | {f"l{i}": "7" for i in range(200)}
    monkeypatch.setattr(state, "LARGE_STATE", 1000)
    assert {r["path"]: r["sha256"] for r in state.read_state_json(spark, str(folder)).collect()} == known
    monkeypatch.setattr(state, "LARGE_STATE", 1 << 20)
    assert not [f for f in state.read_state_json(spark, str(folder)).inputFiles() if f.endswith(".json")]
    assert {r["path"]: r["sha256"] for r in state.read_state_json(spark, str(folder)).collect()} == known


def test_completers_get_batches_of_bounded_size(spark):
    """However many long prompts a task has; the answers are whole and the session's own limit stays."""
    seen = spark.sparkContext.accumulator(0)

    def completer(batches):
        for batch in batches:
            assert len(batch) <= fill.BATCH_ROWS
            assert len(batch) == 1 or batch.str.len().sum() <= fill.BATCH_CHARS
            seen.add(len(batch))
            yield batch.str.len().astype(str)

    sized = F.when(F.col("id") % 500 == 7, 5_000_000).when(F.col("id") % 3 == 0, 60_000).otherwise(10)
    prompts = spark.range(0, 1500, 1, 1).select("id", F.repeat(F.lit("x"), sized.cast("int")).alias("prompt"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    done = fill.complete(prompts, completer)
    assert done.where(F.col("completion") == F.length("prompt").cast("string")).count() == 1500
    assert seen.value == 1500 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_report_inputs_come_from_files_at_hand(spark):
    """Suggestions are made from the files that a report has written, not from the corpus built again."""
    files = spark.createDataFrame(
        [("a.py", "py", "python", "def f(x):\n    return x\n"), ("b.py", "py", "python", 'def g():\n    """Doc."""\n'), ("c.go", "go", "go", "func F() {}")],
        "path string, ext string, lang string, content string",
    )
    rows = change_queries.python_suggestions(spark, "/nowhere", files).select("path", "name", "docstring").collect()
    assert [tuple(r) for r in rows] == [("a.py", "f", "Documents f.")]


def test_written_files_are_the_kept_ones_and_the_quarantine(spark, sf_dir):
    kept, broken = registry.written_files(spark, sf_dir)
    same = registry.kept_files(spark, sf_dir)
    assert kept.columns == same.columns and sorted(kept.collect()) == sorted(same.collect())
    assert broken.columns == ["path", "reason"]
    python = registry.kept_files(spark, sf_dir, ("python",))
    assert sorted(kept.where("lang = 'python'").select("path", "content").collect()) == sorted(python.select("path", "content").collect())
