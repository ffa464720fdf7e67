"""Symbol extraction: one plan for all languages, one exchange by path.

Lines are numbered and masked where the file was read. After the exchange every window and
aggregate is partitioned by path first, so the partitioning is reused to the end.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codecatalog.functions.docs import clean_docs
from codecatalog.functions.folds import flat_brackets, restored
from codecatalog.functions.params import base_names, parse_params
from codecatalog.functions.predicates import (
    deprecated_expr,
    is_exported,
    is_macro_name,
    is_private,
)
from codecatalog.functions.signature import signature_expr
from codecatalog.functions.text import collapse_spaces, let, module_name, normalise_quotes, strip
from codecatalog.operators.lines import (
    by_language,
    code_lines,
    line_window,
    per_specs,
    row_kind,
    up_to_here,
    with_depth,
    with_heads,
)
from codecatalog.specs import BRACES, SPECS, Decl, LangSpec

ARGS_TYPE = "array<struct<name:string,type_hint:string,default:string>>"


def _may_declare(spec: LangSpec, code: Column) -> Column:
    """Cheap test that keeps every line able to declare something or open a scope."""
    if spec.scope == "indent":
        return code.rlike(r":\s*$|^\s*(?:async\s+)?(?:def|class)\b")
    if spec.scope == "end":
        return (F.col("net") > 0) | code.rlike(r"^\s*(?:def|class|module)\b")
    test = F.contains(code, F.lit("{"))
    for decl in spec.decls:
        test = test | code.rlike(decl.pattern)
    return test


@per_specs
def _line_tests(specs: Mapping[str, LangSpec]) -> dict[str, Column]:
    return {
        "may_declare": let(flat_brackets(F.col("code")), lambda code: by_language(specs, lambda s: _may_declare(s, code), F.lit(False))),
        "doc_line": by_language(
            specs, lambda s: F.col("line").rlike(s.doc_line) if s.doc_line else F.lit(False)
        ),
    }


def prepared_lines(files: DataFrame, specs: Mapping[str, LangSpec]) -> DataFrame:
    """Everything that can be decided before the exchange, in as few bytes as possible."""
    lines = code_lines(files, specs).withColumn("kind0", row_kind(specs))
    tests = _line_tests(specs)
    raw_kept = F.col("kind0").isin("M", "T")
    inline_doc = F.regexp_extract("line", r"^\s*(/\*[*!].*?\*/)\s*\S", 1)
    return lines.select(
        "path",
        "lang",
        "line_no",
        "kind0",
        "net",
        "round_net",
        F.when(~F.col("kind0").isin("B", "M"), F.col("code")).alias("code"),
        F.when(raw_kept, F.col("line"))
        .when(F.col("text") != F.col("code"), F.col("text"))
        .alias("alt"),
        F.when((F.col("kind0") == "H") & F.contains("line", F.lit("/*")) & (inline_doc != ""), inline_doc).alias("inline_doc"),
        F.when(
            F.col("kind0") == "H",
            (F.col("round_net") > 0) | tests["may_declare"],
        )
        .otherwise(False)
        .alias("may_declare"),
        F.when(F.col("kind0") == "M", tests["doc_line"]).otherwise(False).alias("doc_line"),
    )


def scope_is(specs: Mapping[str, LangSpec], scope: str) -> Column:
    return F.col("lang").isin(*[s.name for s in specs.values() if s.scope == scope])


def logical_blocks(lines: DataFrame, specs: Mapping[str, LangSpec]) -> DataFrame:
    """One row per declaration candidate with the comments, annotations and strings tied to it."""
    numbered = with_heads(with_depth(lines))
    before = F.lag("kind0").over(line_window())
    block_start = (F.col("kind") == "M") & (
        F.col("alt").rlike(r"^\s*/\*")
        | (F.coalesce(before, F.lit("")) != "M")
        | (F.col("doc_line") != F.coalesce(F.lag("doc_line").over(line_window()), F.lit(False)))
    )
    indent0_head = scope_is(specs, "indent") & (F.col("kind") == "H") & F.col("code").rlike(r"^\S")
    rows = numbered.withColumns(
        {"starts_block": block_start.cast("int"), "starts_owner": indent0_head.cast("int")}
    ).withColumns(
        {
            "block": F.sum("starts_block").over(up_to_here()),
            "owner": F.sum("starts_owner").over(up_to_here()),
        }
    )
    kind = F.col("kind")
    continues_head = (kind == "C") & (F.col("started_by") == "H")
    kept = rows.where(kind.isin("M", "T", "A", "C") | ((kind == "H") & F.col("may_declare")))
    full_text = F.when(F.col("kind0") == "M", F.lit("")).otherwise(F.coalesce(F.col("alt"), F.col("code")))
    code = F.coalesce(F.col("code"), F.lit(""))
    head = kind == "H"
    return (
        kept.groupBy("path", "seg")
        .agg(
            F.first("lang").alias("lang"),
            F.max(F.when(head, F.col("line_no"))).alias("line_no"),
            F.max(F.when(head | continues_head, F.col("line_no"))).alias("header_end"),
            F.max(F.when(head, F.col("depth"))).alias("depth"),
            F.max(F.when(head, F.col("owner"))).alias("owner"),
            F.max(F.when(head, F.col("head_before"))).alias("head_before"),
            F.max(F.when(head, F.col("blank_before"))).alias("blank_before"),
            F.max(F.when(head, F.col("inline_doc"))).alias("inline_doc"),
            F.sum(F.when(head | continues_head, F.col("net"))).alias("net"),
            F.array_sort(
                F.collect_list(
                    F.when(
                        head | continues_head,
                        F.struct("line_no", code.alias("code"), full_text.alias("text")),
                    )
                )
            ).alias("parts"),
            F.array_sort(
                F.collect_list(
                    F.when(kind == "M", F.struct("line_no", "block", F.col("alt").alias("line"), "doc_line"))
                )
            ).alias("comments"),
            F.array_sort(
                F.collect_list(
                    F.when(
                        (kind == "A") | ((kind == "C") & (F.col("started_by") == "A")),
                        F.struct("line_no", kind.alias("kind"), full_text.alias("text")),
                    )
                )
            ).alias("annotations"),
            F.array_sort(
                F.collect_list(F.when(kind == "T", F.struct("line_no", F.col("alt").alias("line"))))
            ).alias("strings"),
        )
        .where("line_no IS NOT NULL")
        .withColumns(
            {
                "code": F.array_join(F.transform("parts", lambda r: r["code"]), " "),
                "text": F.array_join(F.transform("parts", lambda r: r["text"]), " "),
            }
        )
        .drop("parts")
    )


def _decl_struct(decl: Decl, code: Column, text: Column) -> Column:

    def group(i: int) -> Column:
        return F.regexp_extract(code, decl.pattern, i) if i else F.lit("")

    if decl.params:
        start = F.length(group(decl.head))
        size = F.length(group(decl.params))
        params = F.substring(text, start + 1, size)
    else:
        start = size = params = F.lit("")
    if decl.mid:
        ret = F.substring(text, start + size + F.length(group(decl.mid)) + 1, F.length(group(decl.ret)))
    else:
        ret = restored(group(decl.ret))
    bases, extra = params if decl.base_params else restored(group(decl.bases)), restored(group(decl.implements))
    name = group(decl.name)
    if decl.marker == "object":
        name = F.when(name.rlike(r"^(?:companion\s+)?object$"), "Companion").otherwise(name)
    return F.struct(
        F.lit(decl.kind).alias("kind"),
        F.lit(decl.where).alias("where"),
        F.lit(decl.marker).alias("marker"),
        F.lit(",".join(decl.accepts)).alias("accepts"),
        name.alias("name"),
        (F.lit("") if decl.base_params else params).alias("params"),
        strip(ret).alias("ret"),
        bases.alias("bases"),
        extra.alias("implements"),
        group(decl.receiver).alias("receiver"),
        group(decl.mods).alias("mods"),
    )


def _decl_of(spec: LangSpec, code: Column, text: Column) -> Column:
    chain = F
    for decl in spec.decls:
        chain = chain.when(code.rlike(decl.pattern), _decl_struct(decl, code, text))
    return chain.otherwise(F.lit(None)) if spec.decls else F.lit(None)


def with_declarations(blocks: DataFrame, specs: Mapping[str, LangSpec]) -> DataFrame:
    """Add the declaration struct ``d`` (null on lines that only open a scope)."""
    return blocks.withColumn("d", _declared(specs)).withColumn(
        "d", F.when(_is_symbol_like(specs), F.col("d"))
    )


@per_specs
def _declared(specs: Mapping[str, LangSpec]) -> Column:
    # Bound values also keep this large expression out of generated code, where it would not fit.
    return let(
        F.struct(flat_brackets(F.col("code")).alias("code"), "text"), lambda v: by_language(specs, lambda s: _decl_of(s, v["code"], v["text"]))
    )


@per_specs
def _is_symbol_like(specs: Mapping[str, LangSpec]) -> Column:
    """Control words, macro names and non-types only look like declarations."""

    def test(spec: LangSpec) -> Column:
        fine = F.lit(True)
        if spec.skip_names:
            fine = fine & ~F.col("d.name").isin(*spec.skip_names)
        if spec.skip_returns:
            fine = fine & ~F.col("d.ret").isin(*spec.skip_returns)
        if spec.skip_caps_functions:
            fine = fine & ~is_macro_name(F.col("d.name"))
        return (F.col("d.kind") != "function") | fine

    return by_language(specs, test)


def enclosing_scope(blocks: DataFrame, specs: Mapping[str, LangSpec]) -> DataFrame:
    """Add ``scope``: the nearest opener whose body holds the line, and Python's body margin.

    A line that opens a scope is emitted a second time under the depth it opens, so that the nearest
    opener of a line is the last one seen at the line's own depth.
    """
    is_python = scope_is(specs, "indent")
    indent = F.length(F.regexp_extract("code", r"^(\s*)", 1))
    unclosed = F.regexp_replace(flat_brackets(F.col("code")), BRACES, "")
    brace_left = F.col("brace_left")
    is_ruby_like = scope_is(specs, "end")
    opens_now = (
        F.when(is_python, (indent == 0))
        .when(is_ruby_like, F.col("net") > 0)
        .otherwise(brace_left)
    )
    may_open_next = (
        ~is_python & ~is_ruby_like & F.col("d").isNotNull()
        & ~F.contains(F.col("code"), F.lit("{")) & ~F.rtrim("code").endswith(";")
    )
    own_depth = F.when(is_python, F.when(indent == 0, 0).otherwise(F.col("owner"))).otherwise(F.col("depth"))
    opened_depth = F.when(is_python, F.col("owner")).otherwise(F.col("depth") + F.col("net"))
    opener = F.struct(
        F.coalesce(F.col("d.kind"), F.lit("other")).alias("kind"),
        F.coalesce(F.col("d.marker"), F.lit("")).alias("marker"),
        F.coalesce(F.col("d.accepts"), F.lit("")).alias("accepts"),
        F.coalesce(F.col("d.name"), F.lit("")).alias("name"),
        F.col("line_no").alias("line_no"),
        F.when(F.col("code").rlike(r"^\s*\{"), F.col("head_before")).alias("resumes"),
    )
    none = F.lit(None).cast("struct<kind:string,marker:string,accepts:string,name:string,line_no:bigint,resumes:bigint>")
    entry = lambda depth, order, op, pending: F.struct(
        depth.cast("bigint").alias("level"), F.lit(order).alias("step"), op.alias("opener"), pending.alias("pending")
    )
    entries = F.filter(
        F.array(
            entry(own_depth, 0, none, none),
            F.when(opens_now, entry(opened_depth, 1, opener, none)),
            F.when(may_open_next & ~opens_now, entry(opened_depth + 1, 1, none, opener)),
        ),
        lambda e: e.isNotNull(),
    )
    at_level = Window.partitionBy("path", "e.level").orderBy("line_no", "e.step")
    seen = at_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = at_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = (
        blocks.withColumns({"indent": indent, "brace_left": F.contains(unclosed, F.lit("{"))})
        .withColumn("e", F.explode(entries))
        .withColumns(
            {
                "opener": F.last("e.opener", ignorenulls=True).over(seen),
                "pending": F.last("e.pending", ignorenulls=True).over(seen),
                "margin": F.min(F.when(F.col("indent") > 0, F.col("indent"))).over(whole),
            }
        )
        .where("e.step = 0")
    )
    resumed = F.col("opener.resumes")
    scope = F.when(resumed.isNull(), F.col("opener")).otherwise(
        F.when(F.col("pending.line_no") == resumed, F.col("pending")).otherwise(F.col("opener"))
    )
    return placed.withColumn(
        "scope", F.when(F.col("e.level") > 0, scope)
    ).withColumn("level", F.col("e.level")).drop("e", "opener", "pending", "brace_left")


def _fill_gaps(rows: Column) -> Column:
    """Lines of a block in order, with '' for blank lines in between. ``rows`` is a bound value."""
    return F.flatten(
        F.transform(
            rows,
            lambda r, i: F.concat(
                F.array_repeat(
                    F.lit(""),
                    F.when(i == 0, 0).otherwise(r["line_no"] - F.get(rows, i - 1)["line_no"] - 1).cast("int"),
                ),
                F.array(r["line"]),
            ),
        )
    )


def _last_block(comments: Column) -> Column:
    return let(
        F.element_at(comments, -1)["block"],
        lambda block: F.filter(comments, lambda r: r["block"] == block),
    )


@per_specs
def doc_lines(specs: Mapping[str, LangSpec]) -> Column:
    """Raw lines of the documentation block that belongs to the row's declaration."""

    def of_block(block: Column) -> Column:
        first, last = F.element_at(block, 1), F.element_at(block, -1)
        near = F.col("blank_before").isNull() | (F.col("blank_before") < last["line_no"])

        def belongs(spec: LangSpec) -> Column:
            is_block = first["line"].rlike(spec.doc_block) if spec.doc_block else F.lit(False)
            return is_block | (last["doc_line"] & near) if spec.doc_line else is_block

        return F.when(by_language(specs, belongs), _fill_gaps(block))

    inline = [s.name for s in specs.values() if s.doc_block]
    return F.coalesce(
        F.when(F.col("lang").isin(*inline) & F.col("inline_doc").isNotNull(), F.array("inline_doc"))
        .when(scope_is(specs, "indent"), let(F.col("strings"), _fill_gaps))
        .when(F.size("comments") > 0, let(_last_block(F.col("comments")), of_block)),
        F.array().cast("array<string>"),
    )


def _python_decorators() -> Column:
    """Text of each ``@`` line above the header, in order, without the mark."""
    joined = F.array_join(
        F.transform(
            "annotations",
            lambda a: F.concat(F.when(a["kind"] == "A", F.lit("\u0002")).otherwise(F.lit(" ")), strip(a["text"])),
        ),
        "",
    )
    return F.transform(
        F.filter(F.split(joined, "\u0002"), lambda t: strip(t) != ""),
        lambda t: normalise_quotes(strip(F.regexp_replace(t, r"^\s*@", ""))),
    )


def outside_private_types(scoped: DataFrame) -> DataFrame:
    """Without the lines within types whose name is private, however far down.

    A fold over the levels of a file's lines finds where such types end: at the next line that isn't deeper. A private type
    within another needs no range of its own.
    """
    hides = (F.col("d.kind") == "class") & is_private(F.col("d.name"))
    # The brace of a body on its own line has the level of the header it belongs to.
    resumes = F.col("code").rlike(r"^\s*\{")
    row = F.struct("line_no", "level", F.coalesce(hides, F.lit(False)).alias("hides"), resumes.alias("resumes"))
    number = lambda x: F.lit(x).cast("bigint")
    start = F.struct(
        number(None).alias("level"), number(None).alias("since"), F.array().cast("array<struct<since:bigint,until:bigint>>").alias("ranges")
    )

    def step(acc: Column, r: Column) -> Column:
        ends = acc["level"].isNotNull() & (r["level"] <= acc["level"]) & ~r["resumes"]
        free = acc["level"].isNull() | ends
        found = F.struct(acc["since"].alias("since"), (r["line_no"] - 1).alias("until"))
        return F.struct(
            F.when(free, F.when(r["hides"], r["level"])).otherwise(acc["level"]).alias("level"),
            F.when(free, F.when(r["hides"], r["line_no"])).otherwise(acc["since"]).alias("since"),
            F.when(ends, F.array_append(acc["ranges"], found)).otherwise(acc["ranges"]).alias("ranges"),
        )

    def last(acc: Column) -> Column:
        rest = F.struct(acc["since"].alias("since"), number(2**62).alias("until"))
        return F.when(acc["level"].isNull(), acc["ranges"]).otherwise(F.array_append(acc["ranges"], rest))

    ranges = scoped.groupBy("path").agg(F.array_sort(F.collect_list(row)).alias("rows")).where(F.exists("rows", lambda r: r["hides"]))
    hidden = ranges.select("path", F.aggregate("rows", start, step, last).alias("hidden"))
    inside = F.exists("hidden", lambda x: (F.col("line_no") > x["since"]) & (F.col("line_no") <= x["until"]))
    return scoped.join(hidden, "path", "left").where(~F.coalesce(inside, F.lit(False))).drop("hidden")


def declarations(files: DataFrame, specs: Mapping[str, LangSpec] = SPECS, private: bool = True) -> DataFrame:
    """Every declaration with its scope, documentation and parts; nested ones included.

    ``status`` is 'symbol' for catalog rows and 'nested' for the rest. ``private=False`` leaves out what private types hold.
    """
    blocks = with_declarations(logical_blocks(prepared_lines(files, specs), specs), specs)
    scoped = enclosing_scope(blocks, specs)
    scoped = (scoped if private else outside_private_types(scoped)).where("d IS NOT NULL AND d.kind <> 'scope'")
    is_python = scope_is(specs, "indent")
    top = F.col("scope").isNull() & (F.col("level") <= 0) | F.col("scope.accepts").contains("transparent")
    in_class = F.col("scope.kind") == "class"
    in_impl = F.col("scope.accepts").contains("impl")
    carries = ~F.coalesce(
        by_language(
            specs,
            lambda s: F.col("scope.marker").isin(*s.memberless) if s.memberless else F.lit(False),
        ),
        F.lit(False),
    )
    nests = by_language(specs, lambda s: F.lit(s.nested_types))
    margin_ok = ~is_python | (F.col("indent") == F.col("margin"))
    d = F.col("d")
    kind = (
        F.when((d["kind"] == "class") & top, "class")
        .when((d["kind"] == "class") & in_class & nests, "class")
        .when((d["kind"] == "function") & top & (d["receiver"] != ""), "method")
        .when((d["kind"] == "function") & top & d["where"].isin("top", "any"), "function")
        .when(
            (d["kind"] == "function") & in_class & carries & margin_ok & d["where"].isin("member", "any"),
            "method",
        )
        .when((d["kind"] == "function") & in_impl, "method")
    )
    # A pattern made for class bodies proves nothing elsewhere, so such a row is dropped for good.
    real = kind.isNotNull() | (is_python & (d["kind"].isin("function", "class")))
    parent = (
        F.when(d["receiver"] != "", d["receiver"])
        .when(F.col("scope").isNotNull() & ~top, F.col("scope.name"))
        .otherwise("")
    )
    return scoped.where(real).select(
        "path",
        "lang",
        F.coalesce(kind, d["kind"]).alias("kind"),
        F.when(kind.isNotNull(), "symbol").otherwise("nested").alias("status"),
        d["name"].alias("name"),
        F.when(kind.isNotNull(), parent).otherwise("").alias("parent_name"),
        ((d["receiver"] != "") | F.coalesce(in_impl, F.lit(False))).alias("by_receiver"),
        d["marker"].alias("marker"),
        d["params"].alias("params"),
        d["ret"].alias("ret"),
        d["bases"].alias("bases_raw"),
        d["implements"].alias("implements_raw"),
        d["mods"].alias("mods"),
        doc_lines(specs).alias("doc_raw"),
        "annotations",
        "line_no",
        "header_end",
        "indent",
        "code",
    )


def attach_receivers(symbols: DataFrame, specs: Mapping[str, LangSpec] = SPECS) -> DataFrame:
    """Keep a method declared outside its type only if the file declares that type.

    The equi-join on (path, type name) is a window, because both sides are rows of the same table
    and already share the partitioning by path.
    """
    owner_marker = by_language(specs, lambda s: F.lit(s.owner_marker), F.lit(""))
    owns = (F.col("kind") == "class") & (F.col("marker") == owner_marker) & (owner_marker != "")
    key = F.when(F.col("by_receiver"), F.col("parent_name")).otherwise(F.col("name"))
    joined = symbols.withColumn("owner_key", key).withColumn(
        "has_owner", F.max(owns).over(Window.partitionBy("path", "owner_key"))
    )
    return joined.where(~F.col("by_receiver") | F.col("has_owner")).drop("owner_key", "has_owner")


def exported_only(symbols: DataFrame, specs: Mapping[str, LangSpec] = SPECS) -> DataFrame:
    """Languages that export by capital letter list exported names only."""
    by_capital = [s.name for s in specs.values() if s.exported_only]
    return symbols.where(~F.col("lang").isin(*by_capital) | is_exported(F.col("name"))) if by_capital else symbols


def exclude_private(symbols: DataFrame) -> DataFrame:
    """A private owner goes with its own members. ``extract_symbols`` knows owners at any level above."""
    return symbols.where(~is_private(F.col("name")) & ~is_private(F.col("parent_name")))


@per_specs
def _detail_columns(specs: Mapping[str, LangSpec]) -> dict[str, Column]:
    no_args = F.array().cast(ARGS_TYPE)
    no_names = F.array().cast("array<string>")
    ret = collapse_spaces(F.col("ret"))
    is_python = scope_is(specs, "indent")
    all_bases = F.concat_ws(
        ", ", F.nullif(F.col("bases_raw"), F.lit("")), F.nullif(F.col("implements_raw"), F.lit(""))
    )

    def return_type(spec: LangSpec) -> Column:
        if spec.scope == "indent":
            return normalise_quotes(ret)
        return F.regexp_replace(ret, r"^\(([\s\S]*)\)$", "$1") if spec.name == "go" else ret

    splitters: dict[tuple[bool, bool], list[LangSpec]] = {}
    for spec in specs.values():
        splitters.setdefault((spec.angle_brackets, spec.quote_chars), []).append(spec)
    bases = F
    for group in splitters.values():
        bases = bases.when(F.col("lang").isin(*[s.name for s in group]), base_names(all_bases, group[0]))
    cleaners: dict[tuple[str, str], list[LangSpec]] = {}
    for spec in specs.values():
        cleaners.setdefault((spec.doc_style, spec.tag_marks), []).append(spec)
    docs = F
    for (style, marks), group in cleaners.items():
        docs = docs.when(F.col("lang").isin(*[s.name for s in group]), clean_docs(F.col("doc_raw"), style, marks))
    return {
        "args": F.when(
            F.col("params") != "", by_language(specs, lambda s: parse_params(F.col("params"), s))
        ).otherwise(no_args),
        "return_type": by_language(specs, return_type),
        "bases": F.when((F.col("bases_raw") != "") | (F.col("implements_raw") != ""), bases.otherwise(no_names)).otherwise(
            no_names
        ),
        "docstring": F.when(F.size("doc_raw") > 0, docs.otherwise("")).otherwise(""),
        "decorators": F.when(is_python, _python_decorators())
        .when(F.col("marker") != "", F.array("marker"))
        .otherwise(no_names),
        "is_method": F.col("kind") == "method",
        "is_async": F.col("mods").rlike(r"\b(?:async|suspend)\b"),
        "tagged_deprecated": F.exists("doc_raw", lambda x: x.rlike(r"[@\\][Dd]eprecated\b")),
    }


def with_details(rows: DataFrame, specs: Mapping[str, LangSpec] = SPECS) -> DataFrame:
    """Parameters, bases, documentation, flags and signature of each declaration."""
    annotation_texts = F.transform("annotations", lambda a: a["text"])
    parsed = rows.withColumns(_detail_columns(specs))
    return parsed.select(
        "path",
        module_name(F.col("path")).alias("module_name"),
        "lang",
        "kind",
        "status",
        "name",
        "parent_name",
        signature_expr().alias("signature"),
        "args",
        "return_type",
        "bases",
        "decorators",
        "docstring",
        "is_method",
        "is_async",
        (deprecated_expr(F.col("docstring"), annotation_texts) | F.col("tagged_deprecated")).alias("is_deprecated"),
        F.col("line_no").alias("line_number"),
        "header_end",
        "indent",
    )


def catalog_rows(files: DataFrame, specs: Mapping[str, LangSpec] = SPECS, private: bool = True) -> DataFrame:
    """All declarations with details; ``status`` tells catalog symbols from nested ones."""
    return with_details(attach_receivers(exported_only(declarations(files, specs, private), specs), specs), specs)


def extract_symbols(
    files: DataFrame, specs: Mapping[str, LangSpec] = SPECS, private: bool = True
) -> DataFrame:
    """The symbol table of ``files(path, lang, content)``."""
    symbols = catalog_rows(files, specs, private).where("status = 'symbol'").drop("status", "header_end", "indent")
    return symbols if private else exclude_private(symbols)
