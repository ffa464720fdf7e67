"""Documentation pages as tables of text.

A module page is one value built from the rows of one file. Index and navigation grow with the
corpus, so they stay tables of ordered fragments; writing them in order gives the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecatalog.functions.text import first_line, html_escape, page_path, root_prefix
from codecatalog.operators.modules import with_class_line

FOOTER_MD = "*Generated by codecatalog*"


def _lit(text: str) -> Column:
    return F.lit(text)


def _if(test: Column, *parts: Column | str) -> Column:
    cols = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.when(test, F.concat(*cols)).otherwise("")


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _repeat(items: Column, before: str, after: str, escape=lambda c: c) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit(before), escape(x), F.lit(after))), "")


def _markdown_parts() -> dict[str, Column]:
    deprecated = _if(F.col("is_deprecated"), " ⚠️ DEPRECATED")
    decorators = _repeat(F.col("decorators"), "`@", "`\n")
    doc = _if(F.col("docstring") != "", F.col("docstring"), "\n")
    line = _text("**Line:** ", F.col("line_number").cast("string"), "\n\n")
    return {
        "class_head": _text("### ", F.col("signature"), deprecated, "\n", decorators, "\n", doc, "\n", line),
        "method": _text("##### `", F.col("signature"), "`", deprecated, "\n", decorators, "\n", doc, "\n"),
        "function": _text(
            "### `", F.col("signature"), "`", deprecated, "\n", decorators, "\n", doc, "\n", line, "---\n\n"
        ),
    }


def _html_parts() -> dict[str, Column]:
    deprecated = F.col("is_deprecated")
    flag = _if(deprecated, '<span class="badge-deprecated">DEPRECATED</span>\n')
    css = _if(deprecated, " deprecated")
    name = html_escape(F.col("name"))
    decorators = _repeat(F.col("decorators"), '<span class="decorator">@', "</span>\n", html_escape)
    signature = _text('<div class="signature">', html_escape(F.col("signature")), "</div>\n")
    doc = _if(
        F.col("docstring") != "", '<div class="docstring">', html_escape(F.col("docstring")), "</div>\n"
    )
    line = _text('<div class="meta">📍 Line ', F.col("line_number").cast("string"), "</div>\n")

    def block(css_class: str, badge: str, anchor: Column, *rest: Column) -> Column:
        return _text(
            f'<div class="{css_class}', css, '"', anchor, f'>\n<span class="type-badge {badge}">',
            "class" if badge == "class" else "def", "</span>\n", flag, decorators, signature, doc, *rest,
        )

    return {
        "class_head": block("doc-block", "class", _text(' id="class-', name, '"'), line),
        "method": _text(block("doc-block method-block", "method", _lit("")), "</div>\n"),
        "function": _text(block("doc-block", "func", _text(' id="func-', name, '"'), line), "</div>\n"),
        "toc": _text(
            F.when(F.col("kind") == "class", '<a href="#class-').otherwise('<a href="#func-'), name,
            F.when(F.col("kind") == "class", '" class="toc-item toc-class">C ').otherwise('" class="toc-item toc-func">F '),
            name, _if(deprecated, ' <span class="badge-deprecated-sm">deprecated</span>'), "</a>\n",
        ),
    }


_FRAMES = {
    "markdown": {
        "suffix": ".md", "methods": ("#### Methods\n\n", ""), "class_end": "\n---\n\n",
        "classes": ("## Classes\n\n", ""), "functions": ("## Functions\n\n", ""),
    },
    "html": {
        "suffix": ".html", "methods": ('<div class="methods-section">\n<h4>Methods</h4>\n', "</div>\n"),
        "class_end": "</div>\n", "classes": ("<h2>Classes</h2>\n", ""), "functions": ("<h2>Functions</h2>\n", ""),
    },
}


def _joined(rows: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(rows), lambda r: r["text"]), "")


def page_bodies(symbols: DataFrame, fmt: str) -> DataFrame:
    """``(path, classes, functions, toc)``: the fragments of each file, in source order."""
    parts = _markdown_parts() if fmt == "markdown" else _html_parts()
    frame = _FRAMES[fmt]
    rows = with_class_line(symbols).select(
        "path",
        "kind",
        "class_line",
        "line_number",
        F.when(F.col("kind") == "class", parts["class_head"])
        .when(F.col("kind") == "method", parts["method"])
        .otherwise(parts["function"])
        .alias("text"),
        (F.when(F.col("kind") != "method", parts["toc"]) if "toc" in parts else F.lit("")).alias("toc"),
    )
    piece = F.struct("line_number", "text")
    blocks = (
        rows.where("kind = 'function' OR class_line IS NOT NULL")
        .groupBy("path", F.coalesce("class_line", "line_number").alias("line_number"))
        .agg(
            F.max(F.when(F.col("kind") == "class", F.col("text"))).alias("head"),
            F.max(F.when(F.col("kind") == "function", F.col("text"))).alias("function"),
            F.collect_list(F.when(F.col("kind") == "method", piece)).alias("methods"),
            F.max("toc").alias("toc"),
        )
        .withColumn("is_class", F.col("head").isNotNull())
    )
    before, after = frame["methods"]
    class_text = _text(
        F.col("head"),
        _if(F.size("methods") > 0, before, _joined(F.col("methods")), after),
        frame["class_end"],
    )
    return (
        blocks.withColumn("text", F.when(F.col("is_class"), class_text).otherwise(F.col("function")))
        .groupBy("path")
        .agg(
            _joined(F.collect_list(F.when(F.col("is_class"), piece))).alias("classes"),
            _joined(F.collect_list(F.when(~F.col("is_class"), piece))).alias("functions"),
            _joined(
                F.collect_list(
                    F.struct(
                        (~F.col("is_class")).cast("int").alias("rank"), "line_number", F.col("toc").alias("text")
                    )
                )
            ).alias("toc"),
        )
    )


def render_pages(symbols: DataFrame, modules: DataFrame, fmt: str = "markdown") -> DataFrame:
    """``(page_path, content)`` of every module; ``modules`` carries ``page_path``."""
    frame = _FRAMES[fmt]
    joined = modules.join(page_bodies(symbols, fmt), "path", "left").fillna(
        "", ["classes", "functions", "toc"]
    )
    section = lambda name: _if(F.col(name) != "", frame[name][0], F.col(name), frame[name][1])
    doc, name, path = F.col("docstring"), F.col("module_name"), F.col("path")
    if fmt == "markdown":
        content = _text(
            "# `", name, "`\n\n", _if(doc != "", doc, "\n"), "\n**Source:** `", path, "`\n\n---\n\n",
            section("classes"), "\n", section("functions"), "\n", FOOTER_MD,
        )
    else:
        content = _text(
            '<div class="module-header">\n<div class="breadcrumb"><a href="', root_prefix(F.col("page_path")),
            'index.html">Index</a> › <span>', html_escape(name), "</span></div>\n<h1>", html_escape(name),
            "</h1>\n", _if(doc != "", '<p class="module-desc">', html_escape(doc), "</p>\n"),
            '<p class="meta-line">📄 <code>', html_escape(path), "</code></p>\n</div>\n",
            _if(F.col("toc") != "", '<div class="toc-card">\n<h3>Contents</h3>\n', F.col("toc"), "</div>\n"),
            section("classes"), section("functions"),
        )
    return joined.select("page_path", content.alias("content"))


def render_index(modules: DataFrame, counts: DataFrame, fmt: str = "markdown", title: str = "Project Documentation") -> DataFrame:
    """``(part, module_ord, content)``: head (part 0), one fragment per module, foot (part 2).

    ``modules`` carries ``module_ord`` and ``page_path``; ``counts`` is the one-row project total.
    """
    stats = {c: F.col(c).cast("string") for c in ("n_modules", "n_functions", "n_classes")}
    summary = first_line(F.col("docstring"))
    name = F.col("module_name")
    if fmt == "markdown":
        head = _text(
            f"# {title}\n\n> Auto-generated documentation\n\n---\n\n**Stats:** ", stats["n_modules"], " modules · ",
            stats["n_functions"], " functions · ", stats["n_classes"], " classes\n\n## Modules\n\n",
        )
        item = _text(
            "- [", name, "](", F.col("page_path"), ")\n", _if(F.col("docstring") != "", "  — ", summary, "\n"), "\n"
        )
        foot = f"\n---\n\n{FOOTER_MD}"
    else:
        head = _text(
            '<div class="hero">\n<h1>', html_escape(F.lit(title)),
            '</h1>\n<p class="hero-sub">Auto-generated API documentation</p>\n</div>\n<div class="stats">\n',
            *[
                part
                for column, label in (("n_modules", "modules"), ("n_functions", "functions"), ("n_classes", "classes"))
                for part in (
                    '<div class="stat-card"><span class="stat-value">', stats[column],
                    f'</span><span class="stat-label">{label}</span></div>\n',
                )
            ],
            '</div>\n<h2>Modules</h2>\n<div class="module-grid">\n',
        )
        item = _text(
            '<div class="module-card">\n<a href="', html_escape(F.col("page_path")), '">', html_escape(name), "</a>\n",
            F.when(F.col("docstring") != "", _text('<div class="description">', html_escape(summary), "</div>\n")).otherwise(
                '<div class="description muted">No description available</div>\n'
            ),
            '<div class="module-meta"><span>', stats["n_functions"], " functions</span><span>·</span><span>",
            stats["n_classes"], " classes</span></div>\n</div>\n",
        )
        foot = "</div>\n"
    zero = F.lit(0).cast("bigint").alias("module_ord")
    return (
        counts.select(F.lit(0).alias("part"), zero, head.alias("content"))
        .unionByName(modules.select(F.lit(1).alias("part"), "module_ord", item.alias("content")))
        .unionByName(counts.select(F.lit(2).alias("part"), zero, F.lit(foot).alias("content")))
    )


def navigation(modules: DataFrame) -> DataFrame:
    """Links to every module, once; a page marks its own by ``module_name``."""
    return modules.select(
        "module_ord",
        "module_name",
        F.col("page_path").alias("href"),
        root_prefix(F.col("page_path")).alias("root_prefix"),
    )
