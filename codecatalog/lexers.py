"""Lexers of languages whose literals nest: code in strings, strings in that code, comments in comments, heredocs.

A lexer is data: the delimiters of a language, and what each does in each mode. Modes are single characters on a stack:
the empty stack and ``i`` (code within a literal) are code; ``h`` and ``r`` end at a delimiter that was read before
(heredocs and raw strings); others end by a rule.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from codecatalog.functions.folds import written_by
from codecatalog.functions.text import let

CODE = ("", "i")


@dataclass(frozen=True)
class Lexer:
    """``needed`` finds files that need it: others have flat literals, which one pattern cuts out.

    ``delimiters`` is a pattern of the tokens that matter, ``plain`` a class of characters that begin none. ``rules``
    maps a mode and a token to ``+x`` (begin mode x, of several the last is on top), ``-`` (end the mode) or ``.x`` (a whole
    literal of mode x). ``comments`` are modes that are comments. ``heredoc`` and ``raw`` are patterns of tokens that
    announce a body and open a raw string; ``ending`` makes the end delimiter of them. ``regex_after`` tells, from the code
    before a slash, that it begins a regular expression.
    """

    needed: str
    delimiters: str
    plain: str
    rules: dict[str, str] = field(default_factory=dict)
    comments: str = ""
    heredoc: str = ""
    raw: str = ""
    ending: tuple[str, str] = ("", "")
    regex_after: str = ""

    def __hash__(self) -> int:
        return hash((self.needed, self.delimiters))


def _modes(codes: dict[str, str], **modes: dict[str, str]) -> dict[str, str]:
    """Rules of code, which hold at the bottom and in ``i``, and of the modes by their names."""
    rules = {mode + token: action for mode in CODE for token, action in codes.items()}
    rules |= {"i{": "+i", "i}": "-"}
    return rules | {mode + token: action for mode, own in modes.items() for token, action in own.items()}


_LINE_END = {"\n": "-"}

TYPESCRIPT = Lexer(
    needed=r"\$\{",
    delimiters=r"\\[\s\S]|\$\{|//|/\*|\*/|[`\"'{}\[\]/\n]",
    plain=r"[^`\"'{}\[\]/\n\\$*]",
    rules=_modes(
        {"`": "+t", '"': "+d", "'": "+s", "//": "+l", "/*": "+c"},
        t={"`": "-", "${": "+i"}, d={'"': "-"} | _LINE_END, s={"'": "-"} | _LINE_END, l=_LINE_END, c={"*/": "-"},
        x={"/": "-", "//": "-", "[": "+y"} | _LINE_END, y={"]": "-"},
    ),
    comments="lc",
    regex_after=r"(?:^|[=(,:;!&|?{}\[+*%~^-]|\b(?:return|typeof|case|in|of|delete|void|throw|new|do|else|yield|await))\s*$",
)
KOTLIN = Lexer(
    needed=r"\$\{|/\*(?:[^*/]++|\*(?!/)|/(?!\*))*+/\*",
    delimiters=r"\\[^\n]|\$\{|//|/\*|\*/|\"\"\"|'(?:[^'\\\n]|\\[^\n][^'\n]*)'|[\"{}\n]",
    plain=r"[^\"'{}/\n\\$*]",
    rules=_modes(
        {'"""': "+t", '"': "+d", "//": "+l", "/*": "+c"},
        t={'"""': "-", "${": "+i"}, d={'"': "-", "${": "+i"} | _LINE_END, l=_LINE_END, c={"*/": "-", "/*": "+c"},
    ),
    comments="lc",
)
CSHARP = Lexer(
    needed=r"\$@?\"|@\$?\"|\"\"\"",
    delimiters=r"\\[\s\S]|[$@]*\"+|//|/\*|\*/|'(?:[^'\\\n]|\\[^\n][^'\n]*)'|\{\{|\}\}|[{}\n]",
    plain=r"[^\"'{}/\n\\$@*]",
    rules=_modes(
        {'"': "+d", '$"': "+f", '@"': "+v", '$@"': "+w", '@$"': "+w", "//": "+l", "/*": "+c"}
        | {'""': ".d", '$""': ".d", '@""': ".d", '$@""': ".d", "{{": "", "}}": ""},
        d={'"': "-"} | _LINE_END,
        f={'"': "-", "{": "+i"} | _LINE_END,
        v={'"': "-", '"""': "-", '"""""': "-", '\\"': "-"},
        w={'"': "-", '"""': "-", '"""""': "-", "{": "+i", '\\"': "-"},
        l=_LINE_END,
        c={"*/": "-"},
        i={"{{": "+ii", "}}": "--"},
    ),
    comments="lc",
    raw=r"^\$*\"{3,}$",
    ending=(r"^\$*", ""),
)
RUST = Lexer(
    needed=r"/\*(?:[^*/]++|\*(?!/)|/(?!\*))*+/\*|\br#*\"",
    delimiters=r"\\[\s\S]|\br#*\"|\"#*|//|/\*|\*/|'(?:[^'\\\n]|\\[^\n][^'\n]*)'|\n",
    plain=r"[^\"'/\n\\*r]",
    rules=_modes({'"': "+d", "//": "+l", "/*": "+c"}, d={'"': "-"}, l=_LINE_END, c={"*/": "-", "/*": "+c"}),
    comments="lc",
    raw=r"^r#*\"$",
    ending=(r"^r(#*)\"$", '"$1'),
)
RUBY = Lexer(
    needed=r"#\{|<<[~-]?[\"'`]?[A-Za-z_]",
    delimiters=(
        r"\\[\s\S]|#\{|<<[~-][\"'`]?\w+[\"'`]?|<<[\"'`]?[A-Z]\w*[\"'`]?|\n=begin\b|\n=end\b|\n[ \t]*\w+(?=\n|$)|[\"'`{}#\n]"
    ),
    plain=r"[^\"'`{}#\n\\<]",
    rules=_modes(
        {'"': "+d", "'": "+s", "`": "+b", "#": "+l", "#{": "+l", "\n=begin": "+c"},
        d={'"': "-", "#{": "+i"}, s={"'": "-"}, b={"`": "-", "#{": "+i"}, h={"#{": "+i"}, l=_LINE_END, c={"\n=end": "-"},
    ),
    comments="lc",
    heredoc=r"^<<",
    ending=(r"^<<[~-]?[\"'`]?(\w+)[\"'`]?$", "$1"),
)
_F = {"f": "f", "F": "f"}
PYTHON = Lexer(
    needed=r"(?i)\b(?:f|rf|fr)[\"']",
    delimiters=r"\\[\s\S]|(?i:\b(?:f|rf|fr))(?:\"\"\"|'''|\"|')|\"\"\"|'''|\{\{|\}\}|[\"'{}#\n]",
    plain=r"[^\"'{}#\n\\fFrR]",
    rules=_modes(
        {'"': "+d", "'": "+s", '"""': "+D", "'''": "+S", "#": "+l", "{{": "", "}}": ""}
        | {prefix + quote: "+" + mode for prefix in ("f", "F", "rf", "Rf", "rF", "RF", "fr", "fR", "Fr", "FR") for quote, mode in (('"', "e"), ("'", "g"), ('"""', "E"), ("'''", "G"))},
        d={'"': "-", '"""': "-"} | _LINE_END, s={"'": "-", "'''": "-"} | _LINE_END, D={'"""': "-"}, S={"'''": "-"}, l=_LINE_END,
        e={'"': "-", "{": "+i"} | _LINE_END, g={"'": "-", "{": "+i"} | _LINE_END, E={'"""': "-", "{": "+i"}, G={"'''": "-", "{": "+i"},
        i={"{{": "+ii", "}}": "--"},
    ),
    comments="l",
)


def token_kinds(lexer: Lexer, tokens: Column) -> Column:
    """A character for each token: ``c`` code, ``s`` in a string, ``m`` in a comment, by the outermost literal around it."""
    table = F.create_map(*[F.lit(x) for pair in lexer.rules.items() for x in pair])
    start = {"stack": F.lit(""), "pending": F.array().cast("array<string>"), "tail": F.lit("")}

    def read(acc: Column, token: Column) -> Column:
        """What the rules say, and what the other decisions need."""
        top = F.left(acc["stack"], F.lit(1))
        line = F.startswith(token, F.lit("\n"))
        rule = F.try_element_at(table, F.concat(top, token))
        # Rules for a line feed hold for tokens that begin with one.
        of_line = F.try_element_at(table, F.concat(top, F.lit("\n")))
        return F.struct(
            top.alias("top"),
            top.isin(*CODE).alias("in_code"),
            line.alias("line"),
            F.coalesce(rule, F.when(line, of_line), F.lit("")).alias("rule"),
            F.get(acc["pending"], 0).alias("due"),
        )

    def decide(acc: Column, token: Column, r: Column) -> Column:
        """The action, and the end delimiters that are still awaited."""
        action, pending = r["rule"], acc["pending"]
        in_code, due = r["in_code"], r["due"]
        if lexer.raw:
            opens = in_code & token.rlike(lexer.raw)
            action = F.when(opens, "+r").when(r["top"] == "r", F.when(token == due, "-").otherwise("")).otherwise(action)
            pending = F.when(opens, F.array(F.regexp_replace(token, *lexer.ending))).otherwise(pending)
        if lexer.heredoc:
            in_body, more = r["top"] == "h", F.size(acc["pending"]) > 1
            awaited = r["line"] & due.isNotNull() & (in_body | (in_code & ~F.contains(acc["stack"], F.lit("h"))))
            met = F.trim(F.substring(token, F.lit(2), F.length(token))) == due
            # A body begins at the line end; one without lines ends there as well.
            at_line = F.when(in_body, F.when(met & ~more, "-").otherwise("")).otherwise(F.when(met & ~more, ".h").otherwise("+h"))
            action = F.when(awaited, at_line).when(in_body & r["line"], "").otherwise(action)
            announced = in_code & token.rlike(lexer.heredoc)
            pending = (
                F.when(announced, F.array_append(pending, F.regexp_replace(token, *lexer.ending)))
                .when(awaited & met, F.slice(pending, 2, F.greatest(F.size(pending) - 1, F.lit(0))))
                .otherwise(pending)
            )
        if lexer.regex_after:
            action = F.when(in_code & (token == "/") & acc["tail"].rlike(lexer.regex_after), "+x").otherwise(action)
        return F.struct(action.alias("action"), pending.alias("pending"))

    def moved(acc: Column, action: Column) -> Column:
        stack, kind = acc["stack"], F.left(action, F.lit(1))
        return (
            F.when(kind == "+", F.concat(F.substring(action, F.lit(2), F.lit(9)), stack))
            .when(kind == "-", F.substring(stack, F.length(action) + 1, F.length(stack)))
            .otherwise(stack)
        )

    def outermost(acc: Column, action: Column, stack: Column) -> Column:
        """The mode at the bottom: before the token or, where it begins a literal, after it."""
        begun = F.when(F.startswith(action, F.lit(".")), action).otherwise(stack)
        return F.right(F.when(acc["stack"] != "", acc["stack"]).otherwise(begun), F.lit(1))

    def written(acc: Column, token: Column, r: Column, d: Column, stack: Column) -> Column:
        action = d["action"]

        def result(outer: Column) -> Column:
            comment = outer.isin(*lexer.comments) if lexer.comments else F.lit(False)
            tail = acc["tail"]
            if lexer.regex_after:
                # The last code before a slash; after a literal no regular expression begins.
                tail = F.when(r["in_code"] & (action == "") & token.rlike(r"\S"), token).when((action != "") & ~comment, ")").otherwise(tail)
            kind = F.when(outer == "", "c").when(comment, "m").otherwise("s")
            return F.struct(stack.alias("stack"), d["pending"].alias("pending"), tail.alias("tail"), kind.alias("out"))

        return let(outermost(acc, action, stack), result)

    def step(acc: Column, token: Column) -> Column:
        # Each value is bound once: written out, they would multiply in the plan.
        return let(
            read(acc, token),
            lambda r: let(
                decide(acc, token, r),
                lambda d: let(moved(acc, d["action"]), lambda stack: written(acc, token, r, d, stack)),
            ),
        )

    return written_by(tokens, start, step)


def lexed(content: Column, lexer: Lexer) -> Column:
    """``struct<tokens, kinds>``: the whole text in tokens, and the kind of each."""
    every = f"{lexer.delimiters}|{lexer.plain}+|[\\s\\S]"
    return let(
        F.regexp_extract_all(content, F.lit(every), F.lit(0)),
        lambda tokens: F.struct(tokens.alias("tokens"), F.split(token_kinds(lexer, tokens), "").alias("kinds")),
    )
