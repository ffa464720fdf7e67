"""Parameter lists and base-type lists as arrays, with higher-order SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codecatalog.functions.folds import flat_brackets, restored
from codecatalog.functions.text import collapse_spaces, normalise_quotes, strip
from codecatalog.specs import LangSpec

_DOUBLE = r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"'
_SINGLE = r"'[^'\\]*+(?:\\[\s\S][^'\\]*+)*+'"
_CHAR = r"'(?:[^'\\]|\\[^']*)'"


def _pieces(raw: Column, angle: bool, chars: bool) -> Column:
    """Literals, arrows, single brackets and commas, and runs of anything else."""
    special = r",(){}\[\]\"'=\-" + ("<>" if angle else "")
    return F.regexp_extract_all(
        raw, F.lit(rf"{_DOUBLE}|{_CHAR if chars else _SINGLE}|=>|->|[^{special}]+|[\s\S]"), F.lit(0)
    )


def split_top_level(raw: Column, angle: bool = True, chars: bool = False) -> Column:
    """Split on commas outside brackets and literals; blank parts are dropped.

    The fold carries (depth, current part, finished parts). Its cost follows the length of one
    parameter list, which is one declaration header.
    """
    opens = ["(", "[", "{"] + (["<"] if angle else [])
    closes = [")", "]", "}"] + ([">"] if angle else [])
    start = F.struct(
        F.lit(0).alias("depth"), F.lit("").alias("cur"), F.array().cast("array<string>").alias("parts")
    )

    def step(acc: Column, piece: Column) -> Column:
        cut = (piece == ",") & (acc["depth"] <= 0)
        return F.struct(
            (
                acc["depth"]
                + F.when(piece.isin(opens), 1).when(piece.isin(closes), -1).otherwise(0)
            ).alias("depth"),
            F.when(cut, "").otherwise(F.concat(acc["cur"], piece)).alias("cur"),
            F.when(cut, F.array_append(acc["parts"], acc["cur"])).otherwise(acc["parts"]).alias("parts"),
        )

    parts = F.aggregate(
        _pieces(raw, angle, chars), start, step, lambda acc: F.array_append(acc["parts"], acc["cur"])
    )
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def _arg(name: Column, type_hint: Column, default: Column) -> Column:
    return F.struct(
        strip(name).alias("name"), collapse_spaces(type_hint).alias("type_hint"), strip(default).alias("default")
    )


# An '=' that is not part of '=>', '==', '<=', '>=' or '!='.
_ASSIGN = r"(?<![=<>!])=(?![=>])"


def _without_default(part: Column) -> Column:
    at = F.regexp_instr(part, F.lit(_ASSIGN))
    return F.when(at > 0, F.substring(part, F.lit(1), at - 1)).otherwise(part)


def _default(part: Column) -> Column:
    at = F.regexp_instr(part, F.lit(_ASSIGN))
    return F.when(at > 0, F.substring(part, at + 1, F.length(part))).otherwise("")


def _before_colon(part: Column) -> Column:
    return F.regexp_extract(part, r"^([^:]*)", 1)


def _after_colon(part: Column) -> Column:
    return F.regexp_extract(part, r"^[^:]*:([\s\S]*)$", 1)


def _last_word(part: Column) -> Column:
    return F.regexp_extract(part, r"(\S+)\s*$", 1)


def _but_last_word(part: Column) -> Column:
    return F.regexp_extract(part, r"^([\s\S]*\S)\s+\S+\s*$", 1)


def _python(p: Column) -> Column:
    lhs = _without_default(p)
    return _arg(_before_colon(lhs), normalise_quotes(_after_colon(lhs)), normalise_quotes(_default(p)))


def _typescript(p: Column) -> Column:
    lhs = _without_default(p)
    name, hint = _before_colon(lhs), collapse_spaces(_after_colon(lhs))
    optional = F.contains(name, F.lit("?")) & (hint != "") & ~hint.endswith("| undefined")
    plain = _arg(
        F.translate(name, "?", ""),
        F.when(optional, F.concat(hint, F.lit(" | undefined"))).otherwise(hint),
        _default(p),
    )
    pattern = restored(F.regexp_extract(flat_brackets(p), r"^(\{[^{}]*\}|\[[^\[\]]*\]|[^:]*)", 1))
    return F.when(p.rlike(r"^[{\[]"), _arg(pattern, F.lit("object"), F.lit(""))).otherwise(plain)


def _java(p: Column) -> Column:
    bare = restored(F.regexp_replace(flat_brackets(p), r"@[\w.]+(?:\([^()]*\))?\s*", ""))
    bare = F.replace(bare, F.lit("..."), F.lit("[]"))
    return _arg(_last_word(bare), _but_last_word(bare), F.lit(""))


def _go(p: Column) -> Column:
    return _arg(
        F.regexp_extract(p, r"^(\S+)", 1), F.regexp_extract(p, r"^\S+\s+([\s\S]*)$", 1), F.lit("")
    )


def _rust(p: Column) -> Column:
    return _arg(F.regexp_replace(_before_colon(p), r"^\s*mut\s+", ""), _after_colon(p), F.lit(""))


def _csharp(p: Column) -> Column:
    bare = F.regexp_replace(p, r"^(?:\[[^\]]*\]\s*)*(?:(?:ref|out|in|params|this)\s+)*", "")
    lhs = _without_default(bare)
    return _arg(_last_word(lhs), _but_last_word(lhs), _default(bare))


def _cpp(p: Column) -> Column:
    lhs = strip(_without_default(p))
    spaced = F.regexp_replace(F.regexp_replace(lhs, r"\s*([*&]+)\s*", "$1 "), r"\s+", " ")
    return F.when(p == "...", _arg(p, F.lit("variadic"), F.lit(""))).otherwise(
        _arg(_last_word(spaced), _but_last_word(spaced), _default(p))
    )


def _untyped(p: Column) -> Column:
    name = F.regexp_extract(p, r"^([^=]*)", 1)
    keyword = F.regexp_extract(p, r"^\w+:\s*([^=\s][\s\S]*)$", 1)
    return F.when(
        p.rlike(r"^\w+:"), _arg(F.regexp_extract(p, r"^(\w+)", 1), F.lit(""), keyword)
    ).otherwise(_arg(name, F.lit(""), F.regexp_extract(p, r"^[^=]*=([\s\S]*)$", 1)))


def _name_first(p: Column) -> Column:
    lhs = _without_default(p)
    name = F.regexp_replace(_before_colon(lhs), r"^(?:@\w+\s+)*(?:vararg|noinline|crossinline)\s+", "")
    return _arg(name, _after_colon(lhs), _default(p))


_STYLES = {
    "python": _python,
    "typescript": _typescript,
    "type_first_java": _java,
    "name_first_space": _go,
    "rust": _rust,
    "type_first_csharp": _csharp,
    "type_first_cpp": _cpp,
    "untyped": _untyped,
    "name_first_colon": _name_first,
}
# Parts of a list that are no parameter: position markers and receivers.
_NOT_PARAMS = {
    "python": ["*", "/"],
    "rust": ["self", "&self", "&mut self", "mut self"],
    "type_first_cpp": ["void"],
}


def parse_params(raw: Column, spec: LangSpec) -> Column:
    """``array<struct<name,type_hint,default>>`` of one parameter list in one language."""
    parts = split_top_level(raw, spec.angle_brackets, spec.quote_chars)
    drop = _NOT_PARAMS.get(spec.param_style)
    if drop:
        parts = F.filter(parts, lambda p: ~p.isin(drop))
    return F.transform(parts, _STYLES[spec.param_style])


def base_names(raw: Column, spec: LangSpec) -> Column:
    """Base types in order; keyword arguments and access words are not bases."""
    parts = F.filter(
        split_top_level(raw, spec.angle_brackets, spec.quote_chars), lambda p: ~p.rlike(r"^\w+\s*=")
    )
    return F.transform(
        parts,
        lambda p: collapse_spaces(
            F.regexp_replace(p, r"^(?:(?:public|protected|private|virtual)\s+)+", "")
        ),
    )
