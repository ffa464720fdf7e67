"""Automata over the tokens of a text, as folds of higher-order SQL functions.

A state is a struct; a stack in it is a string with a character for each level, the top first, so depth has no limit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from codecatalog.functions.text import let

#: Tokens that a fold takes before what it has written is put behind the rest, so that long texts aren't copied per token.
RUN = 256

#: Brackets of three kinds, those that open and those that close them.
OPENING, CLOSING = "({[", ")}]"
#: What stands for brackets within brackets, so that patterns see one level.
_INNER = "\u0003\u0004\u0005\u0006\u000e\u000f"
_OUTER = "(){}[]"


def written_by(tokens: Column, start: dict[str, Column], step: Callable[[Column, Column], Column]) -> Column:
    """The text that an automaton writes over ``tokens``. ``step(state, token)`` is a struct of the next state and, as
    ``out``, of what to write."""

    def begin(values: dict[str, Column]) -> Column:
        return F.struct(*(v.alias(n) for n, v in values.items()), F.lit("").alias("out"))

    def behind(out: Column, more: Column) -> Column:
        return F.struct(*(more[n].alias(n) for n in start), F.concat(out, more["out"]).alias("out"))

    def one(acc: Column, token: Column) -> Column:
        return let(step(acc, token), lambda s: behind(acc["out"], s))

    def run(acc: Column, at: Column) -> Column:
        done = F.aggregate(F.slice(tokens, at * RUN + 1, F.lit(RUN)), begin({n: acc[n] for n in start}), one)
        return let(done, lambda d: behind(acc["out"], d))

    runs = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(tokens) / RUN).cast("int") - 1, F.lit(0)))
    return F.aggregate(runs, begin(start), run)["out"]


def flat_brackets(code: Column) -> Column:
    """The code with round and curly brackets that lie in others of their kind replaced, to equal length: patterns find the
    outermost pairs by ``[^()]*``, however deep it goes inside. ``restored`` undoes it."""

    def step(acc: Column, token: Column) -> Column:
        depth, out = [], token
        for n, name in enumerate(("round", "curly")):
            opens, closes = token == _OUTER[2 * n], token == _OUTER[2 * n + 1]
            held = acc[name]
            depth.append(F.when(opens, held + 1).when(closes & (held > 0), held - 1).otherwise(held).alias(name))
            out = F.when(opens & (held > 0), _INNER[2 * n]).when(closes & (held > 1), _INNER[2 * n + 1]).otherwise(out)
        return F.struct(*depth, out.alias("out"))

    tokens = F.regexp_extract_all(code, F.lit(r"[(){}]|[^(){}]+"), F.lit(0))
    flat = let(tokens, lambda t: written_by(t, {"round": F.lit(0), "curly": F.lit(0)}, step))
    return F.when(code.rlike(r"\([^()]*+\(|\{[^{}]*+\{"), flat).otherwise(code)


def restored(text: Column) -> Column:
    return F.translate(text, _INNER, _OUTER)
