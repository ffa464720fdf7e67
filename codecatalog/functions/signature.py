"""Readable signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def argument_text(arg: Column) -> Column:
    return F.concat(
        arg["name"],
        F.when(arg["type_hint"] != "", F.concat(F.lit(": "), arg["type_hint"])).otherwise(""),
        F.when(arg["default"] != "", F.concat(F.lit(" = "), arg["default"])).otherwise(""),
    )


def signature_expr() -> Column:
    """``[async ]def name(a: T = d) -> R`` or ``class Name(B1, B2)`` over the symbol columns."""
    function = F.concat(
        F.when(F.col("is_async"), "async def ").otherwise("def "),
        F.col("name"),
        F.lit("("),
        F.array_join(F.transform("args", argument_text), ", "),
        F.lit(")"),
        F.when(F.col("return_type") != "", F.concat(F.lit(" -> "), F.col("return_type"))).otherwise(""),
    )
    type_ = F.concat(
        F.lit("class "),
        F.col("name"),
        F.when(
            F.size("bases") > 0, F.concat(F.lit("("), F.array_join("bases", ", "), F.lit(")"))
        ).otherwise(""),
    )
    return F.when(F.col("kind") == "class", type_).otherwise(function)
