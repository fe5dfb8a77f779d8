"""Transformations of join columns, applied left to right.

toInt            whole number, null where the text is none
scl(+n -n *n)    shift or scale a number
skp(v)           drop rows whose value is v
substit(a,b)     the value b for the value a, others unchanged
replc(a,b)       every a in the text replaced by b
prefix(p), postfix(p)
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sparql.ast import Call


class TransformError(ValueError):
    pass


# Long names under which mappings call the functions.
NAMES = {"scale": "scl", "skip": "skp", "substitute": "substit", "replace": "replc", "toint": "toInt"}


def _scale(c: Column, args: tuple[str, ...]) -> Column:
    found = re.fullmatch(r"_?\s*([-+*])\s*(\d+(?:\.\d+)?)", args[0].strip()) if len(args) == 1 else None
    if not found:
        raise TransformError(f"scl takes +n, -n or *n, not {args}")
    n = float(found[2]) if "." in found[2] else int(found[2])
    number = c.try_cast("double" if isinstance(n, float) else "bigint")
    return {"+": number + n, "-": number - n, "*": number * n}[found[1]]


def apply_calls(df: DataFrame, column: str, calls: tuple[Call, ...]) -> DataFrame:
    """df with its column transformed (and, by skp, without some rows)."""
    for call in calls:
        name, args, c = NAMES.get(call.name.lower(), call.name), call.args, F.col(f"`{column}`")
        need = {"toInt": 0, "scl": 1, "skp": 1, "substit": 2, "replc": 2, "prefix": 1, "postfix": 1}.get(name)
        if need is None:
            raise TransformError(f"{call.name} is no transformation")
        if len(args) != need:
            raise TransformError(f"{name} takes {need} arguments, not {len(args)}")
        if name == "skp":
            df = df.filter(c.cast("string") != args[0])
            continue
        text = c.cast("string")
        value = {
            "toInt": lambda: text.try_cast("bigint"),
            "scl": lambda: _scale(c, args),
            "substit": lambda: F.when(text == args[0], F.lit(args[1])).otherwise(text),
            "replc": lambda: F.replace(text, F.lit(args[0]), F.lit(args[1])),
            "prefix": lambda: F.concat(F.lit(args[0]), text),
            "postfix": lambda: F.concat(text, F.lit(args[0])),
        }[name]()
        df = df.withColumn(column, value)
    return df
