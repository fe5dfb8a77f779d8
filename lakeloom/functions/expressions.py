"""Filter and projection expressions as Spark columns.

A number compared with a text reads the text as a number, null where it is none. A text literal
compared with a number, date or timestamp column is read as that type. Null stands for
"unbound or an error", so a filter keeps a row only where it is true.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..mapping.rml import SPARK_TYPES
from ..sparql.ast import Expr, Iri, Literal, Op, Var

NUMERIC = (T.NumericType,)
Scope = dict[str, tuple[Column, T.DataType]]


class ExpressionError(ValueError):
    pass


def _number(text: str) -> int | float:
    return float(text) if any(c in text for c in ".eE") else int(text)


def literal(x: Literal) -> tuple[Column, T.DataType]:
    if x.is_number:
        n = _number(x.lex)
        return F.lit(n), T.DoubleType() if isinstance(n, float) else T.LongType()
    kind = SPARK_TYPES.get(x.datatype or "", "string")
    if kind == "boolean":
        return F.lit(x.lex in ("true", "1")), T.BooleanType()
    if kind in ("date", "timestamp"):
        return F.lit(x.lex).try_cast(kind), T.DateType() if kind == "date" else T.TimestampType()
    return F.lit(x.lex), T.StringType()


def _is_number(t: T.DataType) -> bool:
    return isinstance(t, NUMERIC)


def _is_time(t: T.DataType) -> bool:
    return isinstance(t, T.DateType | T.TimestampType | T.TimestampNTZType)


def _aligned(a: tuple[Column, T.DataType], b: tuple[Column, T.DataType]) -> tuple[Column, Column]:
    """Both sides in a type that compares them."""
    (x, s), (y, t) = a, b
    if s == t or _is_number(s) and _is_number(t):
        return x, y
    if _is_number(s) or _is_number(t):
        return x.try_cast("double") if not _is_number(s) else x, y.try_cast("double") if not _is_number(t) else y
    if _is_time(s) and _is_time(t):
        return x.cast("timestamp_ntz"), y.cast("timestamp_ntz")
    if _is_time(s):
        return x, y.try_cast(s.simpleString())
    if _is_time(t):
        return x.try_cast(t.simpleString()), y
    return x.cast("string"), y.cast("string")


def _numeric(x: tuple[Column, T.DataType]) -> tuple[Column, T.DataType]:
    return x if _is_number(x[1]) else (x[0].try_cast("double"), T.DoubleType())


_COMPARE = {"=": Column.__eq__, "!=": Column.__ne__, "<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}
_TEXT, _BOOL, _INT, _DOUBLE = T.StringType(), T.BooleanType(), T.IntegerType(), T.DoubleType()


def _pattern(args: list[Expr]) -> str:
    """A regular expression literal with its flags in front."""
    if not all(isinstance(a, Literal) for a in args[:2]):
        raise ExpressionError("patterns and flags are literals")
    flags = "".join(f for f in (args[1].lex if len(args) > 1 else "") if f in "imsx")
    return f"(?{flags}){args[0].lex}" if flags else args[0].lex


def compile_expr(e: Expr, scope: Scope) -> tuple[Column, T.DataType]:
    """(column, its type) of an expression without aggregates."""
    if isinstance(e, Var):
        return scope.get(e.name, (F.lit(None).cast("string"), _TEXT))
    if isinstance(e, Literal):
        return literal(e)
    if isinstance(e, Iri):
        return F.lit(e.value), _TEXT
    if not isinstance(e, Op):
        raise ExpressionError("aggregates are allowed in SELECT, HAVING and ORDER BY only")
    name, args = e.name, e.args
    of = lambda i: compile_expr(args[i], scope)
    text = lambda i: of(i)[0].cast("string")
    if name in _COMPARE:
        return _COMPARE[name](*_aligned(of(0), of(1))), _BOOL
    if name in ("&&", "||"):
        x, y = (compile_filter(a, scope) for a in args)
        return (x & y if name == "&&" else x | y), _BOOL
    if name == "!":
        return ~compile_filter(args[0], scope), _BOOL
    if name == "in":
        one = [compile_expr(Op("=", (args[0], a)), scope)[0] for a in args[1:]]
        return (reduce(lambda a, b: a | b, one) if one else F.lit(False)), _BOOL
    if name in ("+", "-", "*", "/"):
        (x, s), (y, t) = _numeric(of(0)), _numeric(of(1))
        if name == "/":
            return F.try_divide(x.cast("double"), y.cast("double")), _DOUBLE
        kind = s if s == t else _DOUBLE if not (isinstance(s, T.IntegralType) and isinstance(t, T.IntegralType)) else T.LongType()
        return {"+": x + y, "-": x - y, "*": x * y}[name], kind
    if name == "neg":
        x, s = _numeric(of(0))
        return -x, s
    if name == "regex":
        return text(0).rlike(_pattern(list(args[1:]))), _BOOL
    if name == "like":
        return text(0).like(args[1].lex), _BOOL
    if name == "bound":
        return of(0)[0].isNotNull(), _BOOL
    if name == "replace":
        return F.regexp_replace(text(0), _pattern([args[1], *args[3:]]), args[2].lex), _TEXT
    if name == "if":
        (x, s), (y, _) = of(1), of(2)
        return F.when(compile_filter(args[0], scope), x).otherwise(y), s
    if name == "coalesce":
        return F.coalesce(*(of(i)[0] for i in range(len(args)))), of(0)[1]
    if name == "concat":
        return F.concat(*(text(i) for i in range(len(args)))), _TEXT
    if name in ("abs", "ceil", "floor", "round"):
        x, s = _numeric(of(0))
        return getattr(F, name)(x), s if name == "abs" else s if isinstance(s, T.IntegralType) or name == "round" else T.LongType()
    if name in ("year", "month", "day", "hours", "minutes", "seconds"):
        x, s = of(0)
        fn = {"day": F.dayofmonth, "hours": F.hour, "minutes": F.minute, "seconds": F.second}.get(name) or getattr(F, name)
        return fn(x if _is_time(s) else x.try_cast("timestamp")), _INT
    if name == "substr":
        n = of(2)[0] if len(args) > 2 else F.lit(2**31 - 1)
        return F.substring(text(0), of(1)[0].cast("int"), n.cast("int")), _TEXT
    if name in ("strbefore", "strafter"):
        x, mark = text(0), text(1)
        at = F.locate(args[1].lex, x) if isinstance(args[1], Literal) else F.instr(x, mark)
        if name == "strbefore":
            return F.when(at > 0, F.substring(x, F.lit(1), at - 1)).otherwise(F.lit("")), _TEXT
        return F.when(at > 0, F.substring(x, at + F.length(mark), F.length(x))).otherwise(F.lit("")), _TEXT
    simple = {
        "str": lambda: (text(0), _TEXT), "strlen": lambda: (F.length(text(0)), _INT), "ucase": lambda: (F.upper(text(0)), _TEXT), "lcase": lambda: (F.lower(text(0)), _TEXT),
        "contains": lambda: (F.contains(text(0), text(1)), _BOOL), "strstarts": lambda: (F.startswith(text(0), text(1)), _BOOL), "strends": lambda: (F.endswith(text(0), text(1)), _BOOL),
        "isnumeric": lambda: (F.lit(_is_number(of(0)[1])), _BOOL), "isliteral": lambda: (F.lit(not isinstance(args[0], Iri)), _BOOL), "isiri": lambda: (F.lit(isinstance(args[0], Iri)), _BOOL),
        "isuri": lambda: (F.lit(isinstance(args[0], Iri)), _BOOL), "isblank": lambda: (F.lit(False), _BOOL), "sameterm": lambda: compile_expr(Op("=", args), scope),
    }
    if name in simple:
        return simple[name]()
    raise ExpressionError(f"{name} is not supported")


def compile_filter(e: Expr, scope: Scope) -> Column:
    """The effective boolean value of an expression."""
    c, t = compile_expr(e, scope)
    if isinstance(t, T.BooleanType):
        return c
    return c != 0 if _is_number(t) else F.length(c.cast("string")) > 0
