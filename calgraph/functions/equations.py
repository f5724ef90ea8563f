"""Scaling formulas compiled into Spark columns.

A formula is read by an allow-list walk over its syntax tree on the driver; what comes out is a built-in
expression, so rows never meet Python. Case of names does not matter, ``^`` is power, ``%`` is the floor
modulus, a division by zero gives null for that cell.
"""

from __future__ import annotations

import ast
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import floor_mod


class FormulaError(ValueError):
    """The formula uses something that is not allowed."""


_BINARY: dict[type, Callable[[Column, Column], Column]] = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: lambda a, b: F.try_divide(a, b),
    ast.Mod: floor_mod,
    ast.Pow: lambda a, b: F.pow(a, b),
}


def _all_given(f: Callable[..., Column]) -> Callable[..., Column]:
    """Null if any argument is: the built-in skips a failed one."""

    def call(*args: Column) -> Column:
        given = args[0].isNotNull()
        for a in args[1:]:
            given = given & a.isNotNull()
        return F.when(given, f(*args) if len(args) > 1 else args[0])

    return call


#: Name, fewest and most arguments, and what it becomes. The second argument of round must be a whole number.
_CALLS: dict[str, tuple[int, int, Callable[..., Column]]] = {"abs": (1, 1, F.abs), "min": (1, 99, _all_given(F.least)), "max": (1, 99, _all_given(F.greatest)), "sqrt": (1, 1, lambda x: F.when(x >= 0, F.sqrt(x))), "round": (1, 1, F.rint)}


def compile_formula(formula: str, **names: Column) -> Column:
    """The formula as a column over the given names."""
    known = {k.lower(): v.cast("double") for k, v in names.items()}
    try:
        tree = ast.parse(formula.strip().replace("^", "**"), mode="eval").body
    except SyntaxError as e:
        raise FormulaError(formula) from e

    def walk(node: ast.AST) -> Column:
        match node:
            case ast.Constant(value=int() | float() as v) if not isinstance(v, bool):
                return F.lit(float(v))
            case ast.Name(id=name) if name.lower() in known:
                return known[name.lower()]
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -walk(x)
            case ast.UnaryOp(op=ast.UAdd(), operand=x):
                return walk(x)
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _BINARY:
                return _BINARY[type(op)](walk(a), walk(b))
            case ast.Call(func=ast.Name(id=name), args=[x, ast.Constant(value=int() as n)], keywords=[]) if name.lower() == "round" and not isinstance(n, bool):
                return F.bround(walk(x), n)
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name.lower() in _CALLS and _CALLS[name.lower()][0] <= len(args) <= _CALLS[name.lower()][1]:
                return _CALLS[name.lower()][2](*map(walk, args))
        raise FormulaError(formula)

    return walk(tree)


def scale(df: DataFrame, formulas: list[str], formula: str, raw: str, out: str, link: str | None = None, digits: int = 6) -> DataFrame:
    """Adds ``out``: the row's own formula applied to ``raw``; and ``out_error``: why there is no value.

    ``formulas``: the distinct formulas, few compared with the rows; each is compiled once.
    """
    names = {"x": F.col(raw)} | ({"k": F.col(link)} if link else {})
    value, bad = F.lit(None).cast("double"), F.lit(None).cast("string")
    for f in formulas:
        try:
            value = F.when(F.col(formula) == f, compile_formula(f, **names)).otherwise(value)
        except FormulaError:
            bad = F.when(F.col(formula) == f, "unsupported").otherwise(bad)
    df = df.withColumn(out, value)
    ok = F.col(out).isNotNull() & ~F.isnan(out) & (F.abs(out) != float("inf"))
    return df.withColumn(f"{out}_error", F.coalesce(bad, F.when(~ok, "undefined"))).withColumn(out, F.when(ok, F.bround(out, digits)))
