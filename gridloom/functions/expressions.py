"""The closed expression language over bands, compiled to Spark columns.

Every operation yields a nullable double: a null operand gives null (also for ``and``, unlike SQL), and so does a result that
is not finite. A band's value is null where it is not valid.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.model import fields, require

MAX_NODES, MAX_DEPTH = 64, 12
PAIRS = ("add", "subtract", "multiply", "divide", "normalized_difference", "greater", "greater_equal", "less", "and")


def finite(c: Column) -> Column:
    """Null in place of NaN and infinities."""
    return F.when(F.abs(c) < F.lit(math.inf), c)


def bands_of(expr: dict, band_count: int | None = None) -> list[int]:
    """Validate an expression; the bands that it reads, in order."""
    seen: set[int] = set()
    nodes = 0

    def walk(e: dict, depth: int) -> None:
        nonlocal nodes
        nodes += 1
        require(nodes <= MAX_NODES and depth <= MAX_DEPTH, "the expression has more than 64 nodes or is deeper than 12")
        require(isinstance(e, dict) and "op" in e, "an expression needs an op")
        op = e["op"]
        if op == "band":
            fields(e, ("op", "band"), ("op", "band"))
            require(isinstance(e["band"], int) and e["band"] >= 0 and (band_count is None or e["band"] < band_count), "no such band")
            seen.add(e["band"])
        elif op == "constant":
            fields(e, ("op", "value"), ("op", "value"))
            require(math.isfinite(e["value"]), "a constant must be finite")
        elif op == "valid":
            fields(e, ("op", "input"), ("op", "input"))
            walk(e["input"], depth + 1)
        else:
            require(op in PAIRS, f"unknown op: {op}")
            fields(e, ("op", "left", "right"), ("op", "left", "right"))
            walk(e["left"], depth + 1)
            walk(e["right"], depth + 1)

    walk(expr, 1)
    return sorted(seen)


def compile_expression(expr: dict, band: Callable[[int], Column]) -> Column:
    """A column of the expression's value; ``band`` gives a band's value, null where it is not valid."""
    op = expr["op"]
    if op == "band":
        return band(expr["band"])
    if op == "constant":
        return F.lit(float(expr["value"]))
    if op == "valid":
        return compile_expression(expr["input"], band).isNotNull().cast("double")
    a, b = compile_expression(expr["left"], band), compile_expression(expr["right"], band)
    if op == "normalized_difference":  # scaled first, so that large values do not overflow
        m = F.greatest(F.abs(a), F.abs(b))
        x, y = F.try_divide(a, m), F.try_divide(b, m)
        out = F.try_divide(x - y, x + y)
    elif op == "and":
        out = ((a != 0) & (b != 0)).cast("double")
    elif op in ("greater", "greater_equal", "less"):
        out = {"greater": a > b, "greater_equal": a >= b, "less": a < b}[op].cast("double")
    else:
        out = {"add": lambda: a + b, "subtract": lambda: a - b, "multiply": lambda: a * b, "divide": lambda: F.try_divide(a, b)}[op]()
    return F.when(a.isNotNull() & b.isNotNull(), finite(out))


def keep(mask: Column) -> Column:
    """A mask lets a cell through if it is neither null nor zero."""
    return F.coalesce(mask != 0, F.lit(False))
