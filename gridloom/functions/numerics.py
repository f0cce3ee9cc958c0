"""Sums that depend neither on order nor on partitioning: integer digits in the JVM, rounded once.

A double is three whole digits to the base 2**30 at a place that follows its exponent. Digits of equal place are summed
as longs, which is exact for up to 2**32 values of a group, so tasks pre-aggregate and partial sums merge in any
order. Only the totals of a group, a few rows, reach the kernel that rounds them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = 30
PART = 5  # longs of a part: which sum, place, three digits


def power(k: Column) -> Column:
    return F.pow(F.lit(2.0), k.cast("double"))


def exponent(x: Column) -> Column:
    """The binary exponent, at most one off; null for zero."""
    return F.floor(F.log2(F.abs(x))).cast("int")


def shifted(x: Column, k: Column) -> Column:
    """x * 2**k, exact unless the result is out of range; in two steps where 2**k alone would be."""
    half = F.floor(k / 2).cast("int")
    return F.when(F.abs(k) < 1000, x * power(k)).otherwise(x * power(half) * power(k - half))


def digits(df: DataFrame, x: str, k: Column) -> DataFrame:
    """df with the place __at (0 for zero and null) and the digits __d0, __d1, __d2 of x * 2**k; a step a projection, so that none is evaluated twice."""
    scale = float(1 << BASE)
    df = df.withColumn("__at", F.coalesce(F.floor((exponent(F.col(x)) + k) / BASE), F.lit(0)).cast("int"))
    df = df.withColumn("__y", shifted(F.col(x), k - F.col("__at") * BASE))
    df = df.withColumn("__d0", F.col("__y").cast("long")).withColumn("__y", (F.col("__y") - F.col("__d0").cast("double")) * scale)
    df = df.withColumn("__d1", F.col("__y").cast("long"))
    return df.withColumn("__d2", ((F.col("__y") - F.col("__d1").cast("double")) * scale).cast("long")).drop("__y")


def two_product(a: Column, b: Column) -> tuple[Column, Column]:
    """a * b as a rounded product and its error, for numbers whose squares are in range."""

    def halves(v: Column) -> tuple[Column, Column]:
        c = v * 134217729.0
        hi = c - (c - v)
        return hi, v - hi

    p = a * b
    (ah, al), (bh, bl) = halves(a), halves(b)
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def gather(df: DataFrame, keys: list[str], sums: Sequence[Sequence[tuple[Column, Column | int]]], value: Column | None = None) -> DataFrame:
    """By key: ``parts`` (array of longs, PART for each sum and place), ``n``, ``lo`` and ``hi``.

    sums: each a list of terms (x, k), which stand for x * 2**k; null terms count as nothing. n, lo and hi are the number
    and extrema of ``value`` where it is not null, or n the number of rows. Every key of df gets a row.
    """
    terms = [(i, x, k) for i, some in enumerate(sums) for x, k in some]
    none = F.lit(None).cast("double")
    entry = lambda which, x, k, v: F.struct(F.lit(which).alias("__w"), x.alias("__x"), (F.lit(k) if isinstance(k, int) else k).cast("int").alias("__k"), v.alias("__v"))
    rows = [entry(-1, none, 0, F.lit(1.0) if value is None else value), *(entry(i, x, k, none) for i, x, k in terms)]
    each = df.select(*keys, F.inline(F.array(*rows))).where("__w = -1 or __x <> 0")
    finite = F.when(F.col("__x").isNull() | (F.abs("__x") < F.lit(math.inf)), F.col("__x")).otherwise(F.raise_error(F.lit("a sum is not finite")).cast("double"))
    placed = digits(each.select(*keys, "__w", finite.alias("__x"), "__k", "__v"), "__x", F.col("__k"))
    return merge(placed, keys)


def merge(each: DataFrame, names: list[str]) -> DataFrame:
    """Parts by key from single digits (__w, __at, __d0.., __v)."""
    by_place = each.groupBy(*names, "__w", "__at").agg(*(F.sum(f"__d{i}").alias(f"__d{i}") for i in range(3)), F.count("__v").alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    part = F.when(F.col("__w") >= 0, F.array(F.col("__w").cast("long"), F.col("__at").cast("long"), "__d0", "__d1", "__d2"))
    return by_place.groupBy(*names).agg(F.flatten(F.array_sort(F.collect_list(part))).alias("parts"), F.sum("__n").alias("n"), F.min("__lo").alias("lo"), F.max("__hi").alias("hi"))


def again(gathered: DataFrame, keys: list[str]) -> DataFrame:
    """Merge rows of ``gather`` (parts, n, lo, hi) by fewer keys."""
    named = lambda i: F.element_at("__p", i)
    chunks = F.transform(F.sequence(F.lit(0), F.floor(F.size("parts") / PART).cast("int") - 1), lambda i: F.slice("parts", i * PART + 1, PART))
    entries = F.when(F.size("parts") > 0, chunks).otherwise(F.array().cast("array<array<long>>"))
    parts = gathered.select(*keys, F.explode(entries).alias("__p")).select(*keys, named(1).alias("__w"), named(2).alias("__at"), *(named(3 + i).alias(f"__d{i}") for i in range(3)), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(0).cast("long").alias("n"))
    zero = F.lit(0).cast("long")
    heads = gathered.select(*keys, F.lit(-1).cast("long").alias("__w"), zero.alias("__at"), *(zero.alias(f"__d{i}") for i in range(3)), "lo", "hi", "n")
    by_place = parts.unionByName(heads).groupBy(*keys, "__w", "__at").agg(*(F.sum(f"__d{i}").alias(f"__d{i}") for i in range(3)), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    part = F.when(F.col("__w") >= 0, F.array("__w", "__at", "__d0", "__d1", "__d2"))
    return by_place.groupBy(*keys).agg(F.flatten(F.array_sort(F.collect_list(part))).alias("parts"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def whole(parts, sums: int) -> tuple[list[int], int]:
    """The exact totals as integers, and the power of two that scales them all."""
    p = [int(x) for x in parts]
    low = min((p[i + 1] for i in range(0, len(p), PART)), default=0) - 2
    out = [0] * sums
    for i in range(0, len(p), PART):
        which, at, d0, d1, d2 = p[i : i + PART]
        out[which] += (((d0 << BASE) + d1 << BASE) + d2) << BASE * (at - 2 - low)
    return out, BASE * low


def nearest(n: int, k: int) -> float:
    """n * 2**k, rounded once."""
    try:
        return float(n << k) if k >= 0 else n / (1 << -k)
    except OverflowError:
        raise OverflowError("a sum is not finite") from None


def nearest_ratio(x: Fraction) -> float:
    """A fraction, rounded once."""
    try:
        return x.numerator / x.denominator
    except OverflowError:
        raise OverflowError("a result is not finite") from None


def rounded(parts: Column, sums: int, first: int | None = None) -> Column:
    """The totals of the first sums (of all, if not given) as doubles."""

    @F.pandas_udf("array<double>")
    def run(column):
        import pandas as pd

        out = []
        for parts in column:
            totals, k = whole(parts, sums)
            out.append([nearest(n, k) for n in totals[:first]])
        return pd.Series(out)

    return run(parts)


def span(df: DataFrame, x: Column) -> tuple[int, int]:
    """The lowest and highest place that digits of x take: one pass that returns two numbers."""
    e = df.select(F.floor(exponent(x) / BASE).cast("int").alias("a")).agg(F.min("a").alias("lo"), F.max("a").alias("hi")).first()
    return (0, 0) if e["lo"] is None else (e["lo"] - 2, e["hi"])


def spread_digits(df: DataFrame, x: Column, low: int, high: int) -> DataFrame:
    """df with the digits of x at each of the places low..high as columns __p0.., 0 where it has none."""
    df = digits(df.withColumn("__x", x), "__x", F.lit(0))
    at, zero = F.col("__at"), F.lit(0).cast("long")
    each = [F.coalesce(F.when(at == j, F.col("__d0")).when(at == j + 1, F.col("__d1")).when(at == j + 2, F.col("__d2")), zero) for j in range(low, high + 1)]
    return df.withColumns({f"__p{i}": c for i, c in enumerate(each)}).drop("__x", "__at", "__d0", "__d1", "__d2")


def product_terms(c: Column, n: Column, k: int) -> list[tuple[Column, int]]:
    """Terms for ``gather`` of c * n * 2**k, without rounding, for a long n and a c of moderate size."""
    high = F.shiftright(n, 31)
    low = (n - F.shiftleft(high, 31)).cast("double")
    return [(x, k + more) for v, more in ((high.cast("double"), 31), (low, 0)) for x in two_product(c, v)]


def exact_sums(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Correctly rounded sums by key (null values are skipped). A sum that overflows fails."""
    got = gather(df, keys, [[(F.col(v), 0)] for v in values]).withColumn("r", rounded(F.col("parts"), len(values)))
    return got.select(*keys, *(F.col("r")[i].alias(v) for i, v in enumerate(values)))


def compensated(values: Column) -> Column:
    """Neumaier's compensated sum of an array, in order, without leaving the JVM."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))

    def step(acc, x):
        t = acc["s"] + x
        c = acc["c"] + F.when(F.abs(acc["s"]) >= F.abs(x), (acc["s"] - t) + x).otherwise((x - t) + acc["s"])
        return F.struct(t.alias("s"), c.alias("c"))

    return F.aggregate(values, start, step, lambda a: a["s"] + a["c"])


def left_fold(values: Column) -> Column:
    """Plain additions from left to right."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def checked(c: Column, what: str) -> Column:
    """Fails on a result that is not finite."""
    return F.when(c.isNull() | (F.abs(c) < F.lit(math.inf)), c).otherwise(F.raise_error(F.lit(f"{what} is not finite")).cast("double"))
