"""Statistics with rational numbers, for inputs on which doubles lose what matters.

Tasks gather (value, weight) samples of a group; the sample budget bounds a group. Weights and values are doubles, which
are rationals, so sums, ranks and variances below are exact and rounded once.
"""

from __future__ import annotations

import math
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.model import require


def exact_variance(values: list[float], weights: list[float]) -> tuple[float | None, float | None]:
    """Population variance and standard deviation."""
    w = [Fraction(x) for x in weights]
    total = sum(w, Fraction(0))
    if not total:
        return None, None
    v = [Fraction(x) for x in values]
    mean = sum((a * b for a, b in zip(v, w, strict=True)), Fraction(0)) / total
    var = sum((b * (a - mean) ** 2 for a, b in zip(v, w, strict=True)), Fraction(0)) / total
    return float(var), root(var)


def root(x: Fraction) -> float:
    """Square root rounded to a double, also where x itself is too small or large for one."""
    if not x:
        return 0.0
    shift = max(0, 220 - (x.numerator.bit_length() - x.denominator.bit_length()))
    shift += shift % 2
    scaled = math.isqrt((x.numerator << shift) // x.denominator)
    return float(Fraction(scaled, 1 << (shift // 2)))


def exact_quantiles(values: list[float], weights: list[float], probabilities: list[float]) -> list[float | None]:
    pairs = sorted((a, Fraction(b)) for a, b in zip(values, weights, strict=True) if b > 0)
    total = sum((w for _, w in pairs), Fraction(0))
    out: list[float | None] = []
    for p in probabilities:
        goal, cum, found = Fraction(p) * total, Fraction(0), None
        for v, w in pairs:
            cum += w
            if cum >= goal:
                found = v
                break
        out.append(found)
    return out


def exact_masses(values: list[float], weights: list[float], domain: list[float]) -> tuple[dict[float, Fraction], float | None, int]:
    """Mass by value of the domain, the value with most (ties: the smallest), and how many have some."""
    mass = {v + 0.0: Fraction(0) for v in domain}
    for v, w in zip(values, weights, strict=True):
        require(v + 0.0 in mass, "a value is outside category_values")
        mass[v + 0.0] += Fraction(w)
    some = [v for v in sorted(mass) if mass[v] > 0]
    return mass, min(some, key=lambda v: (-mass[v], v)) if some else None, len(some)


def exact_statistics(joined: DataFrame, keys: list[str], probabilities: tuple[float, ...] = (0.5,), domain: tuple[float, ...] | None = None, limit: int = 65_536) -> DataFrame:
    """variance, stddev, quantiles, and majority and variety if a domain is given, by rational arithmetic.

    joined: keys, value, f, valid. Equal (value, f) samples are aggregated before they are gathered.
    """
    rows = joined.where("valid and f > 0").groupBy(*keys, "value", "f").agg(F.count(F.lit(1)).alias("n"))
    count = F.sum("n").over(Window.partitionBy(*keys))
    fits = F.when(count <= limit, F.col("value")).otherwise(F.raise_error(F.lit("more samples than the budget allows")).cast("double"))  # before anything is gathered
    groups = rows.withColumn("value", fits).groupBy(*keys).agg(F.collect_list(F.struct("value", "f", "n")).alias("s"), F.sum("n").alias("n"))

    @F.pandas_udf("variance double, stddev double, quantiles array<double>, majority double, variety int")
    def run(s: pd.Series, n: pd.Series) -> pd.DataFrame:
        out = []
        for samples, count in zip(s, n, strict=True):
            require(count <= limit, "more samples than the budget allows")
            v = [x["value"] for x in samples]
            w = [Fraction(x["f"]) * int(x["n"]) for x in samples]
            top, kinds = exact_masses(v, w, list(domain))[1:] if domain is not None else (None, None)
            out.append((*exact_variance(v, w), exact_quantiles(v, w, list(probabilities)), top, kinds))
        return pd.DataFrame(out, columns=["variance", "stddev", "quantiles", "majority", "variety"])

    return groups.withColumn("r", run("s", "n")).select(*keys, "r.*")
