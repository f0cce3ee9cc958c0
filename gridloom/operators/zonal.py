"""The join of cells and selection, and the statistics of each slice, zone and band.

Cells (slice_id, row, col, band, value, valid) meet runs (zone_id, row, col_start, col_end, fraction) by equality of row and
column tile, and a range test within the tile. The selection is a dimension table: Spark broadcasts it if it is below the
session's threshold; if not, both sides are shuffled by (row, tile), which spreads a large zone over many keys.
"""

from __future__ import annotations

import bisect
import itertools
import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import numerics
from gridloom.functions.expressions import bands_of, compile_expression, keep
from gridloom.functions.numerics import checked
from gridloom.model import Options, require
from gridloom.operators import reducers
from gridloom.operators.coverage import tiled

KEYS = ["slice_id", "zone_id", "band"]
STATUS_LEVEL = 1e-9


def prune(cells: DataFrame, options: Options) -> DataFrame:
    """Only bands that the request reads; the filter reaches the scan."""
    if not options.bands:
        return cells
    need = set(options.bands) | ({options.weight_band} if options.weight_band is not None else set())
    return cells.where(F.col("band").isin(sorted(need)))


def join_cells(cells: DataFrame, selection: DataFrame, edge: int = 256) -> DataFrame:
    """cells ⋈ selection: cell columns with zone_id and f, the covered share."""
    c = cells.withColumn("tx", F.expr(f"col div {edge}"))
    s = tiled(selection, edge).select("zone_id", F.col("row").alias("s_row"), F.col("tx").alias("s_tx"), "col_start", "col_end", F.col("fraction").alias("f"))
    on = (c["row"] == s["s_row"]) & (c["tx"] == s["s_tx"]) & (c["col"] >= s["col_start"]) & (c["col"] < s["col_end"])
    return c.join(s, on).drop("s_row", "s_tx", "tx", "col_start", "col_end")


def with_weights(joined: DataFrame, weight_band: int) -> DataFrame:
    """Adds w, the valid weight of the cell if it is not negative: a window over the cell's bands instead of a self-join."""
    w = Window.partitionBy("slice_id", "zone_id", "row", "col")
    usable = (F.col("band") == weight_band) & F.col("valid") & (F.col("value") >= 0)
    return joined.withColumn("w", F.max(F.when(usable, F.col("value"))).over(w))


def derive(cells: DataFrame, expression: dict | None = None, mask: dict | None = None) -> DataFrame:
    """Apply a job's expression (one output band 0) and mask to the cells; both are evaluated before any aggregation."""
    if expression is None and mask is None:
        return cells
    used = sorted({b for e in (expression, mask) if e is not None for b in bands_of(e)})
    value = lambda b: F.col(f"__b{b}")
    wide = [F.max(F.when((F.col("band") == b) & F.col("valid"), F.col("value"))).alias(f"__b{b}") for b in used]
    if expression is not None:
        rows = cells.groupBy("slice_id", "row", "col").agg(*(wide or [F.lit(1).alias("__one")]))
        v = compile_expression(expression, value)
        if mask is not None:
            v = F.when(keep(compile_expression(mask, value)), v)
        return rows.select("slice_id", "row", "col", F.lit(0).alias("band"), F.coalesce(v, F.lit(0.0)).alias("value"), v.isNotNull().alias("valid"))
    w = Window.partitionBy("slice_id", "row", "col")
    rows = cells.withColumns({f"__b{b}": F.max(F.when((F.col("band") == b) & F.col("valid"), F.col("value"))).over(w) for b in used})
    return rows.withColumn("valid", F.col("valid") & keep(compile_expression(mask, value))).drop(*(f"__b{b}" for b in used))


def zone_areas(selection: DataFrame, areas: DataFrame) -> DataFrame:
    """zone_id, polygon_area, selected (covered cells inside the grid), intersecting_cell_count."""
    n = (F.col("col_end") - F.col("col_start")).cast("double")
    got = numerics.gather(selection, ["zone_id"], [[(n * F.col("fraction"), 0)], [(n, 0)]]).withColumn("r", numerics.rounded(F.col("parts"), 2))
    got = got.select("zone_id", F.col("r")[0].alias("selected"), F.col("r")[1].cast("long").alias("intersecting_cell_count"))
    return areas.select("zone_id", "polygon_area").join(got, "zone_id", "left").fillna({"selected": 0.0, "intersecting_cell_count": 0})


def finish(states: DataFrame, frame: DataFrame) -> DataFrame:
    """Results for every row of ``frame`` (slice_id, band, zone_id and zone areas): derived fields and status."""
    r = frame.join(states, KEYS, "left").fillna({"fractional_sum": 0.0, "covered_cell_equivalents": 0.0, "valid_cell_count": 0})
    cov, sel, area = F.col("covered_cell_equivalents"), F.col("selected"), F.col("polygon_area")
    missing, outside = F.greatest(sel - cov, F.lit(0.0)), F.greatest(area - sel, F.lit(0.0))
    status = F.when(area == 0, "empty").when(sel == 0, "outside").when(cov == 0, "no_valid_data").when((missing > STATUS_LEVEL) | (outside > STATUS_LEVEL), "partial").otherwise("ok")
    return r.withColumns({
        "fractional_sum": checked(F.col("fractional_sum"), "a sum"), "coverage_weighted_mean": F.try_divide("fractional_sum", cov),
        "selected_cell_equivalents": sel, "missing_cell_equivalents": missing, "outside_cell_equivalents": outside, "status": status,
    }).drop("selected")


def _f(value: Column) -> Column:
    return F.when(F.col("valid"), value)


def bin_of(value: Column, edges: tuple[float, ...]) -> Column:
    """Number of the bin (left-closed, the last closed on both sides); -1 below, len(edges) - 1 above."""
    c = F.when(value < edges[0], -1).when(value > edges[-1], len(edges) - 1)
    for i in range(1, len(edges) - 1):
        c = c.when(value < edges[i], i - 1)
    return c.otherwise(len(edges) - 2)


def _terms(rows: DataFrame, options: Options) -> tuple[DataFrame, dict[str, list]]:
    """What each sum adds up, by its name."""
    sums = {"fractional_sum": _f(F.col("value") * F.col("f")), "covered_cell_equivalents": _f(F.col("f"))}
    if options.weight_band is not None:
        weighted = F.col("valid") & F.col("w").isNotNull()
        sums |= {"weighted_sum": F.when(weighted, F.col("value") * F.col("w") * F.col("f")), "weight_sum": F.when(weighted, F.col("w") * F.col("f")), "weighted_valid_cell_equivalents": F.when(weighted, F.col("f"))}
    if options.histogram_edges is not None:
        e = options.histogram_edges
        rows = rows.withColumn("__bin", bin_of(F.col("value"), e))
        sums |= {f"__bin{i}": _f(F.when(F.col("__bin") == i, F.col("f"))) for i in range(-1, len(e))}
    return rows, {k: [(x, 0)] for k, x in sums.items()}


def _moment_terms(rows: DataFrame, weighted: bool) -> tuple[DataFrame, list[list]]:
    """The exact terms of weight, weight * value and weight * value * value, as products of mantissas beside exponents."""
    p = "__w" if weighted else "__u"
    g = F.when(F.col("valid") & F.col("w").isNotNull(), F.col("f") * F.col("w")) if weighted else _f(F.col("f"))
    rows = rows.withColumn(f"{p}g", g)
    for name, x in ((f"{p}n", F.col("value")), (f"{p}m", F.col(f"{p}g"))):
        rows = rows.withColumn(f"{name}e", F.coalesce(numerics.exponent(x), F.lit(0))).withColumn(name, numerics.shifted(x, -F.col(f"{name}e")))
    first, error = numerics.two_product(F.col(f"{p}m"), F.col(f"{p}n"))
    rows = rows.withColumns({f"{p}1": first, f"{p}2": error})
    high, low = (numerics.two_product(F.col(f"{p}{i}"), F.col(f"{p}n")) for i in (1, 2))
    rows = rows.withColumns({f"{p}3": high[0], f"{p}4": high[1], f"{p}5": low[0], f"{p}6": low[1]})
    e, v = F.col(f"{p}me"), F.col(f"{p}ne")
    return rows, [[(F.col(f"{p}m"), e)], [(F.col(f"{p}{i}"), e + v) for i in (1, 2)], [(F.col(f"{p}{i}"), e + 2 * v) for i in (3, 4, 5, 6)]]


def _spread(parts: Column, sums: int, first: int) -> Column:
    """Population variance and standard deviation from the exact totals first, first + 1 and first + 2, each rounded once."""

    @F.pandas_udf("variance double, stddev double")
    def run(column):
        import pandas as pd

        out = []
        for parts in column:
            totals, k = numerics.whole(parts, sums)
            g, gv, gvv = totals[first : first + 3]
            # the totals share one scale, which leaves a square in the variance as it is
            var = Fraction(g * gvv - gv * gv, g * g) if g else None
            out.append((None, None) if var is None else (numerics.nearest_ratio(var), reducers.root(var)))
        return pd.DataFrame(out, columns=["variance", "stddev"])

    return run(parts)


def states(joined: DataFrame, options: Options, spread: tuple[bool, ...] = ()) -> tuple[DataFrame, list[str], int]:
    """One aggregation for all sums, counts, extrema and moments, in exact parts; the sums' names; how many there are."""
    rows, sums = _terms(joined, options)
    terms = list(sums.values())
    for weighted in spread:
        rows, more = _moment_terms(rows, weighted)
        terms += more
    return numerics.gather(rows, KEYS, terms, _f(F.col("value"))), list(sums), len(terms)


def basic_states(joined: DataFrame, options: Options, exact: bool = True, spread: tuple[bool, ...] = ()) -> DataFrame:
    """Sums, counts, extrema, and (by ``spread``: False plain, True weighted) moments, of one aggregation.

    exact: sums and moments are correctly rounded whatever the order and the partitioning; else sums of doubles.
    """
    rows, sums = _terms(joined, options)
    if exact:
        got, names, n = states(joined, options, spread)
        out = got.withColumn("__r", numerics.rounded(F.col("parts"), n, len(names)))
        for i, weighted in enumerate(spread):
            out = out.withColumn(f"__s{i}", _spread(F.col("parts"), n, len(names) + 3 * i))
        spreads = [F.col(f"__s{i}.{s}").alias(f"{'weighted_' if w else ''}{s}") for i, w in enumerate(spread) for s in ("variance", "stddev")]
        out = out.select(*KEYS, *(F.col("__r")[i].alias(k) for i, k in enumerate(names)), F.col("n").alias("valid_cell_count"), F.col("lo").alias("min"), F.col("hi").alias("max"), *spreads)
    else:
        require(not spread, "moments are exact")
        others = [F.count_if(F.col("valid")).alias("valid_cell_count"), F.min(_f(F.col("value"))).alias("min"), F.max(_f(F.col("value"))).alias("max")]
        out = rows.groupBy(*KEYS).agg(*(F.coalesce(F.sum(x), F.lit(0.0)).alias(k) for k, [(x, _)] in sums.items()), *others)
    if options.weight_band is not None:
        out = out.withColumn("weighted_mean", F.when(F.col("weight_sum") > 0, F.try_divide("weighted_sum", "weight_sum")))
    if options.histogram_edges is not None:
        k = len(options.histogram_edges)
        zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
        hist = F.struct(F.array(*(F.lit(float(x)) for x in options.histogram_edges)).alias("edges"), F.array(*(zero(f"__bin{i}") for i in range(k - 1))).alias("counts"), zero("__bin-1").alias("underflow"), zero(f"__bin{k - 1}").alias("overflow"))
        out = out.withColumn("histogram", hist).drop(*(f"__bin{i}" for i in range(-1, k)))
    return out


def moments(joined: DataFrame, weighted: bool = False) -> DataFrame:
    """Population variance and standard deviation, exact and rounded once."""
    rows, terms = _moment_terms(joined, weighted)
    p = "weighted_" if weighted else ""
    got = numerics.gather(rows, KEYS, terms).withColumn("s", _spread(F.col("parts"), 3, 0))
    return got.select(*KEYS, F.col("s.variance").alias(f"{p}variance"), F.col("s.stddev").alias(f"{p}stddev")).where(f"{p}variance is not null")


def masses(joined: DataFrame, weighted: bool = False) -> DataFrame:
    """Covered mass of each distinct value in exact parts, and its cells: what ranks and categories are made from."""
    weight = F.col("f") * F.col("w") if weighted else F.col("f")
    rows = joined.where("valid" + " and w is not null" * weighted).withColumn("g", weight).where("g > 0").withColumn("value", F.col("value") + F.lit(0.0))
    return numerics.gather(rows, [*KEYS, "value"], [[(F.col("g"), 0)]]).select(*KEYS, "value", "parts", "n")


def categories(joined: DataFrame, domain: tuple[float, ...]) -> DataFrame:
    """categories (mass by value of the domain), majority and variety, from exact masses. A valid value outside the domain fails."""
    domain = tuple(float(v) + 0.0 for v in domain)
    known = F.when(F.col("value").isin(list(domain)), F.col("value")).otherwise(F.raise_error(F.lit("a value is outside category_values")).cast("double"))
    m = masses(joined).withColumn("value", known).groupBy(*KEYS).agg(F.collect_list(F.struct("value", "parts")).alias("have"))  # at most len(domain)

    @F.pandas_udf("categories array<struct<value:double,mass:double>>, majority double, variety long")
    def run(column):
        import pandas as pd

        out = []
        for have in column:
            mass = {e["value"]: numerics.whole(e["parts"], 1) for e in have}
            rows = [{"value": v, "mass": numerics.nearest(mass[v][0][0], mass[v][1]) if v in mass else 0.0} for v in domain]
            exact = {v: Fraction(n[0]) * Fraction(2) ** k for v, (n, k) in mass.items()}
            some = [v for v in sorted(exact) if exact[v] > 0]
            out.append((rows, min(some, key=lambda v: (-exact[v], v)) if some else None, len(some)))
        return pd.DataFrame(out, columns=["categories", "majority", "variety"])

    return m.withColumn("r", run(F.col("have"))).select(*KEYS, "r.*")


def ranks(joined: DataFrame, probabilities: tuple[float, ...], weighted: bool = False, limit: int = 65_536) -> DataFrame:
    """Inverse-CDF quantiles of exact masses: the first value whose cumulative mass reaches the share; no interpolation.

    The budget ``limit`` bounds what is gathered for a group; a group with more samples fails.
    """
    p = "weighted_" if weighted else ""
    m = masses(joined, weighted).withColumn("samples", F.sum("n").over(Window.partitionBy(*KEYS)))
    fits = F.when(F.col("samples") <= limit, F.col("value")).otherwise(F.raise_error(F.lit("more samples than quantile_max_samples")).cast("double"))
    lists = m.withColumn("value", fits).groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("value", "parts"))).alias("have"))
    asked = (*probabilities, 0.5)

    @F.pandas_udf("array<double>")
    def run(column):
        import pandas as pd

        out = []
        for have in column:
            totals = [numerics.whole(e["parts"], 1) for e in have]
            low = min(k for _, k in totals)
            cum = list(itertools.accumulate(n[0] << (k - low) for n, k in totals))
            shares = [Fraction(q) * cum[-1] for q in asked]
            out.append([have[bisect.bisect_left(cum, math.ceil(s))]["value"] for s in shares])
        return pd.Series(out)

    r = lists.withColumn("r", run(F.col("have")))
    return r.select(*KEYS, F.slice("r", 1, len(probabilities)).alias(f"{p}quantiles"), F.element_at("r", -1).alias(f"{p}median"))


def measure(cells: DataFrame, selection: DataFrame, areas: DataFrame, options: Options | None = None, slices: DataFrame | None = None, exact: bool = True, edge: int = 256) -> DataFrame:
    """All requested statistics for every slice, zone and band, also where no cell is hit.

    slices: the (slice_id, band) pairs to report; those that occur in the cells if it is not given. exact: sums do not
    depend on order or partitioning; else they are plain sums of doubles.
    """
    options = options or Options()
    joined = join_cells(prune(cells, options), selection, edge)
    if options.weight_band is not None:
        joined = with_weights(joined, options.weight_band)
    pairs = (slices if slices is not None else cells.select("slice_id", "band").distinct())
    if options.bands:
        joined, pairs = (x.where(F.col("band").isin(list(options.bands))) for x in (joined, pairs))
    frame = zone_areas(selection, areas).crossJoin(F.broadcast(pairs.select("slice_id", "band")))  # the rows of the result; at most 4096 slices of 64 bands
    s = options.wants
    spread = tuple(w for w, names in ((False, ("variance", "stddev")), (True, ("weighted_variance", "weighted_stddev"))) if any(map(s, names)))
    out = finish(basic_states(joined, options, exact or bool(spread), spread), frame)
    if options.category_values is not None:
        out = out.join(categories(joined, options.category_values), KEYS, "left")
    if s("median") or s("quantiles"):
        out = out.join(ranks(joined, options.quantiles or (0.5,), False, options.quantile_max_samples), KEYS, "left")
    if s("weighted_median") or s("weighted_quantiles"):
        out = out.join(ranks(joined, options.quantiles or (0.5,), True, options.quantile_max_samples), KEYS, "left")
    return project(out, options)


FACTS = ("selected_cell_equivalents", "missing_cell_equivalents", "outside_cell_equivalents", "intersecting_cell_count", "status")


def project(rows: DataFrame, options: Options) -> DataFrame:
    """Only the requested statistics, beside the keys and the facts about coverage."""
    from gridloom.model import BASIC, COLUMN, EXTENDED

    names = [COLUMN.get(s, s) for s in BASIC + EXTENDED if options.wants(s)]
    require(bool(names), "nothing to compute")
    if any(s.startswith("weight") for s in names):
        names.append("weighted_valid_cell_equivalents")
    return rows.select(*KEYS, *(n for n in names if n in rows.columns), *FACTS)
