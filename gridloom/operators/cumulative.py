"""Sums along polygon edges: every crossing takes what lies left of it from the row's prefix sums.

A run of whole cells costs two look-ups whatever its length. Where an edge crosses cells, their values are taken in part.
Rows are dense: every column is present.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import numerics
from gridloom.model import Grid, Options
from gridloom.operators import zonal
from gridloom.operators.coverage import crossings, left_share
from gridloom.operators.summaries import row_prefixes


TOLERANCE = (1e-8, 1e-10)  # absolute, and for each covered cell


def measure(prefixes: tuple[DataFrame, int, int], cells: DataFrame, edges: DataFrame, selection: DataFrame, areas: DataFrame, grid: Grid, options: Options, pairs: DataFrame) -> DataFrame:
    """sum, support and mean from edge sums; where their error bound exceeds a quarter of the tolerance, from the selection."""
    sums = edge_sums(cells, edges, grid, prefixes)
    allowed = (TOLERANCE[0] + TOLERANCE[1] * F.abs("covered_cell_equivalents")) / 4
    if not sums.where(F.col("error_bound") > allowed).isEmpty():
        return zonal.measure(cells, selection, areas, options, pairs)
    if options.bands:
        pairs = pairs.where(F.col("band").isin(list(options.bands)))
    none = F.lit(None).cast("double")
    states = sums.withColumns({"valid_cell_count": F.lit(0).cast("long"), "min": none, "max": none}).drop("error_bound")
    frame = zonal.zone_areas(selection, areas).crossJoin(F.broadcast(pairs.select("slice_id", "band")))  # the rows of the result; at most 4096 slices of 64 bands
    return zonal.project(zonal.finish(states, frame), options)


def edge_sums(cells: DataFrame, edges: DataFrame, grid: Grid, prefixes: tuple[DataFrame, int, int] | None = None) -> DataFrame:
    """(slice_id, zone_id, band, fractional_sum, covered_cell_equivalents, error_bound) from edges in pixel space.

    Prefixes and their products with an edge's height are exact, so values left of a polygon cancel whole. What
    remains is the rounding of the edges' own heights and shares, times the values they meet: error_bound. Where it is too
    much, ``measure`` falls back to the selection.
    """
    keys = ["slice_id", "band", "zone_id"]
    first = F.least(F.lit(grid.width), F.greatest(F.lit(0), F.floor("lx"))).cast("int")
    last = F.least(F.lit(grid.width - 1), F.ceil("rx") - 1).cast("int")
    cut = crossings(edges, grid).withColumns({"first": first, "last": last})
    pre, low, n = prefixes or row_prefixes(cells)
    names = [*(f"p{j}" for j in range(n)), "count_to"]
    left = cut.withColumn("col", F.col("first") - 1).join(pre, ["row", "col"]).select(*keys, "dy", *names)
    touched = cut.where("last >= first").withColumn("c", F.explode(F.sequence("first", "last"))).withColumn("g", left_share())
    v = cells.select("slice_id", "band", "row", F.col("col").alias("c"), F.when(F.col("valid"), F.col("value")).otherwise(0.0).alias("v"), F.col("valid").cast("double").alias("k"))
    part = touched.join(v, ["row", "c"]).select(*keys, (F.col("dy") * F.col("g")).alias("h"), "v", "k")
    both = left.unionByName(part, allowMissingColumns=True)
    dy, h = F.col("dy"), F.col("h")
    sums = [t for j in range(n) for t in numerics.product_terms(dy, F.col(f"p{j}"), numerics.BASE * (low + j))]
    size = sum((F.abs(F.col(f"p{j}").cast("double")) * 2.0 ** max(-1000, min(900, numerics.BASE * (low + j))) for j in range(n)), F.lit(0.0))
    size = F.coalesce(F.abs(dy) * size, F.abs(h * F.col("v")))
    counts = numerics.product_terms(dy, F.col("count_to"), 0)
    got = numerics.gather(both, keys, [[*sums, (h * F.col("v"), 0)], [*counts, (h * F.col("k"), 0)], [(size, 0)]])
    got = got.withColumn("r", numerics.rounded(F.col("parts"), 3))
    return got.select(*keys, F.col("r")[0].alias("fractional_sum"), F.col("r")[1].alias("covered_cell_equivalents"), (F.col("r")[2] * 2.0**-51).alias("error_bound"))
