"""Summary tables: sums, counts and extrema by tile and level, and the rewrite of a measurement to use them.

Tiles that a zone covers whole are answered from the table; only cells of tiles on the boundary are read. The rewrite is an
explicit union of both plans, and the boundary's tiles reach the scan as a semi-join.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import numerics
from gridloom.model import Grid, Options, require
from gridloom.operators import zonal
from gridloom.operators.coverage import tile_cover, tiled

STATE = ["fractional_sum", "valid_cell_count", "min", "max"]
TILE = ["slice_id", "band", "level", "ty", "tx"]


def _rounded(gathered: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with the state and the exact parts of its sum, which merge without loss."""
    r = gathered.withColumn("r", numerics.rounded(F.col("parts"), 1))
    return r.select(*keys, F.col("r")[0].alias("fractional_sum"), F.col("n").cast("long").alias("valid_cell_count"), F.col("lo").alias("min"), F.col("hi").alias("max"), "parts")


def _gathered(states: DataFrame, *keys) -> DataFrame:
    """States as numerics.again takes them."""
    return states.select(*keys, "parts", F.col("valid_cell_count").alias("n"), F.col("min").alias("lo"), F.col("max").alias("hi"))


def _tiles(cells: DataFrame, edge: int) -> DataFrame:
    v = F.when(F.col("valid"), F.col("value"))
    rows = cells.withColumns({"level": F.lit(0), "ty": F.expr(f"row div {edge}"), "tx": F.expr(f"col div {edge}")})
    return numerics.gather(rows, TILE, [[(v, 0)]], v)


def leaves(cells: DataFrame, edge: int) -> DataFrame:
    """Level 0: (slice_id, band, level, ty, tx) with the state of its valid cells."""
    return _rounded(_tiles(cells, edge), TILE)


def pyramid(cells: DataFrame, edge: int, levels: int) -> DataFrame:
    """Leaves and their parents, each made from two by two children and never from resampled cells."""
    require(edge in (16, 32, 64, 128, 256, 512) and 0 <= levels <= 24, "unsupported tile edge or number of levels")
    leaf = _tiles(cells, edge)
    if not levels:
        return _rounded(leaf, TILE)
    up = F.explode(F.sequence(F.lit(0), F.lit(levels)))
    side = F.expr("shiftleft(1L, level)")
    rows = leaf.drop("level").withColumn("level", up).withColumns({"ty": F.floor(F.col("ty") / side), "tx": F.floor(F.col("tx") / side)})
    return _rounded(numerics.again(rows, TILE), TILE)  # every level from the leaves' exact parts


VERSION = 2
FACTS = ("version", "edge", "levels", "grid_id", "source_id", "build_id")


def ward(cells: DataFrame, path: str, edge: int = 64, levels: int = 4, identity: dict | None = None) -> None:
    """Write a summary table with the identity of its grid and source; an existing one is never overwritten."""
    facts = {"version": VERSION, "edge": edge, "levels": levels, "grid_id": "", "source_id": "", **(identity or {})}
    facts["build_id"] = hashlib.sha256(json.dumps(facts, sort_keys=True).encode()).hexdigest()
    out = pyramid(cells, edge, levels).withColumns({k: F.lit(facts[k]) for k in FACTS})
    out.write.mode("errorifexists").partitionBy("level").parquet(path)


def open_index(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """A summary table and its facts."""
    table = spark.read.parquet(path)
    require(set(FACTS) <= set(table.columns), "not a summary table")
    first = table.select(*FACTS).distinct().limit(2).collect()
    require(len(first) == 1 and first[0]["version"] == VERSION, "a summary table has one version, build and source")
    return table.drop(*FACTS), first[0].asDict()


def row_blocks(cells: DataFrame, width: int = 64) -> DataFrame:
    """State of blocks of 64 columns in a row."""
    v = F.when(F.col("valid"), F.col("value"))
    keys = ["slice_id", "band", "row", "block"]
    return _rounded(numerics.gather(cells.withColumn("block", F.expr(f"col div {width}")), keys, [[(v, 0)]], v), keys)


def check_states(summary: DataFrame, grid: Grid, edge: int) -> DataFrame:
    """States that cannot be: more cells than the tile has, extrema out of order, a mean outside them, or values without cells."""
    side = F.lit(edge) * F.pow(F.lit(2.0), F.col("level"))
    mean = F.try_divide("fractional_sum", F.col("valid_cell_count").cast("double"))
    slack = F.lit(1e-9) + F.lit(1e-12) * F.greatest(F.abs("min"), F.abs("max"))
    bad = (F.col("valid_cell_count") > F.least(side * side, F.lit(float(grid.width) * grid.height))) | (F.col("min") > F.col("max")) | (mean < F.col("min") - slack) | (mean > F.col("max") + slack)
    empty = (F.col("valid_cell_count") == 0) & ((F.col("fractional_sum") != 0) | F.col("min").isNotNull() | F.col("max").isNotNull())
    return summary.where(F.coalesce(bad, F.lit(False)) | empty)


def cover(zones_by_tile: DataFrame, levels: int) -> DataFrame:
    """The fewest nodes over a zone's whole tiles: a parent stands for four whole children. (zone_id, level, ty, tx)."""
    whole = zones_by_tile.where("whole").select("zone_id", "ty", "tx")
    out, level = None, whole
    for k in range(levels + 1):
        four = level.groupBy("zone_id", F.expr("ty div 2").alias("py"), F.expr("tx div 2").alias("px")).agg(F.count(F.lit(1)).alias("n")).where("n = 4")
        own = level.alias("l").join(four.alias("p"), F.expr("l.zone_id = p.zone_id and l.ty div 2 = p.py and l.tx div 2 = p.px"), "left_anti") if k < levels else level
        nodes = own.select("zone_id", F.lit(k).alias("level"), "ty", "tx")
        out = nodes if out is None else out.unionByName(nodes)
        level = four.select("zone_id", F.col("py").alias("ty"), F.col("px").alias("tx"))
    return out


def measure_with(summary: DataFrame, cells: DataFrame, selection: DataFrame, areas: DataFrame, grid: Grid, edge: int, levels: int = 0, options: Options | None = None, slices: DataFrame | None = None) -> DataFrame:
    """Like zonal.measure, with whole tiles taken from the summary. Only basic statistics are eligible.

    Stored and read sums meet as exact parts, so the result equals the direct one.
    """
    options = options or Options()
    require(options.summary_eligible(), "these statistics cannot come from summaries")
    by_tile = tile_cover(selection, grid, edge)
    nodes = cover(by_tile, levels)
    inside = zonal.prune(summary, options).join(nodes, ["level", "ty", "tx"])
    stored = _with_count(inside, *zonal.KEYS)
    rest = tiled(selection, edge).join(by_tile.where("not whole").select("zone_id", "ty", "tx"), ["zone_id", "ty", "tx"])
    tiles = rest.select(F.col("ty").alias("e_ty"), F.col("tx").alias("e_tx")).distinct()
    near = zonal.prune(cells, options).join(tiles, F.expr(f"row div {edge} = e_ty and col div {edge} = e_tx"), "left_semi")
    joined = zonal.join_cells(near, rest.select("zone_id", "row", "col_start", "col_end", "fraction"), edge)
    return _combined(stored, joined, selection, areas, options, slices if slices is not None else summary.select("slice_id", "band").distinct())


def _combined(stored: DataFrame, joined: DataFrame, selection: DataFrame, areas: DataFrame, options: Options, pairs: DataFrame) -> DataFrame:
    """Results from stored parts and cells that were read."""
    read, names, n = zonal.states(joined, Options())
    both = numerics.again(stored.unionByName(read.select(*stored.columns)), zonal.KEYS).withColumn("r", numerics.rounded(F.col("parts"), n))
    states = both.select(*zonal.KEYS, *(F.col("r")[i].alias(k) for i, k in enumerate(names)), F.col("n").alias("valid_cell_count"), F.col("lo").alias("min"), F.col("hi").alias("max"))
    if options.bands:
        pairs = pairs.where(F.col("band").isin(list(options.bands)))
    frame = zonal.zone_areas(selection, areas).crossJoin(F.broadcast(pairs.select("slice_id", "band")))  # the rows of the result; at most 4096 slices of 64 bands
    return zonal.project(zonal.finish(states, frame), options)


def _with_count(states: DataFrame, *keys) -> DataFrame:
    """Stored states as parts of two sums: the values, and the support of whole cells, which is their count."""
    long = lambda v: F.lit(v).cast("long")
    covered = F.array(long(1), long(0), F.col("valid_cell_count"), long(0), long(0))
    return _gathered(states.withColumn("parts", F.concat("parts", covered)), *keys)


def measure_with_blocks(blocks: DataFrame, cells: DataFrame, selection: DataFrame, areas: DataFrame, width: int, options: Options | None = None, slices: DataFrame | None = None) -> DataFrame:
    """Like zonal.measure, with the blocks of a row that a run covers whole taken from their states."""
    options = options or Options()
    require(options.summary_eligible(), "these statistics cannot come from summaries")
    pieces = tiled(selection, width)
    whole = (F.col("fraction") == 1) & (F.col("col_start") == F.col("tx") * width) & (F.col("col_end") == (F.col("tx") + 1) * width)
    stored = zonal.prune(blocks, options).join(pieces.where(whole).select("zone_id", "row", F.col("tx").alias("block")), ["row", "block"])
    joined = zonal.join_cells(zonal.prune(cells, options), pieces.where(~whole).select("zone_id", "row", "col_start", "col_end", "fraction"), width)
    pairs = slices if slices is not None else cells.select("slice_id", "band").distinct()
    return _combined(_with_count(stored, *zonal.KEYS), joined, selection, areas, options, pairs)


def row_prefixes(cells: DataFrame) -> tuple[DataFrame, int, int]:
    """Exact prefix sums and counts along each row, up to and with the cell, and the lowest place and number of places.

    (slice_id, band, row, col, p0.., count_to): p0 is the sum of digits at the lowest place, and so on.
    """
    w = Window.partitionBy("slice_id", "band", "row").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    v = F.when(F.col("valid"), F.col("value"))
    low, high = numerics.span(cells, v)
    placed = numerics.spread_digits(cells, v, low, high)
    sums = [F.sum(f"__p{j}").over(w).alias(f"p{j}") for j in range(high - low + 1)]
    return placed.select("slice_id", "band", "row", "col", *sums, F.sum(F.col("valid").cast("long")).over(w).alias("count_to")), low, high - low + 1


def measure_by_prefix(cells: DataFrame, selection: DataFrame) -> DataFrame:
    """Exact sums and support of runs from two prefixes each, whatever a run's length. Rows are dense: every column is present."""
    pre, low, n = row_prefixes(cells)
    names = [*(f"p{j}" for j in range(n)), "count_to"]
    hi = pre.withColumn("edge", F.col("col") + 1).drop("col")
    s = selection.select("zone_id", "row", F.col("col_start"), F.col("col_end"), "fraction")
    upper = s.join(hi.withColumnRenamed("edge", "col_end"), ["row", "col_end"])
    lower = hi.select("slice_id", "band", "row", F.col("edge").alias("col_start"), *(F.col(c).alias(f"__{c}") for c in names))
    both = upper.join(lower, ["slice_id", "band", "row", "col_start"], "left").withColumns({c: F.col(c) - F.coalesce(F.col(f"__{c}"), F.lit(0).cast("long")) for c in names})
    f = F.col("fraction")
    sums = [t for j in range(n) for t in numerics.product_terms(f, F.col(f"p{j}"), numerics.BASE * (low + j))]
    got = numerics.gather(both, zonal.KEYS, [sums, numerics.product_terms(f, F.col("count_to"), 0)]).withColumn("r", numerics.rounded(F.col("parts"), 2))
    return got.select(*zonal.KEYS, F.col("r")[0].alias("fractional_sum"), F.col("r")[1].alias("covered_cell_equivalents"))
