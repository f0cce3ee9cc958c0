"""The registered queries: every operator over rasters and zones that are made from the driver's tables.

A row of ``orders``, ``part`` or ``events`` is a cell, by its dense key. Zones are rectangles with quarter-cell corners, one for
each nation, and a few fixed shapes. Cell values are integers and shares are dyadic, so sums are exact in any order.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridloom.functions.numerics import exact_sums
from gridloom.functions.normalize import normalize
from gridloom.model import Grid, Options
from gridloom.operators import coverage, cumulative, ordered, reducers, spherical, summaries, zonal
from gridloom.operators import geometry as G
from gridloom.plans import cover
from gridloom.plans.batch import Job, Source
from gridloom.sources import raster, snapshot

WIDE = 100


_schemas: dict[str, StructType] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; its schema is read from the files once."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def _grid(df: DataFrame, key: str, width: int) -> Grid:
    rows = df.agg(F.max(key)).first()[0] // width + 1
    return Grid(width, int(rows), (0.0, 1.0, 0.0, 0.0, 0.0, -1.0), "LOCAL")


def orders(spark, sf_dir) -> tuple[DataFrame, Grid]:
    t = _table(spark, sf_dir, "orders")
    cents = F.round(F.col("o_totalprice").cast("double") * 100)
    return raster.from_table(t, "o_orderkey", WIDE, [(cents, F.col("o_orderstatus") != "P"), (F.col("o_custkey"), F.lit(True))], "orders"), _grid(t, "o_orderkey", WIDE)


def part(spark, sf_dir) -> tuple[DataFrame, Grid]:
    t = _table(spark, sf_dir, "part")
    cents = F.round(F.col("p_retailprice").cast("double") * 100)
    return raster.from_table(t, "p_partkey", 50, [(F.col("p_size"), F.lit(True)), (cents, F.expr("p_partkey % 11 <> 0"))], "part"), _grid(t, "p_partkey", 50)


def events(spark, sf_dir) -> tuple[DataFrame, Grid]:
    t = _table(spark, sf_dir, "events")
    cents = F.round(F.col("value").cast("double") * 100)
    return raster.from_table(t, "event_id", WIDE, [(cents, F.lit(True))], F.col("event_type")), _grid(t, "event_id", WIDE)


BOX = ("(7 * n_nationkey) % 80 + 0.25 * (n_nationkey % 4)", "(7 * n_nationkey) % 80 + 0.25 * (n_nationkey % 4) + 5.5 + 6 * (n_nationkey % 5)", "(11 * n_nationkey) % 120 - 2 + 0.25 * (n_nationkey % 3)", "(11 * n_nationkey) % 120 - 2 + 0.25 * (n_nationkey % 3) + 8.25 + 7 * (n_nationkey % 7)")
#: Fixed shapes in pixel space: rings of (x, y); the first of a part is its shell.
SHAPES = {
    "hole": [[[(2, 1), (12, 1), (12, 9), (2, 9)], [(4, 3), (8, 3), (8, 6.5), (4, 6.5)]]],
    "multi": [[[(0.5, 0.5), (3.5, 0.5), (3.5, 2.25), (0.5, 2.25)]], [[(10, 4), (14, 4), (10, 8)]]],
    "outside": [[[(200, 2), (210, 2), (210, 4), (200, 4)]]],
    "triangle": [[[(0, 0), (8, 0), (0, 8)]]],
    "wedge": [[[(20, 2), (28, 6), (20, 10)]]],
}


def boxes(spark, sf_dir) -> DataFrame:
    n = _table(spark, sf_dir, "nation")
    x0, x1, y0, y1 = (F.expr(f"cast({e} as double)") for e in BOX)
    point = lambda x, y: F.concat(F.lit("["), x.cast("string"), F.lit(","), (-y).cast("string"), F.lit("]"))
    ring = F.concat_ws(",", point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))
    return n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("zone_id"), F.concat(F.lit('{"type":"Polygon","coordinates":[['), ring, F.lit("]]}")).alias("geometry"))


def shape(name: str) -> dict:
    parts = [[[[x, -y] for x, y in [*ring, ring[0]]] for ring in p] for p in SHAPES[name]]
    return {"type": "MultiPolygon", "coordinates": parts}


def shapes(spark, *names: str) -> DataFrame:
    import json

    return spark.createDataFrame([(n, json.dumps(shape(n))) for n in names or SHAPES], "zone_id string, geometry string")


def _slices(spark, source) -> DataFrame | None:
    """What a source is known to hold; the slices of events are found by a scan."""
    return None if source is events else spark.createDataFrame([(source.__name__, b) for b in (0, 1)], "slice_id string, band int")


def _measured(spark, sf_dir, options: Options | None = None, source=orders) -> DataFrame:
    cells, grid = source(spark, sf_dir)
    zones = boxes(spark, sf_dir)
    return zonal.measure(cells, coverage.select_cells(zones, grid), G.zone_facts(zones, grid), options, _slices(spark, source))


def _joined(spark, sf_dir, source, weight_band: int | None = None) -> DataFrame:
    cells, grid = source(spark, sf_dir)
    j = zonal.join_cells(cells, coverage.select_cells(boxes(spark, sf_dir), grid))
    return zonal.with_weights(j, weight_band) if weight_band is not None else j


# --- SQL building blocks -------------------------------------------------------------------------------------------

Z = f"z AS (SELECT 'n' || n_nationkey AS zone_id, CAST({BOX[0]} AS DOUBLE) AS x0, CAST({BOX[1]} AS DOUBLE) AS x1, CAST({BOX[2]} AS DOUBLE) AS y0, CAST({BOX[3]} AS DOUBLE) AS y1 FROM nation)"
C_ORDERS = """c AS (SELECT 'orders' AS slice_id, o_orderkey // 100 AS r, o_orderkey % 100 AS k, 0 AS band, CASE WHEN o_orderstatus <> 'P' THEN round(CAST(o_totalprice AS DOUBLE) * 100) END AS v FROM orders
 UNION ALL SELECT 'orders', o_orderkey // 100, o_orderkey % 100, 1, CAST(o_custkey AS DOUBLE) FROM orders)"""
C_PART = """c AS (SELECT 'part' AS slice_id, p_partkey // 50 AS r, p_partkey % 50 AS k, 0 AS band, CAST(p_size AS DOUBLE) AS v FROM part
 UNION ALL SELECT 'part', p_partkey // 50, p_partkey % 50, 1, CASE WHEN p_partkey % 11 <> 0 THEN round(CAST(p_retailprice AS DOUBLE) * 100) END FROM part)"""
C_EVENTS = "c AS (SELECT event_type AS slice_id, event_id // 100 AS r, event_id % 100 AS k, 0 AS band, round(CAST(value AS DOUBLE) * 100) AS v FROM events)"
SHARE = "(least(r + 1, y1) - greatest(r, y0)) * (least(k + 1, x1) - greatest(k, x0))"
J = f"j AS (SELECT slice_id, zone_id, band, r, k, v, {SHARE} AS f FROM c JOIN z ON r < y1 AND r + 1 > y0 AND k < x1 AND k + 1 > x0)"
JW = "w AS (SELECT slice_id, zone_id, r, k, v AS wv FROM j WHERE band = 1 AND v >= 0), jw AS (SELECT j.*, wv FROM j LEFT JOIN w USING (slice_id, zone_id, r, k))"
AREA = "a AS (SELECT zone_id, (x1 - x0) * (y1 - y0) AS area, greatest(0, least(x1, wide) - greatest(x0, 0)) * greatest(0, least(y1, high) - greatest(y0, 0)) AS selected FROM z, (SELECT max(r) + 1 AS high, {wide} AS wide FROM c))"
STATS = "s AS (SELECT slice_id, zone_id, band, coalesce(sum(v * f), 0) AS s, coalesce(sum(CASE WHEN v IS NOT NULL THEN f END), 0) AS n, count(v) AS cnt, min(v) AS lo, max(v) AS hi FROM j GROUP BY ALL)"
FULL = "full_ AS (SELECT p.slice_id, p.band, a.zone_id, area, selected, coalesce(s, 0) AS s, coalesce(n, 0) AS n, coalesce(cnt, 0) AS cnt, lo, hi FROM (SELECT DISTINCT slice_id, band FROM c) p CROSS JOIN a LEFT JOIN s ON s.slice_id = p.slice_id AND s.band = p.band AND s.zone_id = a.zone_id)"
STATUS = "CASE WHEN area = 0 THEN 'empty' WHEN selected = 0 THEN 'outside' WHEN n = 0 THEN 'no_valid_data' WHEN greatest(selected - n, 0) > 1e-9 OR greatest(area - selected, 0) > 1e-9 THEN 'partial' ELSE 'ok' END"


def sql(*ctes: str, select: str, wide: int = WIDE) -> str:
    return "WITH " + ",\n".join(c.replace("{wide}", str(wide)) for c in ctes) + "\n" + select


BASE = (C_ORDERS, Z, J, AREA, STATS, FULL)
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def _edge_sql(*names: str, high: int, wide: int) -> str:
    """Coverage of fixed shapes from their edges: the integral of the clamped line over each row and column."""
    rows = []
    for n in names:  # edges as written in SHAPES; a shell counts as it turns, a hole against it
        for part in SHAPES[n]:
            for hole, ring in enumerate(part):
                pairs = list(zip(ring, [*ring[1:], ring[0]], strict=True))
                turn = 1 if sum(ax * by - bx * ay for (ax, ay), (bx, by) in pairs) > 0 else -1
                rows += [f"('{n}', {float(ax)}, {float(ay)}, {float(bx)}, {float(by)}, {-turn if hole else turn})" for (ax, ay), (bx, by) in pairs]
    return f"""WITH e(zone_id, ax, ay, bx, y1, factor) AS (VALUES {", ".join(rows)}),
x AS (SELECT zone_id, r, greatest(r, least(ay, y1)) AS lo, least(r + 1, greatest(ay, y1)) AS hi, CAST(ax AS DOUBLE) AS ax, CAST(ay AS DOUBLE) AS ay, CAST(bx AS DOUBLE) AS bx, CAST(y1 AS DOUBLE) AS y1, factor
  FROM e, range(0, {high}) t(r) WHERE ay <> y1 AND greatest(ay, y1) > r AND least(ay, y1) < r + 1),
y AS (SELECT *, ax + (lo - ay) * (bx - ax) / (y1 - ay) AS u, ax + (hi - ay) * (bx - ax) / (y1 - ay) AS w, (hi - lo) * CASE WHEN y1 > ay THEN factor ELSE -factor END AS dy FROM x),
q AS (SELECT zone_id, r, c, dy, least(u, w) AS lx, greatest(u, w) AS rx FROM y, range(0, {wide}) t(c)),
g AS (SELECT zone_id, r, c, sum(dy * CASE WHEN lx >= c + 1 THEN 1 WHEN rx <= c THEN 0 WHEN lx = rx THEN least(1, greatest(0, lx - c))
  ELSE ((least(rx, c + 1) - greatest(lx, c)) * ((greatest(lx, c) - c) + (least(rx, c + 1) - c)) / 2 + greatest(0, rx - (c + 1))) / (rx - lx) END) AS f FROM q GROUP BY ALL)
SELECT zone_id, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, CAST(f AS DOUBLE) AS fraction FROM g WHERE f > 1e-12"""


SMALL = Grid(40, 12, (0.0, 1.0, 0.0, 0.0, 0.0, -1.0), "LOCAL")


# --- coverage ------------------------------------------------------------------------------------------------------


@query(sql(C_ORDERS, Z, J, select="SELECT zone_id, CAST(r AS INTEGER) AS row, CAST(k AS INTEGER) AS col, f AS fraction FROM j WHERE band = 1"))
def coverage_rect_cells(spark, sf_dir):
    _, grid = orders(spark, sf_dir)
    return coverage.cells_of(coverage.select_cells(boxes(spark, sf_dir), grid))


@query(sql(C_ORDERS, Z, J, """i AS (SELECT *, k - row_number() OVER (PARTITION BY zone_id, r, f ORDER BY k) AS g FROM j WHERE band = 1)""", select="SELECT zone_id, CAST(r AS INTEGER) AS row, CAST(min(k) AS INTEGER) AS col_start, CAST(max(k) + 1 AS INTEGER) AS col_end, f AS fraction FROM i GROUP BY zone_id, r, f, g"))
def coverage_spans(spark, sf_dir):
    _, grid = orders(spark, sf_dir)
    return coverage.select_cells(boxes(spark, sf_dir), grid).select("zone_id", "row", "col_start", "col_end", "fraction")


@query(_edge_sql("triangle", "wedge", high=12, wide=40))
def coverage_triangle_cells(spark, sf_dir):
    return coverage.cells_of(coverage.select_cells(shapes(spark, "triangle", "wedge"), SMALL))


@query(_edge_sql("hole", high=12, wide=40))
def coverage_hole(spark, sf_dir):
    return coverage.cells_of(coverage.select_cells(shapes(spark, "hole"), SMALL))


@query(_edge_sql("multi", high=12, wide=40))
def coverage_multipart(spark, sf_dir):
    return coverage.cells_of(coverage.select_cells(shapes(spark, "multi"), SMALL))


@query(_edge_sql(*SHAPES, high=12, wide=40))
def coverage_edges_generic(spark, sf_dir):
    return coverage.cells_of(coverage.select_cells(shapes(spark), SMALL))


@query(_edge_sql(*SHAPES, high=12, wide=40))
def coverage_relational(spark, sf_dir):
    return coverage.cells_of(coverage.select_cells(shapes(spark), SMALL, "relational"))


@query(_edge_sql(*SHAPES, high=12, wide=40))
def coverage_direct_clip(spark, sf_dir):
    return coverage.cells_of(coverage.select_cells(shapes(spark), SMALL, "direct"))


@query(sql(C_ORDERS, Z, J, "t AS (SELECT zone_id, r // 32 AS ty, k // 32 AS tx, count(*) AS cells, count(*) FILTER (f = 1) AS full_ FROM j WHERE band = 1 GROUP BY ALL)", "h AS (SELECT max(r) + 1 AS high FROM c)", select="SELECT zone_id, CAST(ty AS BIGINT) AS ty, CAST(tx AS BIGINT) AS tx, cells, full_ = least(32, high - ty * 32) * least(32, 100 - tx * 32) AS whole FROM t, h"))
def tile_selection_whole(spark, sf_dir):
    _, grid = orders(spark, sf_dir)
    t = coverage.tile_cover(coverage.select_cells(boxes(spark, sf_dir), grid), grid, 32)
    return t.select("zone_id", F.col("ty").cast("long").alias("ty"), F.col("tx").cast("long").alias("tx"), "cells", "whole")


@query(sql(C_ORDERS, Z, J, "g AS (SELECT r, k, string_agg(DISTINCT zone_id, ',' ORDER BY zone_id) AS zones FROM j WHERE band = 1 GROUP BY ALL)", "i AS (SELECT *, k - row_number() OVER (PARTITION BY r, zones ORDER BY k) AS d FROM g)", select="SELECT CAST(r AS INTEGER) AS row, CAST(min(k) AS INTEGER) AS col_start, CAST(max(k) + 1 AS INTEGER) AS col_end, zones FROM i GROUP BY r, zones, d"))
def shared_pieces(spark, sf_dir):
    _, grid = orders(spark, sf_dir)
    return coverage.shared_pieces(coverage.select_cells(boxes(spark, sf_dir), grid)).select("row", "col_start", "col_end", "zones")


SLIVERS = (12, 20, 28, 35, 42, 47)
SLIVER_SQL = f"""WITH s AS (SELECT unnest([{", ".join(map(str, SLIVERS))}]) AS k),
cell AS (SELECT k, r, c, 1.25 + 1.6 * (greatest(r, 1.5) - 1.5) AS x0, 1.25 + 1.6 * (least(r + 1, 6.5) - 1.5) + 1 / power(2, k) AS x1 FROM s, range(1, 7) t(r), range(0, 40) u(c))
SELECT '2^-' || k AS zone_id, count(*) AS cells, 5.0::DOUBLE AS area FROM cell WHERE x0 < c + 1 AND x1 > c GROUP BY k"""


@query(SLIVER_SQL)
def exact_sliver_coverage(spark, sf_dir):
    """Diagonals down to 2^-47 of a cell keep positive, exact shares; areas are given in the sliver's width."""
    rows = [(f"2^-{k}", str([[[[1.25, -1.5], [9.25, -6.5], [9.25 + 2.0**-k, -6.5], [1.25 + 2.0**-k, -1.5], [1.25, -1.5]]]])) for k in SLIVERS]
    zones = spark.createDataFrame([(z, f'{{"type":"MultiPolygon","coordinates":{g}}}') for z, g in rows], "zone_id string, geometry string")
    cells = coverage.cells_of(coverage.select_cells(zones, SMALL))
    area = F.sum("fraction") * F.pow(F.lit(2.0), F.regexp_extract("zone_id", "[0-9]+$", 0).cast("double"))
    return cells.groupBy("zone_id").agg(F.count(F.lit(1)).alias("cells"), F.round(area, 9).alias("area"))


# --- base statistics -----------------------------------------------------------------------------------------------


def _base(name: str, spark_cols: list[str], sql_cols: str):
    @query(sql(*BASE, select=f"SELECT slice_id, zone_id, CAST(band AS INTEGER) AS band, {sql_cols} FROM full_"))
    def f(spark, sf_dir):
        return _measured(spark, sf_dir).select("slice_id", "zone_id", "band", *spark_cols)

    QUERIES[name], ORACLE_SQL[name] = QUERIES.pop("f"), ORACLE_SQL.pop("f")


_base("zonal_sum", ["fractional_sum", "covered_cell_equivalents", "valid_cell_count", "coverage_weighted_mean", "min", "max", "status"], f"s AS fractional_sum, n AS covered_cell_equivalents, cnt AS valid_cell_count, s / nullif(n, 0) AS coverage_weighted_mean, lo AS min, hi AS max, {STATUS} AS status")
_base("zonal_support", ["covered_cell_equivalents", "selected_cell_equivalents", "missing_cell_equivalents", "outside_cell_equivalents"], "n AS covered_cell_equivalents, CAST(selected AS DOUBLE) AS selected_cell_equivalents, CAST(greatest(selected - n, 0) AS DOUBLE) AS missing_cell_equivalents, CAST(greatest(area - selected, 0) AS DOUBLE) AS outside_cell_equivalents")
_base("zonal_mean", ["coverage_weighted_mean"], "s / nullif(n, 0) AS coverage_weighted_mean")
_base("zonal_min_max", ["min", "max"], "lo AS min, hi AS max")
_base("zonal_count", ["valid_cell_count"], "cnt AS valid_cell_count")
_base("zonal_status", ["status"], f"{STATUS} AS status")


@query(sql(*BASE, select="SELECT slice_id, zone_id, CAST(band AS INTEGER) AS band, s AS fractional_sum, n AS covered_cell_equivalents FROM full_ WHERE cnt > 0"))
def zonal_sum_exact_order_free(spark, sf_dir):
    """The same sums through exact partial sums, which do not depend on order."""
    j = _joined(spark, sf_dir, orders).where("valid").select("slice_id", "zone_id", "band", (F.col("value") * F.col("f")).alias("fractional_sum"), F.col("f").alias("covered_cell_equivalents"))
    return exact_sums(j, ["slice_id", "zone_id", "band"], ["fractional_sum", "covered_cell_equivalents"])


@query(sql(C_ORDERS, Z, J, STATS, select="SELECT slice_id, zone_id, s AS fractional_sum FROM s WHERE band = 1"))
def band_projection(spark, sf_dir):
    return _measured(spark, sf_dir, Options(bands=(1,), statistics=("sum",))).where("intersecting_cell_count > 0").select("slice_id", "zone_id", "fractional_sum")


# --- normalisation, expressions and masks ----------------------------------------------------------------------------


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 AND p_size <> 7 THEN p_size * 0.5::DOUBLE - 2 ELSE 0::DOUBLE END AS value, p_partkey % 5 <> 0 AND p_size <> 7 AS valid FROM part")
def normalize_nodata_scale(spark, sf_dir):
    t = _table(spark, sf_dir, "part")
    n = normalize(F.col("p_size"), F.expr("case when p_partkey % 5 <> 0 then 255 else 0 end"), 7.0, 0.5, -2.0)
    return t.select("p_partkey", n.alias("n")).select("p_partkey", "n.value", "n.valid")


@query("SELECT CAST(p_partkey // 50 AS INTEGER) AS row, CAST(p_partkey % 50 AS INTEGER) AS col, CAST(p_size AS DOUBLE) AS sample FROM part WHERE p_partkey // 50 BETWEEN 1 AND 3 AND p_partkey % 50 BETWEEN 5 AND 24")
def raw_window_read(spark, sf_dir):
    """Samples of a window, unpacked again from their little-endian bytes."""
    t = _table(spark, sf_dir, "part").select(F.expr("cast(p_partkey div 50 as int)").alias("row"), F.expr("cast(p_partkey % 50 as int)").alias("col"), F.lit(0).alias("band"), F.col("p_size").alias("sample"), F.lit(255).alias("mask"))
    packed = raster.raw_window(t, 5, 1, 20, 3, [0])

    def unpack(it):
        import numpy as np
        import pyarrow as pa

        for b in it:
            for s in b.column("samples").to_pylist():
                v = np.frombuffer(s, "<f8")
                i = np.arange(len(v))
                yield pa.RecordBatch.from_arrays([pa.array((1 + i // 20).astype(np.int32)), pa.array((5 + i % 20).astype(np.int32)), pa.array(v)], names=["row", "col", "sample"])

    return packed.mapInArrow(unpack, "row int, col int, sample double")


B0, B1 = {"op": "band", "band": 0}, {"op": "band", "band": 1}


def _pair(op, left=B0, right=B1):
    return {"op": op, "left": left, "right": right}


CONST = lambda v: {"op": "constant", "value": v}
WIDE_SQL = "b AS (SELECT slice_id, r, k, max(CASE WHEN band = 0 THEN v END) AS a, max(CASE WHEN band = 1 THEN v END) AS b FROM c GROUP BY ALL)"


def _expression(name: str, expr: dict, text: str, mask: dict | None = None):
    @query(sql(C_ORDERS, WIDE_SQL, select=f"SELECT CAST(r AS INTEGER) AS row, CAST(k AS INTEGER) AS col, CASE WHEN x IS NULL OR isinf(x) OR isnan(x) THEN 0::DOUBLE ELSE x END AS value, x IS NOT NULL AS valid FROM (SELECT r, k, CAST({text} AS DOUBLE) AS x FROM b)"))
    def f(spark, sf_dir):
        return zonal.derive(orders(spark, sf_dir)[0], expr, mask).select("row", "col", "value", "valid")

    QUERIES[name], ORACLE_SQL[name] = QUERIES.pop("f"), ORACLE_SQL.pop("f")


_expression("expr_arith", _pair("subtract", _pair("multiply", B0, CONST(2.0)), _pair("add", B1, CONST(3.0))), "a * 2 - (b + 3)")
_expression("expr_try_divide", _pair("divide", B0, _pair("subtract", B1, CONST(7.0))), "CASE WHEN b - 7 = 0 THEN NULL ELSE a / (b - 7) END")
_expression("expr_normalized_difference", _pair("normalized_difference"), "CASE WHEN greatest(abs(a), abs(b)) = 0 THEN NULL ELSE (a / greatest(abs(a), abs(b)) - b / greatest(abs(a), abs(b))) / nullif(a / greatest(abs(a), abs(b)) + b / greatest(abs(a), abs(b)), 0) END")
_expression("expr_valid", {"op": "valid", "input": B0}, "CASE WHEN a IS NULL THEN 0 ELSE 1 END")
_expression("expr_compare", _pair("add", _pair("greater", B0, CONST(1.5e7)), _pair("add", _pair("greater_equal", B1, CONST(500.0)), _pair("less", B0, CONST(2e7)))), "CASE WHEN a > 1.5e7 THEN 1 WHEN a IS NOT NULL THEN 0 END + (CASE WHEN b >= 500 THEN 1 ELSE 0 END + CASE WHEN a < 2e7 THEN 1 WHEN a IS NOT NULL THEN 0 END)")
_expression("expr_and_null", _pair("and", B0, _pair("less", B1, CONST(0.0))), "CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 0 END")
_expression("mask_filter", B0, "CASE WHEN b > 700 THEN a END", _pair("greater", B1, CONST(700.0)))


@query(sql(C_ORDERS, "m AS (SELECT c.slice_id, c.r, c.k, c.band, CASE WHEN g.v > 700 THEN c.v END AS v FROM c JOIN c g ON g.band = 1 AND g.r = c.r AND g.k = c.k)", Z, J.replace("FROM c JOIN", "FROM m JOIN"), STATS, select="SELECT zone_id, CAST(band AS INTEGER) AS band, s AS fractional_sum, cnt AS valid_cell_count FROM s"))
def mask_measure(spark, sf_dir):
    cells, grid = orders(spark, sf_dir)
    zones = boxes(spark, sf_dir)
    masked = zonal.derive(cells, None, _pair("greater", B1, CONST(700.0)))
    return zonal.measure(masked, coverage.select_cells(zones, grid), G.zone_facts(zones, grid)).where("intersecting_cell_count > 0").select("zone_id", "band", "fractional_sum", "valid_cell_count")


# --- histogram, weights, moments, categories and ranks -----------------------------------------------------------------

HIST = Options(bands=(0,), statistics=("histogram",), histogram_edges=(5.0, 10.0, 20.0, 21.0, 45.0))


@query(sql(C_PART, Z, J, "t AS (SELECT zone_id, b, coalesce(sum(CASE WHEN v >= lo AND (v < hi OR (b = 3 AND v = hi)) THEN f END), 0) AS mass FROM j, (VALUES (0, 5, 10), (1, 10, 20), (2, 20, 21), (3, 21, 45)) h(b, lo, hi) WHERE band = 0 GROUP BY ALL)", select="SELECT zone_id, CAST(b AS INTEGER) AS bin, CAST(mass AS DOUBLE) AS mass FROM t"))
def histogram_edges(spark, sf_dir):
    m = _measured(spark, sf_dir, HIST, part).where("intersecting_cell_count > 0")
    return m.select("zone_id", F.posexplode("histogram.counts").alias("bin", "mass"))


@query(sql(C_PART, Z, J, select="SELECT zone_id, CAST(coalesce(sum(CASE WHEN v < 5 THEN f END), 0) AS DOUBLE) AS underflow, CAST(coalesce(sum(CASE WHEN v > 45 THEN f END), 0) AS DOUBLE) AS overflow FROM j WHERE band = 0 GROUP BY ALL"))
def histogram_under_over(spark, sf_dir):
    m = _measured(spark, sf_dir, HIST, part).where("intersecting_cell_count > 0")
    return m.select("zone_id", "histogram.underflow", "histogram.overflow")


@query(sql(C_PART, Z, J, JW, select="SELECT zone_id, coalesce(sum(v * wv * f), 0) AS weighted_sum, coalesce(sum(CASE WHEN v IS NOT NULL THEN wv * f END), 0) AS weight_sum, sum(v * wv * f) / sum(CASE WHEN v IS NOT NULL THEN wv * f END) AS weighted_mean, coalesce(sum(CASE WHEN v IS NOT NULL AND wv IS NOT NULL THEN f END), 0) AS weighted_valid_cell_equivalents FROM jw WHERE band = 0 GROUP BY ALL"))
def weighted_sum_mean(spark, sf_dir):
    m = _measured(spark, sf_dir, Options(bands=(0,), statistics=("weighted_sum", "weight_sum", "weighted_mean"), weight_band=1), part)
    return m.where("intersecting_cell_count > 0").select("zone_id", "weighted_sum", "weight_sum", "weighted_mean", "weighted_valid_cell_equivalents")


def _moment(name: str, column: str, weighted: bool, root: bool):
    g = "f * wv" if weighted else "f"
    text = f"sum({g} * (v - m) * (v - m)) / sum({g})"
    text = f"sqrt({text})" if root else text

    @query(sql(C_PART, Z, J, JW, f"u AS (SELECT zone_id, sum(v * {g}) / sum({g}) AS m FROM jw WHERE band = 0 AND v IS NOT NULL AND {g} IS NOT NULL GROUP BY ALL)", select=f"SELECT zone_id, round({text}, 6) AS {column} FROM jw JOIN u USING (zone_id) WHERE band = 0 AND v IS NOT NULL AND {g} IS NOT NULL GROUP BY ALL"))
    def f(spark, sf_dir):
        o = Options(bands=(0,), statistics=(column,), weight_band=1 if weighted else None)
        return _measured(spark, sf_dir, o, part).where(f"{column} is not null").select("zone_id", F.round(column, 6).alias(column))

    QUERIES[name], ORACLE_SQL[name] = QUERIES.pop("f"), ORACLE_SQL.pop("f")


_moment("population_variance", "variance", False, False)
_moment("stddev", "stddev", False, True)
_moment("weighted_variance", "weighted_variance", True, False)
_moment("weighted_stddev", "weighted_stddev", True, True)

DOMAIN = tuple(float(v) for v in range(1, 51))
CATS = Options(bands=(0,), statistics=("categories", "majority", "variety"), category_values=DOMAIN)
MASS = "m AS (SELECT zone_id, v, sum(f) AS mass FROM j WHERE band = 0 AND v IS NOT NULL GROUP BY ALL)"


@query(sql(C_PART, Z, J, MASS, "d AS (SELECT zone_id, CAST(v AS DOUBLE) AS v FROM (SELECT DISTINCT zone_id FROM m), range(1, 51) t(v))", select="SELECT zone_id, v AS value, CAST(coalesce(mass, 0) AS DOUBLE) AS mass FROM d LEFT JOIN m USING (zone_id, v)"))
def categories(spark, sf_dir):
    m = _measured(spark, sf_dir, CATS, part).where("intersecting_cell_count > 0")
    return m.select("zone_id", F.explode("categories").alias("c")).select("zone_id", "c.value", "c.mass")


@query(sql(C_PART, Z, J, MASS, select="SELECT zone_id, v AS majority FROM (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY mass DESC, v) AS k FROM m) WHERE k = 1"))
def majority_tiebreak(spark, sf_dir):
    return _measured(spark, sf_dir, CATS, part).where("intersecting_cell_count > 0").select("zone_id", "majority")


@query(sql(C_PART, Z, J, MASS, select="SELECT zone_id, count(*) AS variety FROM m WHERE mass > 0 GROUP BY ALL"))
def variety(spark, sf_dir):
    return _measured(spark, sf_dir, CATS, part).where("intersecting_cell_count > 0").select("zone_id", "variety")


def _rank(name: str, weighted: bool, median: bool):
    g = "f * wv" if weighted else "f"
    ps = (0.5,) if median else (0.0, 0.1, 0.5, 0.9, 1.0)
    p = "weighted_" if weighted else ""
    mass = f"m AS (SELECT zone_id, v, sum({g}) AS mass FROM jw WHERE band = 0 AND v IS NOT NULL AND {g} > 0 GROUP BY ALL)"
    cum = "u AS (SELECT *, sum(mass) OVER (PARTITION BY zone_id ORDER BY v) AS cum, sum(mass) OVER (PARTITION BY zone_id) AS total FROM m)"
    values = ", ".join(f"({i}, {q})" for i, q in enumerate(ps))

    @query(sql(C_PART, Z, J, JW, mass, cum, select=f"SELECT zone_id, CAST(i AS INTEGER) AS i, min(CASE WHEN cum >= total * CAST(p AS DOUBLE) THEN v END) AS value FROM u, (VALUES {values}) q(i, p) GROUP BY ALL"))
    def f(spark, sf_dir):
        stat = f"{p}median" if median else f"{p}quantiles"
        o = Options(bands=(0,), statistics=(stat,), weight_band=1 if weighted else None, quantiles=None if median else ps)
        m = _measured(spark, sf_dir, o, part).where(f"{stat} is not null")
        return m.select("zone_id", F.lit(0).alias("i"), F.col(stat).alias("value")) if median else m.select("zone_id", F.posexplode(stat).alias("i", "value"))

    QUERIES[name], ORACLE_SQL[name] = QUERIES.pop("f"), ORACLE_SQL.pop("f")


_rank("median_invcdf", False, True)
_rank("quantiles_invcdf", False, False)
_rank("weighted_median", True, True)
_rank("weighted_quantiles", True, False)


@query(sql(C_PART, Z, J, MASS, "u AS (SELECT *, sum(mass) OVER (PARTITION BY zone_id ORDER BY v) AS cum, sum(mass) OVER (PARTITION BY zone_id) AS total FROM m)", select="SELECT zone_id, min(CASE WHEN cum >= total * 0.5::DOUBLE THEN v END) AS median FROM u GROUP BY ALL"))
def exact_rank_statistics(spark, sf_dir):
    """Ranks by rational arithmetic."""
    j = _joined(spark, sf_dir, part).where("band = 0")
    return reducers.exact_statistics(j, ["zone_id"]).select("zone_id", F.element_at("quantiles", 1).alias("median"))


# --- batch jobs ----------------------------------------------------------------------------------------------------------


@query(sql(C_EVENTS, Z, J, AREA, STATS, FULL, select=f"SELECT slice_id, zone_id, CAST(band AS INTEGER) AS band, s AS fractional_sum, cnt AS valid_cell_count, lo AS min, hi AS max, {STATUS} AS status FROM full_"))
def batch_zone_slice(spark, sf_dir):
    """All slices in one plan: the selection is joined once with the cells of every slice."""
    return _measured(spark, sf_dir, None, events).select("slice_id", "zone_id", "band", "fractional_sum", "valid_cell_count", "min", "max", "status")


def _job(spark, sf_dir, mode: str = "full") -> Job:
    cells, grid = orders(spark, sf_dir)
    cells = cells.where("band = 0")
    names = ("hole", "multi", "outside", "triangle", "wedge")
    spec = {"zones": [{"id": n, "version": "1", "geometry": shape(n)} for n in names], "slices": [{"id": "a", "source": "a"}, {"id": "b", "source": "b"}], "crs": "LOCAL", "tile_edge": 64, "output_mode": mode}
    if mode == "numeric":
        spec["options"] = {"statistics": ["sum", "support", "mean", "min", "max", "count"]}

    def opened(s):
        shift = cells if s["id"] == "a" else cells.withColumn("value", F.col("value") + 1)
        return Source(grid, shift, s["id"], 1)

    return Job(spark, spec, opened)


SHAPE_F = _edge_sql(*SHAPES, high=12, wide=40).replace("WITH e", "e", 1).replace("SELECT zone_id, CAST(r AS INTEGER)", "sel AS (SELECT zone_id, CAST(r AS INTEGER)").rstrip() + ")"
SHAPE_F = SHAPE_F.replace("FROM q GROUP BY ALL)\nsel", "FROM q GROUP BY ALL),\nsel")
NAMES = ", ".join(f"('{n}', {i})" for i, n in enumerate(("hole", "multi", "outside", "triangle", "wedge")))
JOB_SQL = (C_ORDERS, SHAPE_F, f"names(zone_id, no) AS (VALUES {NAMES})", "cells AS (SELECT t.sl, t.no AS slice_no, r, k, v + t.no AS v FROM c, (VALUES ('a', 0), ('b', 1)) t(sl, no) WHERE band = 0)", "agg AS (SELECT sl, slice_no, zone_id, sum(v * fraction) AS s, sum(CASE WHEN v IS NOT NULL THEN fraction END) AS n, count(v) AS cnt, min(v) AS lo, max(v) AS hi FROM cells JOIN sel ON cells.r = sel.row AND cells.k = sel.col GROUP BY ALL)", "out_ AS (SELECT p.sl AS slice_id, n2.zone_id, p.no * 5 + n2.no AS row_no, coalesce(s, 0) AS s, coalesce(n, 0) AS n, coalesce(cnt, 0) AS cnt, lo, hi FROM (VALUES ('a', 0), ('b', 1)) p(sl, no) CROSS JOIN names n2 LEFT JOIN agg ON agg.sl = p.sl AND agg.zone_id = n2.zone_id)")


@query(sql(*JOB_SQL, select="SELECT slice_id, zone_id, CAST(row_no AS BIGINT) AS row_no, CAST(s AS DOUBLE) AS fractional_sum, CAST(n AS DOUBLE) AS covered_cell_equivalents, cnt AS valid_cell_count, s / nullif(n, 0) AS coverage_weighted_mean, lo AS min, hi AS max FROM out_"))
def batch_numeric_six(spark, sf_dir):
    return _job(spark, sf_dir, "numeric").results().select("slice_id", "zone_id", "row_no", "fractional_sum", "covered_cell_equivalents", "valid_cell_count", "coverage_weighted_mean", "min", "max")


@query(sql(*JOB_SQL, select="SELECT slice_id, zone_id, CAST(row_no AS BIGINT) AS row_no, CAST(s AS DOUBLE) AS fractional_sum FROM out_ WHERE row_no BETWEEN 3 AND 6"))
def batch_page(spark, sf_dir):
    """A page that spans two slices, as a range of row numbers."""
    return _job(spark, sf_dir).results().where("row_no between 3 and 6").select("slice_id", "zone_id", "row_no", "fractional_sum")


# --- summaries -----------------------------------------------------------------------------------------------------------


@query(sql(C_ORDERS, select="SELECT CAST(band AS INTEGER) AS band, CAST(r AS INTEGER) AS row, CAST(k // 64 AS BIGINT) AS block, coalesce(sum(v), 0) AS fractional_sum, count(v) AS valid_cell_count, min(v) AS min, max(v) AS max FROM c GROUP BY ALL"))
def row_blocks_sum(spark, sf_dir):
    return summaries.row_blocks(orders(spark, sf_dir)[0]).select("band", "row", F.col("block").cast("long").alias("block"), "fractional_sum", "valid_cell_count", "min", "max")


@query(sql(C_ORDERS, select="SELECT CAST(l.level AS INTEGER) AS level, CAST(band AS INTEGER) AS band, CAST(r // l.edge AS BIGINT) AS ty, CAST(k // l.edge AS BIGINT) AS tx, coalesce(sum(v), 0) AS fractional_sum, count(v) AS valid_cell_count, min(v) AS min, max(v) AS max FROM c, (VALUES (0, 16), (1, 32), (2, 64)) l(level, edge) GROUP BY ALL"))
def summary_pyramid_level(spark, sf_dir):
    p = summaries.pyramid(orders(spark, sf_dir)[0], 16, 2)
    return p.select("level", "band", F.col("ty").cast("long").alias("ty"), F.col("tx").cast("long").alias("tx"), "fractional_sum", "valid_cell_count", "min", "max")


_indexes: dict[tuple[str, str], str] = {}


def warded(spark, sf_dir) -> DataFrame:
    """The summary table of the orders: written by the first query of an application that needs it, then read."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _indexes:
        path = f"{shared(spark)}/orders-{uuid.uuid4().hex}"
        summaries.ward(orders(spark, sf_dir)[0], path, 16, 1)
        _indexes[key] = path
    return summaries.open_index(spark, _indexes[key])[0]


@query(sql(*BASE, select=f"SELECT zone_id, CAST(band AS INTEGER) AS band, s AS fractional_sum, n AS covered_cell_equivalents, cnt AS valid_cell_count, lo AS min, hi AS max, {STATUS} AS status FROM full_"))
def summary_rewrite_equals_direct(spark, sf_dir):
    cells, grid = orders(spark, sf_dir)
    zones = boxes(spark, sf_dir)
    m = summaries.measure_with(warded(spark, sf_dir), cells, coverage.select_cells(zones, grid), G.zone_facts(zones, grid), grid, 16, 1, slices=_slices(spark, orders))
    return m.select("zone_id", "band", "fractional_sum", "covered_cell_equivalents", "valid_cell_count", "min", "max", "status")


@query(sql(C_ORDERS, Z, J, STATS, select="SELECT zone_id, CAST(band AS INTEGER) AS band, s AS fractional_sum, n AS covered_cell_equivalents FROM s"))
def row_prefix_range(spark, sf_dir):
    cells, grid = orders(spark, sf_dir)
    return summaries.measure_by_prefix(cells, coverage.select_cells(boxes(spark, sf_dir), grid)).select("zone_id", "band", "fractional_sum", "covered_cell_equivalents")


@query(sql(C_ORDERS, SHAPE_F, select="SELECT zone_id, CAST(band AS INTEGER) AS band, CAST(coalesce(sum(v * fraction), 0) AS DOUBLE) AS fractional_sum, CAST(coalesce(sum(CASE WHEN v IS NOT NULL THEN fraction END), 0) AS DOUBLE) AS covered_cell_equivalents FROM c JOIN sel ON c.r = sel.row AND c.k = sel.col GROUP BY ALL"))
def cumulative_edge_sum(spark, sf_dir):
    cells, grid = orders(spark, sf_dir)
    edges = G.edges_of(shapes(spark), grid)
    return cumulative.edge_sums(cells, edges, grid).where("zone_id <> 'outside'").select("zone_id", "band", "fractional_sum", "covered_cell_equivalents")


# --- ordered policies ----------------------------------------------------------------------------------------------------


@query("SELECT c_nationkey AS polygon_id, sum(CASE WHEN v >= 0 AND v <> 4200 THEN v END) AS sum, count(*) FILTER (v >= 0 AND v <> 4200) AS valid_count FROM (SELECT c_nationkey, round(CAST(c_acctbal AS DOUBLE) * 100) AS v FROM customer) GROUP BY ALL")
def ordered_left_fold(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    rows = c.select(F.col("c_nationkey").alias("polygon_id"), F.expr("cast(c_custkey div 64 as int)").alias("window_no"), F.col("c_custkey").cast("long").alias("pos"), F.round(F.col("c_acctbal").cast("double") * 100).alias("value"))
    return ordered.ordered_sums(rows, ["polygon_id"], 4200.0).select("polygon_id", "sum", "valid_count")


@query("SELECT c_nationkey AS polygon_id, count(*) FILTER (v < 0) AS excluded_negative, count(*) FILTER (v BETWEEN 0 AND 100000 AND v = 4200) AS excluded_nodata, CAST(0 AS BIGINT) AS excluded_nonfinite FROM (SELECT c_nationkey, round(CAST(c_acctbal AS DOUBLE) * 100) AS v FROM customer) GROUP BY ALL")
def ordered_exclusion_counters(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    rows = c.select(F.col("c_nationkey").alias("polygon_id"), F.expr("cast(c_custkey div 64 as int)").alias("window_no"), F.col("c_custkey").cast("long").alias("pos"), F.round(F.col("c_acctbal").cast("double") * 100).alias("value"))
    return ordered.ordered_sums(rows, ["polygon_id"], 4200.0).select("polygon_id", "excluded_negative", "excluded_nodata", "excluded_nonfinite")


BULK = "b AS (SELECT CASE WHEN p_size % 2 = 0 THEN 'even' ELSE 'odd' END AS band_id, p_partkey AS idx, round(CAST(p_retailprice AS DOUBLE) * 100) AS v, p_partkey % 7 <> 0 AS mask FROM part)"


def _bulk(spark, sf_dir) -> DataFrame:
    t = _table(spark, sf_dir, "part")
    return t.select(F.expr("case when p_size % 2 = 0 then 'even' else 'odd' end").alias("band_id"), F.lit(0).alias("window_no"), F.col("p_partkey").cast("long").alias("idx"), F.round(F.col("p_retailprice").cast("double") * 100).alias("value"), F.expr("p_partkey % 7 <> 0").alias("mask"))


@query(sql(BULK, select="SELECT band_id, sum(v) AS sum, min(v) AS min, max(v) AS max, sum(v) / count(v) AS mean, count(v) AS valid_count, n AS excluded_mask FROM b JOIN (SELECT band_id, count(*) FILTER (NOT mask) AS n FROM b GROUP BY ALL) USING (band_id) WHERE mask GROUP BY band_id, n"))
def bulk_strict(spark, sf_dir):
    return ordered.bulk_reduce(_bulk(spark, sf_dir)).select("band_id", "sum", "min", "max", "mean", "valid_count", "excluded_mask")


@query(sql(BULK, "s AS (SELECT unnest(range(0, 60)) AS idx UNION ALL SELECT unnest(range(40, 150)))", select="SELECT band_id, sum(v) AS sum, count(v) AS valid_count FROM b JOIN s USING (idx) WHERE mask GROUP BY ALL"))
def bulk_spans_repeat(spark, sf_dir):
    spans = spark.createDataFrame([(0, 0, 0, 60), (0, 1, 40, 110)], "window_no int, span_no long, start long, count long")
    return ordered.bulk_reduce(_bulk(spark, sf_dir), ordered.spans(spans)).select("band_id", "sum", "valid_count")


REQUEST = {"bands": [0], "polygons": [{"id": "p", "windows": [{"window": [2, 3, 10, 5], "indexes": [0, 4, 7, 31]}, {"window": [20, 1, 8, 4], "runs": [[0, 5], [9, 12]]}]}, {"id": "q", "windows": [{"window": [0, 0, 4, 4], "runs": [[2, 16]]}]}]}


@query("SELECT count(DISTINCT n_regionkey) AS polygon_count, count(*) AS window_count, CAST(sum(7 + n_nationkey % 3) AS BIGINT) AS selected_cells, CAST((max(n_nationkey) + 10 - min(n_nationkey)) * (2 * max(n_nationkey) + 5 - 2 * min(n_nationkey)) AS BIGINT) AS envelope_cells FROM nation")
def profile_request_facts(spark, sf_dir):
    """Facts of a request with a polygon for each region and a window for each nation."""
    polygons: dict = {}
    for r in _table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").collect():  # a request: 25 windows
        k = r["n_nationkey"]
        polygons.setdefault(r["n_regionkey"], []).append({"window": [k, 2 * k, 10, 5], "runs": [[k % 5, k % 5 + 4], [k % 5 + 9, k % 5 + 12 + k % 3]]})
    f = ordered.admit({"bands": [0], "polygons": [{"id": str(i), "windows": w} for i, w in polygons.items()]})
    return spark.createDataFrame([tuple(f[k] for k in ("polygon_count", "window_count", "selected_cells", "envelope_cells"))], "polygon_count long, window_count long, selected_cells long, envelope_cells long")


@query(sql(C_ORDERS, "s AS (SELECT * FROM (VALUES ('p', 2, 3, 10, 0, 1), ('p', 2, 3, 10, 4, 5), ('p', 2, 3, 10, 7, 8), ('p', 2, 3, 10, 31, 32), ('p', 20, 1, 8, 0, 5), ('p', 20, 1, 8, 9, 12), ('q', 0, 0, 4, 2, 16)) t(polygon_id, x, y, w, a, b))", "u AS (SELECT polygon_id, y + i // w AS r, x + i % w AS k FROM s, range(0, 64) t(i) WHERE i >= a AND i < b)", select="SELECT polygon_id, sum(v) AS sum, count(v) AS valid_count FROM u JOIN c USING (r, k) WHERE band = 1 GROUP BY ALL"))
def ordered_source_selection(spark, sf_dir):
    """Windows with indexes and runs over a source's raw samples."""
    cells, _ = orders(spark, sf_dir)
    rows = ordered.chosen(cells.where("band = 1").select("row", "col", "band", "value"), ordered.selection_rows(spark, REQUEST))
    return ordered.ordered_sums(rows, ["polygon_id"]).select("polygon_id", "sum", "valid_count")


@query(sql(C_ORDERS, select="""SELECT sha256('{"crs":"LOCAL","height":' || (max(r) + 1) || ',"transform":[0.0,1.0,0.0,0.0,0.0,-1.0],"width":100}') AS grid_id FROM c"""))
def grid_identity(spark, sf_dir):
    return spark.createDataFrame([(orders(spark, sf_dir)[1].identity(),)], "grid_id string")


# --- spherical mass, plans and snapshots -----------------------------------------------------------------------------------

LATITUDE = "60 - 100.0 * {0} / high"
SPHERE_SQL = f"""WITH c AS (SELECT p_partkey // 20 AS r, p_partkey % 20 AS k, CAST(p_size AS DOUBLE) AS v FROM part), h AS (SELECT max(r) + 1 AS high FROM c),
z AS (SELECT 'z' || i AS zone_id, 4.1 + i % 4 AS x0, 4.97 + i % 4 AS x1, 59.3137 - 12.1 * i AS y0, 55.2137 - 12.1 * i AS y1 FROM range(0, 8) t(i)),
j AS (SELECT zone_id, v, greatest(0, least(x1, 4 + 0.25 * (k + 1)) - greatest(x0, 4 + 0.25 * k)) / 0.25 * greatest(0, sin(radians(least(y0, {LATITUDE.format("r")}))) - sin(radians(greatest(y1, {LATITUDE.format("(r + 1)")}))))
  / (sin(radians({LATITUDE.format("r")})) - sin(radians({LATITUDE.format("(r + 1)")}))) AS f
  FROM c, h, z WHERE 4 + 0.25 * k < x1 AND 4 + 0.25 * (k + 1) > x0 AND {LATITUDE.format("r")} > y1 AND {LATITUDE.format("(r + 1)")} < y0),
s AS (SELECT zone_id, v, CASE WHEN f >= 1 - 1e-10 THEN 1 ELSE f END AS f FROM j)
SELECT zone_id, round(sum(v * f), 4) AS mass, round(sum(f), 6) AS covered, count(*) FILTER (f = 1) AS whole, count(*) FILTER (f < 1) AS boundary FROM s GROUP BY zone_id"""


@query(SPHERE_SQL)
def spherical_mass(spark, sf_dir):
    """Population of boxes by spherical area; the parts' rows span a hundred degrees, however many there are."""
    t = _table(spark, sf_dir, "part")
    cells = raster.from_table(t, "p_partkey", 20, [(F.col("p_size"), F.lit(True))], "part")
    rows = int(t.agg(F.max("p_partkey")).first()[0] // 20 + 1)
    grid = Grid(20, rows, (4.0, 0.25, 0.0, 60.0, 0.0, -100.0 / rows), "EPSG:4326")
    box = lambda x, y, w, h: f'{{"type":"Polygon","coordinates":[[[{x},{y}],[{x + w},{y}],[{x + w},{y + h}],[{x},{y + h}],[{x},{y}]]]}}'
    zones = spark.createDataFrame([(f"z{k}", box(4.1 + k % 4, 55.2137 - 12.1 * k, 0.87, 4.1)) for k in range(8)], "zone_id string, geometry string")
    m = spherical.spherical_mass(cells, zones, grid).where("coveredPixelEquivalent > 0")
    return m.select("zone_id", F.round("mass", 4).alias("mass"), F.round("coveredPixelEquivalent", 6).alias("covered"), F.col("fullPixelCount").alias("whole"), F.col("boundaryPixelCount").alias("boundary"))


T32 = "t AS (SELECT zone_id, r // 16 AS ty, k // 16 AS tx, count(*) FILTER (f = 1) AS full_ FROM j WHERE band = 1 GROUP BY ALL), h AS (SELECT max(r) + 1 AS high FROM c), w AS (SELECT zone_id, ty, tx, full_ = least(16, high - ty * 16) * least(16, 100 - tx * 16) AS whole FROM t, h), u AS (SELECT zone_id, ty // 2 AS ty, tx // 2 AS tx FROM w WHERE whole GROUP BY ALL HAVING count(*) = 4)"


@query(sql(C_ORDERS, Z, J, T32, select="SELECT zone_id, CAST(0 AS INTEGER) AS level, CAST(ty AS BIGINT) AS ty, CAST(tx AS BIGINT) AS tx FROM w WHERE whole AND NOT EXISTS (SELECT 1 FROM u WHERE u.zone_id = w.zone_id AND u.ty = w.ty // 2 AND u.tx = w.tx // 2) UNION ALL SELECT zone_id, 1, CAST(ty AS BIGINT), CAST(tx AS BIGINT) FROM u"))
def summary_cover_nodes(spark, sf_dir):
    """The fewest whole nodes of each zone, over two levels of tiles."""
    _, grid = orders(spark, sf_dir)
    nodes = summaries.cover(coverage.tile_cover(coverage.select_cells(boxes(spark, sf_dir), grid), grid, 16), 1)
    return nodes.select("zone_id", "level", F.col("ty").cast("long").alias("ty"), F.col("tx").cast("long").alias("tx"))


@query(sql(C_ORDERS, Z, J, T32, select="SELECT w.zone_id, count(*) FILTER (whole AND u.ty IS NULL) + (SELECT count(*) FROM u v WHERE v.zone_id = w.zone_id) AS summaries, count(*) FILTER (NOT whole) AS raw FROM w LEFT JOIN u ON u.zone_id = w.zone_id AND u.ty = w.ty // 2 AND u.tx = w.tx // 2 AND w.whole GROUP BY w.zone_id"))
def joint_plan(spark, sf_dir):
    """The cheapest cover of each zone's tiles without latency: whole nodes from summaries, as high as they go, and raw tiles."""
    _, grid = orders(spark, sf_dir)
    tiles = coverage.tile_cover(coverage.select_cells(boxes(spark, sf_dir), grid), grid, 16)
    by_zone: dict = {}
    for r in tiles.collect():  # an optimizer's input: a zone has at most 4096 nodes
        by_zone.setdefault(r["zone_id"], []).append((r["ty"], r["tx"], r["cells"], r["whole"]))
    rows = []
    for z, t in by_zone.items():
        nodes, roots = cover.forest(t, 1, 40, 4096, -(-grid.width // 16))
        kinds = [how for root in roots for _, how in cover.plan(nodes, [root], cover.Cost(latency_ns=0.0))["cover"]]
        rows.append((z, kinds.count("summary"), kinds.count("raw")))
    return spark.createDataFrame(rows, "zone_id string, summaries long, raw long")


@query("SELECT count(*) AS cells, CAST(sum(p_size) AS DOUBLE) AS total, CAST(0 AS BIGINT) AS bad_tiles FROM part")
def snapshot_verify(spark, sf_dir):
    """Write a snapshot, read it back and verify it."""
    t = _table(spark, sf_dir, "part")
    raw = t.select(F.expr("cast(p_partkey div 50 as int)").alias("row"), F.expr("cast(p_partkey % 50 as int)").alias("col"), F.lit(0).alias("band"), F.col("p_size").cast("double").alias("sample"), F.lit(255).alias("mask"))
    path = f"{shared(spark)}/snapshot-{uuid.uuid4().hex}"
    snapshot.compile_snapshot(raw, path, _grid(t, "p_partkey", 50), 64)
    bad = snapshot.verify_snapshot(spark, path)
    _, samples, _ = snapshot.open_snapshot(spark, path)
    return samples.agg(F.count(F.lit(1)).alias("cells"), F.sum("sample").alias("total")).crossJoin(bad.agg(F.count(F.lit(1)).alias("bad_tiles")))  # a row each


def shared(spark: SparkSession) -> str:
    """The folder for tables that a query writes: the session's checkpoint folder, or on one machine a temporary one."""
    sc = spark.sparkContext
    folder = sc._jsc.sc().getCheckpointDir()
    if not folder.isEmpty():
        return folder.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp())
    return sc._jsc.sc().getCheckpointDir().get()
