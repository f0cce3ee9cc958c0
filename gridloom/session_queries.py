"""Registered queries that go through sessions, indexes, jobs and streams, and those over values on which plain doubles lose."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import queries as Q
from gridloom.functions import numerics
from gridloom.model import Options
from gridloom.operators import coverage, cumulative, summaries, zonal
from gridloom.operators import geometry as G
from gridloom.plans.batch import Job, fingerprint
from gridloom.plans.batch import Source as JobSource
from gridloom.session import Session, Source
from gridloom.sources import raster
from gridloom.streaming.slices import stream_measure

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
BASE, C_ORDERS, C_PART, Z, J, AREA, STATS, FULL, STATUS, sql = Q.BASE, Q.C_ORDERS, Q.C_PART, Q.Z, Q.J, Q.AREA, Q.STATS, Q.FULL, Q.STATUS, Q.sql


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, oracle
        return f

    return add


# --- values that cancel: whole numbers in SQL, where nothing is rounded -------------------------------------------------------

CANCEL = "c AS (SELECT 'orders' AS slice_id, o_orderkey // 100 AS r, o_orderkey % 100 AS k, 0 AS band, CAST([10000000000000000, 1, -10000000000000000, -2][1 + o_orderkey % 4] AS HUGEINT) AS v FROM orders)"
JH = J.replace("SELECT slice_id", "SELECT CAST(16 * " + Q.SHARE + " AS HUGEINT) AS f16, slice_id", 1)


def cancelling(spark, sf_dir) -> tuple[DataFrame, Q.Grid]:
    cells, grid = Q.orders(spark, sf_dir)
    v = F.element_at(F.array(F.lit(1e16), F.lit(1.0), F.lit(-1e16), F.lit(-2.0)), (1 + (F.col("row") * Q.WIDE + F.col("col")) % 4).cast("int"))
    return cells.where("band = 0").withColumn("value", v).withColumn("valid", F.lit(True)), grid


def _cancelled(measure):
    def run(spark, sf_dir):
        cells, grid = cancelling(spark, sf_dir)
        zones = Q.boxes(spark, sf_dir)
        return measure(cells, grid, zones, coverage.select_cells(zones, grid)).select("zone_id", "fractional_sum", "covered_cell_equivalents")

    return run


CANCELLED = sql(CANCEL, Z, JH, select="SELECT zone_id, CAST(sum(v * f16) AS DOUBLE) / 16 AS fractional_sum, CAST(sum(f16) AS DOUBLE) / 16 AS covered_cell_equivalents FROM j GROUP BY zone_id")


@query(CANCELLED)
def cancelling_sum(spark, sf_dir):
    return _cancelled(lambda c, g, z, s: zonal.measure(c, s, G.zone_facts(z, g)).where("intersecting_cell_count > 0"))(spark, sf_dir)


@query(CANCELLED)
def cancelling_sum_repartitioned(spark, sf_dir):
    """The same sums from cells that are dealt otherwise."""
    return _cancelled(lambda c, g, z, s: zonal.measure(c.repartition(7, "col"), s, G.zone_facts(z, g)).where("intersecting_cell_count > 0"))(spark, sf_dir)


@query(CANCELLED)
def cancelling_prefix(spark, sf_dir):
    return _cancelled(lambda c, g, z, s: summaries.measure_by_prefix(c, s))(spark, sf_dir)


@query(CANCELLED)
def cancelling_edges(spark, sf_dir):
    return _cancelled(lambda c, g, z, s: cumulative.edge_sums(c, G.edges_of(z, g), g).where("covered_cell_equivalents > 0"))(spark, sf_dir)


@query(CANCELLED)
def cancelling_summary(spark, sf_dir):
    return _cancelled(lambda c, g, z, s: summaries.measure_with(summaries.pyramid(c, 16, 1), c, s, G.zone_facts(z, g), g, 16, 1).where("intersecting_cell_count > 0"))(spark, sf_dir)


@query(CANCELLED)
def cancelling_row_blocks(spark, sf_dir):
    return _cancelled(lambda c, g, z, s: summaries.measure_with_blocks(summaries.row_blocks(c, 16), c, s, G.zone_facts(z, g), 16).where("intersecting_cell_count > 0"))(spark, sf_dir)


@query(sql(CANCEL, select="SELECT CAST(l.level AS INTEGER) AS level, CAST(r // l.edge AS BIGINT) AS ty, CAST(k // l.edge AS BIGINT) AS tx, CAST(sum(v) AS DOUBLE) AS fractional_sum, count(v) AS valid_cell_count FROM c, (VALUES (0, 16), (1, 32), (2, 64)) l(level, edge) GROUP BY ALL"))
def cancelling_pyramid(spark, sf_dir):
    p = summaries.pyramid(cancelling(spark, sf_dir)[0], 16, 2)
    return p.select("level", F.col("ty").cast("long").alias("ty"), F.col("tx").cast("long").alias("tx"), "fractional_sum", "valid_cell_count")


@query(sql(CANCEL, Z, JH, "p AS (SELECT zone_id, abs(v) AS v, v < 0 AS low, f16 FROM j WHERE abs(v) < 10)", select="SELECT zone_id, CAST(sum(CASE WHEN low THEN -v ELSE v END * f16) AS DOUBLE) / CAST(sum(f16) AS DOUBLE) AS mean FROM p GROUP BY zone_id"))
def exact_mean(spark, sf_dir):
    cells, grid = cancelling(spark, sf_dir)
    zones = Q.boxes(spark, sf_dir)
    small = cells.withColumn("valid", F.abs("value") < 10)
    m = zonal.measure(small, coverage.select_cells(zones, grid), G.zone_facts(zones, grid)).where("valid_cell_count > 0")
    return m.select("zone_id", F.col("coverage_weighted_mean").alias("mean"))


OFFSET = "c AS (SELECT 'part' AS slice_id, p_partkey // 50 AS r, p_partkey % 50 AS k, 0 AS band, CAST(1000000000000 + p_size AS HUGEINT) AS v FROM part)"
POWERS = "m AS (SELECT zone_id, sum(f16) AS g, sum(f16 * v) AS gv, sum(f16 * v * v) AS gvv FROM j GROUP BY zone_id)"


def _spread(change):
    def run(spark, sf_dir):
        cells, grid = Q.part(spark, sf_dir)
        zones = Q.boxes(spark, sf_dir)
        cells = cells.where("band = 0").withColumn("value", change(F.col("value")))
        return zonal.measure(cells, coverage.select_cells(zones, grid), G.zone_facts(zones, grid), Options(statistics=("variance", "stddev"))).where("variance is not null")

    return run


@query(sql(OFFSET, Z, JH, POWERS, select="SELECT zone_id, round(CAST(g * gvv - gv * gv AS DOUBLE) / CAST(g * g AS DOUBLE), 9) AS variance FROM m"))
def variance_of_large_offsets(spark, sf_dir):
    """A trillion is added to every value: squares need more digits than a double has."""
    return _spread(lambda v: v + 1e12)(spark, sf_dir).select("zone_id", F.round("variance", 9).alias("variance"))


@query(sql(OFFSET.replace("1000000000000 + p_size", "p_size"), Z, JH, POWERS, select="SELECT zone_id, round(sqrt(CAST(g * gvv - gv * gv AS DOUBLE)) / CAST(g AS DOUBLE), 9) AS stddev FROM m"))
def stddev_of_tiny_values(spark, sf_dir):
    """Values of some 1e-200, whose squares are below every double."""
    return _spread(lambda v: v * 1e-200)(spark, sf_dir).select("zone_id", F.round(F.col("stddev") * 1e100 * 1e100, 9).alias("stddev"))


TIES = "c AS (SELECT 'part' AS slice_id, p_partkey // 50 AS r, p_partkey % 50 AS k, 0 AS band, p_size % 3 AS v FROM part)"


@query(sql(TIES, Z, JH, "m AS (SELECT zone_id, v, sum(f16) AS mass FROM j GROUP BY ALL)", select="SELECT zone_id, CAST(v AS DOUBLE) AS majority FROM m QUALIFY row_number() OVER (PARTITION BY zone_id ORDER BY mass DESC, v) = 1"))
def majority_of_exact_masses(spark, sf_dir):
    cells, grid = Q.part(spark, sf_dir)
    zones = Q.boxes(spark, sf_dir)
    cells = cells.where("band = 0").withColumn("value", F.col("value") % 3)
    o = Options(statistics=("majority",), category_values=(0.0, 1.0, 2.0))
    return zonal.measure(cells, coverage.select_cells(zones, grid), G.zone_facts(zones, grid), o).where("majority is not null").select("zone_id", "majority")


# --- coverage in windows and classes of tiles -----------------------------------------------------------------------------------


@query(sql(C_ORDERS, Z, J, select="SELECT zone_id, CAST(r AS INTEGER) AS row, CAST(k AS INTEGER) AS col, f AS fraction FROM j WHERE band = 1 AND k >= 20 AND k < 60 AND r >= 4 AND r < 90"))
def coverage_window(spark, sf_dir):
    _, grid = Q.orders(spark, sf_dir)
    return coverage.cells_of(coverage.select_cells(Q.boxes(spark, sf_dir), grid, window=(20, 4, 40, 86)))


@query(sql(C_ORDERS, Z, "h AS (SELECT max(r) + 1 AS high FROM c)", "t AS (SELECT zone_id, y AS ty, x AS tx, x0 < x * 16 AND x1 > least(x * 16 + 16, 100) AND y0 < y * 16 AND y1 > least(y * 16 + 16, high) AS inside FROM z, h, range(0, 7) a(x), range(0, 5000) b(y) WHERE x * 16 < least(x1, 100) AND (x + 1) * 16 > x0 AND y * 16 < least(y1, high) AND (y + 1) * 16 > y0)", select="SELECT zone_id, ty, tx, CASE WHEN inside THEN 'inside' ELSE 'boundary' END AS class FROM t"))
def tile_classes(spark, sf_dir):
    """Rectangles against polygons, before any cell is looked at."""
    _, grid = Q.orders(spark, sf_dir)
    return G.tile_classes(Q.boxes(spark, sf_dir), grid, 16)


# --- sessions ---------------------------------------------------------------------------------------------------------------------

BOX = {"type": "Polygon", "coordinates": [[[3.25, -2.5], [41.75, -2.5], [41.75, -17.25], [3.25, -17.25], [3.25, -2.5]]]}
ONE = "z AS (SELECT 'zone' AS zone_id, 3.25::DOUBLE AS x0, 41.75::DOUBLE AS x1, 2.5::DOUBLE AS y0, 17.25::DOUBLE AS y1)"
ONE_BASE = (C_ORDERS, ONE, J, AREA, STATS, FULL)
RESULT = f"SELECT CAST(band AS INTEGER) AS band, s AS fractional_sum, n AS covered_cell_equivalents, cnt AS valid_cell_count, lo AS min, hi AS max, {STATUS} AS status FROM full_"
COLUMNS = ("band", "fractional_sum", "covered_cell_equivalents", "valid_cell_count", "min", "max", "status")


def registered(spark, sf_dir, name: str = "orders", **more) -> Source:
    cells, grid = Q.orders(spark, sf_dir)
    s = Session(spark)
    return s._add(Source(s, name, grid, cells.withColumn("slice_id", F.lit(name)), f"orders of {sf_dir}", 2, **more))


@query(sql(*ONE_BASE, select=RESULT))
def session_carve(spark, sf_dir):
    return registered(spark, sf_dir).carve(BOX).select(*COLUMNS)


@query(sql(*ONE_BASE, select=RESULT))
def session_retained_index(spark, sf_dir):
    """Whole tiles come from a table that was written, opened again and found to be of this source."""
    s = registered(spark, sf_dir)
    path = f"{Q.shared(spark)}/index-{uuid.uuid4().hex}"
    s.ward(path, edge=16, levels=2).close_index()
    s.session.register_index(s, path, id="i")
    return s.carve(BOX).select(*COLUMNS)


def _prepared(kind: str):
    def f(spark, sf_dir):
        s = registered(spark, sf_dir).prepare(kind)
        if kind.startswith("cumulative"):
            return s.carve(BOX, backend=kind, metrics=["sum", "support", "mean"]).select("band", "fractional_sum", "covered_cell_equivalents", "coverage_weighted_mean")
        return s.carve(BOX, backend=kind).select(*COLUMNS)

    f.__name__ = f"session_{kind}"
    text = RESULT if not kind.startswith("cumulative") else "SELECT CAST(band AS INTEGER) AS band, s AS fractional_sum, n AS covered_cell_equivalents, s / n AS coverage_weighted_mean FROM full_"
    query(sql(*ONE_BASE, select=text))(f)


for _kind in ("row_blocks", "hierarchy", "cumulative_full"):
    _prepared(_kind)


@query(sql(*ONE_BASE, select="SELECT CAST(1 - band AS INTEGER) AS band, s AS fractional_sum FROM full_"))
def session_band_mapping(spark, sf_dir):
    """Bands are exposed in another order."""
    s = registered(spark, sf_dir)
    return s.session._mapped(s, [1, 0]).carve(BOX, metrics=["sum"]).select("band", "fractional_sum")


@query(sql(*ONE_BASE, select="SELECT CAST(band AS INTEGER) AS band, hi AS max, cnt AS valid_cell_count FROM full_"))
def session_statistic_projection(spark, sf_dir):
    got = registered(spark, sf_dir).carve(BOX, metrics=["max", "count"], bands=[1, 0])
    return got.select("band", *(c for c in got.columns if c in ("fractional_sum", "min", "max", "valid_cell_count", "coverage_weighted_mean")))


@query(sql(*ONE_BASE, select="SELECT 'a' AS source, CAST(band AS INTEGER) AS band, s AS fractional_sum FROM full_ UNION ALL SELECT 'b', CAST(band AS INTEGER), s + n FROM full_"))
def session_plan_reuse(spark, sf_dir):
    """A plan is compiled once and used with two sources on one grid."""
    a = registered(spark, sf_dir, "a")
    s = a.session
    b = s._add(Source(s, "b", a.grid, a.cells.withColumn("value", F.col("value") + 1), "b", 2))
    s.compile_polygon(BOX, source=a, id="p")
    return s.measure(source=a, plan="p").select(F.lit("a").alias("source"), "band", "fractional_sum").unionByName(s.measure(source=b, plan="p").select(F.lit("b").alias("source"), "band", "fractional_sum"))


RAW_SQL = ("c AS (SELECT 'part' AS slice_id, p_partkey // 50 AS r, p_partkey % 50 AS k, 0 AS band, CASE WHEN p_size <> 7 THEN CAST(p_size AS DOUBLE) END AS v FROM part)", ONE, J, AREA, STATS, FULL)


def _raw(spark, sf_dir) -> tuple[DataFrame, Q.Grid]:
    t = Q._table(spark, sf_dir, "part")
    raw = t.select(F.expr("cast(p_partkey div 50 as int)").alias("row"), F.expr("cast(p_partkey % 50 as int)").alias("col"), F.lit(0).alias("band"), F.col("p_size").cast("double").alias("sample"), F.lit(255).alias("mask"))
    return raw, Q._grid(t, "p_partkey", 50)


@query(sql(*RAW_SQL, select="SELECT s AS fractional_sum, n AS covered_cell_equivalents, lo AS min, hi AS max, 'exactextract_rasterio_v030' AS numerical_policy FROM full_", wide=50))
def policy_unscaled_raw(spark, sf_dir):
    """The unscaled policy measures raw samples and compares NoData as a 32-bit number."""
    raw, grid = _raw(spark, sf_dir)
    s = Session(spark)
    src = s._add(Source(s, "part", grid, raster.normalized(raw, "part", 7.0), "part", 1, raw, {"nodata": 7.0}))
    got = src.carve(BOX, backend="exactextract", numerical_policy="exactextract_rasterio_v030")
    return got.select("fractional_sum", "covered_cell_equivalents", "min", "max", "numerical_policy")


@query(sql(*RAW_SQL, select="SELECT s AS fractional_sum, n AS covered_cell_equivalents, 'exactextract_fractional_v030' AS numerical_policy FROM full_", wide=50))
def policy_fractional(spark, sf_dir):
    raw, grid = _raw(spark, sf_dir)
    s = Session(spark)
    src = s._add(Source(s, "part", grid, raster.normalized(raw, "part", 7.0), "part", 1, raw, {"nodata": 7.0}))
    return src.carve(BOX, backend="exactextract").select("fractional_sum", "covered_cell_equivalents", "numerical_policy")


@query(sql(*RAW_SQL, select=f"SELECT s AS fractional_sum, n AS covered_cell_equivalents, cnt AS valid_cell_count, {STATUS} AS status FROM full_", wide=50))
def session_snapshot(spark, sf_dir):
    """A snapshot is written, opened by its location, and answers through its stored summary."""
    raw, grid = _raw(spark, sf_dir)
    s = Session(spark)
    path = f"{Q.shared(spark)}/snapshot-{uuid.uuid4().hex}"
    s._add(Source(s, "part", grid, raster.normalized(raw, "part", 7.0), "part", 1, raw, {"nodata": 7.0})).compile(path, edge=64)
    return s.infuse({"location": path}, id="again").carve(BOX).select("fractional_sum", "covered_cell_equivalents", "valid_cell_count", "status")


@query("SELECT CAST(p_partkey // 50 AS INTEGER) AS row, CAST(p_partkey % 50 AS INTEGER) AS col, CASE WHEN p_size = 7 THEN 0::DOUBLE ELSE p_size * 0.5::DOUBLE - 3 END AS value, p_size <> 7 AS valid FROM part")
def raw_normalized(spark, sf_dir):
    return raster.normalized(_raw(spark, sf_dir)[0], "part", 7.0, 0.5, -3.0).select("row", "col", "value", "valid")


@query("SELECT CAST(p_partkey // 50 AS INTEGER) AS row, CAST(p_partkey % 50 AS INTEGER) AS col, CAST(p_size AS DOUBLE) AS value FROM part")
def tiles_round_trip(spark, sf_dir):
    """Cells are gathered to dense tiles and taken apart again."""
    cells = Q.part(spark, sf_dir)[0].where("band = 0")
    return raster.explode_tiles(raster.to_tiles(cells, 32)).select("row", "col", "value")


@query(sql(C_ORDERS, select="SELECT CAST(band AS INTEGER) AS band, CAST(r // 16 AS BIGINT) AS ty, CAST(k // 16 AS BIGINT) AS tx FROM c WHERE (r // 16) % 3 = 0 GROUP BY ALL HAVING count(v) > 0"))
def summary_bad_states(spark, sf_dir):
    """States that cannot be are found: every third row of tiles is given a least value above its greatest."""
    cells, grid = Q.orders(spark, sf_dir)
    table = summaries.leaves(cells, 16).withColumn("min", F.when(F.col("ty") % 3 == 0, F.col("max") + 1).otherwise(F.col("min")))
    return summaries.check_states(table, grid, 16).select("band", F.col("ty").cast("long").alias("ty"), F.col("tx").cast("long").alias("tx"))


# --- jobs and streams -------------------------------------------------------------------------------------------------------------

SPEC = {"zones": [{"id": f"b{i}", "version": "1", "geometry": {"type": "Polygon", "coordinates": [[[x, -2.5], [x + 20.5, -2.5], [x + 20.5, -30.25], [x, -30.25], [x, -2.5]]]}} for i, x in enumerate((1.25, 30.5, 70.75))], "slices": [{"id": "a", "source": "a"}, {"id": "b", "source": "b"}], "crs": "LOCAL"}
SPEC_Z = "z AS (SELECT 'b' || i AS zone_id, x::DOUBLE AS x0, x::DOUBLE + 20.5 AS x1, 2.5::DOUBLE AS y0, 30.25::DOUBLE AS y1, i FROM (VALUES (0, 1.25), (1, 30.5), (2, 70.75)) t(i, x))"
SPEC_C = "c AS (SELECT s AS slice_id, o_orderkey // 100 AS r, o_orderkey % 100 AS k, 0 AS band, CASE WHEN o_orderstatus <> 'P' THEN round(CAST(o_totalprice AS DOUBLE) * 100) + n END AS v FROM orders, (VALUES ('a', 0), ('b', 1)) t(s, n))"
SPEC_ROWS = "SELECT slice_id, zone_id, CAST(CASE slice_id WHEN 'b' THEN 3 ELSE 0 END + i AS BIGINT) AS row_no, sum(v * f) AS fractional_sum, sum(CASE WHEN v IS NOT NULL THEN f END) AS covered_cell_equivalents, count(v) AS valid_cell_count FROM j JOIN z USING (zone_id) GROUP BY ALL"
JOB_COLUMNS = ("slice_id", "zone_id", "row_no", "fractional_sum", "covered_cell_equivalents", "valid_cell_count")


def _job(spark, sf_dir, more: dict | None = None, checkpoint: dict | None = None) -> Job:
    cells, grid = Q.orders(spark, sf_dir)
    cells = cells.where("band = 0")
    held: dict = {}

    def opened(s):
        if s["id"] not in held:
            shift = cells if s["id"] == "a" else cells.withColumn("value", F.col("value") + 1)
            mixed = (more or {}).get("schedule") == "mixed"
            held[s["id"]] = JobSource(grid, shift, s["id"], 1, summaries.pyramid(shift, 16, 1) if mixed else None, 16, 1)
        return held[s["id"]]

    return Job(spark, {**SPEC, **(more or {})}, opened, checkpoint)


def _schedule(kind: str):
    def f(spark, sf_dir):
        return _job(spark, sf_dir, {"schedule": kind}).results().select(*JOB_COLUMNS)

    f.__name__ = f"batch_schedule_{kind}"
    query(sql(SPEC_C, SPEC_Z, J, select=SPEC_ROWS))(f)


for _kind in ("feature", "mixed"):
    _schedule(_kind)


@query(sql(SPEC_C, SPEC_Z, J, select=SPEC_ROWS))
def batch_resume(spark, sf_dir):
    """Two pages, then the rest by another job from the checkpoint."""
    first = _job(spark, sf_dir)
    pages = [first.next(2), first.next(2)]
    second = _job(spark, sf_dir, checkpoint=json.loads(json.dumps(pages[-1]["checkpoint"])))
    pages += list(second.pages(2))
    rows = [tuple(r[c] for c in JOB_COLUMNS) for p in pages for r in p["rows"]]  # pages of a few zones
    return spark.createDataFrame(rows, "slice_id string, zone_id string, row_no long, fractional_sum double, covered_cell_equivalents double, valid_cell_count long")


@query(f"SELECT s AS slice_id, 'b' || i AS zone_id, sha256('{fingerprint(SPEC)}:b' || i || ':' || s || ':' || s) AS result_id FROM range(0, 3) t(i), (VALUES ('a'), ('b')) u(s)")
def batch_result_id(spark, sf_dir):
    return _job(spark, sf_dir).results().select("slice_id", "zone_id", "result_id")


@query(sql(SPEC_C, SPEC_Z, J, select=SPEC_ROWS.replace("FROM j JOIN", "FROM (SELECT * FROM j WHERE v > 10000000) j JOIN")))
def batch_mask(spark, sf_dir):
    mask = {"op": "greater", "left": {"op": "band", "band": 0}, "right": {"op": "constant", "value": 1e7}}
    return _job(spark, sf_dir, {"mask": mask}).results().where("valid_cell_count > 0").select(*JOB_COLUMNS)


@query(sql(C_ORDERS, SPEC_Z, J, select="SELECT zone_id, CAST(band AS INTEGER) AS band, sum(v * f) AS fractional_sum, count(v) AS valid_cell_count FROM j GROUP BY ALL"))
def stream_slices(spark: SparkSession, sf_dir):
    """Slices that arrive as files are measured as they come."""
    cells, grid = Q.orders(spark, sf_dir)
    base = f"{Q.shared(spark)}/stream-{uuid.uuid4().hex}"
    cells.write.parquet(f"{base}/in")
    zones = spark.createDataFrame([(z["id"], json.dumps(z["geometry"])) for z in SPEC["zones"]], "zone_id string, geometry string")
    stream_measure(spark, f"{base}/in", coverage.select_cells(zones, grid), G.zone_facts(zones, grid), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    got = spark.read.parquet(f"{base}/out").groupBy("zone_id", "band").agg(F.sum("valid_cell_count").alias("valid_cell_count"))
    sums = numerics.exact_sums(spark.read.parquet(f"{base}/out"), ["zone_id", "band"], ["fractional_sum"])
    return got.join(sums, ["zone_id", "band"]).select("zone_id", "band", "fractional_sum", "valid_cell_count")


@query("SELECT CAST(l_suppkey AS INTEGER) AS band, sum(v) AS fractional_sum, count(v) AS valid_cell_count FROM (SELECT l_suppkey % 3 AS l_suppkey, CAST(l_quantity AS DOUBLE) AS v FROM lineitem) GROUP BY ALL")
def plain_grouped_sums(spark, sf_dir):
    """Exact sums of another table, by band."""
    t = Q._table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 3).cast("int").alias("band"), F.col("l_quantity").cast("double").alias("v"))
    got = numerics.gather(t, ["band"], [[(F.col("v"), 0)]], F.col("v")).withColumn("r", numerics.rounded(F.col("parts"), 1))
    return got.select("band", F.col("r")[0].alias("fractional_sum"), F.col("n").alias("valid_cell_count"))
