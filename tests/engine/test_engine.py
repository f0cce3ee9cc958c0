import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridloom.model import Grid, RequestError
from gridloom.operators import coverage, spherical
from gridloom.operators import geometry as G
from gridloom.plans import cover, policy, profile
from gridloom.plans.batch import Job, Source
from gridloom.session import Session
from gridloom.sources import geotiff, raster
from gridloom.streaming.slices import stream_measure

W, H = 70, 40


def square(x0, y0, x1, y1):
    return {"type": "Polygon", "coordinates": [[[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]]}


def raster_of(t):
    values = [[((3 * x + 7 * y + 11 * t) % 31) - 9 for y in range(H) for x in range(W)], [((x + y + t) % 7) + 1 for y in range(H) for x in range(W)]]
    valid = [[(x + 2 * y + t) % 13 != 0 for y in range(H) for x in range(W)], [(2 * x + y + t) % 17 != 0 for y in range(H) for x in range(W)]]
    return {"grid": Grid.local(W, H).record(), "bands": [{"values": v, "valid": k} for v, k in zip(values, valid, strict=True)]}


ZONES = [{"id": "whole", "geometry": square(0, 0, W, H)}, {"id": "shift", "geometry": square(3.25, 2.5, 41.75, 33.25)}, {"id": "out", "geometry": square(900, 900, 901, 901)}]


def brute(t, b, x0, y0, x1, y1):
    r = raster_of(t)["bands"][b]
    total = support = 0.0
    for y in range(H):
        for x in range(W):
            f = max(0, min(x + 1, x1) - max(x, x0)) * max(0, min(H - y, y1) - max(H - y - 1, y0))
            if f > 0 and r["valid"][y * W + x]:
                total, support = total + f * r["values"][y * W + x], support + f
    return total, support


@pytest.fixture(scope="module")
def session(spark):
    s = Session(spark)
    for t in (0, 1):
        s.infuse({"raster": raster_of(t)}, id=f"t{t}")
    return s


def test_cleave_pages_resume_and_match(session):
    job = {"zones": ZONES, "slices": [{"id": "a", "source": "t0"}, {"id": "b", "source": "t1"}], "crs": "LOCAL"}
    rows = list(session.cleave(job, max_rows=2))
    assert [r["row_no"] for r in rows] == [k for k in range(6) for _ in (0, 1)]
    for r in rows:
        box = {"whole": (0, 0, W, H), "shift": (3.25, 2.5, 41.75, 33.25), "out": (900, 900, 901, 901)}[r["zone_id"]]
        assert (r["fractional_sum"], r["covered_cell_equivalents"]) == brute(0 if r["slice_id"] == "a" else 1, r["band"], *box)
    first = next(iter(session.batch_pages(job, max_rows=4)))
    rest = list(session.cleave(job, checkpoint=first["checkpoint"]))
    assert [r["result_id"] for r in first["rows"] + rest] == [r["result_id"] for r in rows]
    with pytest.raises(RequestError):
        list(session.cleave({**job, "zones": ZONES[:2]}, checkpoint=first["checkpoint"]))


def test_carve_expression_mask_and_summary(session, tmp_path):
    s = session.sources["t0"]
    plain = s.carve(ZONES[1]["geometry"]).orderBy("band").collect()
    s.ward(str(tmp_path / "index"), edge=16, levels=2)
    fast = s.carve(ZONES[1]["geometry"]).orderBy("band").collect()
    assert plain == fast
    with pytest.raises(Exception, match="exists"):
        s.ward(str(tmp_path / "index"), edge=16)
    ratio = {"op": "normalized_difference", "left": {"op": "band", "band": 0}, "right": {"op": "band", "band": 1}}
    r = s.carve(ZONES[0]["geometry"], expression=ratio, mask={"op": "greater", "left": {"op": "band", "band": 0}, "right": {"op": "constant", "value": 1}}).first()
    b = raster_of(0)["bands"]
    vals = [(x - y) / (x + y) for x, y, p, q in zip(b[0]["values"], b[1]["values"], b[0]["valid"], b[1]["valid"], strict=True) if p and q and x > 1]
    assert r["valid_cell_count"] == len(vals) and abs(r["fractional_sum"] - sum(vals)) < 1e-9
    with pytest.raises(RequestError):
        s.carve(ZONES[0]["geometry"], metrics=["nope"])


def test_whole_tiles_never_reach_the_cell_scan(session, spark):
    from gridloom.operators import summaries

    s = session.sources["t1"]
    z = spark.createDataFrame([("z", json.dumps(square(0, 0, W, H)))], "zone_id string, geometry string")
    sel = coverage.select_cells(z, s.grid)
    poison = s.cells.withColumn("value", F.lit(1e9))
    got = summaries.measure_with(summaries.pyramid(s.cells, 16, 1), poison, sel, G.zone_facts(z, s.grid), s.grid, 16, 1).orderBy("band").collect()
    assert [r["fractional_sum"] for r in got] == [brute(1, b, 0, 0, W, H)[0] for b in (0, 1)]


def test_job_strictness(spark):
    make = lambda **k: Job(spark, {"zones": ZONES, "slices": [{"id": "a"}], "crs": "LOCAL", **k}, lambda s: Source(None, None, "", 1))
    for bad in ({"tile_edge": 48}, {"zones": [ZONES[0], ZONES[0]]}, {"schedule": "?"}, {"extra": 1}, {"output_mode": "numeric"}, {"expression": {"op": "python"}}):
        with pytest.raises(RequestError):
            make(**bad)
    assert make().fingerprint == make(tile_edge=64, schedule="mixed").fingerprint != make(options={"bands": [0]}).fingerprint


def test_policies():
    assert policy.resolve({})["numerical_policy"] == policy.NATIVE
    assert policy.resolve({"backend": "exactextract"})["numerical_policy"] == policy.FRACTIONAL
    assert policy.resolve({"backend": "auto", "accepted_policies": [policy.RASTERIO]})["selected_backend"] == "exactextract"
    for bad in ({"backend": "?"}, {"numerical_policy": policy.FRACTIONAL}, {"execution_envelope": "process_isolated"}, {"backend": "native", "backend_options": {}}):
        with pytest.raises(RequestError):
            policy.resolve(bad)


def test_profile_route_is_inclusive_and_strict():
    request = {"bands": [0], "polygons": [{"id": "p", "windows": [{"window": [0, 0, 4, 4], "runs": [[0, 16]]}]}]}
    rule = {"enabled": True, "access_classes": ["warm"], "bands": [0], "polygons": [1, 1], "windows": [1, 1], "selected_cells": [16, 16], "envelope_width": [4, 4], "envelope_height": [4, 4], "envelope_cells": [16, 16]}
    p = {"view_id": "v", "numerical_policy": "ordered_v1", "accelerated_when": rule}
    assert profile.route(p, request, "v", "ordered_v1", "warm")[0] == "accelerated"
    assert profile.route(p, request, "v", "ordered_v1")[0] == "direct"
    rule["selected_cells"] = [17, 20]
    assert profile.route(p, request, "v", "ordered_v1", "warm")[0] == "direct"
    with pytest.raises(RequestError):
        profile.route(p, request, "w", "ordered_v1")


def test_joint_plan_is_the_cheapest_cover():
    nodes = {"r": {"certified": True, "summary": {"reads": [("s", 0, 40)], "reduction_ns": 1}, "fallback": {"children": ["a", "b"]}}, "a": {"fallback": {"raw": [("f", 0, 100)]}}, "b": {"fallback": {"raw": [("f", 100, 100)]}}}
    assert cover.plan(nodes, ["r"])["cover"] == [("r", "summary")]
    nodes["r"]["certified"] = False
    got = cover.plan(nodes, ["r"])
    assert got["cover"] == [("a", "raw"), ("b", "raw")] and got["ranges"] == [("f", 0, 200)]


def test_spherical_golden_values(spark):
    grid = Grid(4, 3, (4.0, 0.25, 0.0, 51.0, 0.0, -0.25), "EPSG:4326")
    values = [100.0, 0.0, 250.0, -10.0, 12.0, 15.0, 19.0, 1000.0, 2.0, 70.0, -9999.0, 30.0]
    cells = spark.createDataFrame([("s", i // 4, i % 4, 0, v, i != 10) for i, v in enumerate(values)], "slice_id string, row int, col int, band int, value double, valid boolean")
    thin = lambda k: {"type": "Polygon", "coordinates": [[[4.02, 50.31], [4.92, 50.91], [4.92 + 2.0**-k, 50.91], [4.02 + 2.0**-k, 50.31], [4.02, 50.31]]]}
    oblique = {"type": "Polygon", "coordinates": [[[4.03, 50.31], [4.92, 50.67], [4.14, 50.97], [4.03, 50.31]]]}
    # Mass, covered, whole and boundary cells, footprint.
    want = {
        "whole": (square(4, 50.25, 5, 51), (1498.0, 12.0, 12, 0, 1.0)), "north": (square(4, 50.875, 4.25, 51), (49.93294642430231, 0.4993294642430231, 0, 1, 1.0)),
        "partial": (square(3.5, 50.25, 4.5, 51), (199.0, 6.0, 6, 0, 0.5)), "outside": (square(5.1, 50.3, 5.2, 50.4), (0.0, 0.0, 0, 0, 0.0)),
        "oblique": (oblique, (311.5169793310973, 4.382243808992825, 0, 9, 1.0)), "thin20": (thin(20), (0.0002866954379039854, 9.155798433967533e-06, 0, 6, 1.0)),
        "thin47": (thin(47), (2.136053919583773e-12, 6.821601416146407e-14, 0, 6, 1.0)),
    }
    z = spark.createDataFrame([(k, json.dumps(g)) for k, (g, _) in want.items()], "zone_id string, geometry string")
    for r in spherical.spherical_mass(cells, z, grid).collect():
        mass, covered, full, edge, foot = want[r["zone_id"]][1]
        assert abs(r["mass"] - mass) <= 1e-9 * max(1e-300, mass) and abs(r["coveredPixelEquivalent"] - covered) <= 1e-9 * covered
        assert (r["fullPixelCount"], r["boundaryPixelCount"]) == (full, edge) and abs(r["footprintCoverageFraction"] - foot) < 1e-9


def tiff(path, a, tile=16, deflate=True, predictor=2, nodata=None, planar=1):
    """Write a small tiled GeoTIFF; a is (bands, height, width)."""
    bands, h, w = a.shape
    blocks = []
    for p in range(bands if planar == 2 else 1):
        for y in range(0, h, tile):
            for x in range(0, w, tile):
                src = a[p : p + 1] if planar == 2 else a
                b = np.zeros((tile, tile, src.shape[0]), a.dtype)
                part = src[:, y : y + tile, x : x + tile].transpose(1, 2, 0)
                b[: part.shape[0], : part.shape[1]] = part
                if predictor == 2:
                    b = np.concatenate([b[:, :1], np.diff(b, axis=1)], axis=1).astype(a.dtype)
                if predictor == 3:
                    v = b.astype(">" + a.dtype.str[1:]).reshape(tile, -1).view(np.uint8).reshape(tile, -1, a.dtype.itemsize)
                    v = v.transpose(0, 2, 1).reshape(tile, -1, b.shape[2])
                    raw = np.concatenate([v[:, :1], np.diff(v, axis=1)], axis=1).astype(np.uint8).tobytes()
                else:
                    raw = b.tobytes()
                blocks.append(zlib.compress(raw) if deflate else raw)
    at, offs = 8, []
    for b in blocks:
        offs.append(at)
        at += len(b)
    kind = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
    tags = [(256, 4, [w]), (257, 4, [h]), (258, 3, [a.dtype.itemsize * 8] * bands), (259, 3, [8 if deflate else 1]), (277, 3, [bands]), (284, 3, [planar]), (317, 3, [predictor]), (322, 4, [tile]), (323, 4, [tile]), (324, 4, offs), (325, 4, [len(b) for b in blocks]), (339, 3, [kind] * bands), (33550, 12, [1.0, 1.0, 0.0]), (33922, 12, [0, 0, 0, 0.0, float(h), 0.0]), (34735, 3, [1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, 32631])]
    if nodata is not None:
        tags.append((42113, 2, [*str(nodata).encode(), 0]))
    code = {2: "B", 3: "H", 4: "I", 12: "d"}
    extra, entries, end = b"", b"", at + 2 + 12 * len(tags) + 4
    for tag, t, v in sorted(tags):
        raw = struct.pack(f"<{len(v)}{code[t]}", *v)
        entries += struct.pack("<HHI", tag, t, len(v)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", end + len(extra)))
        extra += raw if len(raw) > 4 else b""
    path.write_bytes(struct.pack("<2sHI", b"II", 42, at) + b"".join(blocks) + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0) + extra)


@pytest.mark.parametrize(("dtype", "predictor", "deflate", "planar"), [("f4", 3, True, 1), ("u2", 2, True, 1), ("i2", 1, False, 2), ("f8", 1, True, 2)])
def test_tiff_reader(spark, tmp_path, dtype, predictor, deflate, planar):
    a = (np.arange(2 * 20 * 37).reshape(2, 20, 37) % 97).astype(dtype)
    tiff(tmp_path / "a.tif", a, predictor=predictor, deflate=deflate, planar=planar)
    _, got, _ = geotiff.decode((tmp_path / "a.tif").read_bytes())
    assert (got == a).all()
    spark.dataSource.register(geotiff.TiffSource)
    df = spark.read.format("gridloom.tiff").option("path", str(tmp_path / "a.tif")).option("x", 5).option("y", 3).option("width", 20).option("height", 14).load()
    rows = df.collect()
    assert len(rows) == 2 * 20 * 14 and all(a[r["band"], r["row"], r["col"]] == r["sample"] for r in rows)


def test_tiff_source_snapshot_and_corruption(spark, tmp_path):
    a = (np.arange(2 * 20 * 37).reshape(2, 20, 37) % 97).astype("f4")
    tiff(tmp_path / "a.tif", a, nodata=5)
    s = Session(spark)
    src = s.infuse({"location": str(tmp_path / "a.tif"), "bands": [1, 0]}, id="tif")
    zone = square(0, 0, 37, 20)
    got = src.carve(zone).orderBy("band").collect()
    assert [r["fractional_sum"] for r in got] == [float(a[b][a[b] != 5].sum()) for b in (1, 0)]
    path = str(tmp_path / "snap")
    src.compile(path, edge=64)
    assert s.verify(path)
    again = s.infuse({"snapshot": path}, id="snap").carve(zone).orderBy("band").collect()
    assert [r["fractional_sum"] for r in again] == [r["fractional_sum"] for r in got]
    rows = spark.read.parquet(f"{path}/samples").toPandas()
    rows.loc[(rows.row == 3) & (rows.col == 4), "sample"] = 1.5
    spark.createDataFrame(rows).write.mode("overwrite").parquet(f"{path}/samples")
    assert not s.verify(path)
    w = src.read_window((2, 1, 3, 2), [0]).first()
    assert np.frombuffer(w["samples"], "<f8").tolist() == a[1, 1:3, 2:5].reshape(-1).tolist()


def test_tiles_round_trip(spark):
    _, cells = raster.inline(spark, raster_of(0), "x")
    back = raster.explode_tiles(raster.to_tiles(cells, 32))
    assert back.exceptAll(cells).isEmpty() and back.count() == cells.count()


def test_streaming_matches_batch(spark, tmp_path):
    grid, cells = raster.inline(spark, raster_of(0), "t0")
    z = spark.createDataFrame([("z", json.dumps(square(1.5, 1, 20, 30)))], "zone_id string, geometry string")
    sel, facts = coverage.select_cells(z, grid).persist(), G.zone_facts(z, grid).persist()
    cells.write.parquet(str(tmp_path / "in"))
    stream_measure(spark, str(tmp_path / "in"), sel, facts, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).where("band = 0").first()
    assert got["fractional_sum"] == brute(0, 0, 1.5, 1, 20, 30)[0]


def test_registered_queries_have_matching_names():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and "zonal_sum" in q
