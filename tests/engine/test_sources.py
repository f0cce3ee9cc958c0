"""Identities, indexes, prepared structures, policies, and NetCDF."""

import asyncio
import json
import os
import struct

import numpy as np
import pytest

from gridloom.model import RequestError
from gridloom.operators import geometry
from gridloom.plans import cover
from gridloom.requests import answer
from gridloom.session import Session
from gridloom.sources import files, geotiff
from tests.engine.test_engine import H, W, brute, raster_of, square, tiff

ZONE = square(3.25, 2.5, 41.75, 33.25)


@pytest.fixture
def session(spark):
    s = Session(spark)
    for t in (0, 1):
        s.infuse({"raster": raster_of(t)}, id=f"t{t}")
    return s


def sums(rows):
    return [(r["fractional_sum"], r["covered_cell_equivalents"]) for r in rows]


def test_prepared_structures_answer_alike(session):
    s = session.sources["t0"]
    want = [brute(0, b, 3.25, 2.5, 41.75, 33.25) for b in (0, 1)]
    plain = s.carve(ZONE).collect()
    for kind in ("row_blocks", "hierarchy"):
        s.prepare(kind)
        assert s.carve(ZONE, backend=kind).collect() == plain
    s.prepare("cumulative_full")
    assert sums(s.carve(ZONE, backend="cumulative_full", metrics=["sum", "support"]).collect()) == want
    assert s.info()["structures"] == ["cumulative_full", "hierarchy", "row_blocks"]
    for bad in ({"backend": "cumulative_blocked"}, {"backend": "cumulative_full"}, {"backend": "row_blocks", "metrics": ["variance"]}, {"backend": "?"}):
        with pytest.raises(RequestError):
            s.carve(ZONE, **bad)
    assert [r["band"] for r in s.carve(ZONE, bands=[1, 0]).collect()] == [1, 0]
    assert sums(asyncio.run(s.carve_async(ZONE))) == want


def test_cumulative_field_falls_back(spark):
    s = Session(spark)
    raster = {"grid": {"width": 64, "height": 1, "transform": [0, 1, 0, 1, 0, -1], "crs": "LOCAL"}, "bands": [{"values": [1e16] + [1.0] * 63}]}
    src = s.infuse({"raster": raster}).prepare("cumulative_full")
    thirds = {"type": "Polygon", "coordinates": [[[1, 0], [40, 0], [20.3, 0.7], [1, 0]]]}
    want = src.carve(thirds, metrics=["sum"]).first()["fractional_sum"]
    assert src.carve(thirds, metrics=["sum"], backend="cumulative_full").first()["fractional_sum"] == want


def test_indexes_know_their_source(session, tmp_path):
    s, other = session.sources["t0"], session.sources["t1"]
    plain = s.carve(ZONE).collect()
    s.ward(str(tmp_path / "i"), edge=16, levels=2)
    assert s.carve(ZONE).collect() == plain
    with pytest.raises(RequestError, match="another source"):
        other.open_index(str(tmp_path / "i"))
    s.close_index()
    with pytest.raises(RequestError, match="another build"):
        session.register_index(s, str(tmp_path / "i"), id="x", expected_build_id="?")
    index = session.register_index(s, str(tmp_path / "i"), id="i")
    assert index.info()["valid"] and session.stats()["indexes"] == 1
    job = {"zones": [{"id": "z", "geometry": ZONE}], "slices": [{"id": "a", "source": "t0", "expected_build_id": index.build_id}], "crs": "LOCAL", "schedule": "mixed"}
    page = session.start_job(job, id="j").next(10)
    assert page["checkpoint"]["pins"][0]["index_build_id"] == index.build_id and sums(page["rows"]) == sums(plain)
    session.jobs.clear()
    with pytest.raises(RequestError, match="another build"):
        session.start_job({**job, "slices": [{"id": "a", "source": "t0", "expected_build_id": "?"}]}, id="k").next(10)
    session.close_index("i")
    assert not index.info()["valid"] and s.summary is None


def test_plans_are_for_one_grid(session, spark):
    session.compile_polygon(ZONE, source=session.sources["t0"], id="p")
    small = {"grid": {"width": 2, "height": 2, "transform": [0, 1, 0, 2, 0, -1], "crs": "LOCAL"}, "bands": [{"values": [1, 2, 3, 4]}]}
    assert session.measure(source=session.sources["t1"], plan="p").count() == 2
    with pytest.raises(RequestError, match="another grid"):
        session.measure(source=session.infuse({"raster": small}), plan="p")


def test_unscaled_policy_refuses_scaled_and_masked_sources(spark):
    s = Session(spark)
    grid = {"width": 2, "height": 2, "transform": [0, 1, 0, 2, 0, -1], "crs": "LOCAL"}
    box = square(0, 0, 2, 2)
    ask = {"backend": "exactextract", "numerical_policy": "exactextract_rasterio_v030"}
    for bad in ({"scale": 10}, {"offset": 1}, {"valid": [True, True, True, False]}):
        with pytest.raises(RequestError, match="refuses"):
            s.infuse({"raster": {"grid": grid, "bands": [{"values": [1, 2, 3, 4], **bad}]}}).carve(box, **ask)
    src = s.infuse({"raster": {"grid": grid, "bands": [{"values": [1, 2, 3, 4], "nodata": 4}]}}, id="ok")
    got = src.carve(box, **ask).first()
    assert (got["fractional_sum"], got["numerical_policy"]) == (6, "exactextract_rasterio_v030")
    with pytest.raises(RequestError, match="sum, support"):
        src.carve(box, metrics=["variance"], **ask)


def test_file_identity_and_change(spark, tmp_path):
    a = (np.arange(2 * 20 * 37).reshape(2, 20, 37) % 97).astype("f4")
    tiff(tmp_path / "a.tif", a)
    path = str(tmp_path / "a.tif")
    s = Session(spark)
    found = files.digest(spark, path)
    for bad in ({"sha256": "0" * 64}, {"length": 1}, {"policy": "trusted_manifest"}, {"policy": "?"}):
        with pytest.raises(RequestError):
            s.infuse({"location": path, "identity": bad})
    src = s.infuse({"location": path, "identity": {"sha256": found, "policy": "verify"}}, id="a")
    with s.verified(src) as receipt:
        assert src.carve(square(0, 0, 37, 20)).count() == 2
    assert receipt == {"a": found}
    with pytest.raises(RequestError, match="changed"), s.verified(src):
        tiff(tmp_path / "a.tif", a + 1)
        os.utime(path, (1, 1))
    with pytest.raises(RequestError, match="changed"):
        src.carve(square(0, 0, 37, 20))
    with pytest.raises(RequestError):
        (tmp_path / "x.tif").write_bytes(b"nothing that is known")
        s.infuse({"location": str(tmp_path / "x.tif")})


def test_tiff_blocks_from_any_store(spark, tmp_path, monkeypatch):
    a = (np.arange(2 * 20 * 37).reshape(2, 20, 37) % 97).astype("f4")
    tiff(tmp_path / "a.tif", a, predictor=3)
    monkeypatch.setattr(files, "is_local", lambda path: False)
    rows = geotiff.load(spark, str(tmp_path / "a.tif")).collect()
    assert len(rows) == a.size and all(a[r["band"], r["row"], r["col"]] == r["sample"] and r["mask"] == 255 for r in rows)


def netcdf(path, a, lats, lons, version=2, record=False, attributes=()):
    """Write a small classic file: variable v (time, lat, lon) with coordinates."""
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    name = lambda n: struct.pack(">I", len(n)) + pad(n.encode())

    def atts(items):
        out = struct.pack(">II", 12, len(items)) if items else struct.pack(">II", 0, 0)
        for n, v in items:
            out += name(n) + (struct.pack(">II", 2, len(v)) + pad(v.encode()) if isinstance(v, str) else struct.pack(">IId", 6, 1, v))
        return out

    big = a.astype(">f4")
    dims = [("time", 0 if record else a.shape[0]), ("lat", len(lats)), ("lon", len(lons))]
    sizes = [len(lats) * 8, len(lons) * 8, big[0].nbytes if record else big.nbytes]
    variables = [("lat", [1], 6, [("units", "degrees_north")]), ("lon", [2], 6, [("units", "degrees_east")]), ("v", [0, 1, 2], 5, list(attributes))]
    offset = ">I" if version == 1 else ">Q"

    def head(begins):
        out = b"CDF" + bytes([version]) + struct.pack(">I", a.shape[0] if record else 0) + struct.pack(">II", 10, len(dims))
        for n, k in dims:
            out += name(n) + struct.pack(">I", k)
        out += struct.pack(">II", 0, 0) + struct.pack(">II", 11, len(variables))
        for (n, ids, kind, items), size, begin in zip(variables, sizes, begins, strict=True):
            out += name(n) + struct.pack(f">I{len(ids)}I", len(ids), *ids) + atts(items) + struct.pack(">II", kind, size) + struct.pack(offset, begin)
        return out

    first = len(head([0, 0, 0]))
    begins = [first, first + sizes[0], first + sizes[0] + sizes[1]]
    path.write_bytes(head(begins) + np.asarray(lats, ">f8").tobytes() + np.asarray(lons, ">f8").tobytes() + big.tobytes())


@pytest.mark.parametrize(("version", "record", "up"), [(1, False, False), (2, True, False), (2, False, True)])
def test_netcdf_variable(spark, tmp_path, version, record, up):
    a = (np.arange(3 * 4 * 6).reshape(3, 4, 6) % 17).astype("f4")
    lats = [50.125 + 0.25 * k for k in range(4)]
    lats = lats if up else lats[::-1]
    path = tmp_path / "a.nc"
    netcdf(path, a, lats, [4.125 + 0.25 * k for k in range(6)], version, record, [("_FillValue", 3.0), ("scale_factor", 2.0), ("add_offset", -1.0)])
    s = Session(spark)
    src = s.infuse({"location": str(path), "variable": "v"})
    assert src.grid.transform == (4.0, 0.25, 0.0, 51.0, 0.0, -0.25) and src.grid.crs == "EPSG:4326" and src.band_count == 3
    got = src.carve(square(4, 50, 5.5, 51)).collect()
    assert [r["fractional_sum"] for r in got] == [float((a[b][a[b] != 3] * 2.0 - 1).sum()) for b in range(3)]
    top = src.carve(square(4, 50.75, 5.5, 51), bands=[0]).first()["fractional_sum"]
    row = a[0][-1 if up else 0]
    assert top == float((row[row != 3] * 2.0 - 1).sum())
    for bad in ({"variable": "w"}, {}, {"variable": "v", "overview": 0}):
        with pytest.raises(RequestError):
            s.infuse({"location": str(path), **bad})
    netcdf(path, a, [50, 50.25, 50.6, 51], [4.125 + 0.25 * k for k in range(6)])
    with pytest.raises(RequestError, match="evenly"):
        s.infuse({"location": str(path), "variable": "v"})


def test_snapshot_brings_its_summary(spark, tmp_path):
    a = (np.arange(2 * 20 * 37).reshape(2, 20, 37) % 97).astype("f4")
    tiff(tmp_path / "a.tif", a)
    s = Session(spark)
    src = s.infuse({"location": str(tmp_path / "a.tif")}, id="a")
    src.compile(str(tmp_path / "snap"), edge=64)
    again = s.infuse({"location": str(tmp_path / "snap")}, id="b")
    assert again.summary is not None and again.build_id
    assert sums(again.carve(square(1.5, 2, 30, 19)).collect()) == sums(src.carve(square(1.5, 2, 30, 19)).collect())
    ok = lambda **v: answer(s, v)
    assert ok(op="begin_verified_source_query", source="a")["ok"] and ok(op="end_verified_source_query", source="a")["ok"]
    assert ok(op="prepare", source="b", kind="row_blocks")["result"]["structures"] == ["row_blocks"]
    assert ok(op="measure_source", source="b", geometry=json.loads(json.dumps(square(0, 0, 9, 9))), backend="row_blocks")["ok"]
    assert ok(op="source_metrics", id="a")["result"]["file"]["length"] > 0


def test_jobs_run_in_their_group(session, spark, monkeypatch):
    seen = []
    real = spark.sparkContext.setJobGroup
    monkeypatch.setattr(type(spark.sparkContext), "setJobGroup", lambda self, *a: (seen.append(a[0]), real(*a)))
    job = {"zones": [{"id": "z", "geometry": square(0, 0, W, H)}], "slices": [{"id": "a", "source": "t0"}], "crs": "LOCAL", "options": {"bands": [1, 0]}}
    rows = list(session.cleave(job, id="mine"))
    assert seen == ["mine"] and spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None
    assert [r["band"] for r in rows] == [1, 0]


def test_delegated_jobs_are_staged(session):
    job = {"zones": [{"id": "z", "geometry": square(0, 0, W, H)}, {"id": "y", "geometry": ZONE}], "slices": [{"id": "a", "source": "t0"}, {"id": "b", "source": "t1"}], "crs": "LOCAL", "backend": "exactextract"}
    rows = list(session.cleave(job, max_rows=1))
    assert [(r["slice_id"], r["zone_id"]) for r in rows] == [(s, z) for s in "ab" for z in "zy" for _ in (0, 1)]
    assert sums(rows)[:2] == [brute(0, b, 0, 0, W, H) for b in (0, 1)]
    with pytest.raises(RequestError):
        session.start_job({**job, "mask": {"op": "band", "band": 0}}, id="x")
    with pytest.raises(RequestError, match="refuses"):
        list(session.cleave({**job, "numerical_policy": "exactextract_rasterio_v030"}))


def test_wkb_and_rectangle_classes(session):
    grid = session.sources["t0"].grid
    raw = geometry.to_wkb(square(0, 0, 2, 3), grid)
    assert raw[:13] == struct.pack("<BIII", 1, 3, 1, 5) and struct.unpack("<10d", raw[13:]) == (0, 0, 2, 0, 2, 3, 0, 3, 0, 0)
    many = geometry.to_wkb({"type": "MultiPolygon", "coordinates": [square(0, 0, 1, 1)["coordinates"], square(2, 2, 3, 3)["coordinates"]]}, grid)
    assert struct.unpack("<BII", many[:9]) == (1, 6, 2)
    hole = {"type": "Polygon", "coordinates": [square(0, 0, 60, 40)["coordinates"][0], square(20, 10, 30, 20)["coordinates"][0]]}
    boxes = np.array([(1, 1, 5, 5), (22, 22, 28, 28), (18, 18, 32, 32), (60, 0, 66, 6), (61, 0, 66, 6), (0, 0, 5, 5)], float)
    got = geometry.classify(geometry.rings(hole, grid), *boxes.T)
    assert got.tolist() == ["inside", "outside", "boundary", "boundary", "outside", "boundary"]


def test_bounded_ranges_and_forest():
    reads = [("a", 0, 10), ("a", 100, 10), ("a", 115, 5), ("b", 0, 1)]
    assert cover.bounded_ranges(reads, 4) == reads
    assert cover.bounded_ranges(reads, 3) == [("a", 0, 10), ("a", 100, 20), ("b", 0, 1)]
    assert cover.bounded_ranges(reads, 2) == [("a", 0, 120), ("b", 0, 1)]
    with pytest.raises(RequestError):
        cover.bounded_ranges(reads, 1)
    tiles = [(y, x, 256, True) for y in range(4) for x in range(4)]
    nodes, roots = cover.forest(tiles, 2, 40, 4096, 4)
    assert roots == ["2/0/0"] and cover.plan(nodes, roots)["cover"] == [("2/0/0", "summary")]
    tiles[5] = (1, 1, 200, False)
    nodes, roots = cover.forest(tiles, 2, 40, 4096, 4)
    got = dict(cover.plan(nodes, roots)["cover"])
    assert got.pop("0/1/1") == "raw" and set(got.values()) == {"summary"} and sum(4 ** int(n[0]) for n in got) == 15


def test_files_are_opened_when_they_are_needed(spark, tmp_path):
    a = (np.arange(2 * 20 * 37).reshape(2, 20, 37) % 97).astype("f4")
    path = tmp_path / "a.tif"
    s = Session(spark)
    ask = lambda **v: answer(s, v)
    assert ask(op="register_file", id="f", spec={"location": str(path)})["ok"] and not s.sources  # not there yet
    tiff(path, a)
    want = [float(a[b].sum()) for b in (0, 1)]
    whole = square(0, 0, 37, 20)
    assert ask(op="configure_file_cache", on=True)["ok"]
    for _ in range(2):
        assert [r["fractional_sum"] for r in ask(op="measure_registered_file", id="f", geometry=whole)["result"]] == want
    assert s.sources["f"].cells.is_cached and ask(op="clear_file_cache")["ok"] and not s.sources["f"].cells.is_cached
    assert ask(op="close_file", id="f")["ok"] and not s.sources and not s.files
    assert [r["fractional_sum"] for r in ask(op="measure_file", spec={"location": str(path)}, geometry=whole)["result"]] == want and not s.sources
    assert not ask(op="measure_file", spec={"raster": {}}, geometry=whole)["ok"]


def test_persistent_backends_and_async_jobs(session, tmp_path):
    s = session.sources["t0"]
    plain = s.carve(ZONE).collect()
    with pytest.raises(RequestError, match="no index"):
        s.carve(ZONE, backend="persistent_flat")
    s.ward(str(tmp_path / "i"), edge=16, levels=2)
    assert s.carve(ZONE, backend="persistent_flat").collect() == s.carve(ZONE, backend="persistent_hierarchy").collect() == s.carve(ZONE, backend="direct").collect() == plain
    job = {"zones": [{"id": "z", "geometry": ZONE}], "slices": [{"id": "a", "source": "t0"}, {"id": "b", "source": "t1"}], "crs": "LOCAL"}

    async def rows():
        return [r async for r in session.cleave_async(job, max_rows=1)]

    assert sums(asyncio.run(rows()))[:2] == sums(plain)
