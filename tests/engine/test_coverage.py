import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.model import Grid, RequestError
from gridloom.operators import coverage, zonal
from gridloom.operators import geometry as G
from gridloom.sources import raster

GRID = Grid.local(2, 2)
CASES = {
    "whole": ([(0, 0), (2, 0), (2, 2), (0, 2)], 10, 4, 2.5),
    "half": ([(0.5, 0), (1.5, 0), (1.5, 2), (0.5, 2)], 5, 2, 2.5),
    "diagonal": ([(0, 0), (2, 0), (0, 2)], 5.5, 2, 2.75),
    "quarter": ([(0, 1.5), (0.5, 1.5), (0.5, 2), (0, 2)], 0.25, 0.25, 1),
}


def polygon(*rings):
    return json.dumps({"type": "Polygon", "coordinates": [[*map(list, r), list(r[0])] for r in rings]})


def zones(spark, rows):
    return spark.createDataFrame(rows, "zone_id string, geometry string")


@pytest.mark.parametrize("strategy", ["scanline", "direct"])
def test_golden_cases(spark, strategy):
    grid, cells = raster.inline(spark, {"grid": GRID.record(), "bands": [{"values": [1, 2, 3, 4]}]})
    z = zones(spark, [(k, polygon(v[0])) for k, v in CASES.items()])
    got = zonal.measure(cells, coverage.select_cells(z, grid, strategy), G.zone_facts(z, grid)).collect()
    for r in got:
        _, total, support, mean = CASES[r["zone_id"]]
        assert (r["fractional_sum"], r["covered_cell_equivalents"], r["coverage_weighted_mean"], r["status"]) == (total, support, mean, "ok")


def test_outside_partial_and_empty(spark):
    grid, cells = raster.inline(spark, {"grid": GRID.record(), "bands": [{"values": [1, None, 3, 4]}]})
    z = zones(spark, [("out", polygon([(5, 5), (6, 5), (6, 6), (5, 6)])), ("part", polygon([(-1, 0), (1, 0), (1, 1), (-1, 1)])), ("none", polygon([(1, 1), (2, 1), (2, 2), (1, 2)]))])
    got = {r["zone_id"]: r for r in zonal.measure(cells, coverage.select_cells(z, grid), G.zone_facts(z, grid)).collect()}
    assert got["out"]["status"] == "outside" and got["out"]["fractional_sum"] == 0 and got["out"]["min"] is None
    assert got["part"]["status"] == "partial" and got["part"]["outside_cell_equivalents"] == 1 and got["part"]["fractional_sum"] == 3
    assert got["none"]["status"] == "no_valid_data" and got["none"]["missing_cell_equivalents"] == 1


@pytest.mark.parametrize("rings", [
    [[(0, 0), (2, 2), (2, 0), (0, 2)]],
    [[(0, 0), (1, 0), (2, 0)]],
    [[(0, 0), (2, 0), (2, 2), (0, 2)], [(3, 3), (4, 3), (4, 4)]],
    [[(0, 0), (2, 0), (2, 2), (0, 2)], [(0.5, 0.5), (1.5, 0.5), (1.5, 1.5)], [(0.6, 0.5), (1.6, 0.5), (1.6, 1.4)]],
    [[(0, 0), (2, 0), (1, 0), (1, 1)]],
    [[(0, 0), (2, float("nan")), (2, 2)]],
])
def test_invalid_polygons_are_refused(rings):
    with pytest.raises((RequestError, ValueError)):
        G.describe({"type": "Polygon", "coordinates": [[*map(list, r), list(r[0])] for r in rings]}, GRID)


def test_strict_geojson():
    for g in ({"type": "Point", "coordinates": [0, 0]}, {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1]]]}, {"type": "Polygon", "coordinates": [[[0, 0, 1], [1, 0, 1], [1, 1, 1], [0, 0, 1]]]}):
        with pytest.raises(RequestError):
            G.describe(g, GRID)


def radial(n, radii, start):
    return [(4 + r * math.cos(start + 2 * math.pi * k / n), 4 + r * math.sin(start + 2 * math.pi * k / n)) for k, r in zip(range(n), radii, strict=False)]


def test_random_polygons_match_exact_clipping(spark):
    import random

    rnd, grid, rows = random.Random(5), Grid.local(8, 8), []
    for k in range(40):
        n = rnd.randint(3, 24)
        rows.append((f"z{k}", polygon(radial(n, [rnd.uniform(0.1, 5.5) for _ in range(n)], rnd.uniform(0, 1)))))
    z = zones(spark, rows)
    key = lambda r: (r["zone_id"], r["row"], r["col"])
    a = {key(r): r["fraction"] for r in coverage.cells_of(coverage.select_cells(z, grid)).collect()}
    b = {key(r): r["fraction"] for r in coverage.cells_of(coverage.clipped(z, grid)).collect()}
    for k in a.keys() | b.keys():
        assert abs(a.get(k, 0) - b.get(k, 0)) < 1e-9


@settings(max_examples=30, deadline=None)
@given(st.integers(3, 12), st.lists(st.floats(0.2, 5), min_size=12, max_size=12), st.floats(0, 1))
def test_shares_add_up_to_the_area(n, radii, start):
    grid = Grid.local(8, 8)
    ring = radial(n, [min(r, 3.9) for r in radii], start)
    g = {"type": "Polygon", "coordinates": [[*map(list, ring), list(ring[0])]]}
    area = G.describe(g, grid)[1]
    assert abs(sum(f for _, _, f in coverage.clip_cells(g, grid)) - area) < 1e-9


def test_slivers_keep_their_area(spark):
    grid = Grid.local(8, 8)
    z = zones(spark, [(str(k), polygon([(1, 1), (7, 6), (7 + 2.0**-k, 6), (1 + 2.0**-k, 1)])) for k in (20, 35, 47)])
    for r in coverage.cells_of(coverage.select_cells(z, grid)).groupBy("zone_id").sum("fraction").collect():
        assert abs(r[1] / (5 * 2.0 ** -int(r[0])) - 1) < 1e-9


def test_ring_rotation_reversal_and_additivity(spark):
    grid = Grid.local(6, 6)
    ring = [(0.3, 0.4), (5.1, 1.2), (4.4, 5.3), (1.1, 4.9)]
    z = zones(spark, [("a", polygon(ring)), ("b", polygon(ring[2:] + ring[:2])), ("c", polygon(ring[::-1]))])
    got = {}
    for r in coverage.cells_of(coverage.select_cells(z, grid)).collect():
        got.setdefault(r["zone_id"], {})[r["row"], r["col"]] = r["fraction"]
    for k in got["a"]:
        assert abs(got["a"][k] - got["b"][k]) < 1e-9 and abs(got["a"][k] - got["c"][k]) < 1e-9
