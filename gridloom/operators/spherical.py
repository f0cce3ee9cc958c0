"""Mass of nonnegative values by spherical area along straight longitude/latitude edges.

The share of a cell is the spherical area of the clipped polygon over the cell's. Clipping is rational; each clipped piece
is a fan of triangles whose exact planar areas are weighted with the mean cosine of latitude, so slivers keep their
relative precision. A share of 1 - 1e-10 or more counts as a whole cell.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import numerics
from gridloom.model import Grid, require
from gridloom.operators import coverage
from gridloom.operators import geometry as G

SNAP = 1 - 1e-10
# Barycentric points and weights of a quadrature of degree 5 on a triangle (Radon).
_A, _B = (6 - math.sqrt(15)) / 21, (6 + math.sqrt(15)) / 21
_QUAD = [((1 / 3, 1 / 3, 1 / 3), 9 / 40)] + [(p, (155 - math.sqrt(15)) / 1200) for p in ((_A, _A, 1 - 2 * _A), (_A, 1 - 2 * _A, _A), (1 - 2 * _A, _A, _A))] + [(p, (155 + math.sqrt(15)) / 1200) for p in ((_B, _B, 1 - 2 * _B), (_B, 1 - 2 * _B, _B), (1 - 2 * _B, _B, _B))]


def weighted_area(points, latitude) -> float:
    """Signed integral of cos(latitude) over a polygon in cells; ``latitude`` maps a cell row ordinate to radians."""
    total = []
    a = points[0]
    for b, c in zip(points[1:], points[2:], strict=False):
        twice = (b[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (b[1] - a[1])
        if twice:
            ys = (float(a[1]), float(b[1]), float(c[1]))
            mean = sum(w * math.cos(latitude(sum(q * y for q, y in zip(p, ys, strict=True)))) for p, w in _QUAD)
            total.append(float(twice) / 2 * mean)
    return math.fsum(total)


def shares(geometry, grid: Grid, clip_to_grid: bool = True) -> list[tuple[int, int, float]]:
    """(row, col, share) of each cell that the polygon touches."""
    from fractions import Fraction

    t = grid.transform
    latitude = lambda py: math.radians(t[3] + py * t[5])
    out: dict[tuple[int, int], float] = {}
    for part in G.rings(geometry, grid):
        for hole, p in part:
            pts = [(Fraction(x), Fraction(y)) for x, y in p.tolist()][:-1]
            sign = (1 if G.area2(p) > 0 else -1) * (-1 if hole else 1)
            ys = [y for _, y in pts]
            rows = range(max(0, math.floor(min(ys))), min(grid.height, math.ceil(max(ys)))) if clip_to_grid else range(math.floor(min(ys)), math.ceil(max(ys)))
            for r in rows:
                band = coverage._clip(coverage._clip(pts, 1, r, True), 1, r + 1, False)
                if not band:
                    continue
                xs = [x for x, _ in band]
                cell = (math.sin(latitude(r)) - math.sin(latitude(r + 1))) / math.radians(-t[5])
                cols = range(max(0, math.floor(min(xs))), min(grid.width, math.ceil(max(xs)))) if clip_to_grid else range(math.floor(min(xs)), math.ceil(max(xs)))
                for c in cols:
                    piece = coverage._clip(coverage._clip(band, 0, c, True), 0, c + 1, False)
                    if len(piece) > 2:
                        out[r, c] = out.get((r, c), 0.0) + sign * weighted_area(piece, latitude) / cell
    return [(r, c, 1.0 if f >= SNAP else f) for (r, c), f in sorted(out.items()) if f > 0]


def footprint(geometry, grid: Grid) -> float:
    """Share of the polygon's spherical area that lies within the grid."""
    t = grid.transform
    row_area = lambda r: math.sin(math.radians(t[3] + r * t[5])) - math.sin(math.radians(t[3] + (r + 1) * t[5]))
    inside = math.fsum(f * row_area(r) for r, _, f in shares(geometry, grid))
    whole = math.fsum(f * row_area(r) for r, _, f in shares(geometry, grid, False))
    return min(1.0, inside / whole) if whole else 0.0


def spherical_mass(cells: DataFrame, zones: DataFrame, grid: Grid) -> DataFrame:
    """By slice and zone: mass, pixel counts and footprint. Cells below zero or not valid carry no mass."""
    require(grid.crs.upper() == "EPSG:4326", "the spherical policy needs EPSG:4326")
    t = grid.transform
    require(-180 <= t[0] and t[0] + grid.width * t[1] <= 180 and t[3] <= 85 and t[3] + grid.height * t[5] >= -85, "the grid is outside the supported extent")

    def kernel(it):
        for batch in it:
            out = []
            for z, g in zip(batch.column("zone_id").to_pylist(), batch.column("geometry").to_pylist(), strict=True):
                G.validate(G.rings(g, grid))
                out += [(z, *cell, None) for cell in shares(g, grid)] + [(z, None, None, None, footprint(g, grid))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64()))], names=["zone_id", "row", "col", "f", "footprint"])

    found = zones.select("zone_id", "geometry").mapInArrow(kernel, "zone_id string, row int, col int, f double, footprint double").persist()
    prints = found.where("row is null").select("zone_id", "footprint")
    share = found.where("row is not null").drop("footprint")
    whole, part = (F.when(F.col("f") == 1, 1.0), 0), (F.when(F.col("f") < 1, 1.0), 0)
    area = numerics.gather(share, ["zone_id"], [[whole], [part], [(F.col("f"), 0)]]).withColumn("r", numerics.rounded(F.col("parts"), 3))
    area = area.select("zone_id", F.col("r")[0].cast("long").alias("fullPixelCount"), F.col("r")[1].cast("long").alias("boundaryPixelCount"), F.col("r")[2].alias("coveredPixelEquivalent"))
    ok = F.col("valid") & (F.col("value") >= 0)
    hit = cells.where("band = 0").join(share, ["row", "col"])
    mass = numerics.gather(hit, ["slice_id", "zone_id"], [[(F.when(ok, F.col("value") * F.col("f")), 0)], [(F.when(ok, F.col("f")), 0)]]).withColumn("r", numerics.rounded(F.col("parts"), 2))
    mass = mass.select("slice_id", "zone_id", F.col("r")[0].alias("mass"), F.col("r")[1].alias("validPopulationPixelEquivalent"))
    frame = prints.crossJoin(F.broadcast(cells.select("slice_id").distinct()))  # the rows of the result; at most 4096 slices
    out = frame.join(area, "zone_id", "left").join(mass, ["slice_id", "zone_id"], "left")
    return out.select("slice_id", "zone_id", F.coalesce("mass", F.lit(0.0)).alias("mass"), F.coalesce("coveredPixelEquivalent", F.lit(0.0)).alias("coveredPixelEquivalent"), F.coalesce("validPopulationPixelEquivalent", F.lit(0.0)).alias("validPopulationPixelEquivalent"), F.coalesce("fullPixelCount", F.lit(0)).alias("fullPixelCount"), F.coalesce("boundaryPixelCount", F.lit(0)).alias("boundaryPixelCount"), F.col("footprint").alias("footprintCoverageFraction"))
