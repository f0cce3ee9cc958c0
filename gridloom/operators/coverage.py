"""Exact fractional coverage of cells by polygons, as a relation of runs.

For an edge and a row the covered share of a column is an integral of a clamped line. Written as differences between
neighbouring columns it is not zero only at columns that the edge touches, so an edge costs rows by its perimeter;
a running sum from the right restores the shares, and stretches between touched columns are runs of one share.

The default strategy does this in one Arrow kernel for each zone, over bands of rows, without a shuffle: zones are the
small side of every join. ``relational`` does the same with joins, aggregation and a window, so that one zone with a very
long outline is spread over tasks. Polygons that are too thin for doubles are clipped with rational numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.model import SELECTION, Grid
from gridloom.operators import geometry as G

SNAP = 1e-10
BAND = 1 << 18  # crossings that a kernel holds at once, about


def crossings(edges: DataFrame, grid: Grid) -> DataFrame:
    """Edges cut by rows: (zone_id, row, lx, rx, dy), with lx <= rx and dy signed."""
    top, end = F.greatest(F.least("ay", "y1"), F.lit(0.0)), F.least(F.greatest("ay", "y1"), F.lit(float(grid.height)))
    rows = edges.where((F.col("ay") != F.col("y1")) & (top < end)).withColumn("row", F.explode(F.sequence(F.floor(top).cast("int"), (F.ceil(end) - 1).cast("int"))))
    lo = F.greatest(F.col("row").cast("double"), F.least("ay", "y1"))
    hi = F.least(F.col("row") + F.lit(1.0), F.greatest("ay", "y1"))
    x_at = lambda y: F.when(y == F.col("ay"), F.col("ax")).when(y == F.col("y1"), F.col("bx")).otherwise(F.col("ax") + (y - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("y1") - F.col("ay")))
    cut = rows.withColumns({"u": x_at(lo), "w": x_at(hi), "dy": (hi - lo) * F.when(F.col("y1") > F.col("ay"), F.col("factor")).otherwise(-F.col("factor"))})
    return cut.select("zone_id", "row", F.least("u", "w").alias("lx"), F.greatest("u", "w").alias("rx"), "dy")


def left_share():
    """Mean over the crossing of the share of column ``c`` that lies left of the edge (columns lx, rx, c)."""
    c = F.col("c").cast("double")
    a, b = F.greatest(F.col("lx"), c), F.least(F.col("rx"), c + 1.0)
    upright = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("lx") - c))
    slanted = ((b - a) * ((a - c) + (b - c)) / 2.0 + F.greatest(F.lit(0.0), F.col("rx") - (c + 1.0))) / (F.col("rx") - F.col("lx"))
    return F.when(F.col("lx") >= c + 1.0, F.lit(1.0)).when(F.col("rx") <= c, F.lit(0.0)).when(F.col("lx") == F.col("rx"), upright).otherwise(slanted)


def runs(edges: DataFrame, grid: Grid) -> DataFrame:
    """selection (zone_id, row, col_start, col_end, fraction) of edges, clipped to the grid."""
    first, last = F.greatest(F.lit(0), F.least(F.lit(grid.width), F.floor("lx"))), F.greatest(F.lit(-1), F.least(F.lit(grid.width - 1), F.ceil("rx") - 1))
    cut = crossings(edges, grid).withColumns({"first": first.cast("int"), "last": F.greatest(last, first - 1).cast("int")})
    at = cut.withColumn("c", F.explode(F.sequence(F.col("first") - 1, F.col("last")))).where((F.col("c") >= 0) & (F.col("c") < grid.width))
    share = at.withColumn("g", left_share()).withColumn("next", F.when(F.col("c") >= F.col("last"), F.lit(0.0)))
    beyond = share.withColumn("c", F.col("c") + 1).withColumn("h", left_share()).withColumn("c", F.col("c") - 1)
    steps = beyond.withColumn("d", F.col("dy") * (F.col("g") - F.coalesce("next", "h"))).groupBy("zone_id", "row", "c").agg(F.sum("d").alias("d"), F.max(F.col("c") >= F.col("first")).alias("touched"))
    down = Window.partitionBy("zone_id", "row").orderBy(F.desc("c"))
    f = steps.withColumns({"fraction": F.sum("d").over(down.rowsBetween(Window.unboundedPreceding, 0)), "below": F.lead("c").over(down)})
    start = F.coalesce(F.col("below") + 1, F.lit(0))
    snapped = F.when(F.col("fraction") > 1 - SNAP, F.lit(1.0)).when(F.col("fraction") < SNAP, F.lit(0.0)).otherwise(F.col("fraction"))
    alone = F.col("touched") & (start == F.col("c"))
    value = F.when(alone, F.least(F.lit(1.0), F.col("fraction"))).otherwise(snapped)
    return f.select("zone_id", "row", start.cast("int").alias("col_start"), (F.col("c") + 1).cast("int").alias("col_end"), value.alias("fraction")).where((F.col("fraction") > 1e-15) & (F.col("col_end") > F.col("col_start")))


def merged(selection: DataFrame) -> DataFrame:
    """Neighbouring runs of one share become one run (gaps and islands)."""
    w = Window.partitionBy("zone_id", "row").orderBy("col_start")
    new = F.coalesce((F.lag("col_end").over(w) != F.col("col_start")) | (F.lag("fraction").over(w) != F.col("fraction")), F.lit(True))
    island = selection.withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("zone_id", "row", "island").agg(F.min("col_start").alias("col_start"), F.max("col_end").alias("col_end"), F.first("fraction").alias("fraction")).drop("island")


def clip_cells(geometry, grid: Grid) -> list[tuple[int, int, float]]:
    """Coverage by clipping every cell with rational numbers: (row, col, fraction)."""
    out: dict[tuple[int, int], Fraction] = {}
    for part in G.rings(geometry, grid):
        for hole, p in part:
            pts = [(Fraction(x), Fraction(y)) for x, y in p.tolist()]
            sign = (1 if G.area2(p) > 0 else -1) * (-1 if hole else 1)
            xs, ys = [x for x, _ in pts], [y for _, y in pts]
            for r in range(max(0, math.floor(min(ys))), min(grid.height, math.ceil(max(ys)))):
                band = _clip(_clip(pts[:-1], 1, r, True), 1, r + 1, False)
                if not band:
                    continue
                bx = [x for x, _ in band]
                for c in range(max(0, math.floor(min(bx))), min(grid.width, math.ceil(max(bx)))):
                    cell = _clip(_clip(band, 0, c, True), 0, c + 1, False)
                    if a := sign * _area(cell):
                        out[r, c] = out.get((r, c), Fraction(0)) + a
            del xs
    return [(r, c, float(f)) for (r, c), f in sorted(out.items()) if f > 0]


def _clip(pts, axis: int, at: int, above: bool):
    """One side of a half-plane clip along an axis."""
    out = []
    for i, q in enumerate(pts):
        p = pts[i - 1]
        inside_p, inside_q = ((v[axis] >= at) if above else (v[axis] <= at) for v in (p, q))
        if inside_p != inside_q:
            t = (at - p[axis]) / (q[axis] - p[axis])
            other = p[1 - axis] + t * (q[1 - axis] - p[1 - axis])
            out.append((Fraction(at), other) if axis == 0 else (other, Fraction(at)))
        if inside_q:
            out.append(q)
    return out


def _area(pts) -> Fraction:
    return sum((pts[i - 1][0] * q[1] - q[0] * pts[i - 1][1] for i, q in enumerate(pts)), Fraction(0)) / 2


def clipped(zones: DataFrame, grid: Grid, only_thin: bool = False) -> DataFrame:
    """The direct strategy: clip every cell of each zone (or of thin ones alone) exactly."""

    def kernel(it):
        for batch in it:
            pairs = zip(batch.column("zone_id").to_pylist(), batch.column("geometry").to_pylist(), strict=True)
            out = [(z, *cell) for z, g in pairs if not only_thin or G.describe(g, grid)[2] for cell in clip_cells(g, grid)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.int32()), pa.array([r[2] + 1 for r in out], pa.int32()), pa.array([r[3] for r in out], pa.float64())], names=["zone_id", "row", "col_start", "col_end", "fraction"])

    return zones.select("zone_id", "geometry").mapInArrow(kernel, SELECTION)


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, value) of the ranges start .. start + size."""
    owner = np.repeat(np.arange(len(starts)), sizes)
    return owner, np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)


def _share(lx: np.ndarray, rx: np.ndarray, c: np.ndarray) -> np.ndarray:
    """As left_share: what lies left of the edge in column c, in the mean over the crossing."""
    a, b = np.maximum(lx, c), np.minimum(rx, c + 1)
    slanted = ((b - a) * ((a - c) + (b - c)) / 2 + np.maximum(0, rx - (c + 1))) / np.where(rx > lx, rx - lx, 1)
    inside = np.where(lx == rx, np.clip(lx - c, 0, 1), slanted)
    return np.where(lx >= c + 1, 1.0, np.where(rx <= c, 0.0, inside))


def zone_runs(edges: list[tuple], grid: Grid) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, col_start, col_end, fraction) of a zone's edges, in order, a band of rows at a time."""
    e = np.array([x[1:] for x in edges], float).reshape(-1, 5)
    e = e[e[:, 1] != e[:, 3]]
    ax, ay, bx, by, factor = e.T
    low, high = np.maximum(np.minimum(ay, by), 0), np.minimum(np.maximum(ay, by), grid.height)
    first, last = np.floor(low).astype(np.int64), np.ceil(high).astype(np.int64)  # rows first .. last - 1
    keep = low < high
    ax, ay, bx, by, factor, first, last = (v[keep] for v in (ax, ay, bx, by, factor, first, last))
    if not len(ax):
        return
    top, end = int(first.min()), int(last.max())
    step = max(1, BAND // len(ax))
    for r0 in range(top, end, step):
        r1 = min(end, r0 + step)
        start, stop = np.maximum(first, r0), np.minimum(last, r1)
        i, row = _ragged(start, np.maximum(0, stop - start))
        if not len(i):
            continue
        lo, hi = np.maximum(row, np.minimum(ay, by)[i]), np.minimum(row + 1.0, np.maximum(ay, by)[i])
        x_at = lambda y: np.where(y == ay[i], ax[i], np.where(y == by[i], bx[i], ax[i] + (y - ay[i]) * (bx - ax)[i] / (by - ay)[i]))  # noqa: B023, E731
        u, w = x_at(lo), x_at(hi)
        dy = (hi - lo) * np.where(by > ay, factor, -factor)[i]
        lx, rx = np.minimum(u, w), np.maximum(u, w)
        c0 = np.clip(np.floor(lx), 0, grid.width).astype(np.int64)
        c1 = np.maximum(np.clip(np.ceil(rx) - 1, -1, grid.width - 1).astype(np.int64), c0 - 1)
        k, c = _ragged(c0 - 1, c1 - c0 + 2)
        ok = (c >= 0) & (c < grid.width)
        k, c = k[ok], c[ok]
        d = dy[k] * (_share(lx[k], rx[k], c) - np.where(c >= c1[k], 0.0, _share(lx[k], rx[k], c + 1)))
        key = row[k] * (grid.width + 1) + c
        order = np.lexsort((d, -key))  # by row from the last, and from the right; ties in one order
        key, d, touched = key[order], d[order], (c >= c0[k])[order]
        cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        if not len(key):
            continue
        steps, touched = np.add.reduceat(d, cuts), np.logical_or.reduceat(touched, cuts)
        row, c = np.divmod(key[cuts], grid.width + 1)
        new = np.append(True, row[1:] != row[:-1])
        f = _sums_by_row(steps, np.flatnonzero(new))
        below = np.append(c[1:], -1)
        below[np.append(new[1:], True)] = -1
        start = below + 1
        snapped = np.where(f > 1 - SNAP, 1.0, np.where(f < SNAP, 0.0, f))
        value = np.where(touched & (start == c), np.minimum(1.0, f), snapped)
        keep = (value > 1e-15) & (f > 1e-15)
        row, start, end_c, value = row[keep][::-1], start[keep][::-1], c[keep][::-1] + 1, value[keep][::-1]
        if not len(row):
            continue
        join = np.append(False, (row[1:] == row[:-1]) & (start[1:] == end_c[:-1]) & (value[1:] == value[:-1]))  # neighbours of one share
        at = np.flatnonzero(~join)
        yield row[at], start[at], end_c[np.append(at[1:] - 1, len(row) - 1)], value[at]


def _sums_by_row(steps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Running sums that begin anew at ``first``, each row added on its own."""
    size = np.diff(np.append(first, len(steps)))
    out = np.empty(len(steps))
    for n in np.unique(size).tolist():
        at = first[size == n][:, None] + np.arange(n)
        out[at] = np.cumsum(steps[at], axis=1)
    return out


def scanned(zones: DataFrame, grid: Grid) -> DataFrame:
    """The default strategy: one kernel, and exact clipping of thin zones."""

    def kernel(it):
        for batch in it:
            for z, g in zip(batch.column("zone_id").to_pylist(), batch.column("geometry").to_pylist(), strict=True):
                edges, _, thin = G.describe(g, grid)
                bands = [tuple(np.array(x) for x in zip(*((r, c, c + 1, f) for r, c, f in clip_cells(g, grid)), strict=True))] if thin else zone_runs(edges, grid)
                for band in bands:
                    if band:
                        row, start, end, f = band
                        yield pa.RecordBatch.from_arrays([pa.array([z] * len(row), pa.string()), *(pa.array(x.astype(np.int32)) for x in (row, start, end)), pa.array(f.astype(float))], names=["zone_id", "row", "col_start", "col_end", "fraction"])

    return zones.select("zone_id", "geometry").mapInArrow(kernel, SELECTION)


def select_cells(zones: DataFrame, grid: Grid, strategy: str = "scanline", window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """The selection of zones (zone_id, geometry): runs of cells with their covered share.

    window: x, y, width and height; only its cells, with the places and shares that they have in the whole grid.
    """
    if window is not None:
        x, y, width, height = window
        s = select_cells(zones, grid, strategy).where((F.col("row") >= y) & (F.col("row") < y + height) & (F.col("col_end") > x) & (F.col("col_start") < x + width))
        return s.withColumns({"col_start": F.greatest("col_start", F.lit(x)), "col_end": F.least("col_end", F.lit(x + width))})
    if strategy == "direct":
        return merged(clipped(zones, grid))
    if strategy == "scanline":
        return scanned(zones, grid)
    if strategy != "relational":
        raise ValueError("strategy is scanline, relational or direct")
    return merged(runs(G.edges_of(zones, grid, thin=False), grid).unionByName(clipped(zones, grid, only_thin=True)))


def cells_of(selection: DataFrame) -> DataFrame:
    """(zone_id, row, col, fraction) of every selected cell."""
    return selection.select("zone_id", "row", F.explode(F.sequence(F.col("col_start"), F.col("col_end") - 1)).alias("col"), "fraction")


def tiled(selection: DataFrame, edge: int) -> DataFrame:
    """Runs cut at tile borders: (zone_id, ty, tx, row, col_start, col_end, fraction)."""
    tx = F.explode(F.sequence(F.expr(f"col_start div {edge}"), F.expr(f"(col_end - 1) div {edge}")))
    cut = selection.withColumn("tx", tx)
    return cut.select("zone_id", F.expr(f"row div {edge}").alias("ty"), "tx", "row", F.greatest("col_start", F.col("tx") * edge).cast("int").alias("col_start"), F.least("col_end", (F.col("tx") + 1) * edge).cast("int").alias("col_end"), "fraction")


def tile_cover(selection: DataFrame, grid: Grid, edge: int) -> DataFrame:
    """By zone and tile: selected cells, and whether the tile is covered whole."""
    t = tiled(selection, edge)
    cells = F.sum((F.col("col_end") - F.col("col_start")).cast("long"))
    full = F.sum(F.when(F.col("fraction") == 1, (F.col("col_end") - F.col("col_start")).cast("long")).otherwise(0))
    size = F.least(F.lit(edge), F.lit(grid.height) - F.col("ty") * edge) * F.least(F.lit(edge), F.lit(grid.width) - F.col("tx") * edge)
    return t.groupBy("zone_id", "ty", "tx").agg(cells.alias("cells"), full.alias("full")).select("zone_id", "ty", "tx", "cells", (F.col("full") == size).alias("whole"))


def shared_pieces(selection: DataFrame) -> DataFrame:
    """Maximal runs with one set of zones: (row, col_start, col_end, zones). An event sweep along each row."""
    ends = selection.select("row", "zone_id", F.col("col_start").alias("at")).unionByName(selection.select("row", "zone_id", F.col("col_end").alias("at"))).select("row", "at").distinct()
    w = Window.partitionBy("row").orderBy("at")
    pieces = ends.withColumn("to", F.lead("at").over(w)).where("to is not null")
    p, s = pieces.alias("p"), selection.alias("s")
    over = p.join(s, (F.col("p.row") == F.col("s.row")) & (F.col("s.col_start") <= F.col("p.at")) & (F.col("s.col_end") >= F.col("p.to")))
    sets = over.groupBy("p.row", "p.at", "p.to").agg(F.array_join(F.array_sort(F.collect_set("s.zone_id")), ",").alias("zones"))
    w = Window.partitionBy("row").orderBy("at")
    new = F.coalesce((F.lag("to").over(w) != F.col("at")) | (F.lag("zones").over(w) != F.col("zones")), F.lit(True))
    run = sets.withColumn("run", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # a running sum of a window over a window is not allowed in one step
    return run.groupBy("row", "run").agg(F.min("at").alias("col_start"), F.max("to").alias("col_end"), F.first("zones").alias("zones")).drop("run")
