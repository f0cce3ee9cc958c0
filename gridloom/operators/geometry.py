"""GeoJSON polygons: strict parsing, validation without repair, and edges in pixel space."""

from __future__ import annotations

import json
import math
import struct
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.model import MAX_COMPONENTS, MAX_HOLES, MAX_VERTICES, Grid, require

EDGES = "zone_id string, ring int, ax double, ay double, bx double, y1 double, factor double"
ZONES = "zone_id string, polygon_area double, thin boolean"


def rings(geometry: str | dict, grid: Grid) -> list[list[tuple[bool, np.ndarray]]]:
    """Components as lists of (is a hole, vertices in pixel space); rings are closed."""
    g = json.loads(geometry) if isinstance(geometry, str) else geometry
    require(isinstance(g, dict) and g.get("type") in ("Polygon", "MultiPolygon"), "only Polygon and MultiPolygon are supported")
    parts = [g["coordinates"]] if g["type"] == "Polygon" else g["coordinates"]
    require(1 <= len(parts) <= MAX_COMPONENTS, "1..128 components are supported")
    total, out = 0, []
    for part in parts:
        require(1 <= len(part) <= MAX_HOLES + 1, "a component has a shell and at most 128 holes")
        shape = []
        for k, ring in enumerate(part):
            require(len(ring) >= 4 and ring[0] == ring[-1], "a ring is closed and has four positions at least")
            require(all(len(p) == 2 and all(isinstance(v, (int, float)) and math.isfinite(v) for v in p) for p in ring), "positions are two finite numbers")
            total += len(ring)
            require(total <= MAX_VERTICES, "more than 10000 vertices")
            if grid.crs == "EPSG:4326":
                require(all(abs(x) <= 180 and abs(y) <= 85 for x, y in ring), "longitudes to 180 and latitudes to 85 are supported")
                require(all(abs(a[0] - b[0]) <= 180 for a, b in zip(ring, ring[1:], strict=False)), "an edge crosses the antimeridian")
            p = np.array([grid.pixel(x, y) for x, y in ring])
            require(bool((np.abs(p) <= 1e9).all()), "the polygon is too far from the grid")
            shape.append((k > 0, p))
        out.append(shape)
    return out


def area2(p: np.ndarray) -> float:
    """Twice the signed area."""
    q = p - p[0]
    return math.fsum((q[:-1, 0] * q[1:, 1] - q[1:, 0] * q[:-1, 1]).tolist())


def _turn(a, b, c) -> int:
    """Exact orientation of three points."""
    x = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    size = abs((b[0] - a[0]) * (c[1] - a[1])) + abs((b[1] - a[1]) * (c[0] - a[0]))
    if abs(x) > 4e-16 * size:
        return 1 if x > 0 else -1
    a, b, c = ([Fraction(float(v)) for v in p] for p in (a, b, c))
    e = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    return (e > 0) - (e < 0)


def _between(a, b, c) -> bool:
    return min(a[0], b[0]) <= c[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= c[1] <= max(a[1], b[1])


def _meet(p, q, r, s) -> bool:
    a, b, c, d = _turn(p, q, r), _turn(p, q, s), _turn(r, s, p), _turn(r, s, q)
    return (a != b and c != d) or (a == 0 and _between(p, q, r)) or (b == 0 and _between(p, q, s)) or (c == 0 and _between(r, s, p)) or (d == 0 and _between(r, s, q))


def _inside(p: np.ndarray, ring: np.ndarray) -> bool:
    x, y = p
    a, b = ring[:-1], ring[1:]
    cross = (a[:, 1] > y) != (b[:, 1] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = a[:, 0] + (y - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])
    return bool((cross & (at > x)).sum() % 2)


def validate(parts: list[list[tuple[bool, np.ndarray]]]) -> None:
    """Refuse rings without area, rings that touch themselves or each other, and misplaced holes or components."""
    flat = [(c, k, p) for c, part in enumerate(parts) for k, (_, p) in enumerate(part)]
    require(all(area2(p) != 0 for _, _, p in flat), "a ring has no area")
    a = np.concatenate([p[:-1] for _, _, p in flat])
    b = np.concatenate([p[1:] for _, _, p in flat])
    ring = np.repeat(np.arange(len(flat)), [len(p) - 1 for _, _, p in flat])
    first = np.cumsum([0, *(len(p) - 1 for _, _, p in flat)])
    require(not (a == b).all(1).any(), "a position is repeated")
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.argsort(low[:, 1], kind="stable")
    ys = low[order, 1]
    for k, i in enumerate(order.tolist()):  # edges that begin below this one's top
        j = order[k + 1 : np.searchsorted(ys, high[i, 1], "right")]
        j = j[(low[j, 0] <= high[i, 0]) & (high[j, 0] >= low[i, 0])]
        for m in j.tolist():
            if ring[m] == ring[i]:
                n = first[ring[i] + 1] - first[ring[i]]
                gap = abs(m - i)
                if gap in (1, n - 1):  # neighbours meet in their common end alone
                    u, v = (i, m) if (m - i) % n == 1 else (m, i)
                    if n > 2 and _turn(a[u], b[u], b[v]) == 0 and float(np.dot(b[u] - a[u], b[v] - a[v])) < 0:
                        require(False, "a ring turns back on itself")
                    continue
            require(not _meet(a[i], b[i], a[m], b[m]), "rings touch or cross")
    shells = [part[0][1] for part in parts]
    for c, part in enumerate(parts):
        for k, (_, hole) in enumerate(part[1:]):
            require(_inside(hole[0], part[0][1]), "a hole lies outside its shell")
            require(not any(_inside(hole[0], other) for m, (_, other) in enumerate(part[1:]) if m != k), "holes overlap")
    for i, s in enumerate(shells):
        for j, t in enumerate(shells):
            if i != j and _inside(s[0], t):
                require(any(_inside(s[0], h) for _, h in parts[j][1:]), "components overlap")


def describe(geometry: str | dict, grid: Grid) -> tuple[list[tuple], float, bool]:
    """Edges (ring, ax, ay, bx, y1, factor), area in cells, and whether the polygon is too thin for plain doubles."""
    parts = rings(geometry, grid)
    validate(parts)
    edges, area, around, number = [], 0.0, 0.0, 0
    for part in parts:
        for hole, p in part:
            twice = area2(p)
            sign = (1.0 if twice > 0 else -1.0) * (-1.0 if hole else 1.0)
            area += (-1.0 if hole else 1.0) * abs(twice) / 2
            around += float(np.hypot(*(p[1:] - p[:-1]).T).sum())
            edges += [(number, ax, ay, bx, by, sign) for (ax, ay), (bx, by) in zip(p[:-1].tolist(), p[1:].tolist(), strict=True)]
            number += 1
    return edges, area, area < 1e-4 or area < around * 1e-7


def edges_of(zones: DataFrame, grid: Grid, thin: bool = True) -> DataFrame:
    """Edges in pixel space of zones (zone_id, geometry), or of those that are not too thin. An invalid polygon fails the job."""

    def kernel(it):
        for batch in it:
            out = []
            for z, g in zip(batch.column("zone_id").to_pylist(), batch.column("geometry").to_pylist(), strict=True):
                edges, _, is_thin = describe(g, grid)
                out += [(z, *e) for e in edges] if thin or not is_thin else []
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int32()), *(pa.array([r[i] for r in out], pa.float64()) for i in range(2, 7))], names=[x.split()[0] for x in EDGES.split(", ")])

    return zones.select("zone_id", "geometry").mapInArrow(kernel, EDGES)


def zone_facts(zones: DataFrame, grid: Grid) -> DataFrame:
    """zone_id, polygon_area in cells, thin."""

    def kernel(it):
        for batch in it:
            out = [describe(g, grid)[1:] for g in batch.column("geometry").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("zone_id"), pa.array([a for a, _ in out], pa.float64()), pa.array([t for _, t in out], pa.bool_())], names=["zone_id", "polygon_area", "thin"])

    return zones.select("zone_id", "geometry").mapInArrow(kernel, ZONES)


def to_wkb(geometry: str | dict, grid: Grid) -> bytes:
    """Little-endian well-known binary in the submitted coordinates, after the same validation."""
    validate(rings(geometry, grid))
    g = json.loads(geometry) if isinstance(geometry, str) else geometry
    ring = lambda r: struct.pack("<I", len(r)) + b"".join(struct.pack("<dd", *p) for p in r)
    polygon = lambda part: struct.pack("<BII", 1, 3, len(part)) + b"".join(map(ring, part))
    return polygon(g["coordinates"]) if g["type"] == "Polygon" else struct.pack("<BII", 1, 6, len(g["coordinates"])) + b"".join(map(polygon, g["coordinates"]))


def classify(parts: list[list[tuple[bool, np.ndarray]]], x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> np.ndarray:
    """``inside``, ``outside`` or ``boundary`` for rectangles in pixel space: on the boundary if an edge may meet the rectangle.

    The rectangle is widened by a guard, so that a doubtful one is on the boundary and never inside.
    """
    flat = [p for part in parts for _, p in part]
    a, b = np.concatenate([p[:-1] for p in flat]), np.concatenate([p[1:] for p in flat])
    guard = 1e-9 * np.maximum(1.0, np.abs(np.concatenate([a, b])).max())
    out = np.empty(len(x0), object)
    for i, (l, t, r, d) in enumerate(zip(x0 - guard, y0 - guard, x1 + guard, y1 + guard, strict=True)):
        near = (np.minimum(a[:, 0], b[:, 0]) <= r) & (np.maximum(a[:, 0], b[:, 0]) >= l) & (np.minimum(a[:, 1], b[:, 1]) <= d) & (np.maximum(a[:, 1], b[:, 1]) >= t)
        p, q = a[near], b[near]
        side = (q[:, 0] - p[:, 0])[:, None] * (np.array([t, t, d, d]) - p[:, 1][:, None]) - (q[:, 1] - p[:, 1])[:, None] * (np.array([l, r, l, r]) - p[:, 0][:, None])
        if ((side.min(1) <= 0) & (side.max(1) >= 0)).any():  # the edge's line parts the corners
            out[i] = "boundary"
        else:
            centre = np.array([(l + r) / 2, (t + d) / 2])
            out[i] = "inside" if any(_inside(centre, part[0][1]) and not any(_inside(centre, h) for _, h in part[1:]) for part in parts) else "outside"
    return out


def tile_classes(zones: DataFrame, grid: Grid, edge: int) -> DataFrame:
    """(zone_id, ty, tx, class) of the tiles in each zone's box that are not outside."""

    def kernel(it):
        for batch in it:
            for z, g in zip(batch.column("zone_id").to_pylist(), batch.column("geometry").to_pylist(), strict=True):
                parts = rings(g, grid)
                validate(parts)
                every = np.concatenate([p for part in parts for _, p in part])
                low, high = np.floor(every.min(0) / edge).astype(int), np.ceil(every.max(0) / edge).astype(int)
                tx = np.arange(max(0, low[0]), min(-(-grid.width // edge), high[0]))
                ty = np.arange(max(0, low[1]), min(-(-grid.height // edge), high[1]))
                ty, tx = (v.ravel() for v in np.meshgrid(ty, tx, indexing="ij"))
                kind = classify(parts, tx * edge, ty * edge, np.minimum((tx + 1) * edge, grid.width), np.minimum((ty + 1) * edge, grid.height))
                keep = kind != "outside"
                n = int(keep.sum())
                yield pa.RecordBatch.from_arrays([pa.array([z] * n, pa.string()), pa.array(ty[keep].astype(np.int64)), pa.array(tx[keep].astype(np.int64)), pa.array(kind[keep].tolist(), pa.string())], names=["zone_id", "ty", "tx", "class"])

    return zones.select("zone_id", "geometry").mapInArrow(kernel, "zone_id string, ty long, tx long, class string")
