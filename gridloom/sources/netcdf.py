"""Variables of classic NetCDF files (CDF-1, CDF-2, CDF-5) as rasters.

The last two dimensions are latitude and longitude (or y and x), with 1-D coordinate variables that step evenly; leading
dimensions become bands. The file's header is read by ranges; samples are cut out of Spark's ``binaryFile`` source by rows
and decoded in tasks, so any store that Spark reads will do (files of up to 2 GB).
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.model import SOURCE_BANDS, Grid, require
from gridloom.sources import files

# External types by number, as big-endian NumPy types.
TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12
CHUNK = 1 << 20


@dataclass
class Variable:
    dims: list[str]
    shape: list[int]
    kind: np.dtype
    begin: int
    step: int  # bytes from one record to the next, 0 for a variable of fixed size
    attributes: dict


class Header:
    def __init__(self, data):
        magic = files.piece(data, 0, 4)
        require(magic[:3] == b"CDF" and magic[3] in (1, 2, 5), "not a classic NetCDF file")
        self.data, self.at = data, 4
        self.count = ">Q" if magic[3] == 5 else ">I"
        self.offset = ">I" if magic[3] == 1 else ">Q"
        records = self.number()
        self._list(DIMENSIONS)
        dims = [(self.name(), self.number()) for _ in range(self.n)]
        self.attributes = self._attributes()
        self._list(VARIABLES)
        raw = []
        for _ in range(self.n):
            name, rank = self.name(), self.number()
            ids = [self.number() for _ in range(rank)]
            attributes, kind, size = self._attributes(), self.take(">I"), self.number()
            raw.append((name, ids, attributes, np.dtype(TYPES[kind]), size, self.take(self.offset)))
        is_record = lambda ids: bool(ids) and dims[ids[0]][1] == 0
        each = sum(size for _, ids, _, _, size, _ in raw if is_record(ids))
        self.variables = {
            name: Variable([dims[i][0] for i in ids], [dims[i][1] or records for i in ids], kind, begin, each if is_record(ids) else 0, attributes)
            for name, ids, attributes, kind, size, begin in raw
        }

    def take(self, form: str):
        value = files.unpack(self.data, form, self.at)[0]
        self.at += struct.calcsize(form)
        return value

    def number(self) -> int:
        return self.take(self.count)

    def bytes(self, n: int) -> bytes:
        out = files.piece(self.data, self.at, n) if n else b""
        self.at += -(-n // 4) * 4
        return out

    def name(self) -> str:
        return self.bytes(self.number()).decode()

    def _list(self, tag: int) -> None:
        found, self.n = self.take(">I"), self.number()
        require(found in (0, tag) and (found or not self.n), "the file's header is damaged")

    def _attributes(self) -> dict:
        self._list(ATTRIBUTES)
        out = {}
        for _ in range(self.n):
            name, kind, n = self.name(), np.dtype(TYPES[self.take(">I")]), self.number()
            raw = self.bytes(n * kind.itemsize)
            out[name] = raw.decode("utf-8", "replace") if kind.kind == "S" else np.frombuffer(raw, kind).tolist()
        return out

    def values(self, name: str) -> np.ndarray:
        """A small variable whole."""
        v = self.variables[name]
        require(not v.step and len(v.shape) == 1, "a coordinate is a vector of fixed size")
        return np.frombuffer(files.piece(self.data, v.begin, v.shape[0] * v.kind.itemsize), v.kind).astype(float)


def _axis(x: np.ndarray) -> tuple[float, float]:
    """(start of the first cell, signed step) of evenly spaced centres, within a few units of rounding."""
    require(len(x) > 1 and np.isfinite(x).all(), "a coordinate needs two finite values")
    step = (x[-1] - x[0]) / (len(x) - 1)
    slack = 32 * np.spacing(np.abs(x).max()) if x.dtype == float else 0
    require(step != 0 and np.abs(x - (x[0] + step * np.arange(len(x)))).max() <= max(slack, abs(step) * 1e-6), "coordinates do not step evenly")
    return float(x[0] - step / 2), float(step)


def load(spark: SparkSession, path: str, variable: str, crs: str | None = None) -> tuple[Grid, DataFrame, dict, int]:
    """(grid, raw samples, attributes, bands) of a variable."""
    head = Header(files.Ranges(spark, path))
    require(variable in head.variables, "no such variable")
    v = head.variables[variable]
    require(len(v.shape) >= 2 and v.kind.kind in "iuf", "a numeric variable with at least two dimensions is required")
    require(all(d in head.variables for d in v.dims[-2:]), "the last two dimensions need coordinates")
    height, width = v.shape[-2:]
    bands = math.prod(v.shape[:-2])
    require(1 <= bands <= SOURCE_BANDS, "1..64 bands")
    (x0, dx), (y0, dy) = _axis(head.values(v.dims[-1])), _axis(head.values(v.dims[-2]))
    require(dx > 0, "longitudes must ascend")
    if crs is None:
        units = str(head.variables[v.dims[-1]].attributes.get("units", ""))
        require(units.startswith("degree"), "a CRS is required")
        crs = "EPSG:4326"
    if crs == "EPSG:4326" and x0 >= 180 - 1e-9:
        x0 -= 360
    flip = dy > 0
    grid = Grid(width, height, (x0, dx, 0.0, y0 + dy * height if flip else y0, 0.0, -abs(dy)), crs)
    row = width * v.kind.itemsize
    high = max(1, CHUNK // row)
    inner = math.prod(v.shape[1:-2]) if v.step else bands
    parts = []
    for b in range(bands):
        start = v.begin + (b // inner * v.step + b % inner * height * row if v.step else b * height * row)
        parts += [(b, y, min(high, height - y), start + y * row) for y in range(0, height, high)]
    blocks = spark.createDataFrame(parts, "band int, y int, h int, at long")
    content = spark.read.format("binaryFile").load(path).select("content")
    cut = content.crossJoin(F.broadcast(blocks)).select("band", "y", "h", F.substr("content", F.col("at") + 1, (F.col("h") * row).cast("long")).alias("raw"))  # one file
    kind = v.kind

    def kernel(it):
        for batch in it:
            for r in batch.to_pylist():
                a = np.frombuffer(r["raw"], kind, r["h"] * width).astype(float)
                y, x = np.divmod(np.arange(len(a)), width)
                y = y + r["y"]
                n = len(a)
                yield pa.RecordBatch.from_arrays([pa.array((height - 1 - y if flip else y).astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(np.full(n, r["band"], np.int32)), pa.array(a), pa.array(np.full(n, 255, np.int32))], names=["row", "col", "band", "sample", "mask"])

    raw = cut.repartition("band", "y").mapInArrow(kernel, "row int, col int, band int, sample double, mask int")
    a = v.attributes
    nodata = a.get("_FillValue", a.get("missing_value", [None]))[0]
    return grid, raw, {"nodata": None if nodata is None else float(nodata), "scale": float(a.get("scale_factor", [1.0])[0]), "offset": float(a.get("add_offset", [0.0])[0])}, bands
