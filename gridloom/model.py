"""Grid and schema definitions, limits and strict validation of requests."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import dataclass

from pyspark.sql import types as T

# Limits of requests.
MAX_DIM = 10_000_000
MAX_CRS_BYTES = 4096
MAX_VERTICES = 10_000
MAX_COMPONENTS = MAX_HOLES = 128
MAX_ZONES = MAX_SLICES = MAX_PAGE = 4096
MAX_EDGES, MAX_CATEGORIES, MAX_QUANTILES = 257, 256, 32
TILE_EDGES = (32, 64, 128, 256, 512)
RESIDENT_BANDS, SOURCE_BANDS = 20, 64

CELLS = T.StructType([
    T.StructField("slice_id", T.StringType()), T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()),
    T.StructField("band", T.IntegerType()), T.StructField("value", T.DoubleType()), T.StructField("valid", T.BooleanType()),
])
SELECTION = "zone_id string, row int, col_start int, col_end int, fraction double"


class RequestError(ValueError):
    """A request that is refused, never repaired."""


def require(ok: bool, message: str) -> None:
    if not ok:
        raise RequestError(message)


def fields(value: dict, allowed: tuple[str, ...], required: tuple[str, ...] = ()) -> dict:
    """Closed records: unknown fields are refused, required ones must be there."""
    require(isinstance(value, dict), "an object is expected")
    unknown = sorted(set(value) - set(allowed))
    require(not unknown, f"unknown fields: {', '.join(unknown)}")
    missing = sorted(set(required) - set(value))
    require(not missing, f"missing fields: {', '.join(missing)}")
    return value


@dataclass(frozen=True)
class Grid:
    """A north-up grid: cell (row, col) spans x0 + col*dx .. and y0 - row*dy .. ."""

    width: int
    height: int
    transform: tuple[float, float, float, float, float, float]
    crs: str

    def __post_init__(self):
        t = self.transform
        require(0 < len(self.crs.encode()) <= MAX_CRS_BYTES, "name the CRS, in 4096 bytes at most")
        require(len(t) == 6 and all(map(math.isfinite, t)), "a grid is placed by six finite coefficients")
        require(t[2] == t[4] == 0 and t[1] > 0 > t[5], "columns run east and rows south; rotated grids are refused")
        require(t[0] + t[1] != t[0] and t[3] + t[5] != t[3], "cells are too small for so distant an origin")
        for name, n in (("width", self.width), ("height", self.height)):
            require(isinstance(n, int) and 0 < n <= MAX_DIM, f"{name} is a number of cells, ten million at most")

    @classmethod
    def of(cls, value: dict) -> Grid:
        fields(value, ("width", "height", "transform", "crs"), ("width", "height", "transform", "crs"))
        return cls(value["width"], value["height"], tuple(float(v) for v in value["transform"]), value["crs"])

    @classmethod
    def local(cls, width: int, height: int) -> Grid:
        """Unit cells whose pixel coordinates are (x, height - y)."""
        return cls(width, height, (0.0, 1.0, 0.0, float(height), 0.0, -1.0), "LOCAL")

    def record(self) -> dict:
        return {"width": self.width, "height": self.height, "transform": list(self.transform), "crs": self.crs}

    def identity(self) -> str:
        return hashlib.sha256(json.dumps(self.record(), sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    def pixel(self, x: float, y: float) -> tuple[float, float]:
        t = self.transform
        return (x - t[0]) / t[1], (y - t[3]) / t[5]

    def world(self, px: float, py: float) -> tuple[float, float]:
        t = self.transform
        return t[0] + px * t[1], t[3] + py * t[5]


BASIC = ("sum", "support", "mean", "min", "max", "count")
EXTENDED = (
    "histogram", "weighted_sum", "weight_sum", "weighted_mean", "variance", "stddev", "weighted_variance", "weighted_stddev",
    "categories", "majority", "variety", "median", "quantiles", "weighted_median", "weighted_quantiles",
)
COLUMN = {"sum": "fractional_sum", "support": "covered_cell_equivalents", "count": "valid_cell_count", "mean": "coverage_weighted_mean"}


@dataclass(frozen=True)
class Options:
    """What to compute. Parameters and statistics must agree: unused parameters are refused."""

    bands: tuple[int, ...] = ()
    statistics: tuple[str, ...] | None = None
    histogram_edges: tuple[float, ...] | None = None
    weight_band: int | None = None
    category_values: tuple[float, ...] | None = None
    quantiles: tuple[float, ...] | None = None
    quantile_max_samples: int = 65_536

    def __post_init__(self):
        s = self.statistics
        require(len(set(self.bands)) == len(self.bands) and all(isinstance(b, int) and b >= 0 for b in self.bands), "bands must be distinct and not negative")
        if s is not None:
            require(len(s) > 0 and len(set(s)) == len(s), "statistics must be distinct and not empty")
            unknown = [x for x in s if x not in BASIC + EXTENDED]
            require(not unknown, f"unknown statistics: {unknown}")
        want = set(s or ())
        weighted = {x for x in want if x.startswith("weight")}
        e = self.histogram_edges
        if e is not None:
            require(2 <= len(e) <= MAX_EDGES and all(map(math.isfinite, e)) and all(a < b for a, b in zip(e, e[1:], strict=False)), "histogram_edges must be 2..257 strictly increasing numbers")
            require(s is None or "histogram" in want, "histogram_edges without the histogram statistic")
        require("histogram" not in want or e is not None, "histogram needs histogram_edges")
        require(not weighted or self.weight_band is not None, "weighted statistics need weight_band")
        require(self.weight_band is None or s is None or bool(weighted), "weight_band without a weighted statistic")
        c, by_class = self.category_values, {"categories", "majority", "variety"} & want
        if c is not None:
            require(1 <= len(c) <= MAX_CATEGORIES and all(map(math.isfinite, c)) and all(a < b for a, b in zip(c, c[1:], strict=False)), "category_values must be 1..256 strictly increasing numbers")
        require(bool(by_class) == (c is not None), "category_values and categorical statistics belong together")
        q, by_rank = self.quantiles, {"quantiles", "weighted_quantiles"} & want
        if q is not None:
            require(1 <= len(q) <= MAX_QUANTILES and all(0 <= p <= 1 for p in q) and all(a < b for a, b in zip(q, q[1:], strict=False)), "quantiles must be 1..32 strictly increasing probabilities")
        require(bool(by_rank) == (q is not None), "quantiles and the quantile statistics belong together")
        require(1 <= self.quantile_max_samples <= 1_000_000, "quantile_max_samples must be 1..1000000")

    @classmethod
    def of(cls, value: dict | None) -> Options:
        value = fields(value or {}, ("bands", "statistics", "histogram_edges", "weight_band", "category_values", "quantiles", "quantile_max_samples"))
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in value.items()})

    def wants(self, statistic: str) -> bool:
        if self.statistics is not None:
            return statistic in self.statistics
        if statistic == "histogram":
            return self.histogram_edges is not None
        if statistic in ("weighted_sum", "weight_sum", "weighted_mean"):
            return self.weight_band is not None
        return statistic in BASIC

    def summary_eligible(self) -> bool:
        """Stored sums, counts and extrema can answer."""
        return self.histogram_edges is None and self.weight_band is None and all(s in BASIC for s in self.statistics or ())
