"""Numerical policies on explicit selections: ordered left folds, and the strict reduction of caller arrays.

Ordered: a left fold within each window by position, then a left fold of the windows' partial sums. The fold is an expression
over a position-sorted array, so the result does not depend on how rows were dealt. Windows are bounded requests (see
LIMIT), which bounds the arrays. The strict policy sums exactly and gathers nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import numerics
from gridloom.functions.numerics import left_fold
from gridloom.model import require

# Request limits, and the order in which each policy excludes values.
LIMIT = 268_435_456
MAX_POLYGONS, MAX_WINDOWS = 256, 4096
ORDERED_SOURCE = ("nonfinite", "nodata", "negative")
ORDERED_BULK = ("mask", "nodata", "nonfinite", "negative")
STRICT_BULK = ("mask", "nodata")


def admit(request: dict) -> dict:
    """Check an ordered request; polygons with windows of ascending indexes or disjoint runs. Returns its facts."""
    polygons = request.get("polygons", [])
    require(1 <= len(polygons) <= MAX_POLYGONS, "1..256 polygons")
    require(len({p["id"] for p in polygons}) == len(polygons), "polygon ids must be distinct")
    windows = cells = 0
    box = None
    for p in polygons:
        for w in p["windows"]:
            windows += 1
            x, y, width, height = w["window"]
            require(width > 0 and height > 0 and x >= 0 and y >= 0, "a window has no cells")
            require(("indexes" in w) != ("runs" in w), "a window has indexes or runs")
            before = cells
            if "indexes" in w:
                ix = w["indexes"]
                require(all(a < b for a, b in zip(ix, ix[1:], strict=False)) and all(0 <= i < width * height for i in ix), "indexes must ascend within the window")
                cells += len(ix)
            else:
                end = 0
                for a, b in w["runs"]:
                    require(end <= a < b <= width * height, "runs must be disjoint, ascending and within the window")
                    cells, end = cells + b - a, b
            if cells > before:
                box = [x, y, x + width, y + height] if box is None else [min(box[0], x), min(box[1], y), max(box[2], x + width), max(box[3], y + height)]
    bands = request.get("bands") or [0]
    require(windows <= MAX_WINDOWS and cells * len(bands) <= LIMIT, "the request is too large")
    envelope = None if box is None else [box[0], box[1], box[2] - box[0], box[3] - box[1]]
    return {"selected_bands": bands, "polygon_count": len(polygons), "window_count": windows, "selected_cells": cells, "selected_contributions": cells * len(bands), "window_envelope": envelope, "envelope_cells": envelope[2] * envelope[3] if envelope else 0}


def selection_rows(spark, request: dict) -> DataFrame:
    """(polygon_id, window_no, row, first, size, start, end, x, y, width) runs of a request; indexes become runs of one."""
    rows = []
    for p in request["polygons"]:
        for k, w in enumerate(p["windows"]):
            x, y, width, _ = w["window"]
            runs = w["runs"] if "runs" in w else [(i, i + 1) for i in w["indexes"]]
            rows += [(p["id"], k, x, y, width, a, b) for a, b in runs]
    return spark.createDataFrame(rows, "polygon_id string, window_no int, x int, y int, width int, start long, end long")


def chosen(cells: DataFrame, runs: DataFrame) -> DataFrame:
    """Raw values of the selected positions: (polygon_id, window_no, band, pos, value, mask), joined on (row, col)."""
    at = runs.withColumn("pos", F.explode(F.sequence(F.col("start"), F.col("end") - 1)))
    at = at.select("polygon_id", "window_no", "pos", (F.col("y") + F.expr("pos div width")).cast("int").alias("row"), (F.col("x") + F.col("pos") % F.col("width")).cast("int").alias("col"))
    return at.join(cells, ["row", "col"])


def reason(order: tuple[str, ...], nodata: float | None) -> Column:
    """Why a value is excluded, or null; the first test in the order that holds is charged."""
    v = F.col("value").cast("double")
    tests = {
        "mask": ~F.coalesce(F.col("mask"), F.lit(True)),
        "nodata": F.lit(False) if nodata is None else (F.isnan(v) if math.isnan(nodata) else v == F.lit(float(nodata))),
        "nonfinite": v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(math.inf)),
        "negative": v < 0,
    }
    out = F.lit(None).cast("string")
    for name in reversed(order):
        out = F.when(tests[name], name).otherwise(out)
    return out


def ordered_sums(rows: DataFrame, keys: list[str], nodata: float | None = None, order: tuple[str, ...] = ORDERED_SOURCE) -> DataFrame:
    """keys, sum, valid_count and exclusion counters. rows: keys, window_no, pos, value, and mask if the order uses it."""
    r = rows.withColumn("why", reason(order, nodata))
    kept = F.when(F.col("why").isNull(), F.struct("pos", F.col("value").cast("double").alias("v")))
    counters = [F.count_if(F.col("why") == n).alias(f"excluded_{n}") for n in order]
    part = r.groupBy(*keys, "window_no").agg(F.array_sort(F.collect_list(kept)).alias("a"), *counters)
    part = part.withColumns({"s": left_fold(F.transform("a", lambda x: x["v"])), "n": F.size("a").cast("long")})
    total = part.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("window_no", "s"))).alias("w"), F.sum("n").alias("valid_count"), *(F.sum(f"excluded_{n}").alias(f"excluded_{n}") for n in order))
    return total.withColumn("sum", left_fold(F.transform("w", lambda x: x["s"]))).drop("w")


def spans(selections: DataFrame) -> DataFrame:
    """Explode spans (window_no, start, count) to selected positions; repeats are kept, in order ``seq``."""
    return selections.select("window_no", F.posexplode(F.sequence(F.col("start"), F.col("start") + F.col("count") - 1)).alias("k", "idx"), "span_no").select("window_no", "idx", (F.col("span_no") * F.lit(1 << 32) + F.col("k")).alias("pos"))


def bulk_reduce(values: DataFrame, selection: DataFrame | None = None, policy: str = "strict_selected_v1", nodata: float | None = None) -> DataFrame:
    """By band_id: sum, min, max, mean, valid_count and counters, of caller arrays.

    values: band_id, window_no, idx, value, mask (optional). selection: window_no, idx, pos; all values if not given;
    a position that is selected twice counts twice. Strict: a valid value that is not finite fails.
    """
    rows = values if "mask" in values.columns else values.withColumn("mask", F.lit(True))
    rows = rows.join(selection, ["window_no", "idx"]) if selection is not None else rows.withColumn("pos", F.col("idx").cast("long"))
    if policy != "strict_selected_v1":
        require(policy == "ordered_v1", "unknown policy")
        return ordered_sums(rows, ["band_id"], nodata, ORDERED_BULK)
    r = rows.withColumn("why", reason(STRICT_BULK, nodata))
    v = F.col("value").cast("double")
    fine = F.when(F.col("why").isNull(), F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(math.inf)), v).otherwise(F.raise_error(F.lit("a selected value is not finite")).cast("double")))
    r = r.withColumn("v", fine)
    counters = r.groupBy("band_id").agg(*(F.count_if(F.col("why") == n).alias(f"excluded_{n}") for n in STRICT_BULK), F.lit(0).cast("long").alias("excluded_nonfinite"), F.lit(0).cast("long").alias("excluded_negative"))
    sums = numerics.gather(r, ["band_id"], [[(F.col("v"), 0)]], F.col("v")).withColumn("sum", numerics.rounded(F.col("parts"), 1)[0])  # no band is gathered
    g = sums.select("band_id", "sum", F.col("lo").alias("min"), F.col("hi").alias("max"), F.col("n").alias("valid_count")).join(counters, "band_id")
    return g.withColumn("mean", F.try_divide("sum", F.col("valid_count").cast("double")))
