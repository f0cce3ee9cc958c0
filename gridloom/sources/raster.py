"""Rasters as cell tables: inline records, dense tiles, columns of ordinary tables; raw windows."""

from __future__ import annotations

import hashlib
import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.normalize import normalize
from gridloom.model import CELLS, RESIDENT_BANDS, SOURCE_BANDS, Grid, fields, require

TILE = "slice_id string, ty int, tx int, band int, x0 int, y0 int, w int, h int, values array<double>, valid array<boolean>"


def inline(spark: SparkSession, raster: dict, slice_id: str = "inline") -> tuple[Grid, DataFrame]:
    """An inline raster {grid, bands: [{values, valid?, nodata?, scale?, offset?, unit?}]} as grid and cells."""
    fields(raster, ("grid", "bands"), ("grid", "bands"))
    grid = Grid.of(raster["grid"])
    require(1 <= len(raster["bands"]) <= RESIDENT_BANDS, "1..20 bands")
    n = grid.width * grid.height
    rows = []
    for b, band in enumerate(raster["bands"]):
        fields(band, ("values", "valid", "nodata", "scale", "offset", "unit"), ("values",))
        values, valid = band["values"], band.get("valid") or [True] * n
        require(len(values) == n and len(valid) == n, "a band has width * height values")
        scale, offset, nodata = float(band.get("scale", 1)), float(band.get("offset", 0)), band.get("nodata")
        for i, (v, ok) in enumerate(zip(values, valid, strict=True)):
            ok = bool(ok) and v is not None and (nodata is None or v != nodata)
            x = float(v) * scale + offset if ok else 0.0
            require(not ok or math.isfinite(x), "a valid value is not finite")
            rows.append((slice_id, i // grid.width, i % grid.width, b, x, ok))
    return grid, spark.createDataFrame(rows, CELLS)


def from_table(df: DataFrame, key: str, width: int, bands: list[tuple[Column, Column]], slice_id: Column | str = "table") -> DataFrame:
    """Cells of a table with a dense integer key: row = key div width, col = key % width; bands are (value, valid) columns."""
    require(1 <= len(bands) <= SOURCE_BANDS, "1..64 bands")
    name = F.lit(slice_id) if isinstance(slice_id, str) else slice_id
    one = lambda b, v, ok: F.struct(F.lit(b).alias("band"), F.when(ok, v.cast("double")).otherwise(0.0).alias("value"), ok.alias("valid"))
    cells = F.explode(F.array(*(one(b, v, F.coalesce(ok, F.lit(False))) for b, (v, ok) in enumerate(bands))))
    rows = df.select(name.alias("slice_id"), F.expr(f"cast({key} div {width} as int)").alias("row"), F.expr(f"cast({key} % {width} as int)").alias("col"), cells.alias("c"))
    return rows.select("slice_id", "row", "col", "c.band", "c.value", "c.valid")


def explode_tiles(tiles: DataFrame) -> DataFrame:
    """Dense tiles to cells."""
    cell = F.posexplode(F.arrays_zip("values", "valid"))
    t = tiles.select("slice_id", "band", "x0", "y0", "w", cell.alias("i", "c"))
    return t.select("slice_id", (F.col("y0") + F.expr("i div w")).cast("int").alias("row"), (F.col("x0") + F.col("i") % F.col("w")).cast("int").alias("col"), "band", F.when(F.col("c.valid"), F.col("c.values")).otherwise(0.0).alias("value"), F.col("c.valid").alias("valid"))


def to_tiles(cells: DataFrame, edge: int) -> DataFrame:
    """Cells to dense tiles of edge * edge cells (fewer at the grid's ends); cells are present once."""
    keyed = cells.groupBy("slice_id", F.expr(f"row div {edge}").alias("ty"), F.expr(f"col div {edge}").alias("tx"), "band")
    got = keyed.agg(F.min("col").alias("x0"), F.min("row").alias("y0"), (F.max("col") - F.min("col") + 1).alias("w"), (F.max("row") - F.min("row") + 1).alias("h"), F.array_sort(F.collect_list(F.struct("row", "col", "value", "valid"))).alias("c"))
    return got.select("slice_id", "ty", "tx", "band", "x0", "y0", "w", "h", F.transform("c", lambda x: x["value"]).alias("values"), F.transform("c", lambda x: x["valid"]).alias("valid"))


def raw_window(raw: DataFrame, x: int, y: int, width: int, height: int, bands: list[int]) -> DataFrame:
    """Original samples and mask bytes of a window: by band, little-endian doubles and bytes in row-major order. raw: row, col, band, sample, mask."""
    require(width > 0 and height > 0 and 1 <= len(bands) <= SOURCE_BANDS and len(set(bands)) == len(bands), "a window with 1..64 distinct bands")
    require(width * height * len(bands) * 9 <= 64 << 20, "the window is larger than 64 MiB")
    part = raw.where(F.col("band").isin(bands) & F.col("row").between(y, y + height - 1) & F.col("col").between(x, x + width - 1))

    def pack(t: pa.Table) -> pa.Table:
        order = np.lexsort((t["col"].to_numpy(), t["row"].to_numpy()))
        samples = t["sample"].to_numpy()[order].astype("<f8").tobytes()
        return pa.table({"band": t["band"][:1], "cells": pa.array([t.num_rows], pa.int64()), "samples": pa.array([samples], pa.binary()), "mask": pa.array([t["mask"].to_numpy()[order].astype(np.uint8).tobytes()], pa.binary())})

    return part.select("row", "col", "band", F.col("sample").cast("double"), F.col("mask").cast("int")).groupBy("band").applyInArrow(pack, "band int, cells long, samples binary, mask binary")


def normalized(raw: DataFrame, slice_id: str, nodata: float | None = None, scale: float = 1.0, offset: float = 0.0) -> DataFrame:
    """Cells from raw samples (row, col, band, sample, mask)."""
    r = raw.withColumn("n", normalize(F.col("sample"), F.col("mask") if "mask" in raw.columns else None, nodata, scale, offset))
    return r.select(F.lit(slice_id).alias("slice_id"), "row", "col", "band", "n.value", "n.valid")


def identity(value: dict) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()
