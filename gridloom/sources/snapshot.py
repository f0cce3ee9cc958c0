"""Lossless snapshots: raw samples and masks as sorted Parquet with digests, published once and verified later."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.model import Grid, require
from gridloom.operators import summaries
from gridloom.sources import files
from gridloom.sources.raster import normalized


def _digests(tiles: DataFrame) -> DataFrame:
    cell = F.concat_ws(",", "row", "col", F.hex(F.encode(F.col("sample").cast("string"), "UTF-8")), "mask")
    return tiles.groupBy("ty", "tx", "band").agg(F.count(F.lit(1)).alias("cells"), F.sha2(F.array_join(F.array_sort(F.collect_list(cell)), ";"), 256).alias("digest"))


def compile_snapshot(raw: DataFrame, path: str, grid: Grid, edge: int = 128, summary: bool = True, nodata: float | None = None, scale: float = 1.0, offset: float = 0.0, levels: int = 3) -> None:
    """Write raw samples (row, col, band, sample, mask), tile digests, metadata and a summary table; never over another."""
    require(edge in (64, 128, 256), "chunks are 64, 128 or 256 cells wide")
    spark = raw.sparkSession
    tiles = raw.withColumns({"ty": F.expr(f"row div {edge}"), "tx": F.expr(f"col div {edge}")})
    out = tiles.repartition("ty", "tx").sortWithinPartitions("ty", "tx", "band", "row", "col")
    out.write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/samples")
    kept = spark.read.parquet(f"{path}/samples")
    _digests(kept).write.mode("errorifexists").parquet(f"{path}/digests")
    content = content_id(spark, path, grid)
    if summary:
        summaries.ward(normalized(kept, "snapshot", nodata, scale, offset), f"{path}/summary", edge, levels, {"grid_id": grid.identity(), "source_id": content})
    meta = [(grid.width, grid.height, list(grid.transform), grid.crs, grid.identity(), content, summary, edge, nodata, scale, offset)]
    spark.createDataFrame(meta, "width int, height int, transform array<double>, crs string, grid_id string, content_id string, summary boolean, edge int, nodata double, scale double, offset double").coalesce(1).write.mode("errorifexists").parquet(f"{path}/metadata")  # last: a snapshot without it is not complete


def content_id(spark: SparkSession, path: str, grid: Grid) -> str:
    """Identity of a snapshot's samples: the digests of its tiles by tile row, then those of the rows."""
    tile = F.concat_ws(":", "tx", "band", "cells", "digest")
    rows = spark.read.parquet(f"{path}/digests").groupBy("ty").agg(F.concat_ws("=", "ty", F.sha2(F.array_join(F.array_sort(F.collect_list(tile)), ";"), 256)).alias("d"))
    whole = rows.agg(F.sha2(F.concat(F.lit(grid.identity()), F.array_join(F.array_sort(F.collect_list("d")), ";")), 256).alias("id"))  # a row for each row of tiles
    return whole.first()["id"]


def is_snapshot(spark: SparkSession, path: str) -> bool:
    fs, p = files._open(spark, f"{path}/metadata")
    return fs.exists(p)


def open_snapshot(spark: SparkSession, path: str) -> tuple[Grid, DataFrame, dict]:
    """(grid, raw samples, metadata)."""
    m = spark.read.parquet(f"{path}/metadata").first()
    grid = Grid(m["width"], m["height"], tuple(m["transform"]), m["crs"])
    require(grid.identity() == m["grid_id"], "the snapshot's grid does not match its identity")
    return grid, spark.read.parquet(f"{path}/samples").drop("ty", "tx"), m.asDict()


def verify_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Tiles whose stored and recomputed digests differ (ty, tx, band); none for a sound snapshot."""
    stored = spark.read.parquet(f"{path}/digests")
    now = _digests(spark.read.parquet(f"{path}/samples"))
    keys = ["ty", "tx", "band"]
    both = stored.select(*keys, F.col("digest").alias("a"), F.col("cells").alias("n")).join(now.select(*keys, F.col("digest").alias("b"), F.col("cells").alias("m")), keys, "full")
    return both.where(~(F.col("a").eqNullSafe(F.col("b")) & F.col("n").eqNullSafe(F.col("m")))).select(*keys)
