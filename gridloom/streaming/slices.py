"""Measure arriving slices: every micro-batch of cells is joined with the same selection and appended to a table.

The selection is static. A slice must arrive whole within a batch (one file or folder); the batch id makes writes idempotent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.model import CELLS, Options
from gridloom.operators import zonal


def stream_measure(spark: SparkSession, incoming: str, selection: DataFrame, areas: DataFrame, out: str, checkpoint: str, options: Options | None = None):
    """Start a query over Parquet files of cells that appear in ``incoming``; results go to ``out/batch=<id>``."""

    def each(batch: DataFrame, number: int) -> None:
        rows = zonal.measure(batch, selection, areas, options)
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    cells = spark.readStream.schema(CELLS).parquet(incoming)
    return cells.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_states(events: DataFrame, time: str, size: str, late: str) -> DataFrame:
    """Sums, counts and extrema of a cell's values by event-time window; rows later than ``late`` are dropped."""
    rows = events.withWatermark(time, late)
    v = F.when(F.col("valid"), F.col("value"))
    return rows.groupBy(F.window(time, size), "row", "col", "band").agg(F.sum(v).alias("fractional_sum"), F.count(v).alias("valid_cell_count"), F.min(v).alias("min"), F.max(v).alias("max"))
