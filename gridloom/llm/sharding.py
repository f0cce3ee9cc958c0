"""Contiguous shards of nearly equal size from global prefix sums.

Rows are range-sorted once; each range partition contributes one total; a row's place on the global line of bytes is
its partition's offset plus a running sum inside the partition; the line is cut at equal targets. Only fixed-width
digests are shuffled, never texts. Partition totals (one row for each range partition) are all that reaches the driver.

Defined results: a null text counts no bytes and has the CRC of no bytes; null ids sort first; ties and repeated rows
are ordered by digest and place in the input, and each keeps its own slot; an empty table gives an empty result;
columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import runtime


def balanced_shards(df: DataFrame, shards: int, law: str = "bytes", key: str = "doc_id", text: str = "text", overhead: int = 8) -> DataFrame:
    """Assign each row a shard and a gapless slot. law: ``bytes`` balances sizes, ``rows`` balances counts."""
    if law not in ("bytes", "rows") or shards < 1:
        raise ValueError("law must be bytes or rows, and shards positive")
    spark = df.sparkSession
    runtime.prepare(spark)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("__at"),
    )
    order = ["doc_id", "text_crc32", "size", "__at"]
    ranged = rows.repartitionByRange(runtime.partitions(spark), *order).withColumn("__part", F.spark_partition_id())
    kept = runtime.cut(ranged)
    totals = kept.groupBy("__part").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()  # one row a partition
    totals.sort(key=lambda r: r[0])
    total, count = sum(r["b"] for r in totals), sum(r["n"] for r in totals)
    before = [(r["__part"], b, n) for r, b, n in zip(totals, itertools.accumulate((r["b"] for r in totals), initial=0), itertools.accumulate((r["n"] for r in totals), initial=0), strict=False)]
    offsets = spark.createDataFrame(before, "__part int, __b long, __n long")
    w = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        kept.withColumns({"__run": F.coalesce(F.sum("size").over(w), F.lit(0)), "__idx": F.count(F.lit(1)).over(w)})
        .join(F.broadcast(offsets), "__part")
        .withColumns({"__before": F.col("__b") + F.col("__run"), "__row": F.col("__n") + F.col("__idx")})
    )
    if law == "bytes":  # a row goes where its middle lies
        cut = F.expr(f"least({shards - 1}, ((2 * __before + size) * {shards}) div {max(1, 2 * total)})")
    else:
        cut = F.expr(f"(__row * {shards}) div {max(1, count)}")
    placed = runtime.cut(placed.select("doc_id", "size", "text_crc32", cut.cast("int").alias("shard"), "__row"))
    first = placed.groupBy("shard").agg(F.min("__row").alias("__first"))  # at most `shards` rows
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("__row") - F.col("__first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
