"""Normalisation of raw samples: masks and NoData are tested on the raw sample, before scale and offset."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Raw scalar types and the Spark types that hold them.
RAW_TYPES = {"Byte": "smallint", "Int8": "tinyint", "UInt16": "int", "Int16": "smallint", "UInt32": "bigint", "Int32": "int", "Float32": "float", "Float64": "double"}


def normalize(raw: Column, mask: Column | None = None, nodata: float | None = None, scale: float = 1.0, offset: float = 0.0) -> Column:
    """A struct (value, valid); an invalid cell has value 0."""
    v = raw.cast("double")
    present = v.isNotNull() & (F.abs(v) < F.lit(math.inf))
    if mask is not None:
        present = present & F.coalesce(mask.cast("int") != 0, F.lit(False))
    if nodata is not None and not math.isnan(nodata):
        present = present & (v != F.lit(float(nodata)))
    out = v * F.lit(float(scale)) + F.lit(float(offset))
    ok = F.coalesce(present & (F.abs(out) < F.lit(math.inf)), F.lit(False))
    return F.struct(F.when(ok, out).otherwise(F.lit(0.0)).alias("value"), ok.alias("valid"))
