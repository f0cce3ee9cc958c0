"""What the operators share at the Spark level: shipping code, cutting lineage, sizing exchanges, Bloom prefilters."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()
_libc = None


def prepare(spark: SparkSession) -> None:
    """Make this package importable on executors, bound Arrow batches, and make sure that a checkpoint folder is set.

    The folder comes from the session (``spark.checkpoint.dir``); one is set here only where none is set, as in tests.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        reachable = os.environ.get("PYTHONPATH", "").split(os.pathsep) + [os.getcwd()]
        if str(ROOT) not in [str(Path(p).resolve()) for p in reachable if p]:
            archive = Path(tempfile.mkdtemp()) / "gridloom_llm.zip"
            with zipfile.ZipFile(archive, "w") as z:
                for p in sorted((ROOT / "gridloom").rglob("*.py")):
                    z.write(p, p.relative_to(ROOT))
            sc.addPyFile(str(archive))
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")  # one machine
        sc.setCheckpointDir(folder)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows become a Parquet table in the shared checkpoint folder, which survives lost executors.

    The shuffle files behind it are given back at once: nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/cut-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._cut_path = path
    return table


def counted(df: DataFrame, **metrics) -> tuple[DataFrame, dict]:
    """``cut``, and metrics of the rows that were written, taken by the same job."""
    seen = Observation()
    table = cut(df.observe(seen, *(v.alias(k) for k, v in metrics.items())))
    got = seen.get or {}  # nothing is observed where the plan is known to be empty
    return table, {k: got.get(k) for k in metrics}


def forget(*tables: DataFrame) -> None:
    """Delete tables of ``cut`` that no later plan reads."""
    for table in tables:
        p = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._cut_path)
        p.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def settle() -> None:
    """Let a Python worker give memory back: large arrays are mapped and unmapped instead of growing the heap."""
    global _libc
    if _libc is None:
        try:
            _libc = ctypes.CDLL("libc.so.6")
            _libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
            _libc.mallopt(-1, 8 << 20)  # M_TRIM_THRESHOLD
        except (OSError, AttributeError):
            _libc = False


def lean(kernel):
    """A kernel for mapInArrow that leaves a small worker behind."""

    @functools.wraps(kernel)
    def run(it):
        settle()
        try:
            yield from kernel(it)
        finally:
            pa.default_memory_pool().release_unused()
            if _libc:
                _libc.malloc_trim(0)

    return run


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it differ from all columns of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    """Tasks of an exchange: the session's own setting, so that a cluster's sizing carries over."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def exchange(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartition(partitions(df.sparkSession), *keys)


def to_tasks(df: DataFrame, bucket: str) -> DataFrame:
    """A packed exchange: bucket k goes to task k, so hash buckets make even tasks. There are ``partitions`` buckets."""
    return df.repartitionById(partitions(df.sparkSession), F.col(bucket).cast("int"))


LEAST_BITS, MOST_BITS = 20, 27  # as powers of two: a filter is broadcast with 16 MB at most
WORD_BLOCK = 1 << 12


def _slots(key: str, size: int, hashed: bool) -> list:
    """Three places of a key: of its hashes, or of its own bits where it is a hash already (see ``has``)."""
    if hashed:
        return [F.shiftrightunsigned(key, 18 * i).bitwiseAND(F.lit(size - 1)) for i in range(3)]
    return [F.pmod(F.xxhash64(F.col(key), F.lit(i)), F.lit(size)) for i in (1, 2, 3)]


def has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of some 64-bit hashes may be in a filter of hashes."""
    out, last = np.ones(len(h), bool), np.uint64(len(bits) * 64 - 1)
    for i in range(3):
        slot = ((h >> np.uint64(18 * i)) & last).astype(np.int64)
        out &= (bits[slot >> 6] >> (slot & 63)) & 1 == 1
    return out


def bloom_bits(keys: DataFrame, key: str, hashed: bool = False) -> np.ndarray:
    """A Bloom filter of a long column as bits packed in int64 words.

    It has 16 places or more for each key up to MOST_BITS; with more keys it lets more rows through and loses its use little by
    little; the exact join behind it decides. Tasks set bits in packed blocks, so that the driver gets blocks alone.
    """
    n = keys.count()
    size = 1 << min(MOST_BITS, max(LEAST_BITS, (16 * n - 1).bit_length()))
    slots = F.explode(F.array(*_slots(key, size, hashed)))
    words = (
        keys.select(slots.alias("slot"))
        .select(F.shiftright("slot", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(slot % 64 as int))").alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("bits"))
    )

    def pack(table: pa.Table) -> pa.Table:
        block = np.zeros(WORD_BLOCK, np.int64)
        word = table["word"].to_numpy()
        block[word % WORD_BLOCK] = table["bits"].to_numpy()
        return pa.table({"block": pa.array([int(word[0]) // WORD_BLOCK], pa.int32()), "bits": pa.array([block.tobytes()], pa.binary())})

    bits = np.zeros(size // 64, np.int64)
    for r in words.groupBy(F.expr(f"word div {WORD_BLOCK}")).applyInArrow(pack, "block int, bits binary").collect():
        bits[r["block"] * WORD_BLOCK : (r["block"] + 1) * WORD_BLOCK] = np.frombuffer(bytes(r["bits"]), np.int64)
    return bits


def maybe_in(df: DataFrame, key: str, bits: np.ndarray, name: str) -> DataFrame:
    """df with a boolean column: may the key be in the filter? No false negatives. Only the key's hashes go through Arrow."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(bits)
    size = len(bits) * 64

    @F.pandas_udf("boolean")
    def test(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        v = shared.value
        out = np.ones(len(a), bool)
        for s in (a, b, c):
            s = s.to_numpy(dtype=np.int64)
            out &= (v[s >> 6] >> (s & 63)) & 1 == 1
        return pd.Series(out)

    return df.withColumn(name, test(*_slots(key, size, False)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
