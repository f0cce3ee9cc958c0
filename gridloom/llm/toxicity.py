"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

The model is fitted on a bounded sample of the labelled rows (``sample``, chosen by a hash of the id), which is found from the
labels alone, so that no text is shuffled. Every n-gram has one of 2**bits places; a place's value in a text is 0 or its
log-count ratio, and a logistic model over all places scores every whole text. Scoring is one table look-up for each
n-gram; a place counts once in a text.

Defined results: null and empty texts get the model's score for a text without n-grams other than blanks; without both
labels the score is the share of toxic labels seen (0 without labels); several labels for a document: toxic if any is;
repeated rows get equal scores; ties in the sample's order do not matter; other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import runtime
from gridloom.llm.chargrams import fit_rows, grams, groups, inside

SIZES = (3, 4, 5)


def present(texts, bits: int):
    """(row, places) of each text: the distinct places of its n-grams."""
    last = np.zeros(1 << bits, np.int32)
    for first, cp, bounds in groups(texts):
        every = [grams(cp, n, bits) for n in SIZES]
        for i, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist(), strict=False)):
            h = np.concatenate([x[a : max(a, b - n + 1)] for x, n in zip(every, SIZES, strict=True)])
            at = np.arange(len(h), dtype=np.int32)
            last[h] = at  # of equal places the last one stays
            yield first + i, h[last[h] == at]


@dataclass
class Model:
    bits: int = 18
    bias: float = 0.0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))  # by place

    def score(self, texts) -> np.ndarray:
        z = np.full(len(texts), self.bias)
        if len(self.weights):
            for i, places in present(texts, self.bits):
                z[i] += self.weights[places].sum(dtype=np.float64)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _class_counts(rows: DataFrame, bits: int) -> np.ndarray:
    """n-gram counts by class over the rows: summed in each task, then by block of n-grams."""
    size, blocks = 1 << bits, 64

    def kernel(it):
        total = np.zeros((2, size), np.int64)
        for batch in it:
            label = np.array(batch.column("y").to_pylist(), np.int64)
            for first, cp, bounds in groups(batch.column("t").to_pylist()):
                y = label[first : first + len(bounds) - 1]
                for n in SIZES:
                    h = grams(cp, n, bits)
                    ok = inside(bounds, n, len(h))
                    toxic = np.repeat(y, np.diff(bounds))[: len(h)]
                    for c in (0, 1):
                        total[c] += np.bincount(h[ok & (toxic == c)], minlength=size)
        part = total.reshape(2, blocks, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array([part[:, i].tobytes() for i in range(blocks)])], names=["b", "v"])

    def add(table: pa.Table) -> pa.Table:
        v = sum(np.frombuffer(x, np.int64) for x in table["v"].to_pylist())
        return pa.table({"b": table["b"][:1], "v": pa.array([v.tobytes()])})

    got = rows.mapInArrow(runtime.lean(kernel), "b int, v binary").groupBy("b").applyInArrow(add, "b int, v binary").collect()  # 64 rows
    out = np.zeros((2, blocks, size // blocks), np.int64)
    for r in got:
        out[:, r["b"]] = np.frombuffer(bytes(r["v"]), np.int64).reshape(2, -1)
    return out.reshape(2, -1)


def ratios(counts: np.ndarray) -> np.ndarray:
    """Log-count ratios of the places, from their counts by class, with one added to each."""
    p, q = counts[1] + 1.0, counts[0] + 1.0
    return np.log(p / p.sum()) - np.log(q / q.sum())


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", bits: int = 18, sample: int = 5_000, penalty: float = 1e-3) -> Model:
    """Learn from the rows of docs that have a 0 or 1 label."""
    runtime.prepare(docs.sparkSession)
    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y"))
    part = min(1.0, sample / max(1, known.count()))
    picked = known.where(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < int(part * (1 << 30)))  # about `sample` rows: may be broadcast
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(picked), "k")
    rows = runtime.cut(rows)
    by_class = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(by_class.values())
    share = (by_class.get(1, 0) + 0.5) / (total + 1) if total else 1e-6
    if len(by_class) < 2:
        return Model(bits, float(np.log(share / (1 - share))) if total else -30.0)
    ratio = ratios(_class_counts(rows, bits))

    def kernel(it):
        for batch in it:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                places = [np.sort(f).astype(np.uint32).tobytes() for _, f in present(part.column("t").to_pylist(), bits)]
                yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(places, pa.binary())], names=["y", "f"])

    blocks, y, cols = [], [], []  # about `sample` rows of places, a few hundred rows in a block
    found = rows.mapInArrow(runtime.lean(kernel), "y int, f binary").repartition(16).sortWithinPartitions("y", "f")
    for r in found.toLocalIterator():
        y.append(r["y"] * 2 - 1)
        cols.append(np.frombuffer(bytes(r["f"]), np.uint32))
        if len(y) == 256:
            blocks.append((np.concatenate(cols), np.array([len(c) for c in cols]), np.array(y, float)))
            y, cols = [], []
    if y:
        blocks.append((np.concatenate(cols), np.array([len(c) for c in cols]), np.array(y, float)))
    w, b = fit_rows(blocks, ratio, penalty)
    return Model(bits, b, (w * ratio).astype(np.float32))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """docs with a score column; every whole text is read. A name that docs has already gets an underscore before it."""
    runtime.prepare(docs.sparkSession)
    name = runtime.fresh(docs, name)[0]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(t):
        import pandas as pd

        runtime.settle()
        return pd.Series(shared.value.score([x if isinstance(x, str) else None for x in t]))

    return docs.withColumn(name, run(F.col(text)))
