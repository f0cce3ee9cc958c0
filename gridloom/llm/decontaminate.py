"""Benchmark decontamination as a prefix-filtered set join.

An item's windows of ``window`` consecutive words (or the whole item if it is shorter) are sets of word shingles. The
shingles are ordered by rarity over all documents, counted in a pass of their own. For full containment the necessary
prefix of a window is its one rarest shingle, so documents and windows are joined on that shingle alone; a window with a
shingle that no document has is gone at once. The shingle's place in the window fixes the only place where the window can
stand (positional bound), it must lie within the document (length bound), and a 128-bit hash of the whole window
confirms the match.

Texts are never shuffled. What travels is, for each place in a document that may hold a prefix shingle, the hashes of the
words around it; a Bloom filter of bounded size sorts out other places. The join is shuffled, unless Spark finds the windows
small enough to broadcast, so any number of items takes the same passes; a passage that many documents hold is a skewed key,
which adaptive execution splits.

Defined results: null texts have no words; null item ids take no part; items without words match nothing; items that
share a window are all reported; repeated items count once; every document row gets a result, repeated rows the same; an
empty benchmark leaves all documents clean; other columns are ignored by ``contamination`` and kept by ``clean``, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import runtime
from gridloom.llm.tokens import U, Words, mix, multipliers, pieces, ragged, windows, words_of

SHINGLE, KIND = 3, "alnum_lower"
HELD = 1_000_000


def _shingles(w: Words, k: int) -> np.ndarray:
    h, ok = windows(w.hash, w.doc, k, 7)
    out = np.zeros(len(w.hash), U)
    out[: len(h)] = np.where(ok, h, 0)
    return out


def item_windows(items: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """Distinct windows: two hashes a and b, length n, shingles s, and the ids k of the items that have it."""
    rows = items.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).where("k is not null and t is not null")

    def kernel(it):
        for batch in it:
            w = words_of(batch.column("t"), KIND)
            ids = batch.column("k").to_pylist()
            out = {x: [] for x in ("a", "b", "n", "s", "k")}
            for n in sorted(set(np.minimum(w.count, window).tolist()) - {0}):
                (a, ok), (b, _) = windows(w.hash, w.doc, n, 1), windows(w.hash, w.doc, n, 2)
                whole = ok & (w.count[w.doc[: len(ok)]] >= window if n == window else w.count[w.doc[: len(ok)]] == n)
                sh = _shingles(w, min(n, SHINGLE))
                for i in np.flatnonzero(whole):
                    out["a"].append(int(a[i].astype(np.int64)))
                    out["b"].append(int(b[i].astype(np.int64)))
                    out["n"].append(n)
                    out["s"].append(sh[i : i + n - min(n, SHINGLE) + 1].astype(np.int64).tolist())
                    out["k"].append(ids[w.doc[i]])
            yield pa.RecordBatch.from_arrays([pa.array(out["a"], pa.int64()), pa.array(out["b"], pa.int64()), pa.array(out["n"], pa.int32()), pa.array(out["s"], pa.list_(pa.int64())), pa.array(out["k"], pa.string())], names=["a", "b", "n", "s", "k"])

    found = rows.mapInArrow(runtime.lean(kernel), "a long, b long, n int, s array<long>, k string").distinct()
    return found.groupBy("a", "b", "n").agg(F.first("s").alias("s"), F.sort_array(F.collect_set("k")).alias("k"))


def _counts(docs: DataFrame, shared, lengths: list[int]) -> DataFrame:
    """(s, c): how often shingles that pass the filter occur over all documents, summed in tasks first."""

    def kernel(it):
        held, size = [], 0

        def summed():
            u, back = np.unique(np.concatenate([s for s, _ in held]), return_inverse=True)
            return u, np.bincount(back, np.concatenate([c for _, c in held])).astype(np.int64)

        for batch in it:
            for part in pieces(batch, "t"):
                w = words_of(part.column("t"), KIND)
                for k in lengths:
                    h = _shingles(w, k)
                    u, c = np.unique(h[runtime.has(shared.value, h) & (h != 0)], return_counts=True)
                    held.append((u, c))
                    size += len(u)
                if size > HELD:
                    u, c = summed()
                    held, size = [(u, c)], len(u)
                    if size > HELD // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(c)], names=["s", "c"])
                        held, size = [], 0
        if held:
            u, c = summed()
            yield pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(c)], names=["s", "c"])

    return docs.select("t").mapInArrow(runtime.lean(kernel), "s long, c long").groupBy("s").agg(F.sum("c").alias("c"))


def anchors(found: DataFrame, counts: DataFrame) -> DataFrame:
    """Windows with their rarest shingle s (ties: the first) and its place; none where some shingle never occurs."""
    each = found.select("a", "b", "n", F.size("s").alias("all"), F.posexplode("s").alias("place", "s"))
    first = each.join(counts, "s").groupBy("a", "b", "n", "all").agg(F.count(F.lit(1)).alias("have"), F.min(F.struct("c", "place", "s")).alias("first"))
    return first.where("have = all").join(found.select("a", "b", "n", "k"), ["a", "b", "n"]).select("first.s", "first.place", "a", "b", "n", "k")


PLACES = [("words", pa.int64()), ("s", pa.int64()), ("start", pa.int64()), ("off", pa.int32()), ("around", pa.binary())]


def _places(docs: DataFrame, shared, lengths: list[int], window: int) -> DataFrame:
    """A row with ``words`` for each document, and a row for each place that may hold a prefix shingle, with the words around it."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select("doc_id", "text_hash").schema)

    def kernel(it):
        for batch in it:
            for part in pieces(batch, "t"):
                w = words_of(part.column("t"), KIND)
                pos, s = [np.zeros(0, np.int64)], [np.zeros(0, U)]
                for k in lengths:
                    h = _shingles(w, k)
                    at = np.flatnonzero(runtime.has(shared.value, h) & (h != 0))
                    pos.append(at)
                    s.append(h[at])
                pos, s = np.concatenate(pos), np.concatenate(s)
                doc = w.doc[pos]
                lo, hi = np.maximum(w.first[doc], pos - window + 1), np.minimum(w.first[doc] + w.count[doc], pos + window)
                flat = w.hash[ragged(lo, hi - lo)].tobytes()
                cuts = np.append(0, np.cumsum(hi - lo)) * 8
                rows, n = len(w.count), len(pos)
                take = pa.array(np.concatenate([np.arange(rows), doc]))
                none = lambda kind: pa.nulls(rows, kind)
                around = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(flat)])
                cols = [pa.concat_arrays([pa.array(w.count.astype(np.int64)), pa.nulls(n, pa.int64())])]
                cols += [pa.concat_arrays([none(x.type), x]) for x in (pa.array(s.astype(np.int64)), pa.array(lo - w.first[doc]), pa.array((pos - lo).astype(np.int32)), around)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(take), part.column("text_hash").take(take), *cols], names=["doc_id", "text_hash", *(x for x, _ in PLACES)])

    return docs.mapInArrow(runtime.lean(kernel), f"{kinds}, words long, s long, start long, off int, around binary")


def _confirm(it):
    """Places where the whole window stands: start becomes the number of its first word in the document."""
    for batch in it:
        off, place, n = (batch.column(c).to_numpy() for c in ("off", "place", "n"))
        around = batch.column("around")
        size = pa.compute.binary_length(around).to_numpy() // 8
        flat = np.frombuffer(b"".join(around.to_pylist()), U)
        first = np.cumsum(size) - size
        begin = off - place
        ok = (begin >= 0) & (begin + n <= size)
        for k in np.unique(n[ok]).tolist():
            at = np.flatnonzero(ok & (n == k))
            h = flat[(first[at] + begin[at])[:, None] + np.arange(k)]
            for c, seed in (("a", 1), ("b", 2)):
                ok[at] &= mix((h * multipliers(k, seed)).sum(1, dtype=U)).astype(np.int64) == batch.column(c).to_numpy()[at]
        keep = pa.array(np.flatnonzero(ok))
        out = batch.take(keep)
        start = out.column("start").to_numpy() + begin[ok]
        yield pa.RecordBatch.from_arrays([out.column("doc_id"), out.column("text_hash"), pa.array(start), out.column("n"), out.column("k")], names=["doc_id", "text_hash", "start", "n", "k"])


def _hits(docs: DataFrame, items: DataFrame, window: int, key: str, text: str, item_key: str, item_text: str) -> tuple[DataFrame, DataFrame]:
    """All documents (doc_id, text_hash, n_words), and those with hits (doc_id, text_hash, n_hit, items)."""
    spark = docs.sparkSession
    runtime.prepare(spark)
    rows = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("t"))
    found = runtime.cut(item_windows(items, item_key, item_text, window))
    lengths = sorted({min(r["n"], SHINGLE) for r in found.select("n").distinct().collect()})  # `window` numbers at most
    wanted = spark.sparkContext.broadcast(runtime.bloom_bits(found.select(F.explode("s").alias("s")).distinct(), "s", True))
    prefix = runtime.cut(anchors(found, _counts(rows, wanted, lengths)))
    shared = spark.sparkContext.broadcast(runtime.bloom_bits(prefix.select("s").distinct(), "s", True))
    places = runtime.cut(_places(rows, shared, lengths, window))
    met = places.where("words is null").drop("words").join(prefix, "s").select("doc_id", "text_hash", "start", "off", "around", "place", "a", "b", "n", "k")
    kind = rows.schema["doc_id"].dataType.simpleString()
    hits = met.mapInArrow(runtime.lean(_confirm), f"doc_id {kind}, text_hash long, start long, n int, k array<string>")
    each = hits.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "n")).alias("at"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("k")))).alias("items"))
    hit = F.array_distinct(F.flatten(F.transform("at", lambda x: F.sequence(x["start"], x["start"] + x["n"] - 1))))
    return places.where("words is not null").select("doc_id", "text_hash", F.col("words").alias("n_words")), each.select("doc_id", "text_hash", F.size(hit).cast("long").alias("n_hit"), "items")


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, text_hash, n_words, n_hit and items (distinct item ids, sorted as strings) of every row of docs."""
    every, hits = _hits(docs, items, window, key, text, item_key, item_text)
    d, h = every.alias("d"), hits.alias("h")
    both = d.join(h, F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.text_hash") == F.col("h.text_hash")), "left")
    return both.select("d.doc_id", "d.text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean(docs: DataFrame, items: DataFrame, window: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs without a hit. Only rows that a Bloom filter of the hits lets through are shuffled."""
    hits = runtime.cut(_hits(docs, items, window, key, text, item_key, item_text)[1].select("doc_id", "text_hash"))
    text_hash, maybe = runtime.fresh(docs, "text_hash", "maybe")
    flagged = runtime.maybe_in(docs.withColumn(text_hash, F.xxhash64(text)), text_hash, runtime.bloom_bits(hits, "text_hash"), maybe)
    other_id, other_hash = runtime.fresh(flagged, "other_id", "other_hash")
    h = hits.select(F.col("doc_id").alias(other_id), F.col("text_hash").alias(other_hash))
    same = F.col(key).eqNullSafe(F.col(other_id)) & (F.col(text_hash) == F.col(other_hash))
    suspect = flagged.where(maybe).join(h, same, "left_anti")
    return flagged.where(~F.col(maybe)).select(*docs.columns).unionByName(suspect.select(*docs.columns))
