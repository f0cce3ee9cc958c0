"""Approximate nearest neighbours by largest inner product: a forest of random-projection trees with exact reranking.

Vectors are lifted by one component so that all have equal length, which turns the largest inner product into the least
distance. Trees are grown on the driver on a bounded sample (``sample`` vectors): a node takes the one of several random
directions between sample points along which its points spread most, and splits at the median. Every vector is
routed through every tree to a leaf. A query searches all trees through one shared priority queue, ordered by the sum
of squared margins crossed so far, until it has enough leaves; within leaves, all candidates are scored exactly, in
double precision on the original vectors, and the best of all leaves are merged.

How many leaves are enough follows the table: the true nearest of CALIBRATE queries are found by brute force, and the
search goes on to the leaf count at which the share GOAL of them is reached, ``probes`` leaves at least. Where vectors have
little structure this count grows with the table, and so does the work.

Leaves that follow each other in a tree are near each other and travel as one bin, so that a query is sent once to a bin
and one list of results comes back.

Equal vectors are indexed once, with the smallest ``top + 1`` of their ids, which are all that any result can hold. A leaf
that is expected to hold more than BLOCK vectors is dealt out in blocks that all of its queries visit, and the queries of
a bin in decks of about DECK, so no task gets an unbounded group. ``recall`` measures results against brute force.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part; those of each length are
searched among themselves; ids that are null take no part; rows that repeat an id and its vector count once; ties go to
the smaller id; with few candidates all are returned; an empty table gives none.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import runtime

BLOCK = 8192
BIN = 65_536
DECK = 32_768
CALIBRATE = 150
GOAL = 0.96


def _matrix(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(usable rows, their vectors in double precision)."""
    lists = col.to_pylist() if col.null_count or col.flatten().null_count or len(set(pa.compute.list_value_length(col).to_pylist())) > 1 else None
    if lists is None:
        if not len(col):
            return np.zeros(0, np.int64), np.zeros((0, 0))
        x = col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(col), -1)
        ok = np.isfinite(x).all(1) & (x != 0).any(1) if x.shape[1] else np.zeros(len(x), bool)
        return np.flatnonzero(ok), x[ok]
    good = [(i, v) for i, v in enumerate(lists) if v and None not in v and np.isfinite(v).all() and any(v)]
    return np.array([i for i, _ in good], np.int64), [np.array(v, float) for _, v in good]


class Tree:
    """Inner nodes as arrays; a child below 0 is leaf -1 - child."""

    def __init__(self, points: np.ndarray, leaf: int, rng: np.random.Generator):
        normals, cuts, kids = [], [], []
        self.leaves = 0

        def grow(ix: np.ndarray) -> int:
            if len(ix) <= leaf:
                self.leaves += 1
                return -self.leaves
            a = points[rng.choice(ix, 16)] - points[rng.choice(ix, 16)]
            a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)
            some = ix if len(ix) <= 2000 else rng.choice(ix, 2000, replace=False)
            w = a[np.argmax((points[some] @ a.T).var(0))]
            p = points[ix] @ w
            cut = float(np.median(p))
            low = p <= cut
            if low.all() or not low.any():  # all alike along every direction tried
                self.leaves += 1
                return -self.leaves
            me = len(normals)
            normals.append(w)
            cuts.append(cut)
            kids.append([0, 0])
            kids[me][0] = grow(ix[low])
            kids[me][1] = grow(ix[~low])
            return me

        self.root = grow(np.arange(len(points)))
        self.normals = np.array(normals).reshape(len(normals), points.shape[1])
        self.cuts, self.kids = np.array(cuts), np.array(kids, np.int64).reshape(-1, 2)

    def route(self, x: np.ndarray) -> np.ndarray:
        at = np.full(len(x), self.root, np.int64)
        while (live := np.flatnonzero(at >= 0)).size:
            k = at[live]
            side = np.einsum("ij,ij->i", x[live], self.normals[k]) > self.cuts[k]
            at[live] = self.kids[k, side.astype(int)]
        return -1 - at


class Forest:
    def __init__(self, points: np.ndarray, length: float, share: float, trees: int, leaf: int, seed: int):
        rng = np.random.default_rng(seed)
        self.length = length
        lifted = self.lift(points)
        size = max(8, int(leaf * share))
        self.trees = [Tree(lifted, size, rng) for _ in range(trees)]
        self.base = np.cumsum([0, *(t.leaves for t in self.trees)])
        self.blocks = max(1, -(-int(2 * max(size, len(points) / max(1, min(t.leaves for t in self.trees))) / max(share, 1e-300)) // BLOCK))

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x / self.length
        return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1, keepdims=True)))])

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        lifted = self.lift(x)
        return np.stack([t.route(lifted) + b for t, b in zip(self.trees, self.base, strict=False)], 1)

    def search(self, x: np.ndarray, probes: int) -> list[list[int]]:
        """Leaves for each query, through a queue shared by all trees."""
        q = np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))])
        margins = [q @ t.normals.T - t.cuts for t in self.trees]
        out = []
        for i in range(len(q)):
            rows = [m[i].tolist() for m in margins]
            heap = [(0.0, k, t.root) for k, t in enumerate(self.trees)]
            found: list[int] = []
            while heap and len(found) < probes:
                far, k, at = heapq.heappop(heap)
                kids, row = self.trees[k].kids, rows[k]
                while at >= 0:
                    m = row[at]
                    near = int(m > 0)
                    heapq.heappush(heap, (far + m * m, k, int(kids[at, 1 - near])))
                    at = int(kids[at, near])
                found.append(-1 - at + int(self.base[k]))
            out.append(found)
        return out

    def bins(self, n: int, most: float) -> np.ndarray:
        """The bin of each leaf: leaves of one tree in sequence, of about ``most`` of the n vectors together."""
        out, at = [], 0
        for t in self.trees:
            each = max(1, int(most * t.leaves / max(1, n)))
            out.append(at + np.arange(t.leaves) // each)
            at = int(out[-1][-1]) + 1
        return np.concatenate(out)

    def enough(self, queries: np.ndarray, truth: list[np.ndarray], goal: float) -> int:
        """Leaves to search for finding the share ``goal`` of true neighbours, given by query as rows of their leaves."""
        need = []
        for found, leaves in zip(self.search(queries, int(self.base[-1])), truth, strict=True):
            place = np.empty(len(found), np.int64)
            place[found] = np.arange(1, len(found) + 1)
            need += place[leaves].min(1).tolist()
        return sorted(need)[max(0, math.ceil(goal * len(need)) - 1)] if need else 0


def _distinct_kernel(every: int, top: int, dims: int):
    """Distinct vectors of a batch with their smallest ids, and the ids that are queries."""

    def kernel(it):
        for batch in it:
            rows, x = _matrix(batch.column("v"))
            ids = batch.column("id").to_pylist()
            found: dict[bytes, list] = {}
            for i, v in zip(rows.tolist(), x, strict=True):
                if ids[i] is not None and len(v) == dims:
                    found.setdefault((v + 0.0).astype("<f8").tobytes(), []).append(ids[i])  # -0 becomes 0
            out = [(k, sorted(set(v))) for k, v in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([v[: top + 1] for _, v in out], pa.list_(pa.int64())), pa.array([[i for i in v if i % every == 0] for _, v in out], pa.list_(pa.int64()))], names=["v", "ids", "queries"])

    return kernel


def _calibrated(known: DataFrame, shared, tested: list, top: int, dims: int) -> int:
    """Leaves that find the share GOAL of the true nearest of the tested queries, which come from brute force over all vectors."""
    if not tested:
        return 0
    own = np.array([r["vid"] for r in tested], np.int64)
    q = np.frombuffer(b"".join(bytes(r["v"]) for r in tested), "<f8").reshape(-1, dims)

    def truth(it):
        best: list[tuple] = [(np.zeros(0), np.zeros(0, np.int64), np.zeros((0, dims)))] * len(q)
        for b in it:
            vid = b.column("vid").to_numpy()
            x = np.frombuffer(b"".join(b.column("v").to_pylist()), "<f8").reshape(len(vid), dims)
            s = q @ x.T
            s[own[:, None] == vid[None]] = -np.inf
            for i in range(len(q)):
                at = np.argpartition(-s[i], top - 1)[:top] if len(vid) > top else np.arange(len(vid))
                all_s, all_v, all_x = (np.concatenate([o, y]) for o, y in zip(best[i], (s[i, at], vid[at], x[at]), strict=True))
                at = np.lexsort((all_v, -all_s))[:top]
                best[i] = all_s[at], all_v[at], all_x[at]
        for i, (s, v, x) in enumerate(best):
            at = np.isfinite(s)
            if at.any():
                leaves = shared.value.leaves_of(x[at])
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(leaves), pa.int64()), pa.array(-s[at]), pa.array(v[at]), pa.array(leaves.tolist(), pa.list_(pa.int64()))], names=["q", "less", "vid", "leaves"])

    near = known.select("vid", "v").mapInArrow(runtime.lean(truth), "q long, less double, vid long, leaves array<long>")
    got = near.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("less", "vid", "leaves"))), 1, top).alias("found")).collect()
    return shared.value.enough(q[[r["q"] for r in got]], [np.array([e["leaves"] for e in r["found"]], np.int64) for r in got], GOAL)


def nearest(df: DataFrame, top: int = 20, every: int = 20, key: str = "vec_id", vector: str = "embedding", trees: int = 8, leaf: int = 512, probes: int = 144, sample: int = 20_000, seed: int = 1) -> DataFrame:
    """query_id, rank, vec_id and score: the nearest found of each row whose id is divisible by ``every``. ``probes``: the least number of leaves."""
    spark = df.sparkSession
    runtime.prepare(spark)
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    lengths = rows.where("id is not null and size(v) > 0").select(F.size("v").alias("n")).distinct().orderBy("n").collect()  # as a rule one
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for r in lengths:
        out = out.unionByName(_nearest(rows, r["n"], top, every, trees, leaf, probes, sample, seed))
    return out


def _nearest(rows: DataFrame, dims: int, top: int, every: int, trees: int, leaf: int, probes: int, sample: int, seed: int) -> DataFrame:
    """Among the vectors of one length."""
    spark = rows.sparkSession
    parts = runtime.cut(rows.mapInArrow(runtime.lean(_distinct_kernel(every, top, dims)), "v binary, ids array<long>, queries array<long>"))
    # of a repeated vector every task keeps its smallest ids alone, before anything is gathered
    first = Window.partitionBy("v").orderBy("id")
    each = parts.select("v", F.explode("ids").alias("id")).withColumn("r", F.dense_rank().over(first)).where(F.col("r") <= top + 1)
    least = each.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    asking = parts.where(F.size("queries") > 0).select("v").distinct().withColumn("asked", F.lit(True))
    known = least.join(asking, "v", "left").select(F.element_at("ids", 1).alias("vid"), "v", "ids", F.coalesce("asked", F.lit(False)).alias("asked"))
    known = runtime.cut(known)

    def longest(it):
        n, most = 0, 0.0
        for b in it:
            x = np.frombuffer(b"".join(b.column("v").to_pylist()), "<f8").reshape(b.num_rows, dims)
            n, most = n + len(x), max(most, float(np.sqrt((x * x).sum(1)).max(initial=0)))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([most])], names=["n", "most"])

    got = known.select("v").mapInArrow(runtime.lean(longest), "n long, most double").agg(F.sum("n").alias("n"), F.max("most").alias("most")).first()
    n, most = got["n"] or 0, got["most"] or 1.0
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    askers = known.where("asked").count()
    share = min(1.0, sample / max(1, n))
    chosen = known.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(share * (1 << 30))).select("vid", "v").collect()  # about `sample` vectors
    chosen.sort(key=lambda r: r["vid"])
    points = np.frombuffer(b"".join(bytes(r["v"]) for r in chosen), "<f8").reshape(-1, dims)
    forest = Forest(points, most, share, trees, leaf, seed)
    shared = spark.sparkContext.broadcast(forest)

    tested = known.where("asked").orderBy(F.xxhash64("v"), "vid").limit(CALIBRATE).select("vid", "v").collect()
    probes = max(probes, _calibrated(known, shared, tested, top, dims))
    bin_of = forest.bins(n, min(BIN, max(BLOCK / 4, trees * n / runtime.partitions(spark))))
    # queries of a bin are dealt out too: a block of vectors goes to each of their decks
    asked = np.frombuffer(b"".join(bytes(r["v"]) for r in tested), "<f8").reshape(-1, dims)
    visits = np.mean([len(np.unique(bin_of[found])) for found in forest.search(asked, probes)]) if tested else 0.0
    decks = max(1, math.ceil(askers * visits / (int(bin_of[-1]) + 1) / DECK))

    def dealt(it):
        """Kind 0: vectors by (bin, block) with their leaf. Kind 1: queries with the leaves that they probe, for each bin and block."""
        f = shared.value
        for b in it:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                vid = part.column("vid").to_numpy()
                raw = part.column("v").to_pylist()
                x = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), dims)
                leaves = f.leaves_of(x)
                each = leaves.shape[1]
                place, who = bin_of[leaves].ravel().tolist(), np.repeat(np.arange(len(raw)), each).tolist()
                block, inside = (vid[who] % f.blocks).tolist(), [[y] for y in leaves.ravel().tolist()]
                deck = [d for d in range(decks) for _ in place]
                place, who, block, inside = place * decks, who * decks, block * decks, inside * decks
                kind = [0] * len(place)
                asked = np.flatnonzero(part.column("asked").to_numpy(zero_copy_only=False))
                for i, found in zip(asked.tolist(), f.search(x[asked], probes) if len(asked) else [], strict=True):
                    found = np.sort(np.array(found, np.int64))
                    u, first = np.unique(bin_of[found], return_index=True)
                    lists = [y.tolist() for y in np.split(found, first[1:])]
                    for k in range(f.blocks):
                        kind += [1] * len(u)
                        place += u.tolist()
                        deck += [int(vid[i]) // every % decks] * len(u)
                        block += [k] * len(u)
                        who += [i] * len(u)
                        inside += lists
                take = pa.array(who, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(place, pa.int64()), pa.array(block, pa.int64()), pa.array(deck, pa.int64()), pa.array(inside, pa.list_(pa.int32())), part.column("vid").take(take), part.column("v").take(take)], names=["kind", "bin", "block", "deck", "leaves", "vid", "v"])

    def scored(table: pa.Table) -> pa.Table:
        """The best of a bin for each query, ties to the smaller id."""
        kind = table["kind"].to_numpy()
        vid = table["vid"].to_numpy()
        lists = table["leaves"].combine_chunks()
        row, leaf = np.repeat(np.arange(len(vid)), pa.compute.list_value_length(lists).to_numpy()), lists.flatten().to_numpy()
        x = np.frombuffer(b"".join(table["v"].to_pylist()), "<f8").reshape(len(vid), dims)
        order = np.argsort(leaf, kind="stable")
        row, leaf = row[order], leaf[order]
        cuts = np.flatnonzero(np.append(True, leaf[1:] != leaf[:-1]))
        who, ids, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(leaf)], strict=True):
            here = row[a:b]
            c, q = here[kind[here] == 0], here[kind[here] == 1]
            for i in range(0, len(q) if len(c) else 0, 256):
                s = x[q[i : i + 256]] @ x[c].T
                m = min(top + 1, s.shape[1])
                edge = np.partition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m]
                r, at = np.nonzero(s >= edge[:, None])
                who.append(vid[q[i : i + 256]][r])
                ids.append(vid[c[at]])
                scores.append(s[r, at])
        who, ids, scores = map(np.concatenate, (who, ids, scores))
        order = np.lexsort((ids, -scores, who))
        who, ids, scores = who[order], ids[order], scores[order]
        u, first, size = np.unique(who, return_index=True, return_counts=True)
        keep = np.arange(len(who)) - np.repeat(first, size) <= top
        cut = pa.array(np.append(0, np.cumsum(np.minimum(size, top + 1))), pa.int32())
        return pa.table({"q": pa.array(u, pa.int64()), "ids": pa.ListArray.from_arrays(cut, pa.array(ids[keep], pa.int64())), "scores": pa.ListArray.from_arrays(cut, pa.array(scores[keep], pa.float64()))})

    spread = known.select("vid", "v", "asked").repartition(runtime.partitions(spark))
    hits = spread.mapInArrow(runtime.lean(dealt), "kind int, bin long, block long, deck long, leaves array<int>, vid long, v binary").groupBy("bin", "block", "deck").applyInArrow(scored, "q long, ids array<long>, scores array<double>")

    def merged(table: pa.Table) -> pa.Table:
        ids, s = table["ids"].combine_chunks().flatten().to_numpy(), table["scores"].combine_chunks().flatten().to_numpy()
        u, first = np.unique(ids, return_index=True)
        order = np.lexsort((u, -s[first]))[: top + 1]
        return pa.table({"q": table["q"][:1], "ids": pa.array([u[order]], pa.list_(pa.int64()))})

    best = hits.groupBy("q").applyInArrow(merged, "q long, ids array<long>").select("q", F.explode("ids").alias("vid"))
    vectors = known.select("vid", "v", "ids")
    pairs = best.join(vectors, "vid").join(known.select(F.col("vid").alias("q"), F.col("v").alias("qv")), "q")

    @F.pandas_udf("double")
    def product(a, b):
        import pandas as pd

        return pd.Series([float(np.frombuffer(x, "<f8") @ np.frombuffer(y, "<f8")) for x, y in zip(a, b, strict=True)])

    entry = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("less"), i.alias("id")))
    lists = pairs.withColumn("score", product("v", "qv")).groupBy("q", "qv").agg(F.slice(F.array_sort(F.flatten(F.collect_list(entry))), 1, top + 1).alias("found"))
    asked = parts.where(F.size("queries") > 0).select("v", "queries")
    results = asked.join(lists, asked["v"] == lists["qv"]).select(F.explode("queries").alias("query_id"), "found").distinct()
    own = F.filter("found", lambda e: e["id"] != F.col("query_id"))
    return results.select("query_id", F.posexplode(F.slice(own, 1, top)).alias("at", "e")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("e.id").alias("vec_id"), (-F.col("e.less")).alias("score"))


def recall(found: DataFrame, rows: DataFrame, top: int = 20, key: str = "vec_id", vector: str = "embedding", queries: int = 200) -> float:
    """Share of the true nearest that were found, over some of the queries, by brute force in blocks on the executors."""
    some = [r[0] for r in found.select("query_id").distinct().orderBy(F.xxhash64("query_id")).limit(queries).collect()]
    asked = rows.where(F.col(key).isin(some)).select(F.col(key).alias("q"), F.col(vector).alias("qv")).collect()
    q = np.array([r["qv"] for r in asked], float)
    ids = np.array([r["q"] for r in asked], np.int64)

    def kernel(it):
        for b in it:
            keep, x = _matrix(b.column("v"))
            fits = [i for i, v in enumerate(x) if len(v) == q.shape[1]]
            vid = b.column("id").to_numpy()[keep[fits]]
            s = q @ np.array([x[i] for i in fits]).reshape(len(fits), q.shape[1]).T
            for i in range(len(q)):
                at = np.lexsort((vid, -s[i]))[: top + 1]
                yield pa.RecordBatch.from_arrays([pa.array([ids[i]] * len(at), pa.int64()), pa.array(vid[at], pa.int64()), pa.array(s[i][at])], names=["q", "id", "s"])

    scores = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).mapInArrow(runtime.lean(kernel), "q long, id long, s double").where("id <> q")
    truth = scores.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("l"), "id"))), 1, top).alias("t"))
    truth = truth.select(F.col("q").alias("query_id"), F.explode("t.id").alias("vec_id"))
    hit = truth.join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").count()
    return hit / max(1, truth.count())
