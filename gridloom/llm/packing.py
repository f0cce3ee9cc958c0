"""Bulk-synchronous best-fit packing of token sequences.

Documents are tokenised and cut into pieces of at most ``capacity`` tokens. Lengths and gaps are integers up to the
capacity, so range-sorted documents are runs of equal length, and range-sorted gaps are runs of equal gap: tables of a few
thousand rows for any corpus. A round is one job over both tables. They are dealt out by ranges of size; in each range a
task sweeps its documents from the longest, and each run claims its successor, the tightest gap that holds it; where runs
claim the same gaps, rank decides: the longer first, and within a run by number. What a range leaves over meets in wider
ranges, and at last in one. At the barrier the placed runs' gaps are updated, and the next round begins. When a round
places nothing, new sequences are opened: for all documents above half the capacity, or else for the longest that hold
half of the tokens left, so that what remains can fill the gaps behind them. It ends when all runs are placed; the places of
the single pieces follow from their ranks, in a distributed step.

Ranks come from totals by task and length and their prefix sums, so no length, however frequent, meets in one task.

Defined results: null text is empty, which is the closing id alone; every row is packed, repeated rows too; ties in length
are ordered by place in the input; an empty table gives no sequences; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import json
import math
import os
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm import runtime
from gridloom.llm.tokens import U, _powers, mix, ragged

SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
KNOWN = 200_000


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes are themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PieceEncoder:
    """Ids of texts for a byte-level BPE vocabulary in the format of the tokenizers library.

    Texts are split into pre-tokens with array operations, and only pre-tokens not seen before are merged. Vocabularies
    whose ids do not follow the order of merges, and texts that hold an added token's string, go to the library itself.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        model = json.loads(spec)
        self.added = [t["content"] for t in model.get("added_tokens", [])]
        symbols, vocab = byte_symbols(), model["model"]["vocab"]
        added = set(self.added)
        ranks = {bytes(symbols[c] for c in t): i for t, i in vocab.items() if t not in added}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        order = [vocab[a + b] for a, b in merges]
        pre = model.get("pre_tokenizer") or {}
        self.direct = order == sorted(order) and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and model.get("normalizer") is None
        if self.direct:
            import tiktoken

            self.merge = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        kinds = np.zeros(0x110000, np.uint8)  # 0 other, 1 letter, 2 number, 3 space
        for cp in range(0x110000):
            c = unicodedata.category(chr(cp))[0]
            if c == "L":
                kinds[cp] = 1
            elif c == "N":
                kinds[cp] = 2
        kinds[SPACES] = 3
        self.kinds, self.known = kinds, {}
        # pre-tokens are looked up by a polynomial over a random value for each character, drawn anew by every worker
        self.values = np.random.default_rng(int.from_bytes(os.urandom(16))).integers(0, 1 << 64, 0x110000, U)

    def pretokens(self, cp: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Starts of pre-tokens. edge: where documents begin, and the end; documents are not empty."""
        n, cls = len(cp), self.kinds[cp]
        start = np.ones(n, bool)
        start[1:] = cls[1:] != cls[:-1]
        first = np.zeros(n + 1, bool)
        first[edge] = True
        start |= first[:-1]
        runs = np.flatnonzero(start)
        ends = np.append(runs[1:], n)
        gap = (cls[runs] == 3) & ~first[ends]  # white space before something else: its last character stands apart
        last = ends[gap] - 1
        start[last] = True
        start[ends[gap][cp[last] == 32]] = False  # or, a blank, belongs to what follows
        for a in np.flatnonzero((cp == 39) & start).tolist():  # 's 't 'm 'd 're 've 'll
            stop = int(edge[np.searchsorted(edge, a, "right")])
            tail = "".join(map(chr, cp[a + 1 : min(stop, a + 3)]))
            size = 2 if tail[:1] in ("s", "t", "m", "d") and tail else 3 if tail in ("re", "ve", "ll") else 0
            if size:
                start[a + 1] = False
                if size == 3:
                    start[a + 2] = False
                if a + size < stop and cls[a + size] == cls[a + size - 1]:
                    start[a + size] = True
        return np.flatnonzero(start)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without special tokens added."""
        out: list[np.ndarray | None] = [None] * len(texts)
        mine = []
        for i, t in enumerate(texts):
            if not t:
                out[i] = np.zeros(0, np.uint32)
            elif not self.direct or any(a in t for a in self.added):
                out[i] = np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32)
            else:
                mine.append(i)
        at = 0
        while at < len(mine):
            group, size = [], 0
            while at < len(mine) and (not group or size + len(texts[mine[at]]) <= 1 << 20):
                group.append(mine[at])
                size += len(texts[mine[at]])
                at += 1
            for i, ids in zip(group, self._encode([texts[i] for i in group]), strict=True):
                out[i] = ids
        return out

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        joined = "".join(texts)
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        edge = np.cumsum([0, *map(len, texts)])
        start = self.pretokens(cp, edge)
        end = np.append(start[1:], len(cp))
        p, inv = _powers(len(cp))
        c = np.zeros(len(cp) + 1, U)
        np.cumsum(self.values[cp] * p[: len(cp)], out=c[1:])
        h = mix((c[end] - c[start]) * inv[start] + (end - start).astype(U))
        uniq, where, back = np.unique(h, return_index=True, return_inverse=True)
        known = self.known
        if len(known) > KNOWN:
            known.clear()
        got = list(map(known.get, uniq.tolist()))
        new = [j for j, v in enumerate(got) if v is None]
        for j, a, b, x in zip(new, start[where[new]].tolist(), end[where[new]].tolist(), uniq[new].tolist(), strict=True):
            got[j] = known[x] = array("I", self.merge(joined[a:b])).tobytes()
        sizes = np.fromiter(map(len, got), np.int64, len(got)) // 4
        flat = np.frombuffer(b"".join(got), np.uint32)
        offs = np.cumsum(sizes) - sizes
        ids = flat[ragged(offs[back], sizes[back])]
        upto = np.append(0, np.cumsum(sizes[back]))
        cuts = upto[np.searchsorted(start, edge)]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


RUN = "kind int, length int, gap int, rank long, sequence long, n long, per int"
DOCUMENTS, GAPS, PLACED = 0, 1, 2
WIDTHS = (16, 1)  # ranges of size in a round's sweeps, from narrow to wide


def _sweep(table: pa.Table) -> pa.Table:
    """Best fit within a range of sizes: runs of documents, longest first, claim the tightest gaps that hold them."""
    rows = table.drop_columns(["range"]).to_pylist()
    out = [r for r in rows if r["kind"] == PLACED]
    gaps = sorted((r for r in rows if r["kind"] == GAPS), key=lambda r: (r["gap"], r["sequence"]))
    sizes = [r["gap"] for r in gaps]
    for d in sorted((r for r in rows if r["kind"] == DOCUMENTS), key=lambda r: (-r["length"], r["rank"])):
        at = bisect.bisect_left(sizes, d["length"])
        while d["n"] and at < len(gaps):
            g = gaps[at]
            per = g["gap"] // d["length"]
            use = min(g["n"], -(-d["n"] // per))
            take = min(d["n"], use * per)
            out.append({"kind": PLACED, "length": d["length"], "gap": g["gap"], "rank": d["rank"], "sequence": g["sequence"], "n": take, "per": per})
            d["n"], d["rank"] = d["n"] - take, d["rank"] + take
            g["n"], g["sequence"] = g["n"] - use, g["sequence"] + use
            if not g["n"]:
                del gaps[at], sizes[at]
        if d["n"]:
            out.append(d)
    out += gaps
    schema = table.schema.remove(table.schema.get_field_index("range"))
    return pa.Table.from_pylist(out, schema)


def _round(spark: SparkSession, runs: list[tuple], capacity: int) -> list:
    """Sweeps over ranges of size, each leaving the rest to the next wider ones; a job over run tables."""
    df = spark.createDataFrame(runs, RUN)
    size = F.when(F.col("kind") == GAPS, F.col("gap")).otherwise(F.col("length"))
    for ranges in WIDTHS:
        wide = -(-(capacity + 1) // ranges)
        df = df.withColumn("range", F.floor(size / wide).cast("int")).groupBy("range").applyInArrow(_sweep, RUN)
    return df.collect()


def _opened(left: dict[int, tuple[int, int]], capacity: int) -> list[tuple[int, int, int]]:
    """(length, members, members in a sequence) for which new sequences open."""
    big = [(x, n, 1) for x, (_, n) in left.items() if 2 * x > capacity]
    if big:
        return big
    volume, out = sum(x * n for x, (_, n) in left.items()) / 2, []
    for x in sorted(left, reverse=True):
        if volume <= 0:
            break
        per = capacity // x
        n = min(left[x][1], max(per, math.ceil(volume / x)))
        out.append((x, n, per))
        volume -= x * n
    return out


def plan(spark: SparkSession, counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rounds of best fit until all is placed: (length, first rank, end of ranks, first sequence, members in a sequence, offset)."""
    left = {x: (0, n) for x, n in counts.items()}  # by length: first rank, how many
    gaps: list[tuple[int, int, int]] = []  # (gap, first sequence, sequences)
    placed, used = [], 0

    def put(length: int, rank: int, n: int, gap: int, sequence: int, per: int) -> None:
        placed.append((length, rank, rank + n, sequence, per, capacity - gap))
        full, part = divmod(n, per)
        for start, many, k in ((sequence, full, per), (sequence + full, 1, part)):
            if many and k and gap > k * length:
                gaps.append((gap - k * length, start, many))

    while left:
        runs = [(DOCUMENTS, x, None, rank, None, n, None) for x, (rank, n) in left.items()]
        runs += [(GAPS, None, g, None, s, n, None) for g, s, n in gaps if g >= min(left)]
        rows = _round(spark, runs, capacity) if len(runs) > len(left) else []
        found = sorted((r for r in rows if r["kind"] == PLACED), key=lambda r: (r["length"], r["rank"]))
        if found:
            gaps = [(r["gap"], r["sequence"], r["n"]) for r in rows if r["kind"] == GAPS]
            left = {r["length"]: (r["rank"], r["n"]) for r in rows if r["kind"] == DOCUMENTS}
            for r in found:
                put(r["length"], r["rank"], r["n"], r["gap"], r["sequence"], r["per"])
            continue
        gaps = []  # none holds what is left
        for x, n, per in _opened(left, capacity):
            rank, all_n = left.pop(x)
            put(x, rank, n, capacity, used, per)
            used += -(-n // per)
            if n < all_n:
                left[x] = (rank + n, all_n - n)
    return placed


def cut_pieces(df: DataFrame, spec: str, capacity: int, closing: int, key: str, text: str, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their task, and their place among the task's pieces of that length."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(spec)
    rows = df.select(F.col(key).alias("doc_id"), F.col(text).alias("__text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def kernel(it):
        encoder, task, seen = PieceEncoder(shared.value), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in it:
            out: dict[str, list] = {c: [] for c in ("row", "piece", "start", "length", "crc", "at", "ids")}
            texts = [t or "" for t in batch.column("__text").to_pylist()]
            for i, ids in enumerate(encoder.encode(texts)):
                ids = np.append(ids, np.uint32(closing)).astype("<u4")
                n = len(ids)
                k = -(-n // capacity)
                a, b = 0, n - capacity * (k - 1)
                for j in range(k):
                    part = ids[a:b]
                    out["row"].append(i)
                    out["piece"].append(j)
                    out["start"].append(a)
                    out["length"].append(b - a)
                    out["crc"].append(zlib.crc32(part.tobytes()))
                    out["at"].append(int(seen[b - a]))
                    seen[b - a] += 1
                    if with_ids:
                        out["ids"].append(part.astype(np.int32))
                    a, b = b, b + capacity
            cols = [batch.column("doc_id").take(pa.array(out["row"], pa.int64())), pa.array(out["piece"], pa.int32()), pa.array(out["start"], pa.int64()), pa.array(out["length"], pa.int64()), pa.array(out["crc"], pa.int64()), pa.array(np.full(len(out["row"]), task, np.int32)), pa.array(out["at"], pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "__task", "__at"]
            if with_ids:
                cols.append(pa.array(out["ids"], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return rows.mapInArrow(runtime.lean(kernel), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, __task int, __at long" + ", ids array<int>" * with_ids)


def pack(df: DataFrame, vocabulary: str, capacity: int = 1024, closing: int = 2, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence and its offset there. vocabulary: path of a tokenizers JSON file on the driver."""
    spark = df.sparkSession
    runtime.prepare(spark)
    with open(vocabulary, encoding="utf-8") as f:
        spec = f.read()
    cut = runtime.cut(cut_pieces(df, spec, capacity, closing, key, text, with_ids))
    totals = cut.groupBy("length", "__task").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("length").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    before = totals.withColumn("__before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    counts = {r["length"]: r["n"] for r in totals.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `capacity` rows at most
    rounds = plan(spark, counts, capacity)
    by_length: dict[int, np.ndarray] = {}
    for length in counts:
        by_length[length] = np.array(sorted(r[1:] for r in rounds if r[0] == length), np.int64)
    shared = spark.sparkContext.broadcast(by_length)
    ranked = cut.join(before.select("length", "__task", "__before"), ["length", "__task"]).withColumn("__rank", F.col("__before") + F.col("__at"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        length, rank = length.to_numpy(), rank.to_numpy()
        seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for x in np.unique(length):
            mine = length == x
            runs = shared.value[int(x)]
            r = rank[mine]
            hit = runs[np.searchsorted(runs[:, 1], r, "right")]
            k, rest = np.divmod(r - hit[:, 0], hit[:, 3])
            seq[mine], off[mine] = hit[:, 2] + k, hit[:, 4] + rest * x
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    extra = ["ids"] if with_ids else []
    return ranked.withColumn("__p", place("length", "__rank")).select("doc_id", "piece", "start", "length", "ids_crc32", "__p.sequence_id", "__p.offset", *extra)
