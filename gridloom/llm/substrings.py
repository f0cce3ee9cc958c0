"""Substring deduplication with difference-cover anchors.

Positions of a document are words. A difference cover D of a period v has, for any two positions i and j, an offset below
v that takes both into D modulo v. So two equal windows of ``window`` words share an aligned anchor: a run of
window - v + 1 words that starts at a cover position in either. Only anchors at cover positions are hashed and compared
over the corpus; windows are hashed only where one of their anchors occurs twice (the extension of a match), and of each
group of equal windows all but the first are repeats.

Data move as packed blocks, one row for each chunk of text and hash bucket. Before every exchange a chunk sends a hash
only once, so a passage that stands in a third of all documents is a few rows and not a hot group. Texts are sent
compressed to their documents' buckets, where what was found about them arrives as packed positions.

Anchors are compared by 48 bits beside the bucket's: a chance match only adds a candidate. Windows are compared by
96 bits beside the bucket's.

Defined results: words are runs of bytes other than space and \\x09-\\x0D; a null text has no words; documents below
``window`` words lose nothing; order is by id (null first), then by a hash of the text where different rows share an id,
then by place; rows that repeat id and text are one document and get the same result; an empty table gives none.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import runtime
from gridloom.llm.tokens import U, mix, pieces, windows, words_of

# Period and perfect difference set modulo that period.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
LOAD = 1_200_000
NULL_ID = -(1 << 63)

BLOCK = "kind int, bucket long, h32 binary, h16 binary, more binary, docs array<long>, ties array<long>, counts binary, pos binary, body binary"
NAMES = [x.split()[0] for x in BLOCK.split(", ")]
TYPES = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(TYPES)], names=NAMES)


def _home(doc: np.ndarray, tie: np.ndarray, n: int) -> np.ndarray:
    """Bucket of a document."""
    return (mix(doc.astype(U) * U(0x9E3779B97F4A7C15) + tie.astype(U)) % U(n)).astype(np.int64)


def _packed(kind: int, bucket: np.ndarray, n: int, doc: np.ndarray, ids: np.ndarray, ties: np.ndarray, pos: np.ndarray, h32=None, h16=None, more=None, body=None):
    """Rows by bucket of entries that are sorted by doc, an index into ids and ties."""
    order = np.argsort(bucket.astype(np.uint16 if n <= 65536 else np.int64), kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        at = order[cuts[b] : cuts[b + 1]]
        d = doc[at]
        first = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
        counts = np.diff(np.append(first, len(d)))
        u = d[first]
        part = [None if x is None else x[at].tobytes() for x in (h32, h16, more, body)]
        yield (kind, b, *part[:3], ids[u], ties[u], counts.astype(np.uint32).tobytes(), pos[at].astype(np.uint32).tobytes(), part[3])


def _unpacked(batch: pa.RecordBatch):
    """(doc, tie, pos) of all entries of packed rows."""
    counts = np.frombuffer(b"".join(batch.column("counts").to_pylist()), np.uint32)
    docs = batch.column("docs").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    ties = batch.column("ties").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(docs, counts), np.repeat(ties, counts), np.frombuffer(b"".join(batch.column("pos").to_pylist()), np.uint32)


def _ranked(doc: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rank of each (doc, tie), and the distinct ones in order."""
    key = np.stack([doc, tie], 1)
    order = np.lexsort((tie, doc))
    s = key[order]
    new = np.append(True, (s[1:] != s[:-1]).any(1)) if len(s) else np.zeros(0, bool)
    rank = np.empty(len(s), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank, s[new][:, 0], s[new][:, 1]


def _anchor_kernel(period: int, cover: tuple[int, ...], size: int, window: int, nb: int):
    at_cover = np.zeros(period, bool)
    at_cover[list(cover)] = True

    def flush(held):
        doc = np.concatenate([x[0] for x in held])
        ids, ties = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
        h, pos = np.concatenate([x[3] for x in held]), np.concatenate([x[4] for x in held])
        _, first, back, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        again = n[back] > 1
        once = np.zeros(len(h), bool)
        once[first] = True
        s = np.flatnonzero(again)  # repeats within this chunk need no comparison
        yield from _packed(1, _home(ids[doc[s]], ties[doc[s]], nb), nb, doc[s], ids, ties, pos[s])
        s = np.flatnonzero(once)
        yield from _packed(0, (h[s] % U(nb)).astype(np.int64), nb, doc[s], ids, ties, pos[s], (h[s] >> U(32)).astype(np.uint32), (h[s] >> U(16)).astype(np.uint16), again[s])

    def anchors_by_bucket(it):
        held, load, ndoc = [], 0, 0
        for batch in it:
            for part in pieces(batch):
                w = words_of(part.column("text"), "space")
                h, ok = windows(w.hash, w.doc, size, 3)
                p = w.position()[: len(h)]
                s = np.flatnonzero(ok & at_cover[p % period] & (w.count[w.doc[: len(h)]] >= window))
                ids = part.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)
                held.append((w.doc[s] + ndoc, ids, part.column("tie").to_numpy(zero_copy_only=False), h[s], p[s]))
                ndoc, load = ndoc + len(ids), load + len(w.hash)
                if load >= LOAD:
                    yield _batch(list(flush(held)))
                    held, load, ndoc = [], 0, 0
        if held:
            yield _batch(list(flush(held)))

    return anchors_by_bucket


def _repeated_anchors_kernel(nb: int):
    """Of anchors by bucket: those that occur more than once, by home bucket of their documents."""

    def repeated_anchors(it):
        held = []
        for batch in it:
            known = batch.filter(pa.compute.equal(batch.column("kind"), 1))
            if known.num_rows:
                yield known
            held.append(batch.filter(pa.compute.equal(batch.column("kind"), 0)))
        if not sum(b.num_rows for b in held):
            return
        got = [_unpacked(b) for b in held]
        doc, tie, pos = (np.concatenate([g[i] for g in got]) for i in range(3))
        join = lambda c, kind: np.frombuffer(b"".join(x for b in held for x in b.column(c).to_pylist()), kind)
        sizes = np.array([len(x) // 2 for b in held for x in b.column("h16").to_pylist()], np.int64)
        bucket = np.repeat(np.concatenate([b.column("bucket").to_numpy() for b in held]), sizes)
        h = (join("h32", np.uint32).astype(U) << U(16)) | join("h16", np.uint16)
        key = (h << U(16)) ^ (mix(bucket.astype(U)) >> U(20))
        order = np.argsort(key)
        k = key[order]
        new = np.append(True, k[1:] != k[:-1])
        n = np.diff(np.append(np.flatnonzero(new), len(k)))
        twice = np.empty(len(k), bool)
        twice[order] = np.repeat(n > 1, n)
        s = np.flatnonzero(twice | (join("more", np.uint8) > 0))
        rank, ids, ties = _ranked(doc[s], tie[s])
        order = np.argsort(rank, kind="stable")
        rows = list(_packed(1, _home(doc[s], tie[s], nb)[order], nb, rank[order], ids, ties, pos[s][order]))
        for i in range(0, len(rows), 256):
            yield _batch(rows[i : i + 256])

    return repeated_anchors


class _Marks:
    """Positions by document, gathered from packed rows."""

    def __init__(self, held: list[pa.RecordBatch]):
        got = [_unpacked(b) for b in held]
        doc, tie, pos = (np.concatenate([g[i] for g in got]) if got else np.zeros(0, np.int64) for i in range(3))
        rank, ids, ties = _ranked(doc, tie)
        order = np.argsort(rank, kind="stable")
        self.pos = pos[order].astype(np.int64)
        cuts = np.searchsorted(rank[order], np.arange(len(ids) + 1))
        self.where = {k: (a, b) for k, a, b in zip(zip(ids.tolist(), ties.tolist(), strict=True), cuts.tolist(), cuts[1:].tolist(), strict=False)}

    def of(self, doc: int, tie: int) -> np.ndarray:
        a, b = self.where.get((doc, tie), (0, 0))
        return self.pos[a:b]


def _texts_kernel(nb: int):
    """Texts, compressed, for their home buckets."""

    def texts_by_home(it):
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        for batch in it:
            ids = batch.column("doc_id")
            d = ids.fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            t = batch.column("tie").to_numpy(zero_copy_only=False)
            body = [z.compress((x or "").encode()) for x in batch.column("text").to_pylist()]
            home = _home(d, t, nb)
            yield _batch([(2, h, None, None, None, [a], [b], None, None, c) for h, a, b, c in zip(home.tolist(), d.tolist(), t.tolist(), body, strict=True)])

    return texts_by_home


def _at_home(it):
    """(marks, batches of (ids, ties, texts)) of a partition whose packed rows come first."""
    import zstandard

    z = zstandard.ZstdDecompressor()
    held, marks = [], None
    for batch in it:
        packed = batch.filter(pa.compute.less(batch.column("kind"), 2))
        if packed.num_rows:
            held.append(packed)
        texts = batch.filter(pa.compute.equal(batch.column("kind"), 2))
        if texts.num_rows:
            if marks is None:
                marks, held = _Marks(held), []
            yield marks, texts.column("docs").flatten().to_numpy(zero_copy_only=False), texts.column("ties").flatten().to_numpy(zero_copy_only=False), [z.decompress(x) for x in texts.column("body").to_pylist()]


def _split(ids, ties, bodies, most=2 << 20):
    i = 0
    while i < len(bodies):
        j, size = i, 0
        while j < len(bodies) and (j == i or size + len(bodies[j]) <= most):
            size += len(bodies[j])
            j += 1
        yield ids[i:j], ties[i:j], bodies[i:j]
        i = j


def _firsts(h: np.ndarray, g: np.ndarray, dp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of windows with hashes h and g at places dp: the first of each, and all that come later (a place may repeat)."""
    order = np.argsort(dp)
    order = order[np.argsort(h[order], kind="stable")]
    hs, gs, ds = h[order], g[order], dp[order]
    first = np.flatnonzero(np.append(True, (hs[1:] != hs[:-1]) | (gs[1:] != gs[:-1])))
    lead = np.repeat(ds[first], np.diff(np.append(first, len(hs))))
    return order[first], order[ds > lead]


def _window_kernel(window: int, period: int, nb: int):
    """Windows over repeated anchors: by chunk, the first of each by hash bucket, and the others as repeats."""

    def flush(held):
        ids, ties = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        doc, pos, h, g = (np.concatenate([x[i] for x in held]) for i in range(2, 6))
        rank, rids, rties = _ranked(ids, ties)
        g = (g >> U(32)).astype(np.uint32)
        dp = (rank[doc].astype(U) << U(32)) | pos.astype(U)
        first, later = _firsts(h, g, dp)
        first, later = first[np.argsort(dp[first])], later[np.argsort(dp[later])]
        r = rank[doc[later]]
        yield from _packed(1, _home(rids[r], rties[r], nb), nb, r, rids, rties, pos[later])
        yield from _packed(0, (h[first] % U(nb)).astype(np.int64), nb, rank[doc[first]], rids, rties, pos[first], h32=g[first], body=h[first])

    def windows_by_bucket(it):
        held, load, ndoc = [], 0, 0
        for marks, ids, ties, bodies in _at_home(it):
            for i, t, b in _split(ids, ties, bodies):
                w = words_of(pa.array(b, pa.binary()), "space")
                n = len(w.hash) - window + 1
                if n <= 0:
                    continue
                mark = np.zeros(len(w.hash) + 1, np.int64)
                for f, a, c in zip(w.first.tolist(), i.tolist(), t.tolist(), strict=True):
                    mark[f + marks.of(a, c) + 1] = 1
                np.cumsum(mark, out=mark)
                near = mark[np.arange(n) + period] > mark[:n]  # an anchor that occurs twice starts in the first places
                (h, ok), (g, _) = windows(w.hash, w.doc, window, 1), windows(w.hash, w.doc, window, 2)
                s = np.flatnonzero(ok & near)
                if not len(s):
                    continue
                held.append((i, t, w.doc[s] + ndoc, w.position()[s], h[s], g[s]))
                ndoc, load = ndoc + len(i), load + len(s)
                if load >= LOAD // 2:
                    yield _batch(list(flush(held)))
                    held, load, ndoc = [], 0, 0
        if held:
            yield _batch(list(flush(held)))

    return windows_by_bucket


def _repeated_windows_kernel(nb: int):
    """Of windows by bucket: all but the first of each, by home bucket of their documents."""

    def repeated_windows(it):
        held = []
        for batch in it:
            known = batch.filter(pa.compute.equal(batch.column("kind"), 1))
            if known.num_rows:
                yield known
            held.append(batch.filter(pa.compute.equal(batch.column("kind"), 0)))
        if not sum(b.num_rows for b in held):
            return
        got = [_unpacked(b) for b in held]
        doc, tie, pos = (np.concatenate([g[i] for g in got]) for i in range(3))
        join = lambda c, kind: np.frombuffer(b"".join(x for b in held for x in b.column(c).to_pylist()), kind)
        rank, ids, ties = _ranked(doc, tie)
        dp = (rank.astype(U) << U(32)) | pos.astype(U)
        _, later = _firsts(join("body", U), join("h32", np.uint32), dp)
        later = later[np.argsort(dp[later])]
        r = rank[later]
        rows = list(_packed(1, _home(ids[r], ties[r], nb), nb, r, ids, ties, pos[later]))
        for i in range(0, len(rows), 256):
            yield _batch(rows[i : i + 256])

    return repeated_windows


def _result_kernel(window: int):
    def kept_words(it):
        for marks, ids, ties, bodies in _at_home(it):
            out: dict[str, list] = {c: [] for c in ("n_words", "n_removed", "kept")}
            for a, c, body in zip(ids.tolist(), ties.tolist(), bodies, strict=True):
                words = body.split()  # at ASCII white space
                p = marks.of(a, c)
                n, kept = len(words), words
                if len(p):
                    step = np.zeros(n + 1, np.int64)
                    np.add.at(step, p, 1)
                    np.add.at(step, p + window, -1)
                    kept = list(compress(words, np.cumsum(step[:-1]) == 0))
                out["n_words"].append(n)
                out["n_removed"].append(n - len(kept))
                out["kept"].append(b" ".join(kept).decode())
            yield pa.RecordBatch.from_arrays([pa.array([None if x == NULL_ID else x for x in ids.tolist()], pa.int64()), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept"], pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return kept_words


def remove_repeats(df: DataFrame, window: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and the kept words, joined by a space, of every row."""
    spark = df.sparkSession
    runtime.prepare(spark)
    period = max(v for v in COVERS if v <= max(min(COVERS), window * 2 // 3))
    if window <= period:
        raise ValueError("windows of 8 words at least")
    nb = runtime.partitions(spark)
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.xxhash64(F.col(text)), F.lit(0)).alias("tie"))
    packed = lambda x, kernel: x.mapInArrow(runtime.lean(kernel), BLOCK)
    apart = lambda x: runtime.to_tasks(x, "bucket")
    anchors = packed(rows, _anchor_kernel(period, COVERS[period], window - period + 1, window, nb))
    twice = runtime.cut(packed(apart(anchors), _repeated_anchors_kernel(nb)))
    texts = packed(rows, _texts_kernel(nb))
    at_home = lambda marks: apart(marks.unionByName(texts)).sortWithinPartitions("kind")
    found = packed(at_home(twice), _window_kernel(window, period, nb))
    repeats = runtime.cut(packed(apart(found), _repeated_windows_kernel(nb)))
    return at_home(repeats).mapInArrow(runtime.lean(_result_kernel(window)), "doc_id long, n_words long, n_removed long, kept string")
