"""N-gram Jaccard join by vertical partitioning: classes of documents connected by similar shingle sets, and their links.

The global order of shingles is by frequency (those not known to be frequent first, then by counted frequency) and by
hash. Similar sets share a shingle among the first of either set in that order (prefix filter), at places that still
allow the overlap (positional filter), have similar sizes (length filter), and differ in few parity cells (a sketch of a bit
for each shingle or two, which bounds the symmetric difference from below). Equal sets are one set from the start.

Candidates are not verified pair by pair. Plausible pairs only say which sets could be connected: each list of a prefix
shingle gives its few possible pairs, or, where a list is crowded, the pairs with its leader; what a crowded list still
holds in different groups is joined by a sweep that stops at one pair for each two groups it connects. So a group of n
near copies makes some n pairs, not n*n, and every plausible pair of a list ends up inside one group.

Then the texts of grouped sets are fetched, once, and the order is cut into fragments: a task counts the overlaps of one
fragment for all pairs of two blocks of a group, apart from the other fragments, and the partial counts are summed for
each pair and compared with the exact bound. Links are thus counted exactly, also within a class, without leaving the
blocks: a set's number of links and a spanning forest come out. The cost of this step grows with the square of a
group's number of different sets.

Any order gives the same result; the list of frequent shingles is bounded (``listed``) and only an aid.

Defined results: null texts and texts without words have the empty set and link with nothing; fewer words than a shingle
has: the whole sequence is the one shingle; rows with equal sets are linked; each row has the component of its own text,
also where rows with other texts repeat its id; a null id belongs to its row's component but is never its smallest id; an empty table gives none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import runtime
from gridloom.llm.components import components
from gridloom.llm.tokens import U, mix, pieces, windows, words_of

LOAD = 1_000_000
FRAGMENTS = 4
CROWD = 512
CROWD_TOKENS = 400_000
SPREAD = 4096
SALTED = 1024


def shingle_sets(col: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    w = words_of(col, "space_lower")
    h, _ = windows(w.hash, w.doc, k, 1)
    out = []
    for f, c in zip(w.first.tolist(), w.count.tolist(), strict=True):
        if c >= k:
            s = np.sort(h[f : f + c - k + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif c:
            out.append(windows(w.hash[f : f + c], w.doc[f : f + c], c, 1)[0])
        else:
            out.append(np.zeros(0, U))
    return out


def set_id(s: np.ndarray) -> tuple[int, int]:
    n = U(len(s))
    a, b = mix(s ^ U(0x5851F42D4C957F2D)), mix(s + U(0x14057B7EF767814F))
    ends = mix(np.array([a.sum(dtype=U) + n, b.sum(dtype=U) ^ n], U)).astype(np.int64)
    return int(ends[0]), int(ends[1])


def cells(s: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles in each hash cell, as longs; a power of two of cells, at least as many as shingles.

    Two sets differ in as many shingles at least as in cells. Twice the cells fold into half by exclusive or.
    """
    m = max(512, 1 << (len(s) - 1).bit_length())
    cell = (mix(s + U(0x2545F4914F6CDD1D)) & U(m - 1)).astype(np.int64)
    return np.packbits((np.bincount(cell, minlength=m) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def _chunks(it, k: int):
    """Stretches of rows as (ids, sets), of about LOAD shingles. Where rows have a ``mark``, ids are (id, mark)."""
    ids, sets, load = [], [], 0
    for batch in it:
        for part in pieces(batch):
            got = shingle_sets(part.column("text"), k)
            these = part.column("doc_id").to_pylist()
            ids += zip(these, part.column("mark").to_pylist(), strict=True) if "mark" in part.schema.names else these
            sets += got
            load += sum(map(len, got))
            if load >= LOAD:
                yield ids, sets
                ids, sets, load = [], [], 0
    if ids:
        yield ids, sets


def _distinct(ids: list, sets: list[np.ndarray]) -> dict[tuple[int, int], tuple[np.ndarray, list]]:
    found: dict[tuple[int, int], tuple[np.ndarray, list]] = {}
    for i, s in zip(ids, sets, strict=True):
        found.setdefault(set_id(s), (s, []))[1].append(i)
    return found


def _by_bucket(bucket: np.ndarray, nb: int):
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(nb + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        yield b, order[cuts[b] : cuts[b + 1]]


def _arrow(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(fields)], names=[f for f, _ in fields])


L, B, I = pa.int64(), pa.binary(), pa.int32()
FIRST = [("kind", I), ("h1", L), ("h2", L), ("n", L), ("docs", pa.list_(L)), ("marks", pa.list_(L)), ("cells", pa.list_(L)), ("bucket", L), ("tokens", B), ("counts", B)]
POSTING = [("bucket", L), ("tokens", B), ("members", B), ("sizes", B), ("places", B)]


def _sets_kernel(k: int, nb: int):
    """Kind 0: the distinct sets of a chunk with their documents. Kind 1: shingles that occur in several of them."""

    def sets_of_chunks(it):
        for ids, sets in _chunks(it, k):
            found = _distinct(ids, sets)
            rows = [(0, a, b, len(s), [d for d, _ in docs], [x for _, x in docs], cells(s), None, None, None) for (a, b), (s, docs) in found.items()]
            u, n = np.unique(np.concatenate([s for s, _ in found.values()]), return_counts=True)
            u, n = u[n > 1], n[n > 1].astype(np.uint32)
            rows += [(1, None, None, None, None, None, None, b, u[at].tobytes(), n[at].tobytes()) for b, at in _by_bucket((u % U(nb)).astype(np.int64), nb)]
            yield _arrow(rows, FIRST)

    return sets_of_chunks


def _frequent(first: DataFrame, nb: int, listed: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted by hash, and their counts: an equal share of the list from each hash bucket."""
    share = max(1, listed // nb)

    def kernel(it):
        held: dict[int, list] = {}
        for batch in it:
            for b, t, c in zip(*(batch.column(x).to_pylist() for x in ("bucket", "tokens", "counts")), strict=True):
                held.setdefault(b, []).append((np.frombuffer(t, U), np.frombuffer(c, np.uint32)))
        rows = []
        for got in held.values():
            u, back = np.unique(np.concatenate([x[0] for x in got]), return_inverse=True)
            n = np.bincount(back, np.concatenate([x[1] for x in got])).astype(np.int64)
            top = np.argsort(-n, kind="stable")[:share]
            top = top[n[top] > 2]
            rows.append((u[top].tobytes(), n[top].tobytes()))
        yield _arrow(rows, [("tokens", B), ("counts", B)])

    rows = runtime.to_tasks(first.where("kind = 1").select("bucket", "tokens", "counts"), "bucket")
    got = rows.mapInArrow(runtime.lean(kernel), "tokens binary, counts binary").collect()  # `listed` shingles at most
    u = np.concatenate([np.frombuffer(bytes(r["tokens"]), U) for r in got] or [np.zeros(0, U)])
    n = np.concatenate([np.frombuffer(bytes(r["counts"]), np.int64) for r in got] or [np.zeros(0, np.int64)])
    order = np.argsort(u)
    return u[order], n[order]


def _rank(s: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Known frequency of each shingle, or 0."""
    if not len(known) or not len(s):
        return np.zeros(len(s), np.int64)
    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
    return np.where(known[at] == s, counts[at], 0)


def _least(n, percent: int):
    """Smallest overlap of a set of n with a set similar to it."""
    return -(-n * percent // 100)


def _blocks(freq: np.ndarray) -> np.ndarray:
    return 1 + freq // SPREAD


def _prefix_kernel(k: int, nb: int, percent: int, shared):
    """Prefix postings of a chunk's distinct sets by bucket of (shingle, block)."""

    def prefix_postings(it):
        known, counts = shared.value
        for ids, sets in _chunks(it, k):
            t, m, n, p = [], [], [], []
            for (a, _), (s, _) in _distinct(ids, sets).items():
                if not len(s):
                    continue
                freq = _rank(s, known, counts)
                size = len(s) - _least(len(s), percent) + 1
                order = np.lexsort((s, freq))[:size] if freq.any() else np.arange(size)
                t.append(s[order])
                m.append(np.full(size, a, np.int64))
                n.append(np.full(size, len(s), np.uint32))
                p.append(np.arange(size, dtype=np.uint32))
            if not t:
                continue
            t, m, n, p = map(np.concatenate, (t, m, n, p))
            salt = (mix(m.astype(U)) % _blocks(_rank(t, known, counts)).astype(U)).astype(U)
            bucket = ((t ^ mix(salt)) % U(nb)).astype(np.int64)
            yield _arrow([(b, t[at].tobytes(), m[at].tobytes(), n[at].tobytes(), p[at].tobytes()) for b, at in _by_bucket(bucket, nb)], POSTING)

    return prefix_postings


def _entries(batches):
    """(shingle, member, size, place) of packed postings, sorted by shingle, then by a random rank of members."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return None
    join = lambda c, kind: np.frombuffer(b"".join(x for b in held for x in b.column(c).to_pylist()), kind)
    t, m, n, p = join("tokens", U), join("members", np.int64), join("sizes", np.uint32), join("places", np.uint32)
    order = np.lexsort((mix(m.astype(U)), t))
    t, m, n, p = t[order], m[order], n[order].astype(np.int64), p[order].astype(np.int64)
    keep = np.append(True, (t[1:] != t[:-1]) | (m[1:] != m[:-1]))
    return t[keep], m[keep], n[keep], p[keep]


def _possible(n1, p1, n2, p2, percent: int):
    """Length and positional filters for sets that share a shingle at places p1 and p2."""
    most = 1 + np.minimum(n1 - p1 - 1, n2 - p2 - 1)
    return (100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)) & ((100 + percent) * most >= percent * (n1 + n2))


LISTS = [("kind", I), ("a", L), ("b", L), ("crowd", L), *POSTING]
FEW = 3


def _list_kernel(nb: int, percent: int, shared, again: bool):
    """Kind 0: candidate pairs (a, b) of a list, ``crowd`` of them around a. Kind 1: crowded lists. Kind 2: leaders of blocks.

    A list with at most FEW possible pairs for each member gives them all; others give the pairs with their first member.
    """

    def candidates(it):
        known, counts = shared.value
        got = _entries(it)
        if got is None:
            return
        t, m, n, p = got
        first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        size = np.diff(np.append(first, len(t)))
        dealt = _blocks(_rank(t[first], known, counts)) > 1
        crowded = dealt | (size > SPREAD)
        a, b, crowd = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        pairs = np.flatnonzero((size == 2) & ~dealt)
        i = first[pairs]
        ok = _possible(n[i], p[i], n[i + 1], p[i + 1], percent)
        a.append(m[i[ok]])
        b.append(m[i[ok] + 1])
        crowd.append(np.ones(int(ok.sum()), np.int64))
        for x in np.flatnonzero((size > 2) & ~crowded).tolist():
            s = slice(first[x], first[x] + size[x])
            some, u, v = 0, [], []
            mine, width, place = m[s], n[s], p[s]
            for k in range(len(mine) - 1):
                hit = k + 1 + np.flatnonzero(_possible(width[k], place[k], width[k + 1 :], place[k + 1 :], percent))
                some += len(hit)
                if some > FEW * len(mine):
                    crowded[x] = True
                    break
                u.append(np.full(len(hit), k))
                v.append(hit)
            else:
                u, v = np.concatenate(u), np.concatenate(v)
                a.append(mine[u])
                b.append(mine[v])
                crowd.append(np.ones(len(u), np.int64))
        lead = np.repeat(first, size)
        ok = np.repeat(crowded, size) & (lead != np.arange(len(t))) & _possible(n[lead], p[lead], n, p, percent)
        a.append(m[lead[ok]])
        b.append(m[ok])
        crowd.append(np.repeat(size, size)[ok])
        a, b, crowd = map(np.concatenate, (a, b, crowd))
        order = np.lexsort((-crowd, b, a))
        a, b, crowd = a[order], b[order], crowd[order]
        keep = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
        keep &= a != b
        a, b, crowd = a[keep], b[keep], crowd[keep]
        empty = lambda k, kinds: [pa.nulls(k, kind) for kind in kinds]
        names = [x for x, _ in LISTS]
        for i in range(0, len(a), 50_000):
            k = len(a[i : i + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(k, np.int32)), *(pa.array(x[i : i + k]) for x in (a, b, crowd)), *empty(k, [x for _, x in POSTING])], names=names)
        if again:
            return
        rows = []
        pack = lambda kind, bucket, at: (kind, None, None, None, bucket, t[at].tobytes(), m[at].tobytes(), n[at].astype(np.uint32).tobytes(), p[at].astype(np.uint32).tobytes())
        held = np.flatnonzero(np.repeat(crowded, size))
        for bucket, at in _by_bucket((t[held] % U(nb)).astype(np.int64), nb):
            rows += [pack(1, bucket, held[at[i : i + 20_000]]) for i in range(0, len(at), 20_000)]
        held = first[dealt]
        for bucket, at in _by_bucket((t[held] % U(nb)).astype(np.int64), nb):
            rows.append(pack(2, bucket, held[at]))
        if rows:
            yield _arrow(rows, LISTS)

    return candidates


ENTRY = "token long, member long, size long, place long, block int, blocks int"


def _unpack_kernel(shared):
    def list_entries(it):
        known, counts = shared.value
        for batch in it:
            for row in range(batch.num_rows):
                t, m, n, p = _entries([batch.slice(row, 1)])
                s = _blocks(_rank(t, known, counts))
                salt = (mix(m.astype(U)) % s.astype(U)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int64)), pa.array(m), pa.array(n), pa.array(p), pa.array(salt), pa.array(s.astype(np.int32))], names=[x.split()[0] for x in ENTRY.split(", ")])

    return list_entries


def _groups(it, keys: list[str]):
    """Groups of rows with equal keys, as tables, from batches sorted by the keys; one group is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in it:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cuts = np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in cols], axis=0)))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), batch.num_rows], strict=True):
            key = tuple(c[a].item() for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _cross_kernel(percent: int):
    """Pairs of groups that a crowded list connects: from entries by (token, pair of blocks, sizes), one pair for each two groups."""

    def groups_met(it):
        out: set[tuple[int, int]] = set()
        for g in _groups(it, ["token", "lo", "hi", "scale"]):
            lo, hi = g["lo"][0].as_py(), g["hi"][0].as_py()
            block, n, p, c, m = (g[x].to_numpy() for x in ("block", "size", "place", "label", "member"))
            order = np.lexsort((m, c))
            block, n, p, c = block[order], n[order], p[order], c[order]
            sketches = g["cells"].combine_chunks().take(pa.array(order))
            width = pa.compute.list_value_length(sketches).to_numpy()
            flat, start = sketches.flatten().to_numpy().view(U), np.append(0, np.cumsum(width))
            names, label = np.unique(c, return_inverse=True)
            for i in range(len(n)):
                j = np.flatnonzero(label != label[i])
                j = j[j > i] if lo == hi else j[block[j] != block[i]] if block[i] == lo else j[:0]
                j = j[_possible(n[i], p[i], n[j], p[j], percent)]
                if not len(j):
                    continue
                met = set()
                for w in np.unique(width[j]).tolist():
                    some = j[width[j] == w]
                    mine, theirs = flat[start[i] : start[i + 1]], flat[start[some][:, None] + np.arange(w)]
                    while len(mine) > theirs.shape[1]:
                        mine = mine[: len(mine) // 2] ^ mine[len(mine) // 2 :]
                    while theirs.shape[1] > len(mine):
                        half = theirs.shape[1] // 2
                        theirs = theirs[:, :half] ^ theirs[:, half:]
                    apart = np.bitwise_count(theirs ^ mine).sum(1, dtype=np.int64)
                    met |= set(label[some[(100 + percent) * (n[i] + n[some] - apart) >= 2 * percent * (n[i] + n[some])]].tolist())
                for x in met:
                    u, v = int(names[label[i]]), int(names[x])
                    out.add((min(u, v), max(u, v)))
                    label[label == x] = label[i]
            if len(out) > 50_000:
                yield _arrow(list(out), [("a", L), ("b", L)])
                out = set()
        if out:
            yield _arrow(list(out), [("a", L), ("b", L)])

    return groups_met


FRAGMENT = [("label", L), ("block", I), ("blocks", I), ("part", I), ("h1", L), ("h2", L), ("tokens", B)]


def _fragment_kernel(k: int, shared):
    """The sets of fetched texts by fragment of the global order. A text whose set is not the one asked for gives nothing."""

    def fragments(it):
        known, counts = shared.value
        half = FRAGMENTS // 2
        levels = np.quantile(counts, np.linspace(0, 1, half + 1)[1:-1]) if len(counts) else np.zeros(half - 1)
        for batch in it:
            for some in pieces(batch):
                rows = []
                asked = zip(*(some.column(c).to_pylist() for c in ("h1", "h2", "label", "block", "blocks")), strict=True)
                for s, (h1, h2, label, block, blocks) in zip(shingle_sets(some.column("text"), k), asked, strict=True):
                    if set_id(s) == (h1, h2):
                        freq = _rank(s, known, counts)
                        part = np.where(freq == 0, (s >> U(60)).astype(np.int64) * half // 16, half + np.searchsorted(levels, freq))
                        rows += [(label, block, blocks, f, h1, h2, s[part == f].tobytes()) for f in range(FRAGMENTS)]
                yield _arrow(rows, FRAGMENT)

    return fragments


def _partial_kernel(it):
    """Overlaps within one fragment of all pairs of two blocks, as a packed matrix. Members are in the order of (block, h1, h2)."""
    for g in _groups(it, ["label", "lo", "hi", "part"]):
        block, h1, h2 = (g[x].to_numpy() for x in ("block", "h1", "h2"))
        order = np.lexsort((h2, h1, block))
        new = np.append(True, (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1]))
        order = order[new]  # rows that repeat an id and its text are one set
        sets = [np.frombuffer(x, U) for x in g["tokens"].take(pa.array(order)).to_pylist()]
        n = np.array([len(x) for x in sets], np.uint32)
        k = len(sets)
        over = np.zeros((k, k), np.uint32)
        shared, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        common = np.cumsum(times > 1) - 1  # a shingle of one set alone adds nothing
        who, use = np.repeat(np.arange(k), n), times[place] > 1
        who, place = who[use], common[place[use]]
        width = int(times.size and common[-1] + 1)
        step = max(1024, (1 << 22) // k)
        for at in range(0, width, step):
            here = (place >= at) & (place < at + step)
            x = np.zeros((k, min(step, width - at)), np.float32)
            x[who[here], place[here] - at] = 1
            over += (x @ x.T).astype(np.uint32)
        del shared
        one = lambda c: pa.array([g[c][0].as_py()], g.schema.field(c).type)
        yield pa.RecordBatch.from_arrays([one("label"), one("lo"), one("hi"), pa.array([h1[order].tobytes()], B), pa.array([h2[order].tobytes()], B), pa.array([block[order].astype(np.int32).tobytes()], B), pa.array([n.tobytes()], B), pa.array([over.tobytes()], B)], names=[x.split()[0] for x in PARTIAL.split(", ")])


PARTIAL = "label long, lo int, hi int, h1 binary, h2 binary, block binary, n binary, over binary"


def _link_kernel(percent: int):
    """Partial overlaps summed by pair: each set's links in the pair of blocks, and its parent in a spanning forest of them."""

    def links(it):
        for g in _groups(it, ["label", "lo", "hi"]):
            read = lambda c, kind: [np.frombuffer(x, kind) for x in g[c].to_pylist()]
            h1, h2, block = read("h1", np.int64)[0], read("h2", np.int64)[0], read("block", np.int32)[0]
            n = sum(x.astype(np.int64) for x in read("n", np.uint32))
            over = sum(x.astype(np.int64) for x in read("over", np.uint32)).reshape(len(n), len(n))
            linked = 100 * over >= percent * (n[:, None] + n[None, :] - over)
            np.fill_diagonal(linked, False)
            if g["lo"][0].as_py() != g["hi"][0].as_py():
                linked &= block[:, None] != block[None, :]
            seen, parent = np.zeros(len(n), bool), np.full(len(n), -1)
            for root in range(len(n)):
                if seen[root]:
                    continue
                seen[root], todo = True, [root]
                while todo:
                    x = todo.pop()
                    new = np.flatnonzero(linked[x] & ~seen)
                    seen[new], parent[new] = True, x
                    todo += new.tolist()
            to = pa.array(h1[parent], mask=parent < 0)
            yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(linked.sum(1)), to], names=["h1", "h2", "links", "parent"])

    return links


def _plausible(found: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets can overlap enough, by the cells in which their parities differ.

    a may lead a large group: its pairs are salted by their list's size (``crowd``).
    """
    found = found.groupBy("a", "b").agg(F.max("crowd").alias("crowd"))
    found = found.withColumn("salt", F.pmod(F.xxhash64("b"), 1 + F.expr(f"crowd div {SALTED}")).cast("int"))
    leaders = found.groupBy("a").agg(F.max("salt").alias("most"))
    b = sketches.select(F.col("h1").alias("b"), F.col("n").alias("nb"), F.col("cells").alias("cb"))
    a = sketches.select(F.col("h1").alias("a"), F.col("n").alias("na"), F.col("cells").alias("ca")).join(leaders, "a").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("most")))).drop("most")
    both = found.select("a", "b", "salt").join(b, "b").join(a, ["a", "salt"])
    half = lambda c, other: F.when(F.size(c) > F.size(other), F.zip_with(F.slice(c, 1, (F.size(c) / 2).cast("int")), F.slice(c, (F.size(c) / 2).cast("int") + 1, (F.size(c) / 2).cast("int")), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(c))
    both = both.withColumns({"ca": half("ca", "cb"), "cb": half("cb", "ca")})  # similar sizes differ by one doubling at most
    apart = F.aggregate(F.zip_with("ca", "cb", lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda t, x: t + x)
    return both.withColumn("apart", apart).where(F.expr(f"{100 + percent} * (na + nb - apart) >= {2 * percent} * (na + nb)")).select("a", "b")


def similar_classes(df: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", listed: int = 400_000, marked: bool = False, linked: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id that links reach) of every row; marked: with text_hash, xxhash64 of the text.

    linked: with n_links, the number of other distinct sets that are similar to the row's own.
    """
    spark = df.sparkSession
    runtime.prepare(spark)
    nb = runtime.partitions(spark)
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("mark", F.xxhash64("text"))
    first = runtime.cut(rows.mapInArrow(runtime.lean(_sets_kernel(k, nb)), "kind int, h1 long, h2 long, n long, docs array<long>, marks array<long>, cells array<long>, bucket long, tokens binary, counts binary"))
    sets = first.where("kind = 0").select("h1", "h2", "n", F.arrays_zip("docs", "marks").alias("rows"), "cells")
    shared = spark.sparkContext.broadcast(_frequent(first, nb, listed))

    posting = "bucket long, tokens binary, members binary, sizes binary, places binary"
    listing = f"kind int, a long, b long, crowd long, {posting}"
    postings = runtime.to_tasks(rows.select("doc_id", "text").mapInArrow(runtime.lean(_prefix_kernel(k, nb, percent, shared)), posting), "bucket")
    lists = runtime.cut(postings.mapInArrow(runtime.lean(_list_kernel(nb, percent, shared, False)), listing))
    leaders = runtime.to_tasks(lists.where("kind = 2").select("bucket", "tokens", "members", "sizes", "places"), "bucket")
    between = leaders.mapInArrow(runtime.lean(_list_kernel(nb, percent, shared, True)), listing)
    least = F.min(F.array_min("rows"))  # the smallest (id, text hash); null ids come first
    named = F.min(F.array_min(F.col("rows.docs")))
    reps = runtime.cut(sets.where("n > 0").groupBy("h1", "h2", "n").agg(least.alias("one"), named.alias("rep"), F.first("cells").alias("cells")))
    found = lists.where("kind = 0").select("a", "b", "crowd").union(between.where("kind = 0").select("a", "b", "crowd"))
    group = components(_plausible(found, reps, percent))

    entries = lists.where("kind = 1").select("bucket", "tokens", "members", "sizes", "places").mapInArrow(runtime.lean(_unpack_kernel(shared)), ENTRY)
    labelled = runtime.cut(entries.join(group.withColumnRenamed("node", "member"), "member", "left").withColumn("label", F.coalesce("label", "member")))
    mixed = labelled.groupBy("token").agg((F.min("label") != F.max("label")).alias("mixed")).where("mixed").select("token")
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    sketches = reps.select(F.col("h1").alias("member"), "cells")
    # similar sets have sizes of one class or of neighbouring ones; a group holds a class and the one below
    scale = F.floor(F.log(F.col("size").cast("double")) / max(1e-6, 1.0001 * math.log(100 / percent))).cast("long")
    dealt = labelled.join(mixed, "token").join(sketches, "member").withColumn("other", others).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    dealt = dealt.withColumn("scale", F.explode(F.array(scale, scale + 1)))
    lists_of = ["token", "lo", "hi", "scale"]
    dealt = runtime.exchange(dealt.select(*lists_of, "block", "member", "size", "place", "label", "cells"), *lists_of).sortWithinPartitions(*lists_of)
    met = runtime.cut(dealt.mapInArrow(runtime.lean(_cross_kernel(percent)), "a long, b long").distinct())
    joined = components(met).select(F.col("node").alias("label"), F.col("label").alias("whole"))
    # groups by the smallest member of their own, or of all groups that lists connect
    alone = met.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(group.select("node"), "node", "left_anti").withColumn("label", F.col("node"))
    group = group.select("node", "label").unionByName(alone).join(joined, "label", "left").select(F.col("node").alias("h1"), F.coalesce("whole", "label").alias("label"))

    grouped = reps.join(group, "h1").select("h1", "h2", "n", "one", "label")
    crowds = grouped.groupBy("label").agg((1 + F.greatest(F.expr(f"sum(n) div {CROWD_TOKENS}"), F.expr(f"count(1) div {CROWD}"))).cast("int").alias("blocks"))
    asked = grouped.join(crowds, "label").select(F.col("one.docs").alias("doc_id"), F.col("one.marks").alias("mark"), "h1", "h2", "label", "blocks", F.pmod(F.xxhash64("h1", "h2"), F.col("blocks")).cast("int").alias("block"))
    asked = runtime.cut(asked)
    near = runtime.maybe_in(rows, "mark", runtime.bloom_bits(asked, "mark"), "maybe").where("maybe").drop("maybe")
    near = near.groupBy("doc_id", "mark").agg(F.first("text").alias("text"))  # repeated rows are one, before the exchange
    wanted = asked.withColumnRenamed("doc_id", "__id").withColumnRenamed("mark", "__mark")
    some = near.join(wanted, near["doc_id"].eqNullSafe(wanted["__id"]) & (near["mark"] == wanted["__mark"])).select("text", "h1", "h2", "label", "blocks", "block")
    parts = some.mapInArrow(runtime.lean(_fragment_kernel(k, shared)), "label long, block int, blocks int, part int, h1 long, h2 long, tokens binary")
    parts = parts.withColumn("other", others).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    keys = ["label", "lo", "hi", "part"]
    parts = runtime.exchange(parts.select(*keys, "block", "h1", "h2", "tokens"), *keys).sortWithinPartitions(*keys)
    partial = parts.mapInArrow(runtime.lean(_partial_kernel), PARTIAL)
    partial = runtime.exchange(partial, *keys[:3]).sortWithinPartitions(*keys[:3])
    links = runtime.cut(partial.mapInArrow(runtime.lean(_link_kernel(percent)), "h1 long, h2 long, links long, parent long"))

    labels = components(links.where("parent is not null").select(F.col("h1").alias("a"), F.col("parent").alias("b"))).withColumnRenamed("node", "h1")
    classed = reps.select("h1", "h2", "rep").join(labels, "h1", "left").withColumn("label", F.coalesce("label", "h1"))
    classes = classed.select("h1", "h2", "label").join(classed.groupBy("label").agg(F.min("rep").alias("least")), "label").select("h1", "h2", "least")
    if linked:
        classes = classes.join(links.groupBy("h1", "h2").agg(F.sum("links").alias("links")), ["h1", "h2"], "left")
    else:
        classes = classes.withColumn("links", F.lit(0).cast("long"))
    classes = runtime.cut(classes)
    runtime.forget(lists, reps, labelled, met, asked, links)
    found = sets.select("h1", "h2", "n", "rows").join(classes, ["h1", "h2"], "left").select(F.explode("rows").alias("row"), F.col("n").alias("n_shingles"), "least", "links")
    found = found.select(F.col("row.docs").alias("doc_id"), "n_shingles", "least", F.col("row.marks").alias("text_hash"), F.coalesce("links", F.lit(0)).alias("n_links"))
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("least")).alias("component_id")
    return found.select("doc_id", "n_shingles", component, *(["n_links"] if linked else []), *(["text_hash"] if marked else []))
