"""Each text operator against a plain version, on a table with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gridloom.llm import chargrams, decontaminate, jaccard, language, packing, queries, secrets, sharding, substrings, toxicity
from gridloom.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, shard int, score double, kind int, rank int"
SPACE = r"[^\x20\x09-\x0D]+"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def word(rnd):
    return "".join(rnd.choice(("an", "er", "th", "on", "É", "x'", "Re", "日", "st")) for _ in range(rnd.randint(1, 3)))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    passage = " ".join(word(rnd) for _ in range(60))
    base = " ".join(word(rnd) for _ in range(120))
    texts = [None, "", "   \n", "one", "one two three", "!!! 123 ???", base, base, base + " tail", passage]
    for k in range(40):
        w = base.split()
        for _ in range(k % 9):
            w[rnd.randrange(len(w))] = word(rnd)
        texts.append(" ".join(w))
    for k in range(25):
        own = [word(rnd) for _ in range(rnd.randint(5, 150))]
        at = rnd.randrange(len(own))
        texts.append((" \t" if k % 2 else "\n").join(own[:at]) + " " + passage + "\x0b" + " ".join(own[at:]))
    texts.append(" ".join(word(rnd) for _ in range(30_000)))  # very long
    texts.append("loop " * 300)
    texts.append("x" * 50_000)
    out = [(i, t) for i, t in enumerate(texts)]
    rnd.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    full = [(i, t, "en", "s", 0, 1, 0.5, 2, 3) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_substrings(docs, rows, empty):
    seen, want = set(), {}
    for i, t in sorted(rows):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for a in range(len(w) - 19):
            k = tuple(w[a : a + 20])
            if k in seen:
                gone[a : a + 20] = [True] * 20
            seen.add(k)
        want[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    got = {r[0]: tuple(r)[1:] for r in substrings.remove_repeats(docs).collect()}
    assert got == want and sum(v[1] for v in got.values()) > 1000
    assert substrings.remove_repeats(empty).count() == 0


def test_substrings_repeated_rows_are_one_document(spark):
    t = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (2, t), (2, "short")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"]) for r in substrings.remove_repeats(df).collect())
    assert got == [(-1, 40, 0), (1, 40, 40), (1, 40, 40), (2, 1, 0), (2, 40, 40)]


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_jaccard(docs, rows, k, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(SPACE, lower(t or ""))
        sets[i] = frozenset(tuple(w[a : a + k]) for a in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = {r[0]: tuple(r)[1:] for r in jaccard.similar_classes(docs, k, percent).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in sets}
    assert len({v[1] for v in got.values()}) < len(got) - 15


def test_jaccard_blocks_of_a_frequent_shingle(spark, monkeypatch):
    """With tiny blocks every list is dealt out; the classes stay the same."""
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(60)] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain = sorted(map(tuple, jaccard.similar_classes(df, 4, 85).collect()))
    monkeypatch.setattr(jaccard, "SPREAD", 8)
    assert sorted(map(tuple, jaccard.similar_classes(df, 4, 85).collect())) == plain


def test_jaccard_counts_all_links(spark, monkeypatch):
    """Links inside a group of near copies, over several blocks, against all pairs."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base[: 60 - int(rng.integers(0, 16))] + [f"x{int(v)}" for v in rng.integers(0, 9, 2)]) for _ in range(40)] + ["far from all of the others here", ""]
    texts.append(texts[0])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if (w := t.split()) else frozenset() for t in texts]
    want = {i: sum(x != y and 100 * len(x & y) >= 85 * len(x | y) for y in set(sets) if x) for i, x in enumerate(sets)}
    assert max(want.values()) > 2
    monkeypatch.setattr(jaccard, "CROWD", 8)
    assert {r["doc_id"]: r["n_links"] for r in jaccard.similar_classes(df, 4, 85, linked=True).collect()} == want


def test_jaccard_empty_and_null_ids(spark, empty):
    assert jaccard.similar_classes(empty).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (8, None), (7, "z")], "doc_id long, text string")
    got = sorted(((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in jaccard.similar_classes(df).collect()))
    assert got == [(-1, 2, 7), (7, 1, 7), (7, 2, 7), (8, 0, 8)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(5, 5), (200, 201)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 140)) and got[201] == 200


def contaminated(rows, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    known = {}
    for i, t in items:
        w = split(t)
        n = min(window, len(w))
        for a in range(len(w) - n + 1 if n and i is not None else 0):
            known.setdefault(tuple(w[a : a + n]), set()).add(str(i))
    out = {}
    for i, t in rows:
        w = split(t)
        hit, found = [False] * len(w), set()
        for n in {len(k) for k in known}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in known:
                    hit[a : a + n] = [True] * n
                    found |= known[tuple(w[a : a + n])]
        out[i] = (len(w), sum(hit), sorted(found))
    return out


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_decontamination(spark, docs, rows, threshold):
    texts = dict(rows)
    some = texts[9].split()
    items = [(1, " ".join(some[5:40])), (2, " ".join(some[30:45]).upper()), (30, "one two"), (4, None), (None, texts[9]), (5, ""), (6, "123"), (30, "one two"), (7, " ".join(some[5:40]))]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["items"])) for r in decontaminate.contamination(docs, bench).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == contaminated(rows, items)
    assert sum(v[1] > 0 for v in got.values()) > 10


def test_decontamination_odd_rows(spark, docs, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, bench).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.clean(empty, bench).count() == 0
    item = "a b c d e f g h i j k"
    rows = [(1, item, 1, "x", 2, 3), (1, item, 4, "y", 5, 6), (1, "clean", 1, "x", 2, 3), (None, item + " z", 1, "x", 2, 3), (None, "clean", 1, "x", 2, 3), (None, None, 1, "x", 2, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, text_hash int, items string, maybe int, __n_hit int")
    bench = spark.createDataFrame([("q", item), ("p", item)], "item_id string, text string")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], list(r["items"])) for r in decontaminate.contamination(df, bench).collect())
    assert got == [(0, 0, 0, []), (0, 1, 0, []), (0, 12, 11, ["p", "q"]), (1, 1, 0, []), (1, 11, 11, ["p", "q"]), (1, 11, 11, ["p", "q"])]
    left = decontaminate.clean(df, bench)
    assert left.columns == df.columns and set(map(tuple, left.collect())) == {rows[2], rows[4], rows[5]}


SECRETS = [
    (0, None), (1, ""), (2, "password=hunter2hunter2 and AKIAABCDEFGHIJKL"), (3, "token: secret=abcdefgh12"), (4, "é api_key = 'abcdefgh' AKIAAKIA x " + "0f" * 20),
    (5, "PassWord:short api-key=abcdefghij apikey=ABCDEFGH"), (6, "user_id=alice\nhttps://db.example.com/x\n" + "aB3" * 9), (7, "just aB3aB3aB3aB3aB3aB3aB3aB3 alone"),
    (8, "username: bob" + "\n\n" + "aB3" * 9), (9, "ſecret=abcdefghij toKen=abcdefghij"), (9, "ſecret=abcdefghij toKen=abcdefghij"),
]


def test_secrets(spark, empty):
    df = spark.createDataFrame(SECRETS, "doc_id long, text string").withColumn("spans", F.lit("clash"))
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    got = {r["doc_id"]: r for r in secrets.find_secrets(df, redact=True).collect()}
    for i, t in SECRETS:
        t = t or ""
        f = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        f += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        f += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(f))
        assert got[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(got[i]["spans"].split(","))
    assert {s.split(":")[0] for s in got[6]["spans"].split(",")} == {"id", "key", "endpoint"}  # complementary parts in a scope
    assert got[7]["spans"] == got[8]["spans"] == ""  # alone, or in another paragraph
    assert "hunter2" not in got[2]["redacted"] and got[0]["redacted"] is None
    assert secrets.find_secrets(empty).count() == 0


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_sharding(docs, rows, empty, law):
    n, texts = 7, dict(rows)
    got = sorted(map(tuple, sharding.balanced_shards(docs, n, law).select("doc_id", "size", "text_crc32", "shard", "slot").collect()))
    total = sum(len((t or "").encode()) + 8 for t in texts.values())
    before, slots = 0, {}
    for k, (i, size, crc, shard, slot) in enumerate(got):
        raw = (texts[i] or "").encode()
        assert (size, crc) == (len(raw) + 8, zlib.crc32(raw))
        assert shard == (min(n - 1, (2 * before + size) * n // (2 * total)) if law == "bytes" else k * n // len(got))
        assert slot == slots.get(shard, 0)
        slots[shard] = slot + 1
        before += size
    assert sharding.balanced_shards(empty, n, law).count() == 0


def test_sharding_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a")] * 50 + [(1, "b")] * 50, "doc_id long, text string")
    got = sharding.balanced_shards(df, 4).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.max("slot").alias("m")).collect()
    assert sorted(r["n"] for r in got) == [25] * 4 and all(r["m"] == 24 for r in got)


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    path, cap = public_tokenizers.path("byte_bpe_50k.json"), 128
    t = Tokenizer.from_file(path)
    got = packing.pack(docs, path, cap).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    total = 0
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        pieces, at = sorted(by_doc[i], key=lambda r: r["piece"]), 0
        assert [p["piece"] for p in pieces] == list(range(-(-len(ids) // cap))) and all(p["length"] == cap for p in pieces[1:])
        for p in pieces:
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
        total += at
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= cap
    assert len(by_seq) <= 1.02 * total / cap + 1
    assert packing.pack(empty, path, cap).count() == 0


def test_packing_rounds_are_as_good_as_best_fit_decreasing(spark):
    rnd = random.Random(5)
    counts = {}
    for _ in range(3000):
        n = rnd.choice((rnd.randint(1, 100), 100, 51, 34))
        counts[n] = counts.get(n, 0) + 1
    placed = packing.plan(spark, counts, 100)
    for n, c in counts.items():
        mine = sorted((lo, hi) for m, lo, hi, *_ in placed if m == n)
        assert [lo for lo, _ in mine] == [0, *(hi for _, hi in mine[:-1])] and mine[-1][1] == c
    got = 1 + max(s + (hi - lo - 1) // per for _, lo, hi, s, per, _ in placed)
    gaps = []
    for n in sorted(counts, reverse=True):
        for _ in range(counts[n]):
            fit = min((g for g in gaps if g >= n), default=None)
            if fit is None:
                gaps.append(100 - n)
            else:
                gaps[gaps.index(fit)] -= n
    assert got <= len(gaps) + 1


def test_tokens_match_the_library_on_hard_texts():
    from tokenizers import Tokenizer

    path, rnd = public_tokenizers.path("byte_bpe_50k.json"), random.Random(2)
    parts = ["'", "s", "t", "re", "ve", "ll", "m", "d", " ", "  ", "\n", "a", "Z", "1", "!", "é", "\t", "'s", "日", "½", " ", "<|endoftext|>", "🙂"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(3000)]
    with open(path, encoding="utf-8") as f:
        mine = packing.PieceEncoder(f.read())
    assert mine.direct
    t = Tokenizer.from_file(path)
    assert [x.tolist() for x in mine.encode(texts)] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


PARTS = {"en": "the of and ing tion er th".split(), "de": "der und sch ein keit ung ü".split(), "fr": "le que eau ment é tion oi".split(), "es": "el que ción ado ñ mente os".split()}


def prose(rnd, lang, n):
    return " ".join("".join(rnd.choice(PARTS[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def test_language_held_out_accuracy(spark):
    rnd = random.Random(4)
    rows = [(i, prose(rnd, l := rnd.choice(list(PARTS)), rnd.randint(8, 60)), l) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = language.train(df.where(queries.fold(4) != 2))
    assert {t[0] for t in model.tasks} == {"family", "germanic", "romance"}
    found = language.identify(df.drop("score"), model)
    held = found.where(queries.fold(4) == 2)
    assert held.where("lang = lang_pred").count() / held.count() > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!!"), (4, "der und sch")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "de" and 0 <= got[4][1] <= 1
    nothing = language.train(df.where("false"))
    assert {r["lang_pred"] for r in language.identify(odd, nothing).collect()} == {"und"}
    single = language.train(df.where("lang = 'de'"))
    assert {r["lang_pred"] for r in language.identify(odd, single).collect()} == {"und", "de"}


def test_toxicity_held_out(spark):
    rnd = random.Random(6)
    rows, labels = [], []
    for i in range(800):
        w, bad = prose(rnd, rnd.choice(("en", "de")), rnd.randint(20, 80)).split(), rnd.random() < 0.2
        if bad:
            for _ in range(3):
                w[rnd.randrange(len(w))] = rnd.choice(("vile", "stupid", "awful"))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(800, None), (801, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit(9))
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, lab.where(queries.fold(5) != 0))
    s = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [(s[i], y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((p >= 0.5) == y for p, y in held) / len(held) > 0.95
    assert s[800] == s[801] and all(0 <= v <= 1 for v in s.values())
    none = toxicity.train(docs, lab.where("false"))
    assert {r["score"] < 0.5 for r in toxicity.score(docs, none).collect()} == {True}


def places(text, sizes, bits):
    """Places of all n-grams of a text, one by one."""
    t = f" {text.lower()} " if text else "  "
    return [int(chargrams.grams(np.array([ord(c) for c in t[i : i + n]], np.uint32), n, bits)[0]) for n in sizes for i in range(len(t) - n + 1)]


def test_toxicity_against_a_plain_version(spark):
    rnd = random.Random(8)
    bad, fine = ["vile", "scum", "hate", "x'"], ["kind", "sun", "tea", "É日"]
    rows = [(i, " ".join(rnd.choice(bad if i % 3 == 0 and rnd.random() < 0.6 else fine) for _ in range(rnd.randint(0, 12)))) for i in range(90)] + [(90, None), (91, ""), (92, "unlabelled")]
    docs = spark.createDataFrame([(i, t, 1.0, "c") for i, t in rows], "doc_id long, text string, score double, k string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(92)], "doc_id long, toxic int")
    bits = 10
    model = toxicity.train(docs, labels, bits=bits)
    counts = np.zeros((2, 1 << bits))
    for i, t in rows[:90] + [rows[91]]:
        for p in places(t, toxicity.SIZES, bits):
            counts[int(i % 3 == 0), p] += 1
    ratio = np.log((counts[1] + 1) / (counts[1] + 1).sum()) - np.log((counts[0] + 1) / (counts[0] + 1).sum())
    used = model.weights != 0
    assert used.sum() > 100 and not (used & (np.abs(ratio) < 1e-12)).any()
    scored = toxicity.score(docs, model)
    assert scored.columns == ["doc_id", "text", "score", "k", "_score"]
    got = {r["doc_id"]: r["_score"] for r in scored.collect()}
    for i, t in rows:
        z = model.bias + sum(float(model.weights[p]) for p in sorted(set(places(t, toxicity.SIZES, bits))))
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-6
    # the fit is the minimum of the stated loss
    x = np.zeros((91, 1 << bits))
    y = np.array([1.0 if i % 3 == 0 else -1.0 for i in [*range(90), 91]])
    for k, (_, t) in enumerate(rows[:90] + [rows[91]]):
        x[k, list(set(places(t, toxicity.SIZES, bits)))] = 1
    x *= ratio
    w = np.where(used, model.weights / np.where(ratio == 0, 1, ratio), 0)
    m = y * (x @ w + model.bias)
    slope = x.T @ (-y / (1 + np.exp(m))) / len(y) + 1e-3 * w
    assert np.abs(slope).max() < 1e-3
    one = toxicity.train(docs, labels.where("toxic = 1"), bits=bits)
    assert {round(r["_score"], 6) for r in toxicity.score(docs, one).collect()} == {round(30.5 / 31, 6)} or len(one.weights) == 0


def test_language_votes_against_a_plain_version(spark):
    rnd = random.Random(9)
    sound = {"de": "schei", "nl": "ijoek", "en": "thwai", "fr": "ouela", "es": "ñosla"}
    make = lambda lang, n: " ".join("".join(rnd.choice(sound[lang]) for _ in range(rnd.randint(2, 6))) for _ in range(n))
    rows = [(i, make(lang, rnd.randint(3, 20)), lang) for i in range(150) for lang in [sorted(sound)[i % 5]]]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = [make(a, 3) + " " + make(b, 3) for a in sound for b in sound] + ["a", "12", None, "", "É"]
    langs, scores = model.predict(texts)
    sig = lambda v: 1 / (1 + np.exp(-4 * v))
    for t, lang, score in zip(texts, langs, scores, strict=True):
        if not t or not any(c.isalpha() for c in t):
            assert (lang, score) == ("und", 0)
            continue
        at = places(t, language.SIZES, model.bits)
        z = {task: float(model.bias[k] + sum(model.weights[p, k] for p in at) / len(at)) for k, task in enumerate(model.tasks)}
        fam = max(model.families, key=lambda f: z["family", "rest", f])
        members = [x for x in model.langs if language.family(x) == fam]
        wins, margin, sure = ({x: 0.0 for x in members}, {x: 0.0 for x in members}, {x: 1.0 for x in members})
        for a in members:
            for b in members:
                if (fam, a, b) in z:
                    v = z[fam, a, b]
                    wins[a if v > 0 else b] += 1
                    margin[a] += v
                    margin[b] -= v
                    sure[a], sure[b] = min(sure[a], sig(v)), min(sure[b], 1 - sig(v))
        best = max(members, key=lambda x: (wins[x], margin[x]))
        assert lang == best and abs(score - sig(z["family", "rest", fam]) * sure[best]) < 1e-4


def test_very_long_texts(spark):
    """A text of some 3 MB goes through every scorer and scanner; links in it are found in linear time."""
    long = "user_id=bob12 Ab1Cd2Ef3Gh4Ij5Kl6Mn7 plain words here\n\n" * 50_000
    df = spark.createDataFrame([(1, long), (2, "short")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in secrets.find_secrets(df).collect()}
    assert found[1]["spans"].count("id:") == found[1]["spans"].count("key:") == 50_000 and found[2]["spans"] == ""
    model = toxicity.Model(10, 0.0, np.ones(1 << 10, np.float32))
    assert toxicity.score(df, model).where("score between 0 and 1").count() == 2
    rows = [(i, ("der die das " if i % 2 else "the and of ") * 5, "de" if i % 2 else "en") for i in range(20)]
    lm = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert language.identify(df, lm).where("lang_pred <> 'und'").count() == 2
