from datetime import date, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import neighbours, queries, runtime, urls

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_neighbours_with_ties_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 12))
    x[300:900] = x[7]  # a hot vector
    x[50] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows[60] = (60, None)
    rows[61] = (61, [1.0] * 11 + [float("nan")])
    rows[62] = (62, [1.0] * 5)
    rows[63] = (63, [1.0] * 11 + [None])
    df = spark.createDataFrame(rows + rows[:3], "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    got = neighbours.nearest(df, 20, 20, leaf=64, probes=60)
    found = {}
    for r in got.collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert {r["query_id"] for r in got.collect() if r["vec_id"] == 62} == set()
    good = [i for i in range(1500) if i not in (50, 60, 61, 62, 63)]
    assert set(found) == {i for i in good if i % 20 == 0}
    hits = total = 0
    for q, rs in found.items():
        rs.sort()
        assert [r[0] for r in rs] == list(range(1, 21)) and all(abs(x[q] @ x[v] - s) < 1e-9 for _, v, s in rs)
        assert [(-s, v) for _, v, s in rs] == sorted((-s, v) for _, v, s in rs)
        scores = x[good] @ x[q]
        best = [good[k] for k in np.lexsort((good, -np.round(scores, 9))) if good[k] != q][:20]
        hits += len({v for _, v, _ in rs} & set(best))
        total += 20
    assert hits / total >= 0.9
    assert [v for _, v, _ in found[300] if v == 7 or 300 <= v < 900][:3] == [7, 301, 302]
    assert neighbours.recall(got, df) >= 0.9


def test_neighbours_few_and_none(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "vec_id long, embedding array<float>")
    got = [(r["rank"], r["vec_id"]) for r in neighbours.nearest(df).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 2), (3, 3), (4, 4)]
    assert neighbours.nearest(df.where("false")).count() == 0


def test_neighbours_of_each_length_and_in_decks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "DECK", 5)
    rng = np.random.default_rng(3)
    x = {i: rng.normal(size=6 if i % 3 else 9) for i in range(400)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in x.items()] + [(1000, [0.0, 0.0])], "vec_id long, embedding array<double>")
    found = {}
    for r in neighbours.nearest(df, 5, 20, leaf=16, probes=1000).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    for q in range(0, 400, 20):
        others = [v for v in x if v != q and len(x[v]) == len(x[q])]
        best = sorted(others, key=lambda v: (-(x[q] @ x[v]), v))[:5]
        assert [found[q][k] for k in range(1, 6)] == best


def test_neighbours_search_goes_on_in_large_forests(spark):
    """Many small leaves, of which the least number of probes is a small share."""
    x = np.random.default_rng(2).normal(size=(6000, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, 20, 20, leaf=16, probes=40)
    assert got.count() == 300 * 20
    assert neighbours.recall(got, df) >= 0.9


def test_urls_match_sql_and_handle_odd_rows(spark):
    start = date(2024, 1, 1)
    rows = [(i, u, start + timedelta(days=(i * 37) % 366)) for i, u in enumerate(["http://adult-x.example.com/a?b", "https://u:p@m.ADS-track.example.com.:8080/x", "http://free-bets.example.net/en/7", "http://xfree-bets.example.net/en", None, "", "no url", "http://tionsh.example.net/fr", "http://tionsh.example.net/fra"] * 40)]
    caps = spark.createDataFrame(rows + rows[:5], "page_id long, url string, day date").withColumn("host", F.lit("clash"))
    entries = spark.sql(f"SELECT * FROM VALUES {queries.LIST_VALUES} AS entries(pattern, category, rule, action, day)")
    got = sorted(tuple(str(v) for v in r) for r in urls.evaluate(caps, entries).collect())
    pages = caps.select("page_id", "url").distinct().toPandas()  # noqa: F841
    want = sorted(tuple(str(v) for v in r) for r in duckdb.sql(queries.OP9_SQL).fetchall())
    assert [(r[0], r[1], r[2][:10], *r[3:]) for r in got] == [(r[0], r[1], r[2][:10], *r[3:]) for r in want]
    assert {r[5] for r in got} == {"allow", "block"}
    undated = caps.withColumn("day", F.lit(None).cast("date"))
    assert {r["verdict"] for r in urls.evaluate(undated, entries).collect()} == {"allow"}
    assert {r["verdict"] for r in urls.evaluate(caps, entries.where("false")).collect()} == {"allow"}
    assert urls.evaluate(caps.where("false"), entries).count() == 0


def test_pipeline_stages(spark, tmp_path):
    base = " ".join(f"word{i}" for i in range(50))
    item = " ".join(f"item{i}" for i in range(14))
    rows = [(0, base), (1, base + " more"), (2, "clean text about nothing in particular"), (3, f"see {item} here"), (4, None), (5, "12 34 !!"), (6, "password=hunter2hunter2 is mine"), (7, "clean text about nothing in particular"), (7, "clean text about nothing in particular"), (8, "another clean text")]
    docs = spark.createDataFrame([(i, t, ("en", "de")[i % 2], "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {"language_id": {0, 1, 2, 3, 6, 7, 8}, "near_duplicates": {0, 2, 3, 6, 8}, "decontamination": {0, 2, 6, 8}, "secret_scan": {0, 2, 6, 8}}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = runtime.cut(stage(spark, now, str(tmp_path)))
        assert now.columns == docs.columns and {r[0] for r in now.select("doc_id").collect()} == kept[name]
    masked = now.where("doc_id = 6").first()
    assert masked["text"] == "[SECRET] is mine" and masked["n_chars"] == len(masked["text"])
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {r[0] for r in whole.select("doc_id").collect()} == {0, 2, 6, 8}
    assert whole.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_near_duplicate_stage_keeps_one_row_of_repeats(spark):
    t = "a b c d e f g h"
    df = spark.createDataFrame([(1, t), (1, t), (2, t), (1, "other words that are not near at all"), (3, "")], "doc_id long, text string")
    got = sorted(map(tuple, corpus_pipeline.near_duplicates(spark, df, "").collect()))
    assert got == [(1, t), (1, "other words that are not near at all"), (3, "")]


def test_near_duplicate_stage_judges_rows_by_their_own_text(spark):
    t = "a b c d e f g h"
    rows = [(1, t), (2, t), (2, "unrelated words of the repeated id stay here"), (None, t), (None, "a clean text without any id stays"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in corpus_pipeline.near_duplicates(spark, df, "").collect()}
    assert got == {rows[0], rows[2], rows[4], rows[5]}


def test_queries_run_on_driver_tables(spark):
    sf = "/root/testdata/sf0.001"
    for name in ("op7_sharding", "op9_urls", "op10_decontamination"):
        df = queries.QUERIES[name](spark, sf)
        assert df.count() > 0 and len(set(df.columns)) == len(df.columns)
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


CLASH = ("gone", "__id", "__hash", "text_hash", "maybe", "lang_pred", "score", "found", "spans", "redacted", "n_hit", "items", "sequence_id", "mark", "label", "part")


@pytest.fixture(scope="module")
def clashing(spark, tmp_path_factory):
    base = " ".join(f"word{i}" for i in range(40))
    item = " ".join(f"item{i}" for i in range(12))
    rows = [
        (1, base), (2, base + " tail"), (None, base), (None, "a clean text without an id"), (None, None), (3, None), (3, ""), (3, "one text of an id that repeats"), (3, "quite another text of the same id"),
        (4, f"x {item} y"), (4, "clean words under an id that is also bad"), (5, "token=abcdefgh12345 inside"), (5, "token=abcdefgh12345 inside"), (6, "z" * 300_000), (7, "loop " * 60_000),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{c}` string" for c in CLASH)
    df = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *(f"{c} {k}" for c in CLASH)) for k, (i, t) in enumerate(rows)], schema)
    folder = tmp_path_factory.mktemp("clash")
    spark.createDataFrame([("q", item)], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return df, str(folder), rows


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_with_clashing_columns_null_ids_and_nothing(spark, clashing, k):
    df, folder, rows = clashing
    name, stage = corpus_pipeline.STAGES[k]
    last = k == len(corpus_pipeline.STAGES) - 1
    assert stage(spark, df.where("false"), folder).count() == 0
    got = stage(spark, df, folder)
    if last:
        assert got.select("doc_id", "piece", "start").count() >= len(rows)
        return
    assert got.columns == df.columns
    kept = sorted(int(r["gone"].split()[1]) for r in got.collect())
    pairs = [rows[i] for i in kept]
    if name == "language_id":
        assert pairs == [r for r in rows if r[1]]
    elif name == "near_duplicates":
        # the smallest id of the copies stays, not the copy without one; of repeated rows one
        assert kept == [0, *range(3, 11), *([11] if 11 in kept else [12]), 13, 14]
    elif name == "decontamination":
        assert kept == [i for i in range(len(rows)) if i != 9]
    else:
        assert kept == list(range(len(rows)))
        masked = {r["gone"]: (r["text"], r["n_chars"]) for r in got.collect()}
        assert masked["gone 11"] == ("[SECRET] inside", 15) and masked["gone 4"][0] is None and masked["gone 3"][0] == rows[3][1]


def test_operators_with_empty_tables_and_clashing_columns(spark, clashing):
    from gridloom.llm import decontaminate, jaccard, language, packing, secrets, sharding, substrings, toxicity

    df, folder, rows = clashing
    for got in (
        jaccard.similar_classes(df, linked=True), substrings.remove_repeats(df, 20), sharding.balanced_shards(df, 3), secrets.find_secrets(df, carry=CLASH),
        toxicity.score(df, toxicity.Model()), language.identify(df, language.train(df)), decontaminate.contamination(df, spark.read.parquet(f"{folder}/benchmark.parquet")),
    ):
        assert got.count() == len(rows) and len(set(got.columns)) == len(got.columns)
    import public_tokenizers

    assert packing.pack(df, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id").distinct().count() == 8


def plain_pipeline(rows, item, k=5, percent=80):
    """What stays, by plain Python: letters, near-duplicate groups, windows of the item, masked secrets."""
    import re

    from gridloom.llm import secrets

    kept = [(i, t) for i, t in rows if t and any(map(str.isalpha, t))]
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    sets = []
    for _, t in kept:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
    label = list(range(len(kept)))
    changed = True
    while changed:
        changed = False
        for a in range(len(kept)):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if label[a] != label[b] and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    low, high = sorted((label[a], label[b]))
                    label = [low if x == high else x for x in label]
                    changed = True
    least = {}
    for (i, _), x in zip(kept, label, strict=True):
        least[x] = min(i, least.get(x, i))
    kept = [r for r, x in zip(kept, label, strict=True) if r[0] == least[x]]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    bad = {tuple(words(item)[j : j + 10]) for j in range(len(words(item)) - 9)}
    kept = [(i, t) for i, t in kept if not any(tuple(words(t)[j : j + 10]) in bad for j in range(len(words(t)) - 9))]
    return [(i, secrets.mask(t, secrets.scan_text(t)[1])) for i, t in kept]


def test_pipeline_equals_a_plain_version(spark, tmp_path):
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    rnd = random.Random(12)
    vocabulary = [f"{a}{b}" for a in ("an", "Er", "thé", "日", "o-") for b in ("", "th", "ST", "9", "re")]
    words = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    base, item = [words(60) for _ in range(6)], " ".join(f"q{j}" for j in range(15))
    rows = []
    for i in range(160):
        w = list(rnd.choice(base)) if rnd.random() < 0.6 else words(rnd.randint(1, 90))
        for _ in range(rnd.choice((0, 0, 1, 2, 4))):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary) + str(i)
        if rnd.random() < 0.1:
            w.insert(rnd.randrange(len(w)), item)
        if rnd.random() < 0.1:
            w.insert(0, "password=hunter2hunter2")
        rows.append((i, rnd.choice((None, "", "12 ;;")) if rnd.random() < 0.05 else " ".join(w)))
    docs = [(i, t, ("en", "de")[i % 2], "s", len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("b", item)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got: dict[int, int] = {}
    fill: dict[int, int] = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in plain_pipeline(rows, item)}
    assert got == want and 20 < len(want) < 140 and max(fill.values()) <= 1024


def test_urls_against_a_plain_version_of_a_long_list(spark):
    import random

    rnd = random.Random(13)
    hosts = [f"{a}{b}.example.{c}" for a in ("x", "www.x", "m.y", "y") for b in ("", "-1") for c in ("com", "org")]
    start = date(2024, 1, 1)
    entries = []
    for _ in range(600):
        pattern = rnd.choice(hosts) + rnd.choice(("", "", "/en", "/en/a"))
        entries.append((pattern, rnd.choice(("c1", "c2")), rnd.choice(("block", "allow")), rnd.choice(("add", "remove")), start + timedelta(days=rnd.randrange(300))))
    caps = [(i, f"https://{rnd.choice(hosts)}{rnd.choice(('', '/', '/en', '/en/a/b', '/fr'))}", start + timedelta(days=rnd.randrange(320))) for i in range(400)]
    listed = spark.createDataFrame(entries, "pattern string, category string, rule string, action string, day date")
    got = {r["page_id"]: (r["n_active"], r["categories"], r["verdict"]) for r in urls.evaluate(spark.createDataFrame(caps, "page_id long, url string, day date"), listed).collect()}
    last: dict = {}
    for p, c, rule, action, day in entries:
        last.setdefault((p, c, rule), {}).setdefault(day, set()).add(action)
    for i, url, day in caps:
        host, _, path = url.removeprefix("https://").partition("/")
        live = []
        for (p, c, rule), days in last.items():
            seen = [d for d in days if d <= day]
            on = host == p or host.endswith("." + p) or ("/" in p and f"{host}/{path}/".startswith(p + "/"))
            if on and seen and "remove" not in days[max(seen)]:
                live.append((len(p), rule, c))
        assert got[i] == (len(live), ",".join(sorted({c for _, _, c in live})), max(live)[1] if live else "allow")
