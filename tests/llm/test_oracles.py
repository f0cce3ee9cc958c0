"""Queries against their SQL counterparts on tables with nulls, repeats of texts, ties, long texts and planted cases."""

import random

import duckdb
import pytest

from gridloom.llm import queries

FRAGMENTS = [
    "user_id=alice99", "login: bob.x", "Account='carol77'", "client_id = 12ab34", "password=hunter2hunter2", "Secret: abc", 'token="ABCDEFGHIJ"', "api-key=zzzzzzzzzz", "apikey:qwertyuiop", "AKIA1234567890ABCD", "AKIA12",
    "deadbeef" * 4, "deadbeef" * 3, "Ab1" * 8, "aB3dE5fG7hI9jK1lM3nO5==", "https://host.example.com/x?y", "host=db.example.org:5432", "postgresql://u@h/db", "jdbc:mysql://h/x", "\n\n", "\n \t\n", "\n", "word", "日本", "x" * 150,
    "access_key_id=Ab1Cd2Ef3Gh4Ij5Kl6Mn7", "SERVER: a.bc", "user=QWErty123456789012345678", "ſecret=abcdefghi", '"', "'", "\x0b",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(3)
    vocabulary = [f"{a}{b}" for a in ("an", "Er", "É", "日", "x'", "o-") for b in ("", "th", "ST", "9", "re")]
    words = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    base, passage = words(90), words(40)
    texts = [None, None, "", " \t\n", "one", "one two three", "!!! ???", " ".join(base), " ".join(base), " ".join(passage), "loop " * 200, " ".join(words(20_000)), "y" * 30_000]
    for k in range(60):
        w = list(base)
        for _ in range(k % 8):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary) + str(k)
        texts.append((" ", "\n", "  ")[k % 3].join(w))
    for _ in range(40):
        w = words(rnd.randint(0, 120))
        at = rnd.randrange(len(w) + 1)
        texts.append(" ".join([*w[:at], *passage[rnd.randint(0, 25) :], *w[at:]]))
    texts += ["".join(rnd.choice(FRAGMENTS) + rnd.choice(("", " ", "\n")) for _ in range(rnd.randint(0, 40))) for _ in range(120)]
    rnd.shuffle(texts)
    items = [("q1", " ".join(passage[:30])), ("q2", " ".join(passage[20:]).upper()), ("q1", " ".join(passage[:30])), ("q3", "one two"), ("q4", None), (None, "one"), ("q5", ""), ("q10", " ".join(base[5:15]))]
    path = tmp_path_factory.mktemp("oracle")
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    pages = [(i, u, "") for i, u in enumerate(["http://adult-x.example.com/a?b", "http://free-bets.example.net/en/7", None, "", "http://tionsh.example.net/fr/a/b", "http://a.b.c.spam-farm.example.org/" + "p/" * 3000] * 30)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return str(path)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, folder, name):
    got = queries.QUERIES[name](spark, folder)
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * {'EXCLUDE (item_id), item_id' if table == 'benchmark' else ''} FROM read_parquet('{folder}/{table}.parquet/*.parquet'){' WHERE item_id IS NOT NULL' if table == 'benchmark' else ''}")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = lambda it: sorted(tuple(str(v)[:10] if c == "day" else str(v) for c, v in zip(columns, r, strict=True)) for r in it)
    found = rows(got.select(*columns).collect())
    assert len(found) > 100 and found == rows(want.fetchall())
