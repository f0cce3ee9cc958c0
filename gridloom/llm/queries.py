"""The registered queries: production parameters, and digest columns derived from the operators' results."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, jaccard, language, neighbours, oracles, packing, runtime, secrets, sharding, substrings, toxicity, urls


def fold(n: int):
    return F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(n))


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(runtime.table(spark, sf_dir, "documents"), 20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = runtime.table(spark, sf_dir, "documents"), runtime.table(spark, sf_dir, "labels")
    docs = docs.select("doc_id", "text")
    model = toxicity.train(docs, labels.where(fold(5) != 0))
    scored = toxicity.score(docs.select("doc_id", "text", (fold(5) == 0).alias("held_out")), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(runtime.table(spark, sf_dir, "documents"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(runtime.table(spark, sf_dir, "embeddings"), 20, 20)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runtime.table(spark, sf_dir, "documents")
    model = language.train(docs.where(fold(4) != 2))
    found = language.identify(docs.select("doc_id", "text", (fold(4) == 2).alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_classes(runtime.table(spark, sf_dir, "documents"), 4, 85, linked=True)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.balanced_shards(runtime.table(spark, sf_dir, "documents"), 24)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(runtime.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


# The dated list entries of the query (pattern, category, rule, action, date).
LIST_ENTRIES = (
    ("adult-x.example.com", "adult", "block", "add", "2024-01-15"),
    ("adult-x.example.com", "adult", "block", "remove", "2024-05-01"),
    ("adult-x.example.com", "adult", "block", "add", "2024-08-10"),
    ("ads-track.example.com", "tracking", "block", "add", "2023-11-01"),
    ("ads-track.example.com", "tracking", "block", "remove", "2024-10-01"),
    ("casino-win.example.net", "gambling", "block", "add", "2024-02-01"),
    ("cheap-pills.example.net", "pharma", "block", "add", "2024-03-01"),
    ("cheap-pills.example.net", "pharma", "block", "remove", "2024-03-01"),
    ("cheap-pills.example.net", "pharma", "block", "add", "2024-06-15"),
    ("free-bets.example.net", "gambling", "block", "add", "2024-01-01"),
    ("free-bets.example.net/en", "reviewed", "allow", "add", "2024-04-01"),
    ("free-bets.example.net/en", "reviewed", "allow", "remove", "2024-07-01"),
    ("spam-farm.example.org", "spam", "block", "add", "2024-02-20"),
    ("www.spam-farm.example.org", "reviewed", "allow", "add", "2024-09-01"),
    ("tionsh.example.net/fr", "licence", "block", "add", "2024-05-20"),
    ("example.org", "licence", "block", "add", "2024-11-15"),
    ("ththth.example.org", "reviewed", "allow", "add", "2024-11-20"),
)


LIST_VALUES = ", ".join(f"('{a}', '{b}', '{c}', '{d}', DATE '{e}')" for a, b, c, d, e in LIST_ENTRIES)


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no fetch dates; they are spread over 2024 by page_id."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), ((F.col("page_id") * 37) % 366).cast("int"))
    captures = runtime.table(spark, sf_dir, "pages").select("page_id", "url", day.alias("day"))
    return urls.evaluate(captures, spark.sql(f"SELECT * FROM VALUES {LIST_VALUES} AS entries(pattern, category, rule, action, day)"))


OP9_SQL = rf"""
WITH entries(pattern, category, rule, action, day) AS (VALUES {LIST_VALUES}),
one AS (SELECT pattern, category, rule, day, max(action) AS action FROM entries GROUP BY ALL),
spans AS (SELECT *, lead(day) OVER (PARTITION BY pattern, category, rule ORDER BY day) AS until FROM one),
caps AS (SELECT DISTINCT page_id, url, CAST(DATE '2024-01-01' + CAST((page_id * 37) % 366 AS INTEGER) AS DATE) AS day,
  regexp_replace(lower(regexp_extract(url, '{urls.HOST}', 1)), '\.+$', '') AS host, regexp_extract(url, '{urls.PATH}', 1) AS path FROM pages),
met AS (SELECT c.page_id, c.url, c.host, c.day, s.pattern, s.category, s.rule FROM caps c LEFT JOIN spans s
  ON s.action = 'add' AND c.day >= s.day AND (s.until IS NULL OR c.day < s.until)
  AND (c.host = s.pattern OR ends_with(c.host, '.' || s.pattern) OR starts_with(c.host || c.path || '/', s.pattern || '/') AND contains(s.pattern, '/')))
SELECT page_id, coalesce(host, '') AS host, day, count(pattern) AS n_active, coalesce(string_agg(DISTINCT category, ',' ORDER BY category), '') AS categories,
  coalesce(max(CASE WHEN pattern IS NOT NULL THEN {{'n': length(pattern), 'rule': rule}} END)['rule'], 'allow') AS verdict
FROM met GROUP BY page_id, url, host, day
"""


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runtime.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, runtime.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES = {f.__name__: f for f in (op1_substrings, op2_toxicity, op3_secrets, op4_neighbours, op5_language, op6_jaccard, op7_sharding, op8_packing, op9_urls, op10_decontamination)}
ORACLE_SQL: dict[str, str] = {"op1_substrings": oracles.OP1_SQL, "op3_secrets": oracles.OP3_SQL, "op6_jaccard": oracles.OP6_SQL, "op7_sharding": oracles.OP7_SQL, "op9_urls": OP9_SQL, "op10_decontamination": oracles.OP10_SQL}
