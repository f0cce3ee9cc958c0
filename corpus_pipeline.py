"""A corpus pipeline: language ID, near-duplicate removal, benchmark decontamination, secret redaction, packing.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept. All but the last return the columns of
``documents``. Between stages rows are written as Parquet to the shared checkpoint folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, jaccard, language, packing, runtime, secrets
from gridloom.llm.queries import fold


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is found go: null texts and texts without a letter.

    Ties and repeated rows are judged alike, by their text alone; an empty table stays empty; other columns pass through.
    """
    model = language.train(docs.where(fold(4) != 2))
    name, score = runtime.fresh(docs, "lang_pred", "score")
    found = language.identify(docs, model, name=name, score=score)
    return found.where(F.col(name) != "und").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group connected by a similarity of 0.8 on five-word shingles, the document with the smallest id stays.

    Each row is judged by its own text. Rows that repeat id and text stay once. Documents without an id stay unless they
    are in a group with one that has. Texts without words, null or not, stay. An empty table stays empty; other columns pass through.
    """
    runtime.prepare(spark)
    classes = runtime.cut(jaccard.similar_classes(docs, 5, 80, marked=True))
    row = ["doc_id", "text_hash"]
    verdict = F.max(F.when(~F.col("doc_id").eqNullSafe(F.col("component_id")), 1).otherwise(0))
    marked = runtime.cut(classes.groupBy(*row).agg(verdict.alias("gone"), F.count(F.lit(1)).alias("n")).where("gone = 1 or n > 1").drop("n"))
    text_hash, maybe, other_id, other_hash, gone = runtime.fresh(docs, "text_hash", "maybe", "other_id", "other_hash", "gone")
    bits = runtime.bloom_bits(marked, "text_hash")
    flagged = runtime.maybe_in(docs.withColumn(text_hash, F.xxhash64("text")), text_hash, bits, maybe)
    clear = flagged.where(~F.col(maybe)).select(*docs.columns)
    m = marked.select(F.col("doc_id").alias(other_id), F.col("text_hash").alias(other_hash), F.col("gone").alias(gone))
    same = (F.col(text_hash) == F.col(other_hash)) & F.col("doc_id").cast("long").eqNullSafe(F.col(other_id))
    suspect = flagged.where(maybe).join(m, same, "left")
    once = suspect.where(F.col(gone) == 0).select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return clear.unionByName(once).unionByName(suspect.where(F.col(gone).isNull()).select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a ten-word window of a benchmark item go; repeated rows share their fate.

    Null texts and texts without words are clean; an empty table, or an empty benchmark, changes nothing; other columns pass through.
    """
    return decontaminate.clean(docs, runtime.table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Findings are masked in the text; n_chars follows where something was masked.

    Every row stays, repeated rows too; null texts stay null; an empty table stays empty; other columns pass through.
    """
    carry = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    found = secrets.find_secrets(docs, redact=True, carry=carry)
    spans, redacted = found.columns[-2:]
    found = found.withColumn("text", F.col(redacted))
    if "n_chars" in carry:
        found = found.withColumn("n_chars", F.when(F.col(spans) == "", F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their sequence and offset. Null texts are the closing id alone; repeated rows are packed too."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("pack_sequences", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    runtime.prepare(spark)
    docs = runtime.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = runtime.cut(docs)
            if k:
                runtime.forget(before)
    return docs
