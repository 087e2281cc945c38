"""Corpus pipeline over ``documents``: language, near-duplicates, benchmark leaks, personal data, packing.

Every stage reads all rows that the one before it kept; all but the last return
the columns of ``documents``.  SQL can't express them; tests hold each stage
against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import decontaminate, language_id, minhash, packing, pii
from logweave.llm.shared import numbered, table, written

LEAST_SCORE = 0.4                    # language score under which a document is rejected
TOKENIZER = "byte_bpe_50k.json"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those whose language stays open."""
    model = language_id.learn(docs)
    found = language_id.identify(docs, model, tuple(docs.columns))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of every group: the least id (null last), then the least row number."""
    rows, number = numbered(docs, "near_rows")
    found = minhash.near_duplicates(rows.select(F.col(number).alias("doc_id"), "text"))
    groups = written(found.select(F.col("doc_id").alias("_at"), F.col("component_id").alias("_group"))
                     .join(rows.select(F.col(number).alias("_at"), F.col("doc_id").alias("_id")), "_at"), "near_groups")
    first = (groups.groupBy("_group").agg(F.count(F.lit(1)).alias("_size"), F.min(F.struct(F.col("_id").isNull().alias("n"), "_id", "_at")).alias("_m"))
             .where("_size > 1").select("_group", F.col("_m._at").alias("_first")))
    gone = groups.join(first, "_group").where("_at <> _first").select("_at")
    return rows.join(gone, rows[number] == gone["_at"], "left_anti").drop(number)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents with a verified overlap with a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind."""
    return pii.redacted(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all token pieces into sequences."""
    return packing.pack(packing.token_pieces(docs, public_tokenizers.path(TOKENIZER)))


STAGES = [
    ("language_id", identify_language),
    ("minhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written once and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
