"""The registered queries ``opN_<name>`` and their SQL; thin forms of the operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import (
    class_lm, decontaminate, language_id, minhash, outliers, packing, periodic, pii, prefix_trie, quality_crf, substring, syncmers, url_filter,
)
from .shared import crc_mod, table

QUERIES = {}
ORACLE: dict[str, str] = {}

TOKENIZER = "byte_bpe_50k.json"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_decontamination(spark, sf_dir):
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE["op1_decontamination"] = decontaminate.oracle()


@query
def op2_url_filter(spark, sf_dir):
    return url_filter.verdicts(table(spark, sf_dir, "pages"))


ORACLE["op2_url_filter"] = url_filter.oracle()


@query
def op3_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    model = language_id.learn(docs.where(~held_out))
    found = language_id.identify(docs.withColumn("held_out", held_out), model, ("doc_id", "held_out"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


@query
def op4_pii(spark, sf_dir):
    return pii.digest(pii.personal_data(table(spark, sf_dir, "documents")))


@query
def op5_packing(spark, sf_dir):
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return packing.pack(pieces)


@query
def op6_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op7_substring_dedup(spark, sf_dir):
    return substring.without_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


@query
def op8_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    model = quality_crf.learn(docs.where(~held_out), labels.where(~held_out))
    return quality_crf.scored(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op9_class_lm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc_mod(F.col("doc_id"), 10) == 0)
    model, counts = class_lm.learn(docs.where(~F.col("held_out")))
    return class_lm.scored(docs, model, counts, ("doc_id", "held_out"))


@query
def op10_quality_rules(spark, sf_dir):
    return outliers.quality_rules(table(spark, sf_dir, "documents"))


@query
def op11_periodic_runs(spark, sf_dir):
    return periodic.digest(periodic.periodic_runs(periodic.with_repeats(table(spark, sf_dir, "documents"))))


@query
def op12_prefix_trie(spark, sf_dir):
    turns = prefix_trie.placed(table(spark, sf_dir, "conversations"))
    return prefix_trie.digest(prefix_trie.trie(prefix_trie.rebuilt(turns), turns.select("conv_id")))


ORACLE["op12_prefix_trie"] = prefix_trie.oracle()


@query
def op13_syncmers(spark, sf_dir):
    return syncmers.digest(syncmers.edited_pairs(table(spark, sf_dir, "documents")))
