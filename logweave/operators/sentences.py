"""Whole-file sentences (S2, P9, M1 input): a file is a sentence, each masked line a word."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.logline import mask


def sentence_stats(lines: DataFrame, group: str = "source", text: str = "line") -> DataFrame:
    """Per sentence: number of lines (words) and of distinct masked lines.

    Works on exploded lines, so no whole file is ever one value; the distinct
    count aggregates (group, word) partially before the shuffle.
    """
    words = lines.select(group, mask(F.col(text)).alias("word"))
    return words.groupBy(group).agg(F.count(F.lit(1)).alias("n_lines"),
                                    F.count_distinct("word").alias("n_words"))


def file_sentences(lines: DataFrame, max_len: int = 1000) -> DataFrame:
    """Word2Vec input ``(path, piece, sentence)`` from file lines ``(path, pos, line)``: a file's masked lines in
    order, cut after every ``max_len`` (where Word2Vec cuts a sentence anyway), so every list is bounded."""
    words = lines.select("path", "pos", F.floor((F.col("pos") - 1) / F.lit(max_len)).alias("piece"), mask(F.col("line")).alias("word"))
    grouped = words.groupBy("path", "piece").agg(F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("_items"))
    return grouped.select("path", "piece", F.transform("_items", lambda x: x["word"]).alias("sentence"))
