"""Text-file sources (S1-S5): syslog files, program lists, dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import running_totals
from ..session import written


SMALL = 1_000_000                    # file splits whose offsets (a few bytes each) may go to every task


def _read_splits(spark: SparkSession, glob: str, **options) -> DataFrame:
    """Lines with their file, the start of their file split, and a number that grows within the split."""
    return spark.read.text(glob, **options).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seq"),
    )


def _with_offsets(raw: DataFrame) -> DataFrame:
    """Adds ``_offset`` (lines in all splits before, by path and start) and ``_first`` (the split's least ``_seq``)."""
    splits = raw.groupBy("path", "_block").agg(F.count(F.lit(1)).alias("_size"),
                                               F.min("_seq").alias("_first"))
    offsets = written(running_totals(splits, ["path", "_block"], "_size", "_offset").select("path", "_block", "_first", "_offset"), "splits")
    # one row per file split: sent to every task while they are few, else joined by shuffles
    return raw.join(F.broadcast(offsets) if offsets.count() <= SMALL else offsets, ["path", "_block"])


def read_log_text(spark: SparkSession, glob: str, number: bool = True) -> DataFrame:
    """Lines of every file matching ``glob`` as ``(line_id, line, path)``.

    ``line_id`` counts lines from 1 in file order (path, then position in the
    file), as ``zipWithIndex() + 1`` would over the sorted file list.  No sort
    of the lines is needed: each file split is read by one task in order, so a
    line's position is  offset(split) + (id - first id of the split), where
    the offsets are running sums over one row per split, taken over all tasks.
    """
    raw = _read_splits(spark, glob)
    if not number:
        return raw.select(F.col("_seq").alias("line_id"), "line", "path")
    line_id = F.col("_offset") + (F.col("_seq") - F.col("_first")) + 1
    return _with_offsets(raw).select(line_id.alias("line_id"), "line", "path")


def read_file_lines(spark: SparkSession, glob: str) -> DataFrame:
    """Every file's content split at line feeds, as ``(path, pos, line)`` with ``pos`` from 1 in the file.

    As with ``content.split("\\n")``, a file that ends with a line feed has one more, empty
    line at its end; carriage returns stay.  Spark leaves empty files out, so they have no line.
    No file is ever one value: its splits are read by different tasks, and its length tells
    whether a line feed ends it.
    """
    placed = _with_offsets(_read_splits(spark, glob, lineSep="\n"))
    number = F.col("_offset") + (F.col("_seq") - F.col("_first"))
    numbered = placed.select("path", number.alias("_no"), "line")
    read = numbered.groupBy("path").agg(F.min("_no").alias("_start"), F.count(F.lit(1)).alias("_n"),
                                        F.sum(F.octet_length("line") + 1).alias("_bytes"))
    lines = numbered.join(read.select("path", "_start"), "path").select("path", (F.col("_no") - F.col("_start") + 1).alias("pos"), "line")
    # names and lengths only; the contents are not read
    files = spark.read.format("binaryFile").load(glob).select(F.col("_metadata.file_path").alias("path"), "length")
    ended = files.join(read, "path").where("_bytes = length").select("path", (F.col("_n") + 1).alias("pos"), F.lit("").alias("line"))
    return lines.unionByName(ended)


def read_program_list(spark: SparkSession, path: str) -> DataFrame:
    """S3: one program name per line, trailing blanks removed (``-`` and ``--`` kept)."""
    return (spark.read.text(path)
            .select(F.regexp_replace("value", r"\s+$", "").alias("program"))
            .where(F.col("program") != "").distinct())


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A template dictionary ``(template, idx)`` or vector dictionary, typed Parquet."""
    return spark.read.parquet(path)
