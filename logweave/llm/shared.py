"""Helpers of the operators: worker setup, words, id handling."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_written, written  # noqa: F401  (the operators' scratch tables)

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SPACE = " \t\n\x0b\x0c\r"                 # the white space between words, \x20 and \x09-\x0D
SPACE_CLASS = r"[\x20\x09-\x0D]"


ROWS_PER_BATCH = "1000"                   # texts are long: Spark's default of 10000 makes large Arrow batches


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, and keep their batches small."""
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(batch) == "10000":
        spark.conf.set(batch, ROWS_PER_BATCH)
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(":")
    if _ROOT not in have:
        env["PYTHONPATH"] = ":".join([_ROOT, *filter(None, have)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def numbered(df: DataFrame, name: str = "rows") -> tuple[DataFrame, str]:
    """``df`` written with a number of its own for every row, and that column's name.

    Ids may be null or repeated, so stages that drop rows decide by the number.
    It is read back from the table: no later scan can deal it out anew.
    """
    taken = {c.lower() for c in df.columns}
    column = "_number"
    while column in taken:
        column += "_"
    return written(df.withColumn(column, F.monotonically_increasing_id()), name), column


def blank(text):
    """Null text counts as empty."""
    return F.coalesce(text, F.lit(""))


def words_of(text):
    """JVM-side words of a text column: runs of anything but ``SPACE``."""
    trimmed = F.btrim(blank(text), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))


def crc_mod(doc_id, mod: int):
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod
