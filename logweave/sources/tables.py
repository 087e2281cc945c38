"""Driver-generated Parquet tables and the syslog view rendered from ``events``.

The Parquet tables hold no syslog, so ``events`` is rendered as one log line
per event, deterministically (the same rule is written in SQL for the oracle):

    <13>1 <ts>-00:00 c0-0c<user%3>s<user> <event_type> <event_id> - -  <severity> reading: addr=0x<hex id> value=<floor(value)>

host = ``c0-0c{user%3}s{user}``, program = event type, line_id = event_id + 1,
severity = low (value < 20), mid (value < 60) or high.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def severity(value: Column) -> Column:
    return (F.when(value < 20, F.lit("low"))
            .when(value < 60, F.lit("mid"))
            .otherwise(F.lit("high")))


def iso_seconds(ts_ntz: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss`` of a TIMESTAMP_NTZ without any time zone.

    ``date_format`` would cast to the session zone and back, which moves times
    inside a daylight-saving gap; the string cast of an NTZ value does not.
    """
    return F.regexp_replace(F.substring(ts_ntz.cast("string"), 1, 19), " ", "T")


def render_event_line(events: DataFrame) -> DataFrame:
    """``events`` -> ``(line_id, line)``; narrow projection, no shuffle."""
    uid = F.col("user_id")
    line = F.concat(
        F.lit("<13>1 "),
        iso_seconds(F.col("ts")),
        F.lit("-00:00 c0-0c"), (uid % 3).cast("string"),
        F.lit("s"), uid.cast("string"),
        F.lit(" "), F.col("event_type"),
        F.lit(" "), F.col("event_id").cast("string"),
        F.lit(" - -  "), severity(F.col("value")),
        F.lit(" reading: addr=0x"), F.lower(F.hex("event_id")),
        F.lit(" value="), F.floor("value").cast("bigint").cast("string"),
    )
    return events.select((F.col("event_id") + 1).alias("line_id"), line.alias("line"))


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw log lines ``(line_id, line)`` rendered from ``events``."""
    return render_event_line(table(spark, sf_dir, "events"))


def spoil(lines: DataFrame) -> DataFrame:
    """Log lines with faults: of every seven, one each loses the clock's seconds, the clock, the
    date's month and day, and all tokens behind the host."""
    kind = F.col("line_id") % 7
    bad = (F.when(kind == 0, F.regexp_replace("line", r"^(\S+ \S{16})\S*", "$1"))
           .when(kind == 1, F.regexp_replace("line", r"^(\S+ \S{10})\S*", "$1"))
           .when(kind == 2, F.regexp_replace("line", r"^(\S+ \S{4})\S*", "$1"))
           .when(kind == 3, F.regexp_extract("line", r"^(\S+ \S+ \S+)", 1))
           .otherwise(F.col("line")))
    return lines.select("line_id", bad.alias("line"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as ``(source, doc_id, line_no, line)``, one row per text line."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("source", "doc_id",
                       F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
