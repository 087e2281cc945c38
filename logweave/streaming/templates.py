"""Incremental template counts over a directory that receives syslog files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import templates as TP


def stream_lines(spark: SparkSession, directory: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """S1 as a stream: new files of ``directory`` as ``(line_id, line)``.

    A stream has no global line order, so ``line_id`` is null here; the
    counting operators do not need it.
    """
    raw = (spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger)
           .text(directory))
    return raw.select(F.lit(None).cast("long").alias("line_id"), F.col("value").alias("line"))


def template_counts(lines: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """A3-A5 on a stream: running counts per template (and ``keys``); use output mode ``complete``
    or ``update``.  State holds one row per distinct (keys, template)."""
    return TP.template_counts(TP.mask_templates(TP.parse_log(lines)), keys)


def start_counts(spark: SparkSession, directory: str, checkpoint: str, sink: str = "parquet",
                 name: str = "template_counts", keys: tuple[str, ...] = (), path: str | None = None):
    """Run :func:`template_counts` with its own streaming checkpoint; returns the query.

    ``parquet`` (default) writes every trigger's changed counts below ``path`` with
    the trigger number ``batch``; the latest row of a key is its count.  ``memory``
    keeps the whole result in the driver and is meant for tests.
    """
    counts = template_counts(stream_lines(spark, directory), keys)
    if sink == "parquet":
        if path is None:
            raise ValueError("the parquet sink needs a path")

        def store(batch: DataFrame, number: int) -> None:
            # a repeated trigger overwrites its own folder
            batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

        return (counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
                .foreachBatch(store).start())
    writer = (counts.writeStream.outputMode("complete").format(sink)
              .option("checkpointLocation", checkpoint))
    if sink == "memory":
        writer = writer.queryName(name)
    return writer.start()
