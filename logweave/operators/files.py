"""Sinks and file layout (K1-K6, S3, S5, M11 text): results, split by program,
compaction, gather, metrics, dictionaries.

The reference writes one directory per program in one pass *per program*; here
one pass writes a table partitioned by program, and readers get the program
back by partition discovery.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _write_by_key(table: DataFrame, key: str, path: str, rows_per_file: int, order: str | None) -> str:
    """Write ``table`` partitioned by ``key`` with at most ``rows_per_file`` rows per file.

    A key is dealt over ceil(rows / rows_per_file) salts, so a hot key (say a
    third of all rows) is written by many tasks and no task writes a small file
    of every key.  Rows are unchanged.
    """
    sizes = table.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    files = sizes.select(key, F.greatest(F.ceil(F.col("_rows") / F.lit(rows_per_file)), F.lit(1)).alias("_files"))
    # a deterministic salt: a re-run task sends every row to the same file again
    salt_src = [F.col(order)] if order else [F.col(c) for c in table.columns]
    salted = (table.join(files, key)   # one row per key: small
              .withColumn("_salt", F.pmod(F.xxhash64(*salt_src), F.col("_files"))))
    # explicit partition count: adaptive coalescing must not fold the salts of a
    # hot key back into one task; maxRecordsPerFile caps a file when salts collide
    n = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = salted.repartition(n, key, "_salt").drop("_files", "_salt")
    (out.write.mode("errorifexists").option("maxRecordsPerFile", rows_per_file)
     .partitionBy(key).parquet(path))
    return path


def split_by_program(parsed: DataFrame, programs: DataFrame, path: str,
                     columns: tuple[str, ...] = ("line_id", "line"), rows_per_file: int = 1_000_000) -> str:
    """K2, F1: keep lines whose program is listed and write them partitioned by program.

    ``programs`` (one column ``program``) is a short list, joined as a
    semi-join; adaptive execution broadcasts it once its size is known.
    """
    kept = parsed.join(programs.select("program").distinct(), "program", "left_semi")
    return _write_by_key(kept.select("program", *columns), "program", path, rows_per_file, columns[0])


def compact(table: DataFrame, key: str, path: str, rows_per_file: int = 1_000_000,
            order: str | None = None) -> str:
    """K3: rewrite ``table`` partitioned by ``key`` in files of at most ``rows_per_file`` rows."""
    return _write_by_key(table, key, path, rows_per_file, order)


def file_counts(spark, path: str, key: str) -> DataFrame:
    """Rows, files and rows of the largest file per partition value of a written table."""
    t = spark.read.parquet(path)
    per_file = t.groupBy(key, F.col("_metadata.file_path").alias("_file")).agg(F.count(F.lit(1)).alias("_rows"))
    return per_file.groupBy(key).agg(F.sum("_rows").alias("n_lines"), F.count(F.lit(1)).alias("n_files"),
                                     F.max("_rows").alias("largest"))


def write_template_counts(counts: DataFrame, key: str, path: str) -> str:
    """K1 per key: template counts written partitioned by ``key`` (parallel write)."""
    counts.write.mode("errorifexists").partitionBy(key).parquet(path)
    return path


def gather(spark, path: str) -> DataFrame:
    """All per-key files of a partitioned table as one DataFrame (partition discovery)."""
    return spark.read.parquet(path)


def write_result(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """K1: a query result as a new table; fails when ``path`` exists.

    Written in parallel (one file per task), not through one task: readers
    take the folder as one table.
    """
    df.write.mode("errorifexists").format(fmt).save(path)
    return path


def write_metrics(metrics: DataFrame, path: str) -> str:
    """K5: a metrics row (error rate, TP/TN/FP/FN, ...) as one JSON file.

    ``metrics`` is an aggregate of one row per evaluation, so one task writes it.
    """
    metrics.coalesce(1).write.mode("errorifexists").json(path)
    return path


def write_dictionary(dictionary: DataFrame, path: str) -> str:
    """K6: a template dictionary ``(template, idx)`` (or vector dictionary) as typed Parquet,
    read back by ``sources.text.read_dictionary``; no ``repr``/``eval``."""
    dictionary.write.mode("errorifexists").parquet(path)
    return path


def write_text(spark, text: str, path: str) -> str:
    """M11 sink: one driver-side text (a tree description) as a text file."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(path)
    return path
