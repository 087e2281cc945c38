"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_scratch: dict[str, SparkSession] = {}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app: str = "logweave", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench (UI off, UTC, AQE on)."""
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
    )
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    On a cluster this must be set (``spark.checkpoint.dir``) to a folder every
    executor can reach.  Only a local-mode session without the setting gets a
    fresh temporary folder, as in tests.
    """
    sc = spark.sparkContext
    path = spark.conf.get(CHECKPOINT_CONF, None) or sc.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a shared folder")
        path = tempfile.mkdtemp(prefix="logweave-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, path)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique folder below the shared checkpoint folder, deleted when the driver ends."""
    base = checkpoint_dir(spark)
    sep = "" if base.endswith("/") else "/"
    path = f"{base}{sep}{name}-{uuid.uuid4().hex[:12]}"
    _scratch[path] = spark
    return path


def written(df, name: str = "table", schema=None):
    """``df`` written once as Parquet below the shared folder and read back.

    For a derived table that feeds several branches of one plan (pushed-down
    filters make the branches differ, so Spark cannot reuse one exchange for
    them): the input is scanned and parsed once, later plans stay small, and a
    lost executor re-reads the table instead of recomputing the lineage.  The
    folder is deleted by :func:`drop_written` or when the driver process ends.
    ``schema`` reads it back as other types that are stored alike.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)


def drop_written() -> None:
    """Delete the scratch folders made so far (best effort)."""
    while _scratch:
        path, spark = _scratch.popitem()
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may be gone when the process ends
            return


atexit.register(drop_written)
