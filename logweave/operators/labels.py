"""Labels (F2, F8, J3, W5, U1): which windows precede a target error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import calendar_window, calendar_window_before, target_times


def target_events(masked: DataFrame, target: str) -> DataFrame:
    """lines whose masked template contains ``target`` (literal, case-sensitive)."""
    return masked.where(F.col("template").contains(target))


def labeled_windows(windows: DataFrame, counts: DataFrame, target: str, w: int,
                    mode: str = "exact", horizon: int | None = None) -> DataFrame:
    """Label main windows ``(win, ws, we)``; targets come from per-second counts.

    ``exact``: 1.0 when (ws, we) equals a target window (t0 - w, t0).
    ``horizon``: 1.0 when a target occurs within ``horizon`` seconds after we.
    """
    keys = windows.select("win", "ws", "we").distinct()
    targets = target_times(counts, target)
    if mode == "exact":
        hits = targets.select((F.col("t") - w).alias("ws"), F.col("t").alias("we"),
                              F.lit(1.0).alias("label"))
        out = keys.join(hits, ["ws", "we"], "left")
    elif mode == "horizon":
        h = horizon if horizon is not None else w
        # a target t0 labels windows with we in [t0 - h, t0): bucketed by floor(we / h)
        tb = targets.select("t", F.explode(F.array(F.floor(F.col("t") / h), F.floor(F.col("t") / h) - 1)).alias("b"))
        kb = keys.withColumn("b", F.floor(F.col("we") / h))
        m = (kb.join(tb, "b").where((F.col("t") > F.col("we")) & (F.col("t") <= F.col("we") + h))
             .select("win").distinct().withColumn("label", F.lit(1.0)))
        out = keys.join(m, "win", "left")
    else:
        raise ValueError("mode must be 'exact' or 'horizon'")
    return out.select("win", "ws", "we", F.coalesce(F.col("label"), F.lit(0.0)).alias("label"))


def labelled_frequencies(freqs: DataFrame, counts: DataFrame, target: str, w: int) -> DataFrame:
    """J3 "exact" on frequency rows ``(ws, we, ..)``: adds ``label`` by one join with the distinct targets."""
    hits = target_times(counts, target).select((F.col("t") - w).alias("ws"), F.col("t").alias("we"), F.lit(1.0).alias("label"))
    return freqs.join(hits, ["ws", "we"], "left").withColumn("label", F.coalesce(F.col("label"), F.lit(0.0)))


def count_window_targets(masked: DataFrame, target: str, w: int, kind: str, x: str = "line_id", keys: tuple[str, ...] = ()) -> DataFrame:
    """Codes of the count windows just before a target line ``x``: ``ceil(x / w) - 1`` (fixed) or ``x - w`` (sliding)."""
    at = target_events(masked, target).select(*keys, F.col(x).alias("_x"))
    code = F.ceil(F.col("_x") / F.lit(w)).cast("long") - 1 if kind == "fixed" else F.col("_x") - w
    return at.select(*keys, code.alias("win")).where(F.col("win") >= 1).distinct()


def labeled_count_windows(contents: DataFrame, masked: DataFrame, target: str, w: int, kind: str,
                          x: str = "line_id", keys: tuple[str, ...] = ()) -> DataFrame:
    """J3 for count windows: ``(*keys, win, label)`` of every window in ``contents``."""
    hits = count_window_targets(masked, target, w, kind, x, keys).withColumn("label", F.lit(1.0))
    return (contents.select(*keys, "win").distinct().join(hits, [*keys, "win"], "left")
            .select(*keys, "win", F.coalesce(F.col("label"), F.lit(0.0)).alias("label")))


def labeled_calendar_windows(contents: DataFrame, masked: DataFrame, target: str, unit: str, w: int) -> DataFrame:
    """J3, F8 for calendar windows: ``(wkey, code, label)``; 1.0 when the window after it, also in
    the next parent unit, holds a target line."""
    at = calendar_window(target_events(masked, target), unit, w).select("wkey", "code").distinct()
    hits = calendar_window_before(at, unit, w).withColumn("label", F.lit(1.0))
    return (contents.select("wkey", "code").distinct().join(hits, ["wkey", "code"], "left")
            .select("wkey", "code", F.coalesce(F.col("label"), F.lit(0.0)).alias("label")))


def training_set(main: DataFrame, target_freqs: DataFrame) -> DataFrame:
    """Bag union of labelled main windows and target windows (label 1.0).

    Long form ``(kind, ws, we, label, idx, freq)``.
    """
    cols = ["ws", "we", "label", "idx", "freq"]
    main = main.select(F.lit("main").alias("kind"), *cols)
    tgt = target_freqs.withColumn("label", F.lit(1.0)).select(F.lit("target").alias("kind"), *cols)
    return main.unionByName(tgt)
