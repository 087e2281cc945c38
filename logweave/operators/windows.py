"""Windows over line numbers and time.

Windows are assigned arithmetically; no range join and no driver-side interval
list.  The bounds S = min(t) and E = max(t) are one small aggregate job whose one
row reaches the driver; they enter the plan as constants.

Time windows are closed on both ends and anchored at S, unlike the built-in
``window()`` (half-open, anchored at the epoch), so they are computed here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

# ---- count windows -------------------------------------------------------------------


def fixed_count_window(x: Column, w: int) -> Column:
    """Window code of line number ``x`` (from 1): ceil(x / w)."""
    return F.ceil(x / F.lit(w)).cast("long")


def sliding_count_windows(x: Column, w: int, mode: str = "reference") -> Column:
    """Array of window codes holding line ``x``.

    ``reference``: x < w -> {x}, else {x-w+1 .. x-1} (the line's own code is
    left out, so window k >= w holds lines k+1 .. k+w-1).
    ``full``: window k holds lines k .. k+w-1, so x is in max(1, x-w+1) .. x.
    """
    if mode == "full":
        return F.sequence(F.greatest(F.lit(1).cast("long"), x - w + 1), x)
    if mode != "reference":
        raise ValueError(f"unknown mode {mode!r}")
    empty = F.array().cast("array<long>")
    upper = F.sequence(x - w + 1, x - 1) if w > 1 else empty
    return F.when(x < w, F.array(x)).otherwise(upper)


def count_window_contents(masked: DataFrame, w: int, kind: str = "fixed",
                          mode: str = "reference", x: str = "line_id", keys: tuple[str, ...] = (),
                          key: str = "template") -> DataFrame:
    """Lines per (window code, ``key``): ``(*keys, win, key, cnt)``.

    ``x`` numbers the lines from 1, within each ``keys`` group if there are keys.
    ``key="idx"`` carries the dictionary's number instead of the template text.
    """
    if kind == "fixed":
        win = fixed_count_window(F.col(x), w)
        assigned = masked.select(*keys, win.alias("win"), key)
    else:
        assigned = masked.select(*keys, F.explode(sliding_count_windows(F.col(x), w, mode)).alias("win"),
                                 key)
    return assigned.groupBy(*keys, "win", key).agg(F.count(F.lit(1)).alias("cnt"))


# ---- sliding time windows ------------------------------------------------------------


class TimeBounds:
    """S, E and the regular window count n as constant columns.

    As scalar subqueries they would stand in every expression of a window plan,
    each with its own copy of the aggregate.
    """

    def __init__(self, log: DataFrame, w: int, s: int, t: str = "t"):
        if s <= 0 or w < 0:
            raise ValueError("window step must be positive and width non-negative")
        self.w, self.s = w, s
        first, last = log.agg(F.min(t), F.max(t)).first()
        if first is None:                 # an empty log has no windows to fill
            first = last = 0
        # windows that end by E: (E - S - w) / s + 1 of them, cut toward zero and never negative
        n = max(int((last - first - w) / s + 1), 0)
        self.S, self.E, self.n = (F.lit(v).cast("long") for v in (first, last, n))

    def start(self, i: Column) -> Column:
        return F.when(i < self.n, self.S + i * self.s).otherwise(self.S + self.n * self.s)

    def end(self, i: Column) -> Column:
        return F.when(i < self.n, self.S + i * self.s + self.w).otherwise(self.E)


def time_window_codes(t: Column, b: TimeBounds) -> Column:
    """W3 + W4: indexes of the closed windows [S+i*s, S+i*s+w] (i < n) holding ``t``,
    plus the tail window i = n, [S+n*s, E].

    i_lo = max(0, ceil((t-S-w)/s)), i_hi = min(n-1, floor((t-S)/s)); a line at or
    after the tail start also belongs to window n, which extends the range by one.
    """
    off = t - b.S
    i_lo = F.greatest(F.lit(0).cast("long"), F.ceil((off - b.w) / F.lit(float(b.s))))
    i_hi = F.when(off >= b.n * b.s, b.n).otherwise(
        F.least(b.n - 1, F.floor(off / F.lit(float(b.s)))))
    return F.when(i_lo <= i_hi, F.sequence(i_lo, i_hi)).otherwise(F.array().cast("array<long>"))


def assign_time_windows(log: DataFrame, w: int, s: int, t: str = "t") -> DataFrame:
    """One row per (line, window): adds ``win, ws, we``.  Empty windows are absent."""
    b = TimeBounds(log, w, s, t)
    # explode_outer + filter: a plain explode makes the optimizer infer
    # size(codes) > 0 and push it, with the whole expression behind t, to the scan
    exploded = (log.withColumn("win", F.explode_outer(time_window_codes(F.col(t), b)))
                .where(F.col("win").isNotNull()))
    return exploded.withColumn("ws", b.start(F.col("win"))).withColumn("we", b.end(F.col("win")))


def per_second(masked: DataFrame) -> DataFrame:
    """Lines per (second, template): ``(t, template, cnt)``.

    The common input of the time-window, target and dictionary operators: one
    aggregate (partial before the shuffle) that every branch of a plan shares,
    and that carries one row per distinct (t, template) instead of one per line.
    """
    return masked.groupBy("t", "template").agg(F.count(F.lit(1)).alias("cnt"))


def template_totals(masked: DataFrame) -> DataFrame:
    """Lines per template ``(template, cnt)``."""
    return masked.groupBy("template").agg(F.count(F.lit(1)).alias("cnt"))


def time_window_contents(counts: DataFrame, w: int, s: int, key: str = "template") -> DataFrame:
    """Lines per (window, ``key``) from per-second counts: ``(win, ws, we, key, cnt)``.

    Only the window number is exploded and grouped; its borders follow from it.
    ``key="idx"`` carries the dictionary's number instead of the template text.
    """
    b = TimeBounds(counts, w, s, "t")
    win = F.explode_outer(time_window_codes(F.col("t"), b)).alias("win")
    assigned = counts.select(win, key, "cnt").where(F.col("win").isNotNull())
    grouped = assigned.groupBy("win", key).agg(F.sum("cnt").alias("cnt"))
    return grouped.select("win", b.start(F.col("win")).alias("ws"), b.end(F.col("win")).alias("we"), key, "cnt")


# ---- calendar windows ----------------------------------------------------------------

_PARENT = {"second": "minute", "minute": "hour", "hour": "day"}


_VALUES = {"second": 60, "minute": 60, "hour": 24}


def calendar_window(masked: DataFrame, unit: str, w: int, ts: str = "ts") -> DataFrame:
    """Adds ``wkey, code``: code = value of ``unit`` div w + 1, restarting in each parent unit.

    The key keeps the parent time (``wkey`` = ts truncated to the parent unit),
    so codes from different hours or days do not merge.
    """
    if unit not in _PARENT:
        raise ValueError(f"unit must be one of {sorted(_PARENT)}")
    col = F.col(ts)
    value = {"second": F.second, "minute": F.minute, "hour": F.hour}[unit](col)
    code = (F.floor(value / F.lit(w)) + 1).cast("int")
    zero = F.lit(0)
    # truncation from the NTZ fields, so the session time zone plays no part
    parent = {
        "day": F.make_timestamp_ntz(F.year(col), F.month(col), F.dayofmonth(col), zero, zero, zero),
        "hour": F.make_timestamp_ntz(F.year(col), F.month(col), F.dayofmonth(col), F.hour(col), zero, zero),
        "minute": F.make_timestamp_ntz(F.year(col), F.month(col), F.dayofmonth(col), F.hour(col),
                                       F.minute(col), zero),
    }[_PARENT[unit]]
    return masked.withColumns({"wkey": parent, "code": code})


def calendar_window_contents(masked: DataFrame, unit: str, w: int, ts: str = "ts") -> DataFrame:
    """Lines per (calendar window, template): ``(wkey, code, template, cnt)``."""
    keyed = calendar_window(masked, unit, w, ts).select("wkey", "code", "template")
    return keyed.groupBy("wkey", "code", "template").agg(F.count(F.lit(1)).alias("cnt"))


def calendar_window_before(windows: DataFrame, unit: str, w: int) -> DataFrame:
    """The calendar window before each ``(wkey, code)``, across the parent's border: code 1 follows the
    last code of the parent unit before it."""
    last = (_VALUES[unit] - 1) // w + 1
    border = F.col("code") == 1
    return windows.select(
        F.when(border, F.col("wkey") - F.expr(f"interval 1 {_PARENT[unit]}")).otherwise(F.col("wkey")).alias("wkey"),
        F.when(border, F.lit(last)).otherwise(F.col("code") - 1).cast("int").alias("code"))


# ---- target (pre-failure) windows ----------------------------------------------------


def target_times(counts: DataFrame, target: str) -> DataFrame:
    """F2 + distinct: seconds at which a target error occurs (literal substring of the template)."""
    return counts.where(F.col("template").contains(target)).select("t").distinct()


ROWS_PER_TASK = 1 << 20      # rows that a task of the target windows sorts


def target_window_contents(counts: DataFrame, target: str, w: int,
                           include_target: bool = True, key: str = "template") -> DataFrame:
    """For each target second t0, the window [t0-w, t0] (closed; with
    ``include_target=False`` the end is open) as ``(ws, we, key, cnt)``.

    ``counts``: per-second counts ``(t, template, cnt)`` (and ``idx`` for ``key="idx"``).  Targets lie
    close together, so their windows share most lines; no line is joined with the
    targets near it.  Time is cut into buckets of w seconds.  A window that ends at second o of a
    bucket holds the bucket's lines up to o and the lines of the bucket before it from o on:

    1. For every (bucket, template) a running count over the seconds of the bucket starts with all lines
       of the bucket before it, takes in the bucket's lines and lets go of the earlier ones.
    2. Targets meet the *distinct* templates of their two buckets; each such question is sorted
       among the running count's rows (3 w of them at most) and reads it off.

    One shuffle, by (bucket, template number), over tasks that follow from the number of rows, so a
    task's memory does not grow with the log.
    """
    b = max(1, w)
    seconds = F.col("t") - F.col("bucket") * b
    bucket = F.floor(F.col("t") / F.lit(b))
    # the texts of templates stay out of the shuffle
    names = written(counts.select(key).distinct().withColumn("_k", F.monotonically_increasing_id()), "names")
    rows = counts.join(names, key).select("_k", "t", bucket.alias("bucket"), "cnt")
    totals = written(rows.groupBy("_k", "bucket").agg(F.sum("cnt").alias("cnt"), F.count(F.lit(1)).alias("n")), "buckets")
    targets = target_times(counts, target).select(F.col("t").alias("t0"), "t", bucket.alias("bucket")).select("t0", "bucket", seconds.alias("at"))
    covers = totals.select("_k", "bucket")
    if w > 0:
        covers = covers.unionByName(totals.select("_k", (F.col("bucket") + 1).alias("bucket"))).distinct()
    n = _target_tasks(covers, targets, totals)

    none = F.lit(None).cast("long")
    enter = rows.select("_k", "bucket", (seconds if include_target else seconds + 1).alias("at"), "cnt", none.alias("t0"))
    stream = enter.unionByName(covers.join(targets, "bucket").select("_k", "bucket", "at", F.lit(0).cast("long").alias("cnt"), "t0"))
    if w > 0:
        after = (F.col("bucket") + 1).alias("bucket")
        stream = (stream.unionByName(totals.select("_k", after, F.lit(-1).cast("long").alias("at"), "cnt", none.alias("t0")))
                  .unionByName(rows.select("_k", after, (seconds + 1).alias("at"), (-F.col("cnt")).alias("cnt"), none.alias("t0"))))
    # changes come before the questions of the same second; buckets are many and templates may be few,
    # so sorting by the bucket first tells most rows apart
    until = (Window.partitionBy("bucket", "_k").orderBy("at", F.col("t0").asc_nulls_first())
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    answers = (stream.repartition(n, "bucket", "_k").withColumn("_in", F.sum("cnt").over(until))
               .where(F.col("t0").isNotNull() & (F.col("_in") > 0)))
    return answers.join(names, "_k").select((F.col("t0") - w).alias("ws"), F.col("t0").alias("we"), key, F.col("_in").alias("cnt"))


def _target_tasks(covers: DataFrame, targets: DataFrame, totals: DataFrame) -> int:
    """Tasks for the rows of the running counts and their questions; one row of sums reaches the driver."""
    asked = (covers.groupBy("bucket").agg(F.count(F.lit(1)).alias("_c"))
             .join(targets.groupBy("bucket").agg(F.count(F.lit(1)).alias("_t")), "bucket")
             .agg(F.coalesce(F.sum(F.col("_c") * F.col("_t")), F.lit(0)))).first()[0]
    held = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = int(totals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-(asked + 2 * held) // ROWS_PER_TASK))
