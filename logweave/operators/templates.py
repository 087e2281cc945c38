"""Parsing (P1-P4), masking (P2-P3), counting (A1-A5), dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import logline as L
from .numbering import number_rows


WORDS = 5      # leading tokens of a line that hold fields


def _field(k: int) -> Column:
    """Token ``k`` (from 0) of the cut line ``_w``, null when the line is shorter."""
    blank = (F.get("_w", F.lit(0)) == "").cast("int")      # a line that begins with blanks
    return F.nullif(F.get("_w", k + blank), F.lit(""))


def _parsed_columns(lines: DataFrame) -> DataFrame:
    # a generator cuts the line into tokens: filters on the fields stay above it.
    # Through a mere projection they are pushed down, and for every field they
    # use cut the line anew and build it anew, if it is built by an expression.
    # ``t`` reads the projected ``ts`` in a second projection, so the timestamp
    # expression is not copied into it four times
    cut = lines.select("line_id", "line", F.explode_outer(F.array(F.split("line", r"\s+", WORDS + 2))).alias("_w"))
    fields = cut.select(
        "line_id",
        L.priority(_field(0)).alias("pri"),
        L.timestamp_of(_field(1)).alias("ts"),
        _field(2).alias("host"),
        _field(3).alias("program"),
        _field(4).alias("pid"),
        L.message("line").alias("message"),
        "line",
    )
    return fields.select("line_id", "pri", "ts", L.epoch_seconds(F.col("ts")).alias("t"),
                         "host", "program", "pid", "message", "line")


def _good(parsed: DataFrame):
    return F.col("ts").isNotNull() & F.col("program").isNotNull()


def parse_log(lines: DataFrame) -> DataFrame:
    """``(line_id, line)`` -> parsed lines; unparseable lines are left out.

    A line needs a valid timestamp token and at least four tokens (program is
    token 3).  Use :func:`quarantined_lines` to see the rest.
    """
    parsed = _parsed_columns(lines)
    return parsed.where(_good(parsed))


def quarantined_lines(lines: DataFrame) -> DataFrame:
    """Lines :func:`parse_log` drops, with the reason."""
    parsed = _parsed_columns(lines)
    reason = (F.when(F.col("program").isNull(), F.lit("too few tokens"))
              .otherwise(F.lit("bad timestamp")))
    return parsed.where(~_good(parsed)).select("line_id", "line", reason.alias("reason"))


def mask_templates(parsed: DataFrame, column: str = "line") -> DataFrame:
    """Add ``template`` = masked text of the whole line."""
    return parsed.withColumn("template", L.mask(column))


def line_count(lines: DataFrame) -> DataFrame:
    """A1: one row ``cnt``."""
    return lines.agg(F.count(F.lit(1)).alias("cnt"))


def template_counts(masked: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """A3-A4: lines per template (and per ``keys``); partial aggregation absorbs hot templates."""
    return masked.groupBy(*keys, "template").agg(F.count(F.lit(1)).alias("cnt"))


def template_counts_by_host(masked: DataFrame, all_label: str = "ALL") -> DataFrame:
    """A5: counts per (host, template) plus the all-host total, host = ``all_label``.

    Lines are counted per (host, template) first; the totals roll up those counts.
    """
    per_host = masked.groupBy("host", "template").agg(F.count(F.lit(1)).alias("cnt"))
    agg = per_host.groupingSets([["host", "template"], ["template"]], "host", "template").agg(
        F.sum("cnt").alias("cnt"), F.grouping("host").alias("_all"))
    host = F.when(F.col("_all") == 1, F.lit(all_label)).otherwise(F.col("host"))
    return agg.select(host.alias("host"), "template", "cnt")


def ranked_counts(counts: DataFrame) -> DataFrame:
    """O2: counts in falling order with their rank from 1 (ties by template), written in that order."""
    return number_rows(counts, [F.col("cnt").desc(), F.col("template").asc()], name="rank")


def totals(counts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Re-aggregate partial counts ``(..., template, cnt)`` to ``(*keys, template, cnt)``."""
    return counts.groupBy(*keys, "template").agg(F.sum("cnt").alias("cnt"))


def template_dictionary(counts: DataFrame) -> DataFrame:
    """Index templates from 0 by count ascending, ties by template.

    ``counts`` has one row per template.  The number of templates depends on
    the data (imperfect masking can leave millions), so they are numbered by
    the distributed W1 numbering (range partitions + per-partition offsets),
    not by a window without partition key, which would put them all in one task.
    """
    ordered = counts.select("template", "cnt")
    numbered = number_rows(ordered, ["cnt", "template"], name="_no")
    return numbered.select("template", (F.col("_no") - 1).cast("int").alias("idx"))


def one_hot_dictionary(dictionary: DataFrame) -> DataFrame:
    """V2: one-hot code of every template as ``(template, idx, size)``: a one at ``idx`` of ``size``.

    The dense code would have size * size entries; vectors are built from this
    form only where a model needs them (:func:`features.sparse_features`).
    """
    size = dictionary.select(F.count(F.lit(1))).scalar()
    return dictionary.select("template", "idx", size.cast("int").alias("size"))


def top_templates(counts: DataFrame, k: int) -> DataFrame:
    """Dictionary of the ``k`` most frequent templates (ties by template), idx 0..k-1."""
    top = counts.orderBy(F.col("cnt").desc(), F.col("template").asc()).limit(k)
    return template_dictionary(top)


def oov_templates(masked: DataFrame, dictionary: DataFrame) -> DataFrame:
    """J4 report: templates of ``masked`` that the dictionary lacks, with line counts."""
    counts = template_counts(masked)
    return counts.join(dictionary.select("template"), "template", "left_anti")
