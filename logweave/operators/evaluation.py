"""Classifier evaluation (A9, A10, F5, K5): one aggregate, one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion_matrix(pairs: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """TP = (1,1), TN = (0,0), FP = (label 0, pred 1), FN = (label 1, pred 0); error = share of label != pred.

    Returns one row ``(tp, tn, fp, fn, n, error)``; precision and recall are
    derived from it by :func:`with_rates`.
    """
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    return pairs.agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count(F.lit(1)).alias("n"),
        (F.count_if(y != p) / F.count(F.lit(1))).alias("error"),
    )


def with_rates(confusion: DataFrame) -> DataFrame:
    """Add precision, recall (null when undefined) and the error of always saying the more frequent label."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return confusion.select("*",
                            F.try_divide(tp, tp + fp).alias("precision"),
                            F.try_divide(tp, tp + fn).alias("recall"),
                            F.try_divide(F.least(tp + fn, F.col("n") - tp - fn), F.col("n")).alias("majority_error"))


def label_totals(rows: DataFrame, name: str, label: str = "label") -> DataFrame:
    """What any model on ``rows`` is measured against: ``(model, n, positives, negatives, majority_error)``."""
    y = F.col(label).cast("double")
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(y == 1).alias("positives"), F.count_if(y == 0).alias("negatives"))
    return totals.select(F.lit(name).alias("model"), "*",
                         F.try_divide(F.least("positives", "negatives"), F.col("n")).alias("majority_error"))
