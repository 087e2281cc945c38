"""Quality rules: base limits and robust multivariate outliers, all in DataFrame expressions.

Per language and source the minimum covariance determinant is estimated by
concentration steps: start from the rows nearest to the median (scaled by the
median absolute deviation), then take mean and covariance of the ``share`` of
rows with the least Mahalanobis distance, again and again.  Three starts, which
measure nearness differently, run side by side, and each group takes the
estimate whose covariance has the least determinant.  A row is rejected
when its squared distance to its group, rescaled by the group's median, exceeds
``cutoff``, a chi-square quantile.  Statistics are transformed to tame their tails, and every variance
has a floor, so a statistic that hardly varies in a group cannot reject a row on
its own small scale.

All work in a group is sums, approximate quantiles and row-wise expressions: a
group with most rows is spread over all tasks.

Defined cases: null text has no words; null language or source is a group of
its own; a group whose rows all fail the base rules has no estimate and keeps
none of them; repeated rows and null ids are rows like any other; other columns
are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, blank, words_of, written

LEAST_WORDS, REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SHARE, STEPS = 0.75, 3
CHI2_MEDIAN = 4.3515                 # median of chi-square with 5 degrees of freedom
CUTOFF = 30.856                      # squared robust distance: chi-square's 0.99999 quantile with 5 degrees of freedom
STATISTICS = ("z_length", "z_symbols", "z_lines", "z_repeats", "z_upper")
FLOORS = (0.1, 0.1, 0.1, 0.1, 0.1)   # least standard deviation of each statistic

_POSITION_BITS = 30                  # a string has less than 2 ** 30 words


def _repeated_words(words):
    """Words inside 3-word windows that occur twice or more, the first one included.

    The windows' hashes are sorted together with their positions by their upper
    bits; positions whose neighbours agree are sorted once more by the lower
    bits.  What agrees in both is repeated.
    """
    n = F.size(words)
    low = (1 << _POSITION_BITS) - 1

    def twins(codes):
        """Codes whose upper part also stands beside them in the sorted array."""
        key = lambda x: F.shiftright(x, _POSITION_BITS)
        return F.filter(codes, lambda x, i: ((i > 0) & (key(x) == key(F.get(codes, i - 1)))) | (key(x) == key(F.get(codes, i + 1))))

    return n, low, twins


def text_statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """``keep`` and ``n_words, word_chars, n_symbols, n_upper, n_lines, n_dup_lines, n_repeat_words``."""
    text = blank(F.col("text"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    base = docs.select(*keep, text.alias("_text"), words_of(F.col("text")).alias("_words"), lines.alias("_lines"))
    n, low, twins = _repeated_words(F.col("_words"))
    grams = F.when(n > 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(
        F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    base = base.select(
        *keep, n.cast("long").alias("n_words"),
        F.length(F.translate("_text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("_text") - F.length(F.translate("_text", UPPER, ""))).cast("long").alias("n_upper"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        grams.alias("_grams"))
    upper = F.sort_array(F.transform("_grams", lambda h, i: h.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))))
    base = base.withColumn("_upper", upper)
    base = base.withColumn("_found", twins(F.col("_upper")))
    lower = F.sort_array(F.transform("_found", lambda x: F.shiftleft(
        F.get("_grams", x.bitwiseAND(F.lit(low)).cast("int")), _POSITION_BITS).bitwiseOR(x.bitwiseAND(F.lit(low)))))
    base = base.withColumn("_lower", lower)
    at = F.sort_array(F.transform(twins(F.col("_lower")), lambda x: x.bitwiseAND(F.lit(low))))
    base = base.withColumn("_at", at)
    covered = F.aggregate(
        F.transform("_at", lambda x, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get("_at", i + 1) - x, F.lit(3).cast("long")))),
        F.lit(0).cast("long"), lambda a, b: a + b)
    return base.withColumn("n_repeat_words", covered).drop("_grams", "_upper", "_found", "_lower", "_at")


def transformed(stats: DataFrame) -> DataFrame:
    """The statistic vector of every row."""
    n = F.col("n_words") + 1
    return (stats.withColumn("z_length", F.log((F.col("word_chars") + 1) / n))
            .withColumn("z_symbols", F.sqrt(F.col("n_symbols") / n))
            .withColumn("z_upper", F.sqrt(F.col("n_upper") / (F.col("word_chars") + 1)))
            .withColumn("z_lines", F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 1)))
            .withColumn("z_repeats", F.sqrt(F.col("n_repeat_words") / n)))


def _with_group(rows: DataFrame, estimates: DataFrame, group) -> DataFrame:
    """Every row with its group's estimates; null keys match null keys."""
    renamed = estimates.select(*[F.col(g).alias(f"_g_{g}") for g in group], *[c for c in estimates.columns if c not in group])
    same = None
    for g in group:
        one = F.col(g).eqNullSafe(F.col(f"_g_{g}"))
        same = one if same is None else same & one
    return rows.join(renamed, same, "left").drop(*[f"_g_{g}" for g in group])


def _moments(rows: DataFrame, group, stats, floors) -> DataFrame:
    """Mean ``m_i`` and inverse Cholesky factor ``f_i_j`` of the covariance per group.

    Column by column, so that no expression holds another one twice.
    """
    p = len(stats)
    cov = [(F.covar_pop(stats[i], stats[j]) + (floors[i] ** 2 if i == j else 0.0)).alias(f"c_{i}_{j}") for i in range(p) for j in range(i + 1)]
    out = rows.groupBy(*group).agg(*[F.avg(s).alias(f"m_{i}") for i, s in enumerate(stats)], *cov)
    for i in range(p):
        for j in range(i + 1):
            rest = sum((-F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.col(f"c_{i}_{j}"))
            out = out.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l_{j}_{j}"))
    for i in range(p):
        out = out.withColumn(f"f_{i}_{i}", 1 / F.col(f"l_{i}_{i}"))
        for j in range(i):
            inner = sum((F.col(f"l_{i}_{k}") * F.col(f"f_{k}_{j}") for k in range(j, i)), F.lit(0.0))
            out = out.withColumn(f"f_{i}_{j}", -inner / F.col(f"l_{i}_{i}"))
    return out.select(*group, *[f"m_{i}" for i in range(p)], *[f"f_{i}_{j}" for i in range(p) for j in range(i + 1)])


def _distance(stats):
    """Squared Mahalanobis distance from the columns of :func:`_moments`."""
    total = F.lit(0.0)
    for i in range(len(stats)):
        y = sum((F.col(f"f_{i}_{j}") * (F.col(s) - F.col(f"m_{j}")) for j, s in enumerate(stats[:i + 1])), F.lit(0.0))
        total = total + F.pow(y, F.lit(2.0))
    return total


def _starts(stats, floors) -> list:
    """Distances from the median in units of the median absolute deviation, one per start: the sum of squares,
    the sum of bounded squares (a far value counts no more than a near outlier), and the largest one."""
    z = [(F.col(s) - F.col(f"m_{i}")) / (1.4826 * F.col(f"s_{i}") + floors[i]) for i, s in enumerate(stats)]
    squares = sum((x * x for x in z), F.lit(0.0))
    bounded = sum((F.pow(F.tanh(x / 2), F.lit(2.0)) for x in z), F.lit(0.0))
    return [squares, bounded, F.greatest(*[F.abs(x) for x in z])]


def robust_distance(rows: DataFrame, group=("lang", "source"), stats=STATISTICS, floors=FLOORS, share: float = SHARE,
                    steps: int = STEPS, fit_on=None) -> DataFrame:
    """``rows`` with ``robust_distance``: squared, rescaled so that a group's median is chi-square's.

    Concentration runs from several fixed starts side by side (they are one more grouping column),
    and every group takes the estimate with the least determinant.
    ``fit_on``: condition on the rows that the estimates are made of.
    """
    names = list(group)
    fit = rows.where(fit_on) if fit_on is not None else rows
    fit = fit.select(*names, *stats)
    centre = fit.groupBy(*names).agg(*[F.percentile_approx(s, 0.5, 10000).alias(f"m_{i}") for i, s in enumerate(stats)])
    off = _with_group(fit, centre, names).select(*names, *[F.abs(F.col(s) - F.col(f"m_{i}")).alias(s) for i, s in enumerate(stats)])
    spread = off.groupBy(*names).agg(*[F.percentile_approx(s, 0.5, 10000).alias(f"s_{i}") for i, s in enumerate(stats)])
    start = written(_with_group(centre, spread, names), "estimates")
    runs = [*names, "_start"]
    first = F.posexplode(F.array(*_starts(stats, floors))).alias("_start", "_d")
    scored = _with_group(fit, start, names).select(*names, *stats, first)
    several = fit.withColumn("_start", F.explode(F.sequence(F.lit(0), F.lit(len(_starts(stats, floors)) - 1))))
    for _ in range(steps + 1):
        limit = scored.groupBy(*runs).agg(F.percentile_approx("_d", share, 10000).alias("_limit"))
        core = _with_group(scored, limit, runs).where(F.col("_d") <= F.col("_limit"))
        estimate = written(_moments(core, runs, stats, floors), "estimates")
        scored = _with_group(several, estimate, runs).select(*runs, *stats, _distance(stats).alias("_d"))
    # the least determinant; the factor's diagonal holds its inverse root
    inverse_root = sum((F.log(F.col(f"f_{i}_{i}")) for i in range(len(stats))), F.lit(0.0))
    own = [c for c in estimate.columns if c not in runs]
    best = estimate.groupBy(*names).agg(F.max_by(F.struct(*own), F.struct(inverse_root, -F.col("_start"))).alias("_b")).select(*names, "_b.*")
    best = written(best, "estimates")
    final = _with_group(fit, best, names).select(*names, _distance(stats).alias("_d"))
    scale = final.groupBy(*names).agg(F.greatest(F.percentile_approx("_d", 0.5, 10000) / CHI2_MEDIAN, F.lit(1.0)).alias("_scale"))
    both = written(_with_group(best, scale, names), "estimates")
    gone = [c for c in both.columns if c not in names]
    return _with_group(rows, both, names).withColumn("robust_distance", _distance(stats) / F.col("_scale")).drop(*gone)


def quality_rules(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Statistics, ``base_failed``, ``robust_distance`` and ``kept``, one row per input row."""
    stats = written(text_statistics(docs), "statistics")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    rows = transformed(stats.withColumn("base_failed", failed))
    judged = robust_distance(rows, fit_on=~F.col("base_failed"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         (~F.col("base_failed") & F.coalesce(F.col("robust_distance") <= cutoff, F.lit(False))).alias("kept"),
                         "robust_distance")
