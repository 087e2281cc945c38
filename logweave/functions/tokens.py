"""LogSig tokenising (P6, P7), term pairs (P12) and signature text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .logline import mask

# Fixed values of the reference's preprocessing: separators that become a blank,
# the sign set apart by blanks, the blank-delimited number run that becomes "*",
# the count of leading header tokens dropped, and the weekday names of the
# special-line rule (the reference's list, with its "Thr", in its order).
SEPARATORS = "[:|;,]"
SPACED_SIGN = "="
NUMBER_RUN = " [0-9]* "
NUMBER_TOKEN = " * "
HEADER_TOKENS = 10
REFERENCE_WEEKDAYS = ["Mon", "Tue", "Wed", "Thr", "Fri", "Sat", "Sun"]
WEEKDAY_SKIP = 9
STAR = "*"

WEEKDAYS = REFERENCE_WEEKDAYS + ["Thu"]


def _drop(arr: Column, n: int) -> Column:
    return F.slice(arr, n + 1, F.greatest(F.size(arr) - n, F.lit(0)))


def p6_tokens(line: Column, premask: bool = False) -> Column:
    """Strip, separators -> blank, '=' -> ' = ', ' <digits> ' -> ' * ',
    split on blanks, drop the 10 header tokens.  ``premask`` masks hex
    addresses and numbers first."""
    s = mask(line) if premask else line
    s = F.regexp_replace(s, r"^\s+|\s+$", "")
    s = F.regexp_replace(s, SEPARATORS, " ")
    s = F.regexp_replace(s, SPACED_SIGN, " = ")
    s = F.regexp_replace(s, NUMBER_RUN, NUMBER_TOKEN)
    return _drop(F.split(s, r"\s+"), HEADER_TOKENS)


def weekday_rule(arr: Column, weekday: str = "intent") -> Column:
    """P7 on a token-array column.

    ``literal`` drops 9 more tokens when token 0 is a weekday (never fires on
    standard lines, whose token 0 is ``*``); ``intent`` also looks past one
    leading ``*`` and knows ``Thu``; ``off`` skips the rule.  ``arr`` is used
    several times, so pass a column reference, not an expression.
    """
    first, second = F.get(arr, 0), F.get(arr, 1)
    if weekday == "literal":
        return F.when(first.isin(REFERENCE_WEEKDAYS), _drop(arr, WEEKDAY_SKIP)).otherwise(arr)
    if weekday == "intent":
        return (F.when((first == STAR) & second.isin(WEEKDAYS), _drop(arr, WEEKDAY_SKIP + 1))
                .when(first.isin(WEEKDAYS), _drop(arr, WEEKDAY_SKIP))
                .otherwise(arr))
    if weekday == "off":
        return arr
    raise ValueError("weekday must be 'literal', 'intent' or 'off'")


def with_logsig_tokens(df: DataFrame, line: str = "line", premask: bool = False,
                       weekday: str = "intent", name: str = "tokens") -> DataFrame:
    """P6 + P7 as a column ``name``; the array is projected once, then the rule reads it."""
    base = df.withColumn("_p6", p6_tokens(F.col(line), premask))
    return base.withColumn(name, weekday_rule(F.col("_p6"), weekday)).drop("_p6")


def term_pairs(df: DataFrame, tokens: str = "tokens", keep: tuple[str, ...] = ("line_id",), block: int | None = None) -> DataFrame:
    """Every ordered pair (tokens[i], tokens[j]), i < j, duplicates kept: ``(*keep, a, b)``.

    Without ``block`` a line's pairs are formed by the task that holds it.  With it a
    line is cut into blocks of so many tokens and its pairs of blocks are dealt over
    all tasks, so a task forms ``block`` squared pairs of a line at a time.
    """
    # the outer form: a plain explode makes the optimizer infer size(tokens) > 0 and
    # push it below the tokenising projection, which would run the regexes twice;
    # an empty line yields one (null, null) row, and the second explode drops it
    if block is None:
        pos = df.select(*keep, tokens, F.posexplode_outer(tokens).alias("_i", "a"))
        rest = F.slice(tokens, F.col("_i") + 2, F.size(tokens) - F.col("_i") - 1)
        return pos.select(*keep, "a", F.explode(rest).alias("b"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = F.floor((F.greatest(F.size(tokens), F.lit(1)) - 1) / F.lit(block)).cast("int")
    left = df.select(*keep, tokens, F.explode_outer(F.sequence(F.lit(0), last)).alias("_x"))
    both = left.select(*keep, "_x", F.slice(tokens, F.col("_x") * block + 1, block).alias("_l"), tokens,
                       F.explode_outer(F.sequence(F.col("_x"), last)).alias("_y"))
    cells = both.select(*keep, "_x", "_y", "_l", F.slice(tokens, F.col("_y") * block + 1, block).alias("_r"))
    # an explicit partition count: the rows are few beside the pairs they explode into
    dealt = cells.repartition(n, *keep, "_x", "_y")
    pos = dealt.select(*keep, "_x", "_y", "_r", F.posexplode_outer("_l").alias("_i", "a"))
    rest = F.when(F.col("_x") == F.col("_y"), F.slice("_r", F.col("_i") + 2, F.size("_r") - F.col("_i") - 1)).otherwise(F.col("_r"))
    return pos.select(*keep, "a", F.explode(rest).alias("b"))


def collapse_runs(arr: Column) -> Column:
    """Keep the first of every run of equal consecutive elements."""
    return F.filter(arr, lambda x, i: (i == 0) | (x != F.element_at(arr, i)))


def drop_last(arr: Column) -> Column:
    return F.slice(arr, 1, F.greatest(F.size(arr) - 1, F.lit(0)))


def with_signature(df: DataFrame, tokens: str = "tokens", name: str = "signature") -> DataFrame:
    """First terms of the line's pairs with consecutive repeats collapsed,
    i.e. the tokens without the last one, each run of equal tokens kept once."""
    head = df.withColumn("_head", drop_last(F.col(tokens)))
    return head.withColumn(name, F.array_join(collapse_runs(F.col("_head")), " ")).drop("_head")
