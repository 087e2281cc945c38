"""Benchmark decontamination by spaced seeds, all in DataFrame expressions.

A seed is a fixed mask over consecutive words; words at ignored positions may
differ.  Hashes of the masked words of every position of the benchmark items are
joined with those of the documents.  A hit fixes an alignment; around it, the
words of both sides are compared one by one, and a ``window`` of aligned words
with at least ``least`` equal ones is a verified overlap (substitutions only).
In a window with two substitutions at most, the masks always have a hit.

Words are lower-cased runs of letters and digits.  Items shorter than the window
need the same share of their own length.  Such an item is cut into one run of
words more than it may have substitutions, so one run is whole in every match;
the runs are its seeds, and documents are hashed for the lengths that occur.

Defined cases: null texts and items without words cannot match; a document
shorter than both window and item cannot; repeated items count once per item id,
repeated documents are reported once per row's id; null ids are ids like any
other; other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import blank, numbered, written

MASKS = ((0, 1, 2, 3, 5, 6, 7), (0, 1, 2, 3, 5, 7, 8), (0, 1, 4, 7, 8, 9, 10))
WINDOW, LEAST = 13, 11
SMALL = 4_000_000                    # benchmark seeds (16 bytes each) that may be sent to every task
_SPLIT = r"[^\p{L}\p{N}]+"


def tokens(text):
    return F.filter(F.split(F.lower(blank(text)), _SPLIT), lambda w: w != "")


def parts(size: int, window: int = WINDOW, least: int = LEAST) -> list[tuple[int, int]]:
    """``(start, length)`` of the runs of a short item: one more than its substitutions."""
    runs = size - -(-least * size // window) + 1
    cuts = [size * k // runs for k in range(runs + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _seed(number: int, words, at, mask):
    return F.xxhash64(F.lit(number), *[F.get(words, at + o) for o in mask])


def _seeds(words, at, masks):
    """Hash of every mask at position ``at``; null where the mask passes the end."""
    n = F.size(words)
    return F.array(*[F.when(at + m[-1] < n, _seed(i, words, at, m)) for i, m in masks.items()])


def _positions(rows: DataFrame, masks: dict, *keep) -> DataFrame:
    """One row per position where the shortest mask fits."""
    span = min(m[-1] for m in masks.values())
    return (rows.where(F.size("words") > span)
            .select(*keep, "words", F.explode(F.sequence(F.lit(0), F.size("words") - 1 - span)).alias("at"))
            .select(*keep, "words", "at", F.explode(_seeds(F.col("words"), F.col("at"), masks)).alias("seed")).where("seed is not null"))


def _short_seeds(items: DataFrame, window: int, least: int) -> DataFrame:
    """The runs of items shorter than the window."""
    words = F.col("words")
    runs = [F.when(F.size(words) == m, F.struct(F.lit(a).alias("at"), _seed(len(MASKS) + n, words, F.lit(a), range(n)).alias("seed")))
            for m in range(1, window) for a, n in parts(m, window, least)]
    found = items.where(F.size(words) < window).select("item_id", "words", F.explode(F.array(*runs)).alias("run"))
    return found.where("run is not null").select("item_id", "words", "run.at", "run.seed")


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """``(doc_id, item_id, matched, compared)`` of every verified pair.

    ``matched`` is the most equal words in a window of ``compared`` aligned words.
    """
    items = benchmark.select("item_id", tokens(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
    items = written(items, "items")
    masks = dict(enumerate(MASKS))
    long = _positions(items.where(F.size("words") >= window), masks, "item_id")
    item_seeds = written(long.unionByName(_short_seeds(items, window, least)).select("item_id", F.col("words").alias("item"), F.col("at").alias("j"), "seed"), "seeds")
    keys = item_seeds.select("seed").distinct()
    rows = docs.select("doc_id", tokens(F.col("text")).alias("words"))
    short = [r[0] for r in items.select(F.size("words").alias("m")).where(F.col("m") < window).distinct().collect()]
    masks |= {len(MASKS) + n: range(n) for m in short for _, n in parts(m, window, least)}
    found = _positions(rows, masks, "doc_id")
    # the benchmark's seeds go to every task only while they are few; else both sides are dealt out by seed
    small = item_seeds.count() <= SMALL
    hits = found.join(F.broadcast(keys), "seed", "left_semi") if small else found.join(keys, "seed", "left_semi")
    # words around the hit, as far as a window that holds the mask can reach
    reach = window + max(m[-1] for m in masks.values())
    left = F.greatest(F.col("at") - reach, F.lit(0))
    hits = hits.select("doc_id", "seed", "at", (F.col("at") - left).alias("before"),
                       F.slice("words", left + 1, F.col("at") - left + reach + 1).alias("part"))
    pairs = hits.join(F.broadcast(item_seeds) if small else item_seeds, "seed")
    # equal words along the alignment: part[k] stands against item[k + shift]
    shift = F.col("j") - F.col("before")
    lo, hi = F.greatest(F.lit(0), -shift), F.least(F.size("part"), F.size("item") - shift)
    equal = F.transform(F.sequence(lo, hi - 1), lambda k: (F.get("part", k) == F.get("item", k + shift)).cast("int"))
    pairs = pairs.select("doc_id", "item_id", F.size("item").alias("m"), equal.alias("equal"))
    wide = F.least(F.lit(window), F.col("m"))
    sums = F.when(F.size("equal") >= wide, F.transform(
        F.sequence(F.lit(1), F.size("equal") - wide + 1),
        lambda s: F.aggregate(F.slice("equal", s, wide), F.lit(0), lambda a, b: a + b)))
    pairs = pairs.select("doc_id", "item_id", wide.alias("compared"), F.array_max(sums).alias("matched"))
    enough = F.col("matched") * window >= F.col("compared") * least
    return (pairs.where(enough).groupBy("doc_id", "item_id")
            .agg(F.max("matched").cast("int").alias("matched"), F.max("compared").cast("int").alias("compared")))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows without a verified overlap, whatever their ids; all columns stay."""
    rows, number = numbered(docs, "leak_rows")
    bad = overlaps(rows.select(F.col(number).alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("_bad")).distinct()
    return rows.join(bad, rows[number] == bad["_bad"], "left_anti").drop(number)


def oracle() -> str:
    """DuckDB SQL of :func:`overlaps` for ``documents`` and ``benchmark``, by the rule alone: no masks, no seeds.

    Equal words of a document and an item lie on a diagonal (the difference of their
    places).  On each diagonal with enough of them the fullest window starts or ends at an equal
    word, or lies at an end of the overlap.
    """
    words = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS words FROM documents),
b AS (SELECT row_number() OVER () AS s, * FROM (SELECT DISTINCT item_id, words FROM (SELECT item_id, {words} AS words FROM benchmark) WHERE len(words) > 0)),
dw AS (SELECT r, unnest(words) AS w, unnest(range(len(words))) AS i FROM d),
bw AS (SELECT s, unnest(words) AS w, unnest(range(len(words))) AS j FROM b),
dense AS (
  SELECT r, s, i - j AS diag FROM dw JOIN bw USING (w) GROUP BY ALL
  HAVING count(*) * {WINDOW} >= (SELECT min(least({WINDOW}, len(words))) FROM b) * {LEAST}
),
spans AS (
  SELECT r, s, diag, least({WINDOW}, len(b.words)) AS m, greatest(0, diag) AS lo, least(len(d.words), len(b.words) + diag) - 1 AS hi, d.words AS dx, b.words AS bx
  FROM dense JOIN d USING (r) JOIN b USING (s) WHERE least(len(d.words), len(b.words) + diag) - greatest(0, diag) >= least({WINDOW}, len(b.words))
),
eq AS (
  SELECT r, s, diag, m, lo, hi, i FROM (SELECT *, unnest(range(lo, hi + 1)) AS i FROM spans) WHERE dx[i + 1] = bx[i - diag + 1]
),
near AS (
  SELECT *, count(*) OVER (PARTITION BY r, s, diag ORDER BY i RANGE BETWEEN CURRENT ROW AND m - 1 FOLLOWING) AS ahead,
         count(*) OVER (PARTITION BY r, s, diag ORDER BY i RANGE BETWEEN m - 1 PRECEDING AND CURRENT ROW) AS behind
  FROM eq
),
best AS (
  SELECT r, s, m, greatest(coalesce(max(ahead) FILTER (i + m - 1 <= hi), 0), coalesce(max(behind) FILTER (i - m + 1 >= lo), 0),
                           count(*) FILTER (i <= lo + m - 1), count(*) FILTER (i >= hi - m + 1)) AS matched
  FROM near GROUP BY r, s, diag, m, lo, hi
)
SELECT d.doc_id, b.item_id, CAST(max(matched) AS INT) AS matched, CAST(max(m) AS INT) AS compared
FROM best JOIN d USING (r) JOIN b USING (s) WHERE matched * {WINDOW} >= m * {LEAST} GROUP BY d.doc_id, b.item_id"""
