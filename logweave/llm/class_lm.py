"""Brown class-based bigram language model.

Symbols are the most frequent words (at most ``words`` of them, cut at a count)
and, for all other words, ``endings`` groups by their last three bytes; one more
symbol ends a text.  Exchange clustering deals the symbols to ``classes``
classes: from class bigram counts, every symbol's gain of mutual information in
every class is worked out in parallel; in a sweep about half of the symbols
that gain move, and a sweep that lowers the total is taken back and the next one
moves fewer.  The end is a class of its own.

P(text) is the product over its words and the end of P(class | previous class),
P(symbol | class) and, in an ending group, P(word | group); the first two are
interpolated with or smoothed by unigrams, the last gives unseen words a share.
The base score is the smoothed unigram model.

All counts are made over all training texts.  What is sent to the tasks has a
bound: the symbol table (``words`` + ``endings``), class matrices, and counts of
at most ``known`` frequent words; other words meet their counts in a join.

Defined cases: null text is empty (an end only); repeated rows are scored and
counted each; a null id is an id like any other; other columns are ignored; an
empty table gives an empty result, and without training texts the base model
gives every token probability 1.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import prepare, written
from .words import groups, mix, word_hashes

WORDS, ENDINGS, CLASSES, SWEEPS = 2048, 512, 48, 8
KNOWN = 1 << 18
ADD = 0.1                            # additive smoothing of word counts
BACK = 20.0                          # weight of the class unigram in a transition
END = np.uint64(1)                   # hash that stands for the end of a text


def tokens(column, endings: int):
    """``(hash, ending group, words per text)`` of the lower-cased words."""
    h, counts, s, e, data, _ = word_hashes(column, lower=True, spans=True)
    h[h == END] = np.uint64(2)
    suffix = np.zeros(len(h), np.uint64)
    for back in range(1, 4):
        at = e - back
        b = data[np.maximum(at, 0)].astype(np.uint64)
        b = np.where((b >= 65) & (b <= 90), b + np.uint64(32), b)
        suffix = suffix * np.uint64(257) + np.where(at >= s, b, np.uint64(0))
    return h, (mix(suffix + np.uint64(1)) % np.uint64(endings)).astype(np.int64), counts


def _counts(endings):
    def run(batches):
        for batch in batches:
            for part in groups(batch):
                h, g, _ = tokens(part.column(0), endings)
                key, at, n = np.unique(h, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.r_[key, END].view(np.int64)), pa.array(np.r_[g[at], -1].astype(np.int32)),
                     pa.array(np.r_[n, len(part)].astype(np.int64))], ["h", "g", "c"])
    return run


def _frequent(counts: DataFrame, most: int, histogram) -> DataFrame:
    """The words whose count is at least the least count that at most ``most`` words reach."""
    total, least = 0, math.inf
    for c, n in histogram:                                # counts falling
        total += n
        if total > most:
            break
        least = c
    return counts.where((F.col("g") >= 0) & (F.col("c") >= F.lit(float(least))))


def _lookup(table: np.ndarray, values: np.ndarray):
    """``(position, found)`` of values in a sorted table."""
    if not len(table):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return at, table[at] == values


def _symbols(h, g, counts, top, endings):
    """Symbol of every token with the end symbol behind every text, and the symbol before it."""
    at, found = _lookup(top, h)
    sym = np.where(found, at, len(top) + g)
    end = len(top) + endings
    seq = np.insert(sym, np.cumsum(counts), end)
    return seq, np.r_[end, seq[:-1]], found


def _bigrams(shared, endings):
    def run(batches):
        top = shared.value
        size = len(top) + endings + 1
        for batch in batches:
            for part in groups(batch):
                h, g, counts = tokens(part.column(0), endings)
                seq, before, _ = _symbols(h, g, counts, top, endings)
                key, n = np.unique(before * size + seq, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((key // size).astype(np.int32)), pa.array((key % size).astype(np.int32)),
                                                  pa.array(n.astype(np.int64))], ["w1", "w2", "n"])
    return run


# ---- exchange clustering ------------------------------------------------------------------

def _xlx(x):
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def information(m: np.ndarray) -> float:
    """The part of the log-likelihood that the classes decide."""
    return float(_xlx(m).sum() - _xlx(m.sum(axis=1)).sum() - _xlx(m.sum(axis=0)).sum())


def best_class(x: int, left: np.ndarray, right: np.ndarray, twice: float, m: np.ndarray):
    """``(class, gain)`` of the best move of a symbol out of class ``x``; the last class stays closed.

    ``left``/``right``: counts with the class before/behind the symbol; ``twice``:
    the symbol behind itself.
    """
    m = m.copy()
    m[:, x] -= left
    m[x, :] -= right
    m[x, x] += twice
    left, right = left.copy(), right.copy()
    left[x] -= twice
    right[x] -= twice
    rows, cols = m.sum(axis=1) + left, m.sum(axis=0) + right
    out, into = right.sum() + twice, left.sum() + twice
    now = _xlx(m)
    d = np.diag(m)
    total = (_xlx(m + left[:, None]) - now).sum(axis=0) + (_xlx(m + right[None, :]) - now).sum(axis=1)
    total += _xlx(d + left + right + twice) - _xlx(d + left) - _xlx(d + right) + _xlx(d)
    total -= _xlx(rows + out) - _xlx(rows) + _xlx(cols + into) - _xlx(cols)
    total[-1] = -np.inf
    b = int(total.argmax())
    return b, float(total[b] - total[x])


def exchange(bigrams: DataFrame, size: int, uni: np.ndarray, classes: int, sweeps: int) -> np.ndarray:
    """Class of every symbol; the last symbol (the end) has the last class alone."""
    spark = bigrams.sparkSession
    rank = np.argsort(np.argsort(-uni, kind="stable"), kind="stable")
    cls = rank % classes
    cls[-1] = classes
    both = classes + 1

    def matrix(cls):
        # one row per pair of classes reaches the driver
        m = np.zeros((both, both))
        for r in _named(bigrams, cls, spark).groupBy("c1", "c2").agg(F.sum("n").alias("n")).collect():
            m[r["c1"], r["c2"]] = r["n"]
        return m

    m = matrix(cls)
    share = 0.5
    for sweep in range(sweeps):
        named = _named(bigrams, cls, spark)
        sides = (named.select(F.col("w2").alias("w"), F.col("c1").alias("c"), F.col("n").alias("l"), F.lit(0).cast("long").alias("r"), F.lit(0).cast("long").alias("t"))
                 .unionByName(named.select(F.col("w1").alias("w"), F.col("c2").alias("c"), F.lit(0).cast("long").alias("l"), F.col("n").alias("r"),
                                           F.when(F.col("w1") == F.col("w2"), F.col("n")).otherwise(F.lit(0)).alias("t"))))
        vectors = (sides.groupBy("w", "c").agg(F.sum("l").alias("l"), F.sum("r").alias("r"), F.sum("t").alias("t"))
                   .groupBy("w").agg(F.collect_list("c").alias("c"), F.collect_list("l").alias("l"), F.collect_list("r").alias("r"), F.sum("t").alias("t")))
        shared = spark.sparkContext.broadcast((cls, m))

        def moves(batches):
            cls, m = shared.value
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    left, right = np.zeros(both), np.zeros(both)
                    left[r["c"]], right[r["c"]] = r["l"], r["r"]
                    rows.append((r["w"], *best_class(int(cls[r["w"]]), left, right, r["t"], m)))
                w, b, gain = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.int32()), pa.array(b, pa.int32()), pa.array(gain, pa.float64())], ["w", "b", "gain"])

        new = cls.copy()
        # one row per symbol that gains
        for r in vectors.where(F.col("w") < size - 1).mapInArrow(moves, "w int, b int, gain double").where("gain > 1e-6").collect():
            dice = int(mix(np.array([r["w"] * 1000 + sweep], np.uint64))[0] >> np.uint64(11)) / 2 ** 53
            if dice < share:
                new[r["w"]] = r["b"]
        shared.unpersist()
        after = matrix(new)
        if information(after) > information(m):
            cls, m = new, after
        else:
            share /= 3
    return cls


def _named(bigrams, cls, spark):
    """Bigrams with the classes of both symbols (the table of classes has a row per symbol)."""
    table = spark.createDataFrame(pa.table({"w": pa.array(np.arange(len(cls)), pa.int32()), "c": pa.array(cls, pa.int32())}))
    one = F.broadcast(table.select(F.col("w").alias("w1"), F.col("c").alias("c1")))
    two = F.broadcast(table.select(F.col("w").alias("w2"), F.col("c").alias("c2")))
    return bigrams.join(one, "w1").join(two, "w2")


class ClassModel:
    """Tables of the model as sent to the tasks, and the counts table that stays in Spark."""

    def __init__(self, **tables):
        self.__dict__.update(tables)


def learn(texts: DataFrame, words: int = WORDS, endings: int = ENDINGS, classes: int = CLASSES, sweeps: int = SWEEPS,
          known: int = KNOWN) -> tuple[ClassModel, DataFrame]:
    """Fit on all rows of ``texts(text)``; returns the model and the table of all word counts ``(h, g, c)``."""
    spark = texts.sparkSession
    prepare(spark)
    texts = texts.select("text")
    counts = written(texts.mapInArrow(_counts(endings), "h bigint, g int, c bigint")
                     .groupBy("h", "g").agg(F.sum("c").alias("c")), "counts")
    all_n, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # counts of counts: their number grows with the logarithm of the corpus
    bucket = F.floor(F.log2("c") * 64)
    steps = (counts.where("g >= 0").groupBy(bucket.alias("b")).agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("n"))
             .orderBy(F.col("b").desc()).collect())
    histogram = [(r["c"], r["n"]) for r in steps]
    top = _frequent(counts, words, histogram).select("h").toArrow()["h"].to_numpy().view(np.uint64)
    top = np.sort(top)
    table = _frequent(counts, known, histogram).select("h", "c").toArrow()
    kh, kc = table["h"].to_numpy().view(np.uint64), table["c"].to_numpy()
    order = np.argsort(kh)
    kh, kc = kh[order], kc[order]

    size = len(top) + endings + 1
    shared = spark.sparkContext.broadcast(top)
    bigrams = written(texts.mapInArrow(_bigrams(shared, endings), "w1 int, w2 int, n bigint")
                      .groupBy("w1", "w2").agg(F.sum("n").alias("n")), "bigrams")
    uni = np.zeros(size)
    for r in bigrams.groupBy("w2").agg(F.sum("n").alias("n")).toArrow().to_pylist():
        uni[r["w2"]] = r["n"]
    cls = exchange(bigrams, size, uni, classes, sweeps)

    # the group of a word that is not a symbol of its own shares its probability among its words
    rare = counts.where("g >= 0").join(F.broadcast(spark.createDataFrame(pa.table({"h": pa.array(top.view(np.int64))}))), "h", "left_anti")
    n_group, v_group = np.zeros(endings), np.zeros(endings)
    for r in rare.groupBy("g").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        n_group[r["g"]], v_group[r["g"]] = r["n"], r["v"]
    m = np.zeros((classes + 1, classes + 1))
    for r in _named(bigrams, cls, spark).groupBy("c1", "c2").agg(F.sum("n").alias("n")).collect():
        m[r["c1"], r["c2"]] = r["n"]
    per_class = np.bincount(cls, weights=uni, minlength=classes + 1)
    members = np.bincount(cls, minlength=classes + 1)
    uniform = (per_class + ADD) / (per_class + ADD).sum()
    transition = np.log10((m + BACK * uniform[None, :]) / (m.sum(axis=1, keepdims=True) + BACK))
    emission = np.log10((uni + ADD) / (per_class + ADD * members)[cls])
    model = ClassModel(
        top=top, known_hash=kh, known_count=kc, cls=cls, transition=transition, emission=emission, endings=endings,
        tokens=int(all_n), base_log=math.log10(all_n + ADD * (distinct + 1)),
        group_log=np.log10(n_group + ADD * (v_group + 1)), end_count=float(uni[-1]))
    return model, counts


def _score(shared):
    def run(batches):
        m = shared.value
        for batch in batches:
            for part in groups(batch):
                h, g, counts = tokens(part.column(part.num_columns - 1), m.endings)
                seq, before, own = _symbols(h, g, counts, m.top, m.endings)
                doc = np.repeat(np.arange(len(counts)), counts)
                doc_end = np.repeat(np.arange(len(counts)), counts + 1)
                sums = lambda w, d: np.bincount(d, weights=w, minlength=len(counts))
                score = sums(m.transition[m.cls[before], m.cls[seq]] + m.emission[seq], doc_end)
                at, found = _lookup(m.known_hash, h)
                log_c = np.zeros(len(h))
                if found.any():
                    log_c[found] = np.log10(m.known_count[at[found]] + ADD)
                base = sums(log_c, doc) + math.log10(m.end_count + ADD) - (counts + 1) * m.base_log
                score += sums(np.where(own, 0.0, log_c - m.group_log[g]), doc)
                known = sums(found, doc) + (m.end_count > 0)
                # other words meet their counts in a join
                rare = np.flatnonzero(~found)
                cut = np.searchsorted(doc[rare], np.arange(len(counts) + 1))
                rest = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(h[rare].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array((counts + 1).astype(np.int64)), pa.array(known.astype(np.int64)),
                     pa.array(base), pa.array(score), rest],
                    [*part.schema.names[:-1], "n_tokens", "n_known", "base_score", "score", "rest"])
    return run


def scored(docs: DataFrame, model: ClassModel, counts: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``n_tokens, n_known, train_tokens, base_score, score, perplexity``; one row per input row."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    kinds = ", ".join(f"_keep{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    narrow = docs.select(*[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)], "text")
    rows = narrow.mapInArrow(_score(shared), f"{kinds}, n_tokens bigint, n_known bigint, base_score double, score double, rest array<bigint>")
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "scored")
    rest = rows.select("_row", F.explode("rest").alias("h")).groupBy("_row", "h").agg(F.count(F.lit(1)).alias("n"))
    value = F.coalesce(F.col("c"), F.lit(0))
    more = (rest.join(counts.where("g >= 0").select("h", "c"), "h", "left")
            .groupBy("_row").agg(F.sum(F.col("n") * F.log10(value + ADD)).alias("_log"),
                                 F.sum(F.when(value > 0, F.col("n")).otherwise(F.lit(0))).alias("_known")))
    out = rows.drop("rest").join(more, "_row", "left")
    log = F.coalesce("_log", F.lit(0.0))
    out = out.select(*[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)], "n_tokens",
                     (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
                     F.lit(model.tokens).cast("long").alias("train_tokens"),
                     (F.col("base_score") + log).alias("base_score"), (F.col("score") + log).alias("score"))
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
