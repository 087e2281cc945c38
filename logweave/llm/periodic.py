"""Periodic runs of words: a sparse diagonal dynamic programme over earlier occurrences.

A run is a stretch of consecutive words with smallest period q, as long as
``max(least, times * q)`` words, that no neighbouring word extends.  On the
diagonal of lag q (word i against word i - q) a run is a row of matches, and the
match length of a lag grows by one with every word whose earlier occurrence
lies q back.

Following every earlier occurrence of a frequent word would cost the square of
its count, so the diagonals are read at dyadic levels.  At level m a "word" is the
block of L = 2^m consecutive words that starts there, and lags in (L/2, L] are
looked at.  Within a run of smallest period q <= L no block of L >= q words recurs
sooner than q back (two periods of a stretch that long would have a smaller common
one), so the nearest earlier occurrence of every block names the only lag that can
be active there: one lag per word and level.  From left to right the
match length of the active lag grows while the nearest occurrence stays q back;
when it changes the diagonal ends and emits its run if it is long enough.  A run of
``times`` >= 3 periods holds q + 1 such blocks at least, so none is missed, and its
borders follow from the first and the last block.  A block can recur only where
both its halves do, so a level looks at what recurred on the one below.

Work and memory are O(n log n) per text; texts are taken in slices of an Arrow
batch.  Words and blocks are told apart by 64-bit hashes.

Defined cases: null text has no words; an id is not looked at, so null and
repeated ids and repeated rows are rows like any other; other columns are left as
they are; empty tables stay empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import prepare, words_of
from .words import groups, mix, word_hashes

LEAST = 6                            # words of a run
TIMES = 4                            # periods of a run

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def _nearest(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance of every place of ``at`` to the nearest earlier place with an equal key (0: none),
    and whether its key has another place at all.  ``at`` ascends."""
    order = np.argsort(key, kind="stable")
    k, p = key[order], at[order]
    again = np.r_[False, k[1:] == k[:-1]]
    lag = np.zeros(len(at), np.int64)
    lag[order] = np.where(again, np.r_[0, p[1:] - p[:-1]], 0)
    shared = np.zeros(len(at), bool)
    shared[order] = again | np.r_[again[1:], False]
    return lag, shared


def runs(h: np.ndarray, counts: np.ndarray, least: int = LEAST, times: int = TIMES):
    """Runs of all texts, whose word hashes are ``h`` one after another.

    ``(row, start, length, period)`` by row, start and period; start in words of the text.
    """
    counts = np.asarray(counts, np.int64)
    first = np.cumsum(counts) - counts
    row = np.repeat(np.arange(len(counts)), counts)
    end = (first + counts)[row]
    found = [np.empty((4, 0), np.int64)]
    # equal blocks of different texts are different: the text's number enters the hash
    block = mix(h + mix(row.astype(np.uint64) + np.uint64(1)))
    at, size = np.arange(len(h)), 1
    while len(at):
        lag, shared = _nearest(block[at], at)
        active = (lag > size // 2) & (lag <= size)
        i, q = at[active], lag[active]
        if len(i):
            new = np.r_[True, (i[1:] != i[:-1] + 1) | (q[1:] != q[:-1]) | (row[i[1:]] != row[i[:-1]])]
            head = np.flatnonzero(new)
            matches = np.diff(np.r_[head, len(i)]) + size - 1
            i, q = i[head], q[head]
            long = matches + q >= np.maximum(least, times * q)
            i, q, matches = i[long], q[long], matches[long]
            found.append(np.stack([row[i], i - q - first[row[i]], matches + q, q]))
        # the blocks of twice the size: in the text, long enough for the next lags, both halves recur
        recurs = np.zeros(len(h) + 1, bool)
        recurs[at[shared]] = True
        at = at[shared]
        at = at[at + 2 * size <= end[at]]
        at = at[recurs[at + size] & (counts[row[at]] >= times * (size + 1))]
        if len(at):
            block = block + np.uint64(2 * size + 1) * np.r_[block[size:], np.zeros(min(size, len(block)), np.uint64)]
            block = mix(block)
        size *= 2
    r = np.concatenate(found, axis=1)
    return r[:, np.lexsort((r[3], r[1], r[0]))]


def _spans_of(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of ``0..size-1`` inside any of the spans."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:-1]) > 0


def _collapsed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> str:
    """The words of one text joined by one space."""
    size = ends - starts
    if not len(size):
        return ""
    to = np.cumsum(size + 1) - size - 1
    out = np.full(int(to[-1] + size[-1]), 32, np.uint8)
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(to, size) + within] = data[np.repeat(starts, size) + within]
    return out.tobytes().decode("utf-8")


def _found_rows(names: list[str], least: int, times: int):
    def run(batches):
        for batch in batches:
            for part in groups(batch):
                h, counts, starts, ends, data, _ = word_hashes(part.column(part.schema.get_field_index("text")), spans=True)
                row, start, length, period = runs(h, counts, least, times)
                first = np.cumsum(counts) - counts
                gone = _spans_of(len(h), first[row] + start + period, first[row] + start + length)
                n, s, e = len(counts), starts[~gone], ends[~gone]
                kept = np.bincount(np.repeat(np.arange(n), counts)[~gone], minlength=n)
                to = np.cumsum(kept)
                texts = [_collapsed(data, s[a:b], e[a:b]) for a, b in zip(to - kept, to)]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32()),
                    pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"]))
                own = [part.column(part.schema.get_field_index(c)) for c in names]
                yield pa.RecordBatch.from_arrays([*own, lists, pa.array(texts, pa.string())], [*names, "runs", "collapsed"])
    return run


def periodic_runs(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``(*keep, runs, collapsed)`` per document.

    ``runs``: every run as ``(start, length, period)`` in words, by start and
    period.  ``collapsed``: the text's words joined by one space, without those
    that a run holds after its first period.  ``times`` is 3 at least.
    """
    if times < 3 or least < 1:
        raise ValueError("a run holds three periods and one word at least")
    prepare(docs.sparkSession)
    rows = docs.select(*keep, "text")
    kind = T.StructType([*(rows.schema[c] for c in keep), T.StructField("runs", T.ArrayType(RUN)),
                         T.StructField("collapsed", T.StringType())])
    return rows.mapInArrow(_found_rows(list(keep), least, times), kind)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from :func:`periodic_runs`: the run of greatest exact exponent (ties: the first), hashes of all."""
    best = F.reduce("runs", F.lit(None).cast(RUN), lambda b, r: F.when(
        b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"), F.col("_best.length").alias("length"), F.col("_best.period").alias("period"),
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """The contract's input: in a tenth of the documents the words from one place on repeat with one period.

    A null id counts as the empty text.
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = docs.select("doc_id", "text", h.alias("_h"), F.when(h % 10 == 0, words_of(F.col("text"))).alias("_w"))
    g, n = F.expr("_h div 10"), F.size("_w").cast("long")
    placed = words.withColumns({"_g": g, "_n": n}).withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    placed = placed.withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    again = F.expr("transform(_w, (x, i) -> if(i < _a, x, _w[int(_a + (i - _a) % _p)]))")
    text = F.when((F.col("_h") % 10 == 0) & (F.col("_n") > 0), F.array_join(again, " ")).otherwise(F.col("text"))
    return placed.select("doc_id", text.alias("text"))
