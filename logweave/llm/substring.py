"""Exact removal of long repeated spans with a compacted De Bruijn graph of words.

The edges of the graph are the windows of ``window`` consecutive words.  Every
window is anchored at its least ``k``-word sequence (by hash), so equal windows
have equal anchors, and the consecutive windows of a document with one anchor
form a *segment*: a path of edges compacted before anything is shuffled.

1. Anchors are counted.  One that occurs once has no repeated window.  One that
   occurs more often is *plain* if all its segments are alike (no branch) and
   *branching* otherwise.
2. Plain segments that always follow each other are joined into paths: a join of
   every segment with its only successor, and the source coordinates of its
   first occurrence, give each path its segments in order.  A path is then
   looked up by its first segment alone, and every occurrence is verified by the
   coordinate of its last segment.
3. Only under branching anchors windows are compared one by one, once for each
   different segment, however many copies it has.
4. The repeated spans of a document are joined with its text and cut out.

A fixed-size bit set of repeated anchors keeps the others out of the shuffles;
it lets some of them through by chance and never holds one back, so results do
not depend on it.  Windows are compared by anchor (64 bits) and 40 more bits.

Defined cases: null text has no words; texts under ``window`` words lose
nothing; repeated rows are places of their own, so their windows repeat; a null
id is an id like any other; other columns are ignored; empty tables stay empty.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bitset import bit_set, has_bits
from .shared import blank, prepare, written
from .words import groups, mix, sequence_hashes, word_hashes

WINDOW = 35
ANCHOR = 12
FILTER_BITS = 25                     # the bit set of repeated anchors has 2 ** FILTER_BITS bits


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least of ``values[i:i+width]`` for every i."""
    low, at, have = values, np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        right = low[step:] < low[:-step]
        at = np.where(right, at[step:], at[:-step])
        low = np.where(right, low[step:], low[:-step])
        have += step
    return at


def segments(column, window: int, k: int):
    """Segments of all texts of an Arrow column.

    ``(row, start, size, anchor, segment, previous, next, windows)``: size in
    windows, start in words of the text, previous and next anchor (0 at the
    ends), windows as one 5-byte value each.
    """
    h, counts = word_hashes(column)
    first = np.cumsum(counts) - counts
    if len(h) < window:
        return None
    row = np.repeat(np.arange(len(counts)), counts)
    starts = np.flatnonzero((first + counts)[row] - np.arange(len(h)) >= window)
    if not len(starts):
        return None
    grams = sequence_hashes(h, k)
    at = _least(grams, window - k + 1)[starts]
    edge = sequence_hashes(h, window)[starts]
    doc = row[starts]
    new = np.r_[True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]
    head = np.flatnonzero(new)
    size = np.diff(np.r_[head, len(starts)])
    tail = head + size - 1
    anchor = grams[at[head]]
    anchor[anchor == 0] = 1
    seg = mix(edge[head] * np.uint64(3) + edge[tail] * np.uint64(5) + size.astype(np.uint64))
    doc = doc[head]
    same = doc[1:] == doc[:-1]
    zero = np.uint64(0)
    previous = np.r_[zero, np.where(same, anchor[:-1], zero)]
    following = np.r_[np.where(same, anchor[1:], zero), zero]
    data = np.ascontiguousarray(edge.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])
    offsets = np.r_[head, len(starts)].astype(np.int64) * 5
    windows = pa.Array.from_buffers(pa.large_binary(), len(head), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return doc, starts[head] - first[doc], size, anchor, seg, previous, following, windows


def _long(values):
    return pa.array(np.asarray(values).astype(np.uint64).view(np.int64))


def _anchor_rows(window, k):
    def run(batches):
        for batch in batches:
            for part in groups(batch):
                if found := segments(part.column(part.schema.get_field_index("text")), window, k):
                    yield pa.RecordBatch.from_arrays([_long(found[3]), _long(found[4])], ["anchor", "segment"])
    return run


def _occurrence_rows(window, k, bits, mask):
    def run(batches):
        have = bits.value
        for batch in batches:
            for part in groups(batch):
                found = segments(part.column(part.schema.get_field_index("text")), window, k)
                if not found:
                    continue
                row, start, size, anchor, seg, previous, following, windows = found
                keep = np.flatnonzero(has_bits(have, mask, anchor))
                ids = pa.array(row[keep])
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index("doc_id")).take(ids),
                     part.column(part.schema.get_field_index("_key")).take(ids),
                     pa.array(start[keep].astype(np.int32)), pa.array(size[keep].astype(np.int32)),
                     _long(anchor[keep]), _long(seg[keep]), _long(previous[keep]), _long(following[keep]),
                     windows.take(pa.array(keep)).cast(pa.binary())],
                    ["doc_id", "_key", "start", "size", "anchor", "segment", "previous", "following", "windows"])
    return run


def _paths(plain: DataFrame) -> DataFrame:
    """Compact plain segments into paths: ``(anchor, path, place, length)``.

    ``plain`` holds occurrences under plain anchors.  ``place`` is the distance
    in windows from the start of the path; ``length`` the windows of the path.
    """
    nodes = plain.groupBy("anchor").agg(
        F.min(F.struct("doc_id", "_key", "start")).alias("source"), F.first("size").alias("size"),
        F.min("previous").alias("p0"), F.max("previous").alias("p1"),
        F.min("following").alias("f0"), F.max("following").alias("f1"))
    nodes = written(nodes, "nodes")
    left = nodes.where("f0 = f1 and f0 <> 0").select(F.col("anchor").alias("_before"), F.col("f0").alias("anchor"))
    linked = nodes.where("p0 = p1 and p0 <> 0").join(left, "anchor").where("p0 = _before").select("anchor", F.lit(True).alias("_linked"))
    nodes = nodes.join(linked, "anchor", "left")
    # linked segments follow each other in the document of their first occurrence
    order = Window.partitionBy("source.doc_id", "source._key").orderBy("source.start")
    nodes = nodes.withColumn("_path", F.sum(F.when(F.col("_linked"), 0).otherwise(1)).over(order))
    whole = Window.partitionBy("source.doc_id", "source._key", "_path")
    return nodes.select(
        "anchor", (F.col("source.start") - F.min("source.start").over(whole)).cast("int").alias("place"),
        F.sum("size").over(whole).cast("int").alias("length"), "size")


def repeated_spans(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Spans of words covered by windows that occur again: ``(doc_id, _key, start, end)``.

    ``docs(doc_id, _key, text)``; spans may touch or overlap, the end is exclusive.
    """
    prepare(docs.sparkSession)
    texts = docs.select("doc_id", "_key", "text")
    anchors = (texts.select("text").mapInArrow(_anchor_rows(window, k), "anchor bigint, segment bigint")
               .groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("segment").alias("lo"), F.max("segment").alias("hi"))
               .where("n > 1").select("anchor", (F.col("lo") != F.col("hi")).alias("branching")))
    anchors = written(anchors, "anchors")
    bits, mask = bit_set(anchors, filter_bits)
    id_type = texts.schema["doc_id"].dataType.simpleString()
    found = texts.mapInArrow(
        _occurrence_rows(window, k, bits, mask),
        f"doc_id {id_type}, _key bigint, start int, size int, anchor bigint, segment bigint, "
        "previous bigint, following bigint, windows binary")
    # dealt out by anchor once; a hot anchor's rows are split by the adaptive skew join
    found = written(found.join(anchors, "anchor"), "segments")

    plain = found.where("not branching").drop("windows")
    paths = written(_paths(plain), "paths")
    heads = paths.where("place = 0").select("anchor", "length")
    tails = paths.where("place + size = length").select("anchor", F.col("length").alias("_length"), F.col("place").alias("_place"))
    at_head = plain.join(heads, "anchor").select("doc_id", "_key", "start", "length")
    # an occurrence of a path is verified where its last segment has to start
    at_tail = (plain.join(tails, "anchor")
               .select(F.col("doc_id").alias("_doc"), F.col("_key").alias("_k"),
                       (F.col("start") - F.col("_place")).alias("_start"), "_length"))
    whole = at_head.join(at_tail, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_k"))
                         & (F.col("start") == F.col("_start")) & (F.col("length") == F.col("_length")), "left_semi")
    spans = whole.select("doc_id", "_key", "start", (F.col("start") + F.col("length") + (window - 1)).alias("end"))

    # under branching anchors: every different segment once, its windows one by one
    branching = found.where("branching")
    kinds = branching.groupBy("anchor", "segment", "windows").agg(F.count(F.lit(1)).alias("copies"))
    fives = F.transform(F.sequence(F.lit(0), F.floor(F.length("windows") / 5) - 1),
                        lambda i: F.substr("windows", (i * 5 + 1).cast("int"), F.lit(5)))
    one = written(kinds.select("anchor", "segment", "copies", F.posexplode(fives).alias("j", "w")), "windows")
    again = one.groupBy("anchor", "w").agg(F.sum("copies").alias("n")).where("n > 1").select("anchor", "w")
    # written, so that the join below is of two plain shuffles and a hot segment's rows are split
    masks = written(one.join(again, ["anchor", "w"]).groupBy("anchor", "segment")
                    .agg(F.expr("bit_or(shiftleft(1L, j))").alias("mask")), "masks")
    runs = F.when(F.col("mask") == F.expr("shiftleft(1L, size) - 1"), F.array(F.struct(F.lit(0).alias("j"), F.col("size").alias("m")))) \
        .otherwise(F.transform(F.filter(F.sequence(F.lit(0), F.col("size") - 1), lambda j: F.getbit(F.col("mask"), j) == 1),
                               lambda j: F.struct(j.alias("j"), F.lit(1).alias("m"))))
    parts = branching.join(masks, ["anchor", "segment"]).select("doc_id", "_key", "start", F.explode(runs).alias("run"))
    loose = parts.select("doc_id", "_key", (F.col("start") + F.col("run.j")).alias("start"),
                         (F.col("start") + F.col("run.j") + F.col("run.m") + (window - 1)).alias("end"))
    return spans.unionByName(loose).distinct()


def _kept(batches):
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
        spans = batch.column(batch.schema.get_field_index("spans"))
        words, removed, digest, kept_text = [], [], [], []
        for text, cut in zip(texts, spans.to_pylist()):
            have = (text or b"").split()
            words.append(len(have))
            if cut:
                gone = np.zeros(len(have) + 1, np.int32)
                for s in cut:
                    gone[s["start"]] += 1
                    gone[s["end"]] -= 1
                gone = np.cumsum(gone[:-1]) > 0
                removed.append(int(gone.sum()))
                have = [w for w, g in zip(have, gone.tolist()) if not g]
            else:
                removed.append(0)
            joined = b" ".join(have)
            kept_text.append(joined)
            digest.append(hashlib.sha256(joined).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(batch.schema.get_field_index("doc_id")), pa.array(words, pa.int64()), pa.array(removed, pa.int64()),
             pa.array(digest), pa.array(kept_text, pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def without_repeats(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256, kept_text)``, one row per input row.

    A segment's windows are one long of bits: ``window`` has ``k`` words at least and ``k`` + 63 at most.
    """
    if not 1 <= k <= window <= k + 63:
        raise ValueError("a window has k to k + 63 words")
    texts = docs.select("doc_id", "text").withColumn("_key", F.xxhash64("doc_id", blank(F.col("text"))))
    spans = repeated_spans(texts, window, k)
    # adjacent window spans of a document merge before they are gathered
    order = Window.partitionBy("doc_id", "_key").orderBy("start", "end")
    merged = (spans.withColumn("_new", F.when(F.col("start") <= F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1))
              .withColumn("_run", F.sum("_new").over(order))
              .groupBy("doc_id", "_key", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
              .groupBy(F.col("doc_id").alias("_doc"), F.col("_key").alias("_k"))
              .agg(F.collect_list(F.struct("start", "end")).alias("spans")))
    joined = texts.join(merged, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_k")), "left")
    id_type = texts.schema["doc_id"].dataType.simpleString()
    return joined.select("doc_id", "text", "spans").mapInArrow(
        _kept, f"doc_id {id_type}, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string")
