"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad.  A line's features (shape of its characters and
words, repeated words, repeated lines) and those of its neighbours feed the
state scores; transitions tie adjacent lines.  Lines of labelled training
documents carry their document's label; the field is fitted by gradient ascent
on a bounded sample of them.  A document's score is the mean of the
forward-backward marginals of "good", weighted by line length.

Defined cases: null or empty text is one empty line; a document with several
labels takes their mean; null labels are left out; without both labels in the
training rows the score is the share of good ones (1/2 without any).  Rows are
judged one by one; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import prepare
from .words import flat, groups, mix, word_hashes

SAMPLE = 3000                       # training documents per label
STEPS = 200

_CLASSES = 7
_CLASS = np.zeros(256, np.uint8)    # 0: other
_CLASS[65:91] = 1                   # upper case
_CLASS[97:123] = 2                  # lower case
_CLASS[48:58] = 3
_CLASS[[ord(c) for c in "#*$%&|<>~^_=+{}[]\\@"]] = 4
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 5
_CLASS[[9, 10, 11, 12, 13, 32]] = 6


def line_features(column):
    """``(features of every line, line lengths, lines per text)`` of an Arrow column."""
    data, offsets = flat(column)
    feed = np.flatnonzero(data == 10)
    n_docs = len(offsets) - 1
    per = np.diff(np.searchsorted(feed, offsets)) + 1                    # lines per text
    first = np.cumsum(per) - per
    starts = np.empty(per.sum(), np.int64)
    ends = np.empty(per.sum(), np.int64)
    is_first = np.zeros(len(starts), bool)
    is_first[first] = True
    starts[is_first] = offsets[:-1]
    starts[~is_first] = feed + 1
    is_last = np.zeros(len(starts), bool)
    is_last[first + per - 1] = True
    ends[is_last] = offsets[1:]
    ends[~is_last] = feed
    size = ends - starts

    kinds = _CLASS[data]
    share = np.zeros((len(starts), _CLASSES))
    line_of = np.searchsorted(starts, np.arange(0, len(data) + 1, 1 << 20), side="right")
    for i, lo in enumerate(range(0, len(data), 1 << 20)):               # blocks keep the counters small
        hi = min(lo + (1 << 20), len(data))
        a = max(int(line_of[i]) - 1, 0)
        z = int(np.searchsorted(starts, hi))
        s, e = np.clip(starts[a:z], lo, hi) - lo, np.clip(ends[a:z], lo, hi) - lo
        for c in range(_CLASSES):
            run = np.concatenate(([0], np.cumsum(kinds[lo:hi] == c, dtype=np.int32)))
            share[a:z, c] += run[e] - run[s]

    h, _, ws, _, _, _ = word_hashes(column, spans=True)
    line = np.searchsorted(starts, ws, side="right") - 1
    words = np.bincount(line, minlength=len(starts)).astype(float)
    def count(mask, at):
        return np.bincount(line[at:][mask], minlength=len(starts)) if len(h) > at else np.zeros(len(starts))
    twin = count((h[1:] == h[:-1]) & (line[1:] == line[:-1]), 1)         # a word twice in a row
    exclaim = _per_line(data, starts, ends, ord("!"))
    bars = _per_line(data, starts, ends, ord("|"))
    # words of a pair that the same text has had before
    doc = np.searchsorted(offsets, ws, side="right") - 1
    pair = mix(h[1:] * np.uint64(3) + h[:-1]) ^ mix(doc[1:].astype(np.uint64)) if len(h) > 1 else np.empty(0, np.uint64)
    seen = np.zeros(len(pair), bool)
    if len(pair):
        order = np.argsort(pair, kind="stable")
        same = pair[order][1:] == pair[order][:-1]
        seen[order[1:][same]] = True
    again = count(seen, 1)
    # a line equal to an earlier one of its text
    total = np.zeros(len(starts), np.uint64)
    np.add.at(total, line, mix(h + (np.arange(len(h)) - np.searchsorted(line, line)).astype(np.uint64)))
    key = mix(total) ^ mix(np.repeat(np.arange(n_docs), per).astype(np.uint64))
    order = np.argsort(key, kind="stable")
    twice = np.zeros(len(starts), bool)
    twice[order[1:][key[order][1:] == key[order][:-1]]] = True
    twice &= words > 0

    chars = np.maximum(size, 1)[:, None]
    w = np.maximum(words, 1)
    letters = np.maximum(share[:, 1] + share[:, 2], 1)
    f = np.column_stack([
        np.ones(len(starts)), np.log1p(size) / 5, np.log1p(words) / 4, share / chars,
        share[:, 1] / letters, share[:, 4] / w, exclaim / w, bars / w, twin / w, again / w, twice,
        size / w / 10, words == 0])
    left = np.zeros_like(f)
    left[1:] = f[:-1]
    left[is_first] = 0
    right = np.zeros_like(f)
    right[:-1] = f[1:]
    right[is_last] = 0
    wide = np.column_stack([f, left[:, 3:], right[:, 3:], is_first, is_last])
    return np.minimum(wide, 4.0), size + 1, per


def _per_line(data, starts, ends, byte):
    at = np.flatnonzero(data == byte)
    return np.searchsorted(at, ends) - np.searchsorted(at, starts)


def marginals(score, per, transition):
    """``(P(good) of every line, pair marginals summed, log partition)`` for chains of ``per`` lines.

    ``score``: log potential of good against bad; ``transition``: 2 x 2 log potentials.
    Chains step together, the longest first, so a step costs one small array operation.
    """
    order = np.argsort(-per, kind="stable")
    first = (np.cumsum(per) - per)[order]
    size = per[order]
    longest = int(size[0]) if len(size) else 0
    t = np.exp(transition - transition.max())
    p = 1 / (1 + np.exp(-score))
    emit = np.column_stack([1 - p, p]) + 1e-12
    forward = np.empty((len(score), 2))
    scale = np.empty(len(score))
    live = np.searchsorted(-size, -np.arange(longest), side="left")     # chains longer than step
    for s in range(longest):
        at = first[:live[s]] + s
        a = emit[at] if s == 0 else (forward[at - 1] @ t) * emit[at]
        z = a.sum(axis=1)
        forward[at], scale[at] = a / z[:, None], z
    backward = np.ones((len(score), 2))
    pair = np.zeros((2, 2))
    for s in range(longest - 2, -1, -1):
        at = first[:live[s + 1]] + s
        nxt = emit[at + 1] * backward[at + 1] / scale[at + 1][:, None]
        pair += t * (forward[at].T @ nxt)
        backward[at] = nxt @ t.T
    both = forward * backward
    return both[:, 1] / both.sum(axis=1), pair


class QualityModel:
    """Weights of the line features and of the transitions."""

    def __init__(self, weights, transition, centre, spread, prior):
        self.weights, self.transition, self.centre, self.spread, self.prior = weights, transition, centre, spread, prior

    def score(self, column) -> np.ndarray:
        """Length-weighted mean marginal of "good" of every text."""
        x, size, per = line_features(column)
        if self.weights is None:
            return np.full(len(per), self.prior)
        good, _ = marginals(((x - self.centre) / self.spread) @ self.weights, per, self.transition)
        first = np.cumsum(per) - per
        if not len(per):
            return np.empty(0)
        return np.clip(np.add.reduceat(good * size, first) / np.add.reduceat(size, first), 0, 1)


def fit(x, per, label, weight, steps: int = STEPS, ridge: float = 1e-3) -> QualityModel:
    """Gradient ascent (Adam) on the weighted conditional log-likelihood of the line labels."""
    prior = float((label * weight).sum() / weight.sum()) if len(label) else 0.5
    if len(set(label.tolist())) < 2:
        return QualityModel(None, None, None, None, prior)
    centre, spread = x.mean(axis=0), x.std(axis=0) + 1e-3
    centre[0], spread[0] = 0, 1
    x = (x - centre) / spread
    y = np.repeat(label, per).astype(float)
    w = np.repeat(weight / per, per)                                    # every document counts alike
    w /= w.sum()
    # pairs of adjacent lines have equal labels
    links = np.array([[float((w[np.repeat(per, per) > 1] * (1 - y[np.repeat(per, per) > 1])).sum()), 0.0], [0.0, float((w[np.repeat(per, per) > 1] * y[np.repeat(per, per) > 1]).sum())]])
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        transition = theta[-4:].reshape(2, 2)
        good, pair = marginals(x @ theta[:-4], per, transition)
        expected = pair / max(pair.sum(), 1e-12) * links.sum()
        slope = np.r_[x.T @ (w * (y - good)), (links - expected).ravel()] - ridge * theta
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope ** 2
        theta += 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        theta[-4:] = np.clip(theta[-4:], -2, 2)                         # neighbours inform, they don't decide
    return QualityModel(theta[:-4], theta[-4:].reshape(2, 2), centre, spread, prior)


def _features(batches):
    for batch in batches:
        for part in groups(batch):
            x, _, per = line_features(part.column(part.schema.get_field_index("text")))
            first = np.cumsum(per) - per
            rows = [x[a:a + n].astype(np.float32).tobytes() for a, n in zip(first, per)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(rows, pa.binary())], ["y", "w", "x"])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """Fit on at most about ``sample`` documents per label: ``docs(doc_id, text)``, ``labels(doc_id, quality)``."""
    prepare(docs.sparkSession)
    marks = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y")))
    sizes = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    share = F.lit(1.0)
    for y, n in sizes.items():
        share = F.when(F.col("y") == y, F.lit(min(1.0, sample / n))).otherwise(share)
    some = (marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
            .select("doc_id", "y", (1 / share).alias("w")))
    # the sample is bounded by its parameter, so it can be sent to every task
    rows = (docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
            .select("y", "w", "text").mapInArrow(_features, "y int, w double, x binary").toArrow())
    if not rows.num_rows:
        return QualityModel(None, None, None, None, 0.5)
    xs = rows["x"].to_pylist()
    width = line_features(pa.array([""]))[0].shape[1]
    x = np.frombuffer(b"".join(xs), np.float32).reshape(-1, width).astype(float)
    per = np.array([len(b) // (4 * width) for b in xs])
    return fit(x, per, rows["y"].to_numpy(), rows["w"].to_numpy())


def scored(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``(doc_id, score)``, one row per input row."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        for batch in batches:
            for part in groups(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.score(part.column(1)))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(judge, f"doc_id {kind}, score double")
