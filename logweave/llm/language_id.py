"""Language identification with error-correcting output codes.

Every learned language has a codeword of +1 and -1.  For every bit a binary
classifier over hashed 4-byte sequences of the folded text (lower case, anything
but letters as spaces) tells the languages with +1 from those with -1: its
weights are log ratios of the two sides' mean sequence frequencies, counted
over all training documents.  A text's bit value is the squashed sum of its
weights.  Decoding is loss-weighted: the codeword with the least exponential
loss wins, each bit weighted by how often it was right for that language on a
bounded sample of training documents.  ``ambiguous`` tells that the runner-up is
close.

Up to ``EXHAUSTIVE`` languages get the exhaustive code, more of them a seeded
random one whose length grows with their number.

Defined cases: null text, or text without a letter, is ``und`` with score 0; so
is everything if nothing could be learned.  With one language, that one is
predicted.  Null languages are not learned from.  Rows are judged one by one;
other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import prepare
from .words import flat, groups

GRAM_BITS = 16
EXHAUSTIVE = 6
SAMPLE = 2000                       # training documents per language that weigh the bits
CLOSE = 0.25                        # runner-up's loss within this of the best: ambiguous
_BLOCK = 1 << 17

_rng = np.random.default_rng(11)
_MULTIPLY = (_rng.integers(0, 1 << 31, 4, dtype=np.uint32) * np.uint32(2) + np.uint32(1))
_BYTE = _rng.integers(0, 1 << 32, 256, dtype=np.uint32)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
for _c in range(97, 123):
    _FOLD[_c] = _FOLD[_c - 32] = _c


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """``n`` rows of +1 / -1, all different, no constant column."""
    if n < 2:
        return np.ones((n, 0), np.int8)
    if n <= EXHAUSTIVE:
        bits = (np.arange(1, 1 << (n - 1))[None, :] >> np.arange(n)[:, None]) & 1   # last row is all zero
        return np.where(bits == 1, 1, -1).astype(np.int8)
    rng = np.random.default_rng(seed)
    length = int(np.ceil(10 * np.log2(n)))
    best, apart = None, -1
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.int8), (n, length))
        if (np.abs(code.sum(axis=0)) == n).any():
            continue
        least = int((((code.astype(int) @ code.T) - length) // -2 + np.eye(n, dtype=int) * length).min())
        if least > apart:
            best, apart = code, least
    return best


def _grams(data: np.ndarray, offsets: np.ndarray):
    """Blocks of ``(hashed sequence, text number)`` over the flat bytes of padded texts."""
    ends = offsets[1:]
    for lo in range(0, max(len(data) - 3, 0), _BLOCK):
        b = data[lo:lo + _BLOCK + 3]
        f = _FOLD[b]
        upper = np.flatnonzero((b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97) & (b[:-1] == 0xC3)) + 1
        f[upper] += 32                                    # the upper case letters of U+00C0 to U+00DE
        t = _BYTE[f]
        n = len(b) - 3
        h = t[:n] * _MULTIPLY[0]
        for j in range(1, 4):
            h += t[j:j + n] * _MULTIPLY[j]
        gram = h >> np.uint32(32 - GRAM_BITS)
        at = np.arange(lo, lo + n)
        first, last = np.searchsorted(ends, [lo, lo + n - 1], side="right")
        text = np.repeat(np.arange(first, last + 1),
                         np.diff(np.r_[lo, np.minimum(ends[first:last], lo + n), lo + n]))
        ok = (at + 3 < ends[text]) & ~((f[:n] == 32) & (f[1:n + 1] == 32))
        yield gram[ok], text[ok]


def _count(batches):
    """``(lang, gram, n)`` of a task's training documents."""
    counts: dict[str, np.ndarray] = {}

    def out():
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])],
                                             ["lang", "gram", "n"])
        counts.clear()

    for batch in batches:
        for part in groups(batch):
            langs = part.column(part.schema.get_field_index("lang")).to_pylist()
            data, offsets = flat(part.column(part.schema.get_field_index("text")))
            names = sorted(set(langs))
            number = np.array([names.index(x) for x in langs])
            for gram, text in _grams(data, offsets):
                both = np.bincount(number[text] * (1 << GRAM_BITS) + gram, minlength=len(names) << GRAM_BITS)
                for i, name in enumerate(names):
                    own = both[i << GRAM_BITS:(i + 1) << GRAM_BITS].astype(np.int64)
                    counts[name] = counts[name] + own if name in counts else own
        if len(counts) > 64:                              # bounded memory, whatever the column holds
            yield from out()
    yield from out()


def bit_values(column, weights: np.ndarray) -> np.ndarray:
    """Squashed sum of every bit's weights per text."""
    data, offsets = flat(column)
    total = np.zeros((len(offsets) - 1, weights.shape[1]))
    n = np.zeros(len(offsets) - 1)
    for gram, text in _grams(data, offsets):
        if len(text):
            head = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
            total[text[head]] += np.add.reduceat(weights[gram], head, axis=0)
            n[text[head]] += np.diff(np.r_[head, len(text)])
    return np.tanh(total / np.sqrt(np.maximum(n, 1))[:, None])


def decode(values: np.ndarray, code: np.ndarray, weight: np.ndarray):
    """``(language number, score, ambiguous)`` by the least weighted exponential loss."""
    loss = (weight[None] * np.exp(-code[None] * values[:, None, :])).sum(axis=2)
    best = loss.argmin(axis=1)
    rows = np.arange(len(values))
    p = np.exp(-4 * (loss - loss.min(axis=1, keepdims=True)))
    p /= p.sum(axis=1, keepdims=True)
    if loss.shape[1] > 1:
        two = np.partition(loss, 1, axis=1)
        close = two[:, 1] - two[:, 0] < CLOSE
    else:
        close = np.zeros(len(values), bool)
    return best, p[rows, best], close


def _padded(text):
    return F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit("  "))


class LanguageModel:
    """Languages, codewords, weights of the bit classifiers and of the bits."""

    def __init__(self, languages, code, weights, reliability):
        self.languages, self.code, self.weights, self.reliability = languages, code, weights, reliability


def learn(train: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """Fit on all rows of ``train(text, lang)`` with a language; memory grows with the languages only."""
    prepare(train.sparkSession)
    # the sample below is drawn by id and text: a text that many documents share is not all in or all out
    dice = F.pmod(F.xxhash64(*(c for c in ("doc_id", "text") if c in train.columns)), F.lit(1_000_000))
    train = train.where(F.col("lang").isNotNull()).select(_padded(F.col("text")).alias("text"), "lang", dice.alias("_dice"))
    counted = train.select("text", "lang").mapInArrow(_count, "lang string, gram int, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = counted.toArrow()                             # at most 2 ** GRAM_BITS rows per language
    languages = sorted(set(table["lang"].to_pylist()))
    number = {x: i for i, x in enumerate(languages)}
    freq = np.zeros((len(languages), 1 << GRAM_BITS))
    freq[[number[x] for x in table["lang"].to_pylist()], table["gram"].to_numpy()] = table["n"].to_numpy()
    freq = (freq + 0.5) / (freq + 0.5).sum(axis=1, keepdims=True)
    code = codewords(len(languages))
    weights = np.zeros((1 << GRAM_BITS, code.shape[1]), np.float32)
    for b in range(code.shape[1]):
        weights[:, b] = np.log(freq[code[:, b] > 0].mean(axis=0) / freq[code[:, b] < 0].mean(axis=0))
    reliability = np.ones(code.shape)
    if len(languages) > 1:
        sizes = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}
        share = F.lit(0.0)
        for x, n in sizes.items():
            share = F.when(F.col("lang") == x, F.lit(min(1.0, sample / n))).otherwise(share)
        some = train.where(F.col("_dice") < share * 1_000_000).select("text", "lang")
        shared = train.sparkSession.sparkContext.broadcast((weights, code, number))

        def right(batches):
            weights, code, number = shared.value
            for batch in batches:
                for part in groups(batch):
                    at = np.array([number[x] for x in part.column(part.schema.get_field_index("lang")).to_pylist()])
                    hit = bit_values(part.column(part.schema.get_field_index("text")), weights) * code[at] > 0
                    for i in np.unique(at):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(code.shape[1], i, np.int32)), pa.array(np.arange(code.shape[1], dtype=np.int32)),
                             pa.array(hit[at == i].sum(axis=0).astype(np.int64))], ["l", "b", "hits"])

        hits = some.mapInArrow(right, "l int, b int, hits bigint").groupBy("l", "b").agg(F.sum("hits").alias("hits")).collect()
        for r in hits:
            reliability[r["l"], r["b"]] = r["hits"] + 1
        reliability /= reliability.sum(axis=1, keepdims=True)
    return LanguageModel(languages, code, weights, reliability)


def identify(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of ``docs`` and ``lang_pred, score, ambiguous``; one row per input row."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    narrow = docs.select(*[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)],
                         letters.alias("_letters"), _padded(F.col("text")).alias("text"))
    kinds = [docs.schema[c].dataType.simpleString() for c in keep]

    def judge(batches):
        m = shared.value
        names = np.array([*m.languages, "und"], dtype=object)
        for batch in batches:
            for part in groups(batch):
                known = part.column(len(keep)).to_numpy(zero_copy_only=False).astype(bool) & bool(m.languages)
                if m.code.shape[1]:
                    best, score, close = decode(bit_values(part.column(len(keep) + 1), m.weights), m.code, m.reliability)
                else:
                    best, score, close = np.zeros(len(known), int), np.ones(len(known)), np.zeros(len(known), bool)
                best = np.where(known, best, len(m.languages))
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(keep))]
                    + [pa.array(names[best].tolist(), pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(known & close)],
                    [f"_keep{i}" for i in range(len(keep))] + ["lang_pred", "score", "ambiguous"])

    schema = ", ".join([f"_keep{i} {k}" for i, k in enumerate(kinds)] + ["lang_pred string, score double, ambiguous boolean"])
    out = narrow.mapInArrow(judge, schema)
    return out.select(*[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score", "ambiguous")
