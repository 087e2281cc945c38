"""Best-fit packing of token sequences by a grouping genetic algorithm.

Documents become ids of a byte-level BPE plus an end id and are cut into pieces
of at most ``capacity`` tokens (only documents longer than that; the first
piece takes the remainder).  Pieces of the full length are sequences of their
own.  The others are dealt at random over blocks of about ``block_items``.
Every block is evolved on ``islands`` islands: a chromosome is a grouping of the
block's pieces into bins, crossover injects whole well-filled bins of one
parent into the other, drops the bins that now hold a piece twice and best-fits
the displaced pieces.  After an epoch the elites of each island migrate to the
next one (a shuffle of groupings); the best grouping of a block wins.  Bins that
end up loosely filled are opened again over all blocks and packed once more.

Defined cases: null text is empty (one end id); repeated rows and null ids are
rows like any other (rows are told apart by an internal number); an empty table
gives an empty table; other input columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import prepare, written
from .words import groups, mix, word_hashes

CAPACITY = 1024
END_ID = 2
KNOWN = 1 << 20                     # words whose ids a worker remembers (about 40 bytes each)
SLICE = 1 << 20                     # bytes of text that are encoded together
PARTS = 1 << 17                     # young parts of words whose ids it remembers

# White space as the tokenizer's pattern knows it.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_EDGE = re.compile(f"^[{_WS}]|[{_WS}]$|^$")
# The tokenizer's pattern that splits text before merges (a fixed value).
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def _byte_characters() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest for U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Odd(Exception):
    """A word with white space at its edge: its ids depend on its neighbours."""


class _Known(dict):
    """text -> ids as little-endian bytes, learned on first sight.

    Holds ``size`` entries and as many older ones; when it is full the older
    half is forgotten, and an older entry that is met again is young again.
    """

    def __init__(self, encode, size: int):
        super().__init__()
        self._encode, self._size = encode, size
        self._older: dict[str, bytes] = {}

    def __missing__(self, text):
        ids = self._older.get(text)
        if ids is None:
            ids = self._encode(text)
        if len(self) >= self._size:
            self._older = dict(self)
            self.clear()
        self[text] = ids
        return ids


class Encoder:
    """Ids of whole texts, with a bounded memory of words.

    The tokenizer's pattern always cuts before a single space and around a
    single line feed that stand between other characters, so ids of the parts
    can be joined.  Any text where white space meets white space, or stands at an end, is encoded
    whole instead.

    A batch's words are hashed together, its distinct words are looked up in a sorted table of
    64-bit hashes, only unknown ones are encoded, and the ids of all words are put together by
    their offsets in one array.  When the table is over its bound, words not met again since
    the last time go (all go if too many were).
    """

    def __init__(self, path: str, known: int = KNOWN):
        import regex
        from tokenizers import Tokenizer
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        self._split = regex.compile(PATTERN).findall
        self._model = self._tokenizer.model
        self._characters = _byte_characters()
        self._space = self._characters[32]
        self._four = [i.to_bytes(4, "little") for i in range(self._tokenizer.get_vocab_size())]
        self._part = _Known(self._merge, PARTS)          # by part of the pattern
        self._known = known
        self._feed = np.frombuffer(self.whole("\n"), "<u4")
        self._empty()

    def _empty(self):
        self._keys = np.empty(0, np.uint64)              # sorted
        self._at, self._size = np.empty(0, np.int64), np.empty(0, np.int32)   # size -1: an odd word
        self._met = np.empty(0, bool)
        self._ids = self._feed.copy()                    # the line feed's ids, then the words'

    def whole(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _merge(self, part: str) -> bytes:
        if part.isascii() and part.isprintable():        # of these bytes only the space has a stand-in
            part = part.replace(" ", self._space)
        else:
            part = part.encode().decode("latin-1").translate(self._characters)
        four = self._four
        return b"".join([four[t.id] for t in self._model.tokenize(part)])

    def _word(self, lead: str, word: str) -> bytes:
        if word.isalpha() and word.isascii():            # one part, as are most words
            return self._part[lead + word]
        if _EDGE.search(word):
            raise _Odd
        return b"".join([self._part[p] for p in self._split(lead + word)])

    def _forget(self):
        keep = np.flatnonzero(self._met)
        if len(keep) > self._known // 2:
            return self._empty()
        size = np.maximum(self._size[keep], 0).astype(np.int64)
        to = np.cumsum(size) - size
        ids = self._ids[np.repeat(self._at[keep] - to, size) + np.arange(int(size.sum()))]
        self._keys, self._size = self._keys[keep], self._size[keep]
        self._at, self._met = to + len(self._feed), np.zeros(len(keep), bool)
        self._ids = np.concatenate([self._feed, ids])

    def _learn(self, keys: np.ndarray, words: list[tuple[str, str]]):
        """Adds words under their sorted keys."""
        found, size = [], np.empty(len(words), np.int32)
        for i, (lead, word) in enumerate(words):
            try:
                data = self._word(lead, word)
                found.append(data)
                size[i] = len(data) // 4
            except _Odd:
                size[i] = -1
        used = np.maximum(size, 0).astype(np.int64)
        at = np.cumsum(used) - used + len(self._ids)
        place = np.searchsorted(self._keys, keys)
        self._keys = np.insert(self._keys, place, keys)
        self._at, self._size = np.insert(self._at, place, at), np.insert(self._size, place, size)
        self._met = np.insert(self._met, place, False)
        self._ids = np.concatenate([self._ids, np.frombuffer(b"".join(found), "<u4")])

    def batch(self, column):
        """``(ids, ends, odd)`` of an Arrow string column: ids of all texts one after another, each text's end in
        them, and the texts that have to be encoded whole."""
        h, counts, s, e, data, offsets = word_hashes(column, spans=True)
        n = len(counts)
        odd = np.zeros(n, bool)
        white = np.flatnonzero((data == 32) | ((data >= 9) & (data <= 13)))
        here = np.searchsorted(offsets, white, side="right") - 1
        kind = data[white]
        odd[here[((kind != 32) & (kind != 10)) | (white == offsets[here]) | (white == offsets[here + 1] - 1)]] = True
        odd[here[1:][(white[1:] == white[:-1] + 1) & (here[1:] == here[:-1])]] = True
        feeds = white[kind == 10]
        doc = np.repeat(np.arange(n), counts)
        first = (s == offsets[doc]) | (data[np.maximum(s - 1, 0)] == 10)
        key, at, word = np.unique(mix(h ^ np.where(first, np.uint64(0), np.uint64(0x5851F42D4C957F2D))), return_index=True, return_inverse=True)
        if len(self._keys) > self._known:
            self._forget()
        place = np.searchsorted(self._keys, key)
        have = np.zeros(len(key), bool)
        inside = place < len(self._keys)
        have[inside] = self._keys[place[inside]] == key[inside]
        if not have.all():
            new = at[~have]
            self._learn(key[~have], [("" if f else " ", data[a:z].tobytes().decode()) for f, a, z in zip(first[new], s[new].tolist(), e[new].tolist())])
            place = np.searchsorted(self._keys, key)
        self._met[place[have]] = True
        size, start = self._size[place][word].astype(np.int64), self._at[place][word]
        odd[doc[size < 0]] = True
        # words and line feeds in text order
        order = np.argsort(np.concatenate([s, feeds]), kind="stable")
        size = np.concatenate([np.maximum(size, 0), np.full(len(feeds), len(self._feed))])[order]
        start = np.concatenate([start, np.zeros(len(feeds), np.int64)])[order]
        owner = np.concatenate([doc, here[kind == 10]])[order]
        to = np.cumsum(size) - size
        ids = self._ids[np.repeat(start - to, size) + np.arange(int(size.sum()))]
        return ids, np.cumsum(np.bincount(owner, weights=size, minlength=n).astype(np.int64)), odd

    def texts(self, column):
        """The ids of every text of an Arrow string column (null: none)."""
        ids, ends, odd = self.batch(column)
        lo = 0
        for i, hi in enumerate(ends.tolist()):
            yield np.frombuffer(self.whole(column[i].as_py()), "<u4") if odd[i] else ids[lo:hi]
            lo = hi

    def __call__(self, text: str | None) -> bytes:
        return next(self.texts(pa.array([text], pa.string()))).tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of a document with ``n`` ids."""
    first = n % capacity or capacity
    if n <= capacity:
        return [(0, n)]
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``, one row per piece."""
    prepare(docs.sparkSession)
    narrow = docs.select("doc_id", "text")
    id_type = narrow.schema["doc_id"].dataType.simpleString()
    end = np.array([END_ID], "<u4")

    def pieces(batches):
        encode = encoder(tokenizer_path)
        for batch in (part for whole in batches for part in groups(whole, SLICE)):
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, found in enumerate(encode.texts(batch.column(1))):
                data = np.concatenate([found, end])
                for i, (s, n) in enumerate(cut(len(data), capacity)):
                    part = data[s:s + n]
                    rows.append(row), piece.append(i), start.append(s), length.append(n)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part.tobytes())
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                       pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return narrow.mapInArrow(pieces, schema + (", ids binary" if with_ids else ""))


# ---- the genetic algorithm on one block ---------------------------------------------------

def best_fit(order, lengths, bins, fills, capacity) -> None:
    """Put the items of ``order`` into the fullest bin with room (``bins``: item -> bin, in place)."""
    room: dict[int, list[int]] = {}
    mask = 0
    for b, f in enumerate(fills):
        r = capacity - f
        if r:
            room.setdefault(r, []).append(b)
            mask |= 1 << r
    for item in order:
        size = lengths[item]
        fits = mask >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask &= ~(1 << r)
            fills[b] += size
            r -= size
        else:
            b, r = len(fills), capacity - size
            fills.append(size)
        if r:
            room.setdefault(r, []).append(b)
            mask |= 1 << r
        bins[item] = b


def _dense(bins):
    """Bins renumbered without gaps."""
    return np.unique(bins, return_inverse=True)[1]


def _fitness(bins, lengths, capacity) -> float:
    """Mean squared filling of the bins; fewer and fuller bins are better."""
    fills = np.bincount(bins, weights=lengths)
    return float(np.mean((fills / capacity) ** 2))


def _refill(bins, free, lengths, capacity, rng):
    """Renumber the bins of the items that are not ``free`` and best-fit the free ones."""
    out = np.full(len(bins), -1, np.int64)
    kept = ~free
    out[kept] = _dense(bins[kept])
    fills = np.bincount(out[kept], weights=lengths[kept]).astype(int).tolist() if kept.any() else []
    order = np.flatnonzero(free)
    order = order[np.lexsort((rng.random(len(order)), -lengths[order]))]
    placed = out.tolist()
    best_fit(order.tolist(), lengths.tolist(), placed, fills, capacity)
    return np.array(placed, np.int64)


def _child(a, b, lengths, capacity, rng):
    """Well-filled bins of ``a`` injected into ``b``."""
    fill = np.bincount(a, weights=lengths)
    good = fill >= np.median(fill)
    inject = good & (rng.random(len(fill)) < 0.5)
    injected = inject[a]
    hit = np.zeros(b.max() + 1, bool)
    hit[b[injected]] = True
    free = hit[b] & ~injected
    merged = np.where(injected, a, b + len(fill))
    return _refill(merged, free, lengths, capacity, rng)


def _mutant(a, lengths, capacity, rng):
    """The loosest bins and a few others opened and best-fitted again."""
    fill = np.bincount(a, weights=lengths)
    opened = rng.random(len(fill)) < 0.05
    opened[np.argsort(fill)[:max(2, len(fill) // 50)]] = True
    return _refill(a, opened[a], lengths, capacity, rng)


def _start(lengths, capacity, rng, sort):
    """Best fit of all items: by falling length, or in random order."""
    key = -lengths.astype(float) + (0 if sort else rng.random(len(lengths)) * capacity)
    bins = [-1] * len(lengths)
    best_fit(np.argsort(key, kind="stable").tolist(), lengths.tolist(), bins, [], capacity)
    return np.array(bins, np.int64)


def evolve(lengths, population, capacity, rng, size: int, generations: int):
    """The population after ``generations``, best first; stops at the lower bound."""
    population = list(population)
    while len(population) < size:
        population.append(_start(lengths, capacity, rng, sort=not population))
    least = math.ceil(lengths.sum() / capacity)
    scored = sorted(((_fitness(p, lengths, capacity), i, p) for i, p in enumerate(population)), key=lambda x: (-x[0], x[1]))
    for g in range(generations):
        if scored[0][2].max() + 1 <= least:
            break
        half = max(2, size // 2)
        i, j = rng.integers(0, half), rng.integers(0, len(scored))
        young = [_child(scored[i][2], scored[j][2], lengths, capacity, rng),
                 _child(scored[j][2], scored[i][2], lengths, capacity, rng),
                 _mutant(scored[0][2], lengths, capacity, rng)]
        scored += [(_fitness(p, lengths, capacity), size + 3 * g + n, p) for n, p in enumerate(young)]
        scored = sorted(scored, key=lambda x: (-x[0], x[1]))[:size]
    return [p for _, _, p in scored]


# ---- islands on Spark --------------------------------------------------------------------------

_ISLAND = "block bigint, island int, elite int, fitness double, items binary, lengths binary, bins binary"


def _block_number(row, blocks: int, seed: int):
    return F.pmod(F.xxhash64(row, F.lit(seed)), F.lit(blocks))


def _pack_blocks(items: DataFrame, n: int, capacity: int, block_items: int, islands: int,
                 population: int, generations: int, elites: int, level: int) -> DataFrame:
    """``items(_row, length)`` -> ``(_row, sequence_id, offset, fill)``."""
    blocks = max(1, math.ceil(n / block_items))
    dealt = items.withColumn("block", _block_number(F.col("_row"), blocks, level))

    def first(key, pdf):
        block = int(key[0])
        pdf = pdf.sort_values("_row")                    # the same block after a retry gives the same bins
        rows, lengths = pdf["_row"].to_numpy(np.int64), pdf["length"].to_numpy(np.int64)
        out = []
        for island in range(islands):
            rng = np.random.default_rng([level, block, island])
            pop = evolve(lengths, [], capacity, rng, population, generations)
            out += [(block, island, e, _fitness(p, lengths, capacity), rows.tobytes(), lengths.tobytes(),
                     p.astype(np.int32).tobytes()) for e, p in enumerate(pop[:elites])]
        return pd.DataFrame(out, columns=["block", "island", "elite", "fitness", "items", "lengths", "bins"])

    def later(key, pdf):
        block, island = int(key[0]), int(key[1])
        pdf = pdf.sort_values(["fitness", "elite"], ascending=[False, True])
        rows = np.frombuffer(pdf["items"].iloc[0], np.int64)
        lengths = np.frombuffer(pdf["lengths"].iloc[0], np.int64)
        rng = np.random.default_rng([level, block, island, 1])
        pop = evolve(lengths, [np.frombuffer(b, np.int32).astype(np.int64) for b in pdf["bins"]],
                     capacity, rng, max(population, len(pdf)), generations)
        best = pop[0]
        return pd.DataFrame([(block, island, 0, _fitness(best, lengths, capacity), rows.tobytes(), lengths.tobytes(),
                              best.astype(np.int32).tobytes())],
                            columns=["block", "island", "elite", "fitness", "items", "lengths", "bins"])

    grown = dealt.groupBy("block").applyInPandas(first, _ISLAND)
    # elites stay at home and also reach the next island
    moved = grown.withColumn("island", F.explode(F.array("island", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int"))))
    final = moved.groupBy("block", "island").applyInPandas(later, _ISLAND)
    best = final.groupBy("block").agg(F.max_by(F.struct("items", "lengths", "bins"),
                                               F.struct("fitness", -F.col("island"))).alias("best"))

    def spread(batches):
        for batch in batches:
            for block, best in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = np.frombuffer(best["items"], np.int64)
                lengths = np.frombuffer(best["lengths"], np.int64)
                bins = np.frombuffer(best["bins"], np.int32).astype(np.int64)
                order = np.lexsort((rows, bins))
                n, b = lengths[order], bins[order]
                total = np.cumsum(n) - n
                head = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
                offset = total - np.repeat(total[head], np.diff(np.r_[head, len(b)]))
                fill = np.bincount(bins, weights=lengths).astype(np.int64)[b]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[order]), pa.array(((block << 24) | b) * 4 + level), pa.array(offset), pa.array(fill)],
                    ["_row", "sequence_id", "offset", "fill"])

    return best.mapInArrow(spread, "_row bigint, sequence_id bigint, offset bigint, fill bigint")


def pack(pieces: DataFrame, capacity: int = CAPACITY, block_items: int = 4096, islands: int = 2,
         population: int = 6, generations: int = 12, elites: int = 2, loose: float = 0.995) -> DataFrame:
    """``pieces(.., length)`` with ``sequence_id`` and ``offset``: every sequence holds at most ``capacity``.

    Memory of a task is bounded by a block of about ``block_items`` lengths.
    """
    spark = pieces.sparkSession
    pieces = written(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    short = pieces.where(F.col("length") < capacity).select("_row", "length")
    n = short.count()
    packed = written(_pack_blocks(short, n, capacity, block_items, islands, population, generations, elites, 1), "packed")
    tight = packed.where(F.col("fill") >= loose * capacity).select("_row", "sequence_id", "offset")
    rest = packed.where(F.col("fill") < loose * capacity).select("_row").join(short, "_row")
    m = packed.where(F.col("fill") < loose * capacity).count()
    again = _pack_blocks(rest, m, capacity, block_items, islands, population, generations, elites, 2)
    full = pieces.where(F.col("length") >= capacity).select("_row", (-1 - F.col("_row")).alias("sequence_id"),
                                                            F.lit(0).cast("long").alias("offset"))
    places = full.unionByName(tight).unionByName(again.select("_row", "sequence_id", "offset"))
    return pieces.join(places, "_row").drop("_row")
