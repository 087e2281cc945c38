"""Near-duplicate groups with b-bit MinHash, confirmed on whole shingle sets.

A document's set holds its distinct shingles of ``words`` lower-cased words.
Equal sets form one class, so copies cost one signature.  128 minima per class
give 32 band keys of 4 full minima each, and a signature of 4 hashed bits of
every minimum, packed into eight longs.

Classes that share a band key meet in a bucket.  A bucket is worked through in
stars, not in all pairs: its members are paired with one leader, first its most
central class, in the next rounds one that hashing picks.  A pair is kept when
the bit count of its signatures, corrected for chance matches of 4-bit values,
is not clearly under the threshold, and becomes a link when the Jaccard
similarity of the whole sets reaches it.  Pairs inside one component need no
test, so each round leaves less.  For what the buckets of several components then
hold, shared shingles give an exact bound: classes x and y of different components
share at most the r shingles of x, and of y, that occur in another component at
all, and a link needs (100 + p) shared >= p (n_x + n_y).  So x fits sets of up to
(100 + p) r / p - n_x shingles only.  A class that fits none in its bucket is left out, which are
the variants of one text that are too far from it and the texts that share just a passage; the
others outside the bucket's most common component are tested against the members
of other components that fit and that a longer signature (1024 minima, 2 bits) finds likely.

Bands miss a pair at the threshold with probability (1 - 0.75^4)^32 < 1e-5, and
less above it; the signature filter with less than 1e-5 (4.2e-6 at the threshold
for independent matches).

Defined cases: null text, or text without words, has an empty set and stands
alone; fewer words than a shingle make one shingle of all words; repeated rows
are members of one class; a null id is never the id of a component unless all
ids of it are null; other columns are ignored; empty tables stay empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitset import bit_set, has_bits
from .components import components
from .shared import prepare, written
from .words import groups, mix, sequence_hashes, word_hashes

WORDS, PERCENT = 5, 75
PERMUTATIONS, BAND_ROWS, LOW_BITS = 128, 4, 4
BANDS = PERMUTATIONS // BAND_ROWS
LONGS = PERMUTATIONS * LOW_BITS // 64
FILTER_BITS = 25
ROUNDS = 1
FINE, FINE_BITS = 1024, 2           # signature of the classes that stars leave open
FINE_MARGIN = 0.075                  # 4.6 standard deviations of its estimate at the threshold

_rng = np.random.default_rng(7)
_FACTOR = _rng.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFT = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)
_FINE_FACTOR = _rng.integers(0, 1 << 31, FINE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_FINE_SHIFT = _rng.integers(0, 1 << 32, FINE, dtype=np.uint32)


def shingle_sets(column, words: int = WORDS):
    """Sorted distinct 64-bit shingles of every text of an Arrow column."""
    h, counts = word_hashes(column, lower=True)
    grams = sequence_hashes(h, words)
    at = 0
    for n in counts.tolist():
        if n >= words:
            yield np.unique(grams[at:at + n - words + 1])
        elif n:
            yield mix(sequence_hashes(h[at:at + n], n) + np.uint64(n))
        else:
            yield np.empty(0, np.uint64)
        at += n


def minima(shingles: np.ndarray, factor=_FACTOR, shift=_SHIFT) -> np.ndarray:
    """The least value of every permutation over a set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(factor), 0xFFFFFFFF, np.uint32)
    step = max(1, (1 << 17) // len(factor))
    for lo in range(0, len(x), step):
        np.minimum(least, (factor[:, None] * x[None, lo:lo + step] + shift[:, None]).min(axis=1), out=least)
    return least


def packed(least: np.ndarray, bits: int) -> np.ndarray:
    """``bits`` of a hash of every minimum of every row, packed into longs.

    The minimum's own low bits would not do: whether two values of one affine
    permutation agree in them depends on the shingles' low bits alone, so chance
    matches of all permutations would come together.  The hash takes the
    permutation's number too.
    """
    hashed = mix(least.astype(np.uint64) | (np.arange(least.shape[1], dtype=np.uint64) << np.uint64(32)))
    low = (hashed >> np.uint64(64 - bits)).reshape(len(least), -1, 64 // bits)
    place = (np.arange(64 // bits) * bits).astype(np.uint64)
    return np.bitwise_or.reduce(low << place, axis=2).view(np.int64)


def _fold(values, factor):
    """Order-free hash of a set."""
    return int(mix(values * np.uint64(factor)).sum(dtype=np.uint64)) if len(values) else 0


def _signed(values):
    return np.asarray(values, np.uint64).view(np.int64)


_SCHEMA = "doc_id {id}, tag bigint, n bigint, k1 bigint, k2 bigint, bands binary, low array<bigint>"


def _signatures(words):
    def run(batches):
        for batch in batches:
            for part in groups(batch):
                text = part.column(part.schema.get_field_index("text"))
                sets = list(shingle_sets(text, words))
                k1 = np.array([_fold(s, 0x9E3779B97F4A7C15) for s in sets], np.uint64)
                k2 = np.array([_fold(s, 0xC2B2AE3D27D4EB4F) for s in sets], np.uint64)
                least = np.array([minima(s) for s in sets], np.uint32).reshape(len(sets), PERMUTATIONS)
                rows = least.reshape(len(sets), BANDS, BAND_ROWS).astype(np.uint64)
                keys = np.zeros((len(sets), BANDS), np.uint64)
                for j in range(BAND_ROWS):
                    keys = mix(keys * np.uint64(31) + rows[:, :, j] + np.uint64(1))
                low = packed(least, LOW_BITS)
                ids = part.column(part.schema.get_field_index("_id")).to_numpy(zero_copy_only=False).view(np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index("doc_id")), pa.array(_signed(mix(k1 ^ ids))),
                     pa.array([len(s) for s in sets], pa.int64()), pa.array(_signed(k1)), pa.array(_signed(k2)),
                     pa.array([k.tobytes() for k in keys], pa.binary()),
                     pa.array(list(low), pa.list_(pa.int64()))],
                    ["doc_id", "tag", "n", "k1", "k2", "bands", "low"])
    return run


def _sets(words, bits, mask):
    def run(batches):
        have = bits.value
        for batch in batches:
            for part in groups(batch):
                ids = part.column(part.schema.get_field_index("_id")).to_numpy(zero_copy_only=False).view(np.uint64)
                tags, k2s, sets = [], [], []
                for s, i in zip(shingle_sets(part.column(part.schema.get_field_index("text")), words), ids):
                    tag = mix(np.array([_fold(s, 0x9E3779B97F4A7C15)], np.uint64) ^ i)
                    if len(s) and has_bits(have, mask, tag)[0]:
                        tags.append(int(tag.view(np.int64)[0]))
                        k2s.append(int(_signed([_fold(s, 0xC2B2AE3D27D4EB4F)])[0]))
                        sets.append(s.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(tags, pa.int64()), pa.array(k2s, pa.int64()),
                                                  pa.array(sets, pa.list_(pa.int64()))], ["tag", "k2", "shingles"])
    return run


def _estimate(left: str, right: str, permutations: int = PERMUTATIONS, bits: int = LOW_BITS):
    """Collision-corrected similarity from two packed signatures: equal low values by bit counts."""
    ones = sum(1 << i for i in range(0, 64, bits))
    ones = ones - (1 << 64) if ones >= 1 << 63 else ones
    total = F.lit(0)
    for i in range(permutations * bits // 64):
        x = F.col(left)[i].bitwiseXOR(F.col(right)[i])
        width = 1
        while width < bits:                               # any differing bit marks the lowest one of its value
            x = x.bitwiseOR(F.shiftrightunsigned(x, width))
            width *= 2
        total = total + (64 // bits - F.bit_count(x.bitwiseAND(F.lit(ones))))
    chance = 1 / (1 << bits)
    return (total / permutations - chance) / (1 - chance)


def _likely(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Pairs whose estimated similarity is at least ``least``."""
    left = classes.select(F.col("c").alias("u"), F.col("low").alias("_lu"))
    right = classes.select(F.col("c").alias("v"), F.col("low").alias("_lv"))
    return pairs.join(left, "u").join(right, "v").where(_estimate("_lu", "_lv") >= least).select("u", "v")


def _sets_of(wanted: DataFrame, classes: DataFrame, texts: DataFrame, words: int, filter_bits: int) -> DataFrame:
    """Whole shingle sets ``(c, shingles)`` of the classes ``wanted(c)``, from one text each."""
    needed = written(wanted.join(classes.select("c", "tag", "k2"), "c"), "needed")
    bits, mask = bit_set(needed.select(F.col("tag").alias("anchor")), filter_bits)
    return written(texts.mapInArrow(_sets(words, bits, mask), "tag bigint, k2 bigint, shingles array<bigint>")
                   .join(needed, ["tag", "k2"]).dropDuplicates(["c"]).select("c", "shingles"), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(u, v)`` whose whole sets reach ``percent`` per cent Jaccard similarity."""
    both = (pairs.join(sets.select(F.col("c").alias("u"), F.col("shingles").alias("su")), "u")
            .join(sets.select(F.col("c").alias("v"), F.col("shingles").alias("sv")), "v"))
    shared = F.size(F.array_intersect("su", "sv"))
    return both.where(100 * shared >= percent * (F.size("su") + F.size("sv") - shared)).select("u", "v")


def _joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """``label(c, component)`` of all classes with the components that ``links`` connect merged."""
    left = label.select(F.col("c").alias("u"), F.col("component").alias("cu"))
    right = label.select(F.col("c").alias("v"), F.col("component").alias("cv"))
    between = links.join(left, "u").join(right, "v").select(F.col("cu").alias("u"), F.col("cv").alias("v"))
    merged = components(between).select(F.col("u").alias("component"), F.col("component").alias("_root"))
    return written(label.join(merged, "component", "left").select("c", F.coalesce("_root", "component").alias("component")), "labels")


def _open_members(members: DataFrame, label: DataFrame) -> DataFrame:
    """``(band, key, c, component)`` of the buckets that hold several components."""
    named = members.join(label, "c")
    several = (named.groupBy("band", "key").agg(F.min("component").alias("a"), F.max("component").alias("b"))
               .where("a <> b").select("band", "key"))
    return written(named.select("band", "key", "c", "component").join(several, ["band", "key"], "left_semi"), "open")


def _star_pairs(members: DataFrame, pick) -> DataFrame:
    """Every bucket's members against its one member with the greatest ``pick`` (of another component)."""
    chosen = members.groupBy("band", "key").agg(F.max(F.struct(pick.alias("p"), F.col("c"), F.col("component"))).alias("m"))
    chosen = chosen.select("band", "key", F.col("m.c").alias("leader"), F.col("m.component").alias("lead"))
    pairs = members.join(written(chosen, "leaders"), ["band", "key"]).where("component <> lead")
    return pairs.select(F.least("leader", "c").alias("u"), F.greatest("leader", "c").alias("v")).distinct()


def _fine(batches):
    """Long signatures ``(c, fine)`` of whole sets."""
    for batch in batches:
        sets = [np.asarray(x, np.int64).view(np.uint64) for x in batch.column(1).to_pylist()]
        least = np.array([minima(x, _FINE_FACTOR, _FINE_SHIFT) for x in sets], np.uint32).reshape(len(sets), FINE)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(packed(least, FINE_BITS)), pa.list_(pa.int64()))], ["c", "fine"])


def _fitting(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The open ``members`` that another component's class in their bucket may be linked with, with ``n`` (their set's
    size) and ``most`` (the largest set that they can be linked with); see the module's text for the bound."""
    open_sets = sets.join(members.select("c", "component").distinct(), "c")
    shingles = written(open_sets.select("c", "component", F.explode("shingles").alias("s")), "shingles")
    foreign = (shingles.groupBy("s").agg(F.min("component").alias("a"), F.max("component").alias("b"))
               .where("a <> b").select("s"))
    shared = shingles.join(foreign, "s").groupBy("c").agg(F.count(F.lit(1)).alias("r"))
    sized = open_sets.select("c", F.size("shingles").cast("long").alias("n")).join(shared, "c").select(
        "c", "n", F.expr(f"({100 + percent} * r - {percent} * n) div {percent}").alias("most"))
    rows = written(members.join(written(sized, "fits"), "c"), "fitting")
    for _ in range(2):
        # against the bucket's smallest set and widest bound; fewer members tighten both
        ends = rows.groupBy("band", "key").agg(F.min("n").alias("_n"), F.max("most").alias("_most"),
                                               F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").drop("a", "b")
        rows = written(rows.join(ends, ["band", "key"]).where("_n <= most AND n <= _most").drop("_n", "_most"), "fitting")
    return rows


def _rest_pairs(members: DataFrame, sets: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Likely pairs between what is left: every member outside its bucket's most common component
    against the bucket's members of other components.  ``members`` come from :func:`_fitting`.

    The sets' sizes have to fit each other, and a longer signature decides what is likely.  Both are part of the
    join's condition, and so is that the bucket is the first one the two share: a
    likely pair leaves the join once, others never.
    """
    sizes = members.groupBy("band", "key", "component").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("band", "key").agg(F.max(F.struct("n", "component")).alias("m")).select("band", "key", F.col("m.component").alias("main"))
    fine = (sets.join(members.select("c").distinct(), "c").select("c", "shingles").mapInArrow(_fine, "c bigint, fine array<bigint>")
            .join(classes.select("c", "bands"), "c"))
    rows = written(members.join(main, ["band", "key"]).join(written(fine, "fine"), "c"), "rest")
    outside = rows.where("component <> main").select("band", "key", F.col("c").alias("x"), F.col("component").alias("cx"),
                                                     F.col("fine").alias("fx"), F.col("bands").alias("bx"), F.col("n").alias("nx"), F.col("most").alias("mx"))
    inside = rows.select("band", "key", F.col("c").alias("y"), F.col("component").alias("cy"), F.col("main"),
                         F.col("fine").alias("fy"), F.col("bands").alias("by"), F.col("n").alias("ny"), F.col("most").alias("my"))
    # two members outside are one pair
    once = (F.col("cy") == F.col("main")) | (F.col("x") < F.col("y"))
    likely = _estimate("fx", "fy", FINE, FINE_BITS) >= percent / 100 - FINE_MARGIN
    first = ~F.exists(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: (i < outside["band"]) & (
        F.substr(F.col("bx"), i * 8 + 1, F.lit(8)) == F.substr(F.col("by"), i * 8 + 1, F.lit(8))))
    pairs = outside.join(inside, (outside["band"] == inside["band"]) & (outside["key"] == inside["key"])
                         & (F.col("cx") != F.col("cy")) & once & (F.col("ny") <= F.col("mx")) & (F.col("nx") <= F.col("my")) & likely & first)
    return pairs.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, margin: float = 0.2,
                    rounds: int = ROUNDS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per input row."""
    prepare(docs.sparkSession)
    texts = docs.select("doc_id", F.xxhash64("doc_id").alias("_id"), "text")
    id_type = texts.schema["doc_id"].dataType.simpleString()
    signed = written(texts.mapInArrow(_signatures(words), _SCHEMA.format(id=id_type)), "signatures")
    classes = (signed.where("n > 0").groupBy("k1", "k2", "n", "bands", "low")
               .agg(F.min("doc_id").alias("first_id"), F.min("tag").alias("tag"))
               .withColumn("c", F.monotonically_increasing_id()))
    classes = written(classes, "classes")

    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.substr("bands", i * 8 + 1, F.lit(8)))
    banded = classes.select("c", F.posexplode(keys).alias("band", "key"))
    buckets = banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = written(banded.join(buckets, ["band", "key"]), "members")
    central = written(members.groupBy("c").agg(F.sum("size").alias("central")), "central")
    sets = _sets_of(central.select("c"), classes, texts, words, filter_bits)
    label = central.select("c", F.col("c").alias("component"))
    least = percent / 100 - margin

    def linked(pairs):
        return written(_confirmed(pairs, sets, percent), "confirmed")

    # first the most central class leads: the text that many near copies were made from leads all
    # their buckets.  Then a class that hashing picks anew for every bucket and round
    now = members.join(central, "c").select("band", "key", "c", F.col("c").alias("component"), "central")
    label = _joined(label, linked(written(_likely(_star_pairs(now, F.col("central")), classes, least), "likely")))
    for r in range(rounds):
        now = _open_members(members, label)
        pick = F.xxhash64("c", "band", F.lit(r))
        label = _joined(label, linked(written(_likely(_star_pairs(now, pick), classes, least), "likely")))
    # what is left in buckets with several components
    rest = written(_rest_pairs(_fitting(_open_members(members, label), sets, percent), sets, classes, percent), "rest_pairs")
    label = _joined(label, linked(rest))

    group = classes.join(label, "c", "left").withColumn("component", F.coalesce("component", "c"))
    lowest = group.groupBy("component").agg(F.min("first_id").alias("component_id"))
    ids = group.join(lowest, "component").select("k1", "k2", "component_id")
    out = signed.select("doc_id", "n", "k1", "k2").join(ids, ["k1", "k2"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))
