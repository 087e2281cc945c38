"""Document fingerprints of closed syncmers, in SQL functions alone.

A text's words are hashed in overlapping pairs (the inner substrings).  A k-mer of
``K`` words is an anchor if the least of its pairs stands first or last in it.  Whether
it is one depends on its own words only, so equal passages have equal anchors
wherever they stand, and of any ``K - 1`` consecutive k-mers one at least is an anchor.

The fingerprint is the row of anchors in text order, seven hexadecimal digits each:
the distance in words from the anchor before it (from the text's start for the
first; at most 15) and 24 bits of the k-mer's hash.  Two anchors match if both agree,
that is if the k-mers are alike *and* stand at the same place behind the anchor
before them; this holds in a passage that moved as a whole.  A
text with words but without an anchor has one that stands for all its words.

Defined cases: null text counts as empty; a text without words has the empty
fingerprint, alike (1.0) to other empty ones and unlike (0.0) to all others; white space does
not count; equal texts have equal fingerprints, whatever their ids; other columns
are left out; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import number_rows
from .shared import blank, words_of, written

# the unit of a k-mer is a word, so a shifted or respaced passage keeps its anchors
K = 5                                # words of an anchor
INNER = K - 1                        # pairs of consecutive words in it
PIECE = 16                           # longer words count as pieces of so many characters


def with_anchors(texts: DataFrame, text: str, name: str, k: int = K) -> DataFrame:
    """Adds ``name``: the anchors of the column ``text`` in text order, an ``array<int>`` (hash and distance)."""
    if not 3 <= k <= 16:
        raise ValueError("an anchor has 3 to 16 words")
    w, h, p = f"_{name}_w", f"_{name}_h", f"_{name}_p"
    m = k - 1
    first = " and ".join(f"{h}[i] <= {h}[i + {j}]" for j in range(1, m))
    last = " and ".join(f"{h}[i + {m - 1}] < {h}[i + {m - 1 - j}]" for j in range(1, m))
    # one 64-bit hash of the k-mer from pairs that cover its words
    cover = ", ".join(f"{h}[x + {j}]" for j in sorted({*range(0, m, 2), m - 1}))
    gap = f"if(i = 0, least(x, 15), least(x - {p}[i - 1], 15))"
    anchor = f"int(shiftleft({gap}, 24) | (xxhash64({cover}) & 16777215))"
    pieces = (f"if(exists({w}, x -> char_length(x) > {PIECE}), flatten(transform({w}, x -> if(char_length(x) <= {PIECE}, array(x), "
              f"regexp_extract_all(x, '(?s).{{1,{PIECE}}}', 0)))), {w})")
    whole = f"if(size({w}) = 0, array(), array(int(xxhash64({w}) & 16777215)))"
    # each array is its own projection: used many times, it must not be put in again in place of its name
    out = texts.withColumn(w, words_of(F.col(text)))
    out = out.withColumn(w, F.expr(pieces))
    out = out.withColumn(h, F.expr(f"if(size({w}) < {k}, array(), zip_with(slice({w}, 1, size({w}) - 1), slice({w}, 2, size({w}) - 1), (a, b) -> xxhash64(a, b)))"))
    out = out.withColumn(p, F.expr(f"if(size({h}) = 0, array(), filter(sequence(0, size({h}) - {m}), i -> ({first}) or ({last})))"))
    out = out.withColumn(name, F.expr(f"if(size({p}) = 0, {whole}, transform({p}, (x, i) -> {anchor}))"))
    return out.drop(w, h, p)


def as_text(anchors: Column) -> Column:
    """The fingerprint: anchors as hexadecimal digits, one after another."""
    return F.array_join(F.transform(anchors, lambda x: F.lpad(F.hex(x.cast("long")), 7, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of the different anchors of both texts that they have in common (0 to 1); 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    total = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * both / total)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_chars, anchors, fingerprint)`` per document."""
    texts = docs.select("doc_id", blank(F.col("text")).alias("text"))
    found = with_anchors(texts, "text", "anchors")
    return found.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "anchors", as_text(F.col("anchors")).alias("fingerprint"))


KEY = ["_null", "_id", "_h1", "_h2"]


def _keyed(docs: DataFrame) -> DataFrame:
    """``(*KEY, text)``: the id with its null flag, two hashes of the text, the text."""
    texts = docs.select(F.col("doc_id").isNull().alias("_null"), F.coalesce(F.col("doc_id"), F.lit(0)).alias("_id"), blank(F.col("text")).alias("text"))
    return texts.select("_null", "_id", F.xxhash64("text").alias("_h1"), F.xxhash64(F.lit("text"), "text").alias("_h2"), "text")


def successors(keyed: DataFrame) -> DataFrame:
    """``(*KEY, _n, _copies, _next_...)``: every different row, its characters, how often it occurs, and the key of the row behind it.

    Null ids come first, rows of one id are in the order of their texts' hashes, and the first row
    comes behind the last.  Only ids, hashes and lengths are sorted, over all tasks.
    """
    rows = keyed.groupBy(*KEY, F.char_length("text").cast("long").alias("_n")).agg(F.count(F.lit(1)).alias("_copies"))
    order = [F.col("_null").desc(), *[F.col(c) for c in KEY[1:]]]
    placed = written(number_rows(rows, order, name="_at"), "order")
    last = placed.agg(F.max("_at")).first()[0]
    behind = F.when(F.col("_at") == 1, F.lit(last)).otherwise(F.col("_at") - 1)
    followers = placed.select(behind.cast("long").alias("_at"), *[F.col(c).alias(f"_next{c}") for c in KEY])
    return written(placed.join(followers, "_at").drop("_at"), "successors")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """The contract's rows: every text, its edited text, and both fingerprints beside the next document's.

    ``(doc_id, n_chars, edited, anchors, edited_anchors, next_anchors)``.  In the edited text the last
    quarter of the characters gives way to the first as many of the next document.  Rows alike in
    id and text are worked on once: all but the last of them have their like as the next document.
    """
    keyed = _keyed(docs)
    links = successors(keyed)
    texts = keyed.groupBy(*KEY).agg(F.first("text").alias("text"))
    quarter = F.expr("_n div 4")
    # every row sends the one before it what that needs: the first characters and the anchors
    to = [f"_to{c}" for c in KEY]
    asked = links.select(*[F.col(f"_next{c}").alias(c) for c in KEY], *[F.col(c).alias(t) for c, t in zip(KEY, to)], quarter.alias("_m"))
    sent = with_anchors(texts.join(asked, KEY), "text", "next_anchors").select(
        *[F.col(t).alias(c) for c, t in zip(KEY, to)], F.expr("left(text, int(_m))").alias("_head"), "next_anchors")
    rows = texts.join(links.select(*KEY, "_n", "_copies"), KEY).join(sent, KEY)
    rows = with_anchors(rows, "text", "anchors")
    # one output row per copy: the last is followed by the next row, the others by their like
    own = F.struct(F.expr("left(text, int(_n div 4))").alias("head"), F.col("anchors").alias("anchors"), F.expr("_copies - 1").alias("times"))
    other = F.struct(F.col("_head").alias("head"), F.col("next_anchors").alias("anchors"), F.lit(1).cast("long").alias("times"))
    kinds = F.when(F.col("_copies") > 1, F.array(other, own)).otherwise(F.array(other))
    rows = rows.select("_null", "_id", "_n", "text", "anchors", F.explode(kinds).alias("_k"))
    rows = rows.select(F.when(~F.col("_null"), F.col("_id")).alias("doc_id"), F.col("_n").alias("n_chars"), "anchors",
                       F.concat(F.expr("left(text, int(_n - _n div 4))"), F.col("_k.head")).alias("edited"),
                       F.col("_k.anchors").alias("next_anchors"), F.col("_k.times").alias("_times"))
    rows = with_anchors(rows, "edited", "edited_anchors")
    return rows.select("doc_id", "n_chars", "edited", "anchors", "edited_anchors", "next_anchors", "_times")


def digest(pairs: DataFrame) -> DataFrame:
    """The contract's columns from :func:`edited_pairs`, one row per copy."""
    out = pairs.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("anchors")).alias("fingerprint"),
        as_text(F.col("edited_anchors")).alias("edited_fingerprint"), likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"),
        likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"), "_times")
    return out.select("*", F.explode(F.array_repeat(F.lit(0), F.col("_times").cast("int")))).drop("_times", "col")
