"""Prefix trie of conversations from fixed-length blocks of turns.

A turn has a 128-bit digest of role and text, tagged with its depth; a sequence of turns
has the exclusive or of its turns' digests.  Conversations are cut into blocks of
``BLOCK`` turns:

1. Conversations are grouped by their successive block digests: a block node is a path (the
   digest of all blocks before it) with the digest of the block itself, its member count
   and its least member.  Only one row per block, not per turn, is grouped.
2. Where a path goes on with a single block, all members share every turn in it, and
   the turns' nodes follow from that one block.  Only where siblings diverge the turn
   boundaries inside the blocks are refined: the different blocks' first 1, 2, .. turns are
   grouped, one row per different block.

Sums over subtrees need no walk of the tree.  A node is owned by its least member; a
conversation owns the lower end of its own path.  So a subtree's sum is the sum of
its members' totals over what they own, less what the node's owner owns above
the node: one more grouping by blocks, and a running sum along each path.

No conversation, path or group is ever one task's list: turns are numbered over all tasks,
running values along a conversation are taken by stretches and then over
stretches, groups are counted before they are shuffled.  The ids that
end at one node are hashed as a sorted stream.

Defined cases: null role or text counts as empty; null turns come first; turns of
one number are in the order of their digests; rows with a null id belong to no
conversation and are left out; repeated rows are turns of their own; other columns
are ignored; without a conversation there is no node.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.numbering import number_rows
from .shared import blank, prepare, written

BLOCK = 8                            # turns of a block
STRETCH = 512                        # rows of a path whose running value one window takes

NODE = ["depth", "d1", "d2"]
PATH = ["k", "p1", "p2"]
BLOCK_NODE = [*PATH, "x1", "x2"]


def placed(conversations: DataFrame) -> DataFrame:
    """``(conv_id, pos, a1, a2, bytes)``: every turn's place in its conversation (from 1), digest and UTF-8 bytes."""
    role, text = blank(F.col("role")), blank(F.col("text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(role, text).alias("a1"),
        F.xxhash64(F.lit("turn"), role, text).alias("a2"), F.octet_length(text).cast("long").alias("bytes"))
    numbered = number_rows(turns, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("a1"), F.col("a2")], name="_no")
    first = numbered.groupBy("conv_id").agg(F.min("_no").alias("_first"))
    return written(numbered.join(first, "conv_id").select("conv_id", (F.col("_no") - F.col("_first") + 1).alias("pos"), "a1", "a2", "bytes"), "turns")


def _before(rows: DataFrame, keys: list[str], order: str, columns: dict, total, combine, empty, stretch: int) -> DataFrame:
    """Adds the running ``total`` of ``columns`` (name -> source) over the rows of ``keys`` before each row.

    Within stretches of ``order`` first, then over the stretches, so a path of any
    length is dealt over many groups.
    """
    at = F.floor(F.col(order) / F.lit(stretch)).alias("_s")
    earlier = Window.partitionBy(*keys, "_s").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_s", at)
    inner = rows.select("*", *[F.coalesce(total(c).over(earlier), empty).alias(f"_in_{n}") for n, c in columns.items()])
    # stretches after the first: what all the ones before them add
    long = rows.groupBy(*keys, "_s").agg(*[total(c).alias(f"_of_{n}") for n, c in columns.items()])
    before = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    carried = long.select(*keys, "_s", *[total(f"_of_{n}").over(before).alias(f"_to_{n}") for n in columns]).where("_s > 0")
    out = inner.join(carried, [*keys, "_s"], "left")
    return out.select(*[c for c in rows.columns if c != "_s"],
                      *[combine(F.col(f"_in_{n}"), F.coalesce(F.col(f"_to_{n}"), empty)).alias(n) for n in columns])


def _blocks(turns: DataFrame, block: int, stretch: int) -> DataFrame:
    """``(conv_id, *BLOCK_NODE, items)``: every conversation's blocks with the path before them."""
    tagged = turns.select("conv_id", F.col("pos").alias("depth"), F.expr(f"(pos - 1) div {block}").alias("k"),
                          F.xxhash64("pos", "a1").alias("h1"), F.xxhash64("pos", "a2").alias("h2"), "bytes")
    # at most `block` turns each
    cut = tagged.groupBy("conv_id", "k").agg(
        F.sort_array(F.collect_list(F.struct("depth", "h1", "h2", "bytes"))).alias("items"),
        F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
    paths = _before(cut, ["conv_id"], "k", {"p1": "x1", "p2": "x2"}, F.bit_xor,
                    lambda a, b: a.bitwiseXOR(b), F.lit(0).cast("long"), max(stretch // block, 1))
    return written(paths.select("conv_id", *BLOCK_NODE, "items"), "blocks")


def _refined(blocks: DataFrame, measures: dict) -> DataFrame:
    """Turn nodes ``(*NODE, e1, e2, bytes, *measures)`` from block nodes; ``e1, e2`` is the parent's digest.

    ``measures``: name -> aggregate that merges the measure of blocks that begin alike.
    """
    single = (blocks.where("k > 0").groupBy(*PATH).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1")
              .select(*PATH, F.lit(True).alias("_alone")))
    # the first block has the root above it, where conversations diverge: no look-up for those rows
    flagged = (blocks.where("k > 0").join(single, PATH, "left")
               .unionByName(blocks.where("k = 0").withColumn("_alone", F.lit(None).cast("boolean"))))

    def through(p: str, h: str, j: str) -> str:
        return f"aggregate(slice(items, 1, {j}), {p}, (acc, x) -> acc ^ x.{h})"

    steps = F.expr(f"transform(items, (x, i) -> struct(x.depth as depth, {through('p1', 'h1', 'i + 1')} as d1, {through('p2', 'h2', 'i + 1')} as d2, "
                   f"{through('p1', 'h1', 'i')} as e1, {through('p2', 'h2', 'i')} as e2, x.bytes as bytes))")
    turns = flagged.select("_alone", *measures, F.explode(steps).alias("_t")).select("_alone", "_t.*", *measures)
    key = [*NODE, "e1", "e2", "bytes"]
    alone = turns.where(F.col("_alone")).select(*key, *measures)
    diverging = turns.where(F.col("_alone").isNull()).groupBy(*key).agg(*[f(c).alias(c) for c, f in measures.items()])
    return alone.unionByName(diverging)


def _hash_rows(batches):
    """SHA-256 of the comma-joined ids of each node, from rows sorted by node and id."""
    at, digest = None, None
    done: list[tuple] = []

    def flush():
        cols = list(zip(*done))
        done.clear()
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], [*NODE, "ends_sha256"])

    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy() for i in range(3)])
        ids = batch.column(3).to_pylist()
        if not ids:
            continue
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), len(ids)]
        for a, z in zip(cuts, cuts[1:]):
            key = tuple(int(x) for x in keys[:, a])
            part = ",".join(map(str, ids[a:z]))
            if key == at:
                digest.update(("," + part).encode())
                continue
            if at is not None:
                done.append((*at, digest.hexdigest()))
            at, digest = key, hashlib.sha256(part.encode())
        if len(done) >= 1000:
            yield flush()
    if at is not None:
        done.append((*at, digest.hexdigest()))
        yield flush()


def _ends(blocks: DataFrame, members: DataFrame) -> DataFrame:
    """``(*NODE, conv_id)``: where every member ends; the root for one without turns."""
    last = blocks.groupBy("conv_id").agg(F.max(F.struct(
        "k", F.col("p1").bitwiseXOR(F.col("x1")).alias("d1"), F.col("p2").bitwiseXOR(F.col("x2")).alias("d2"),
        F.element_at("items", -1)["depth"].alias("depth"))).alias("_l"))
    zero = F.lit(0).cast("long")
    return members.join(last, "conv_id", "left").select(
        *[F.coalesce(F.col(f"_l.{c}"), zero).alias(c) for c in NODE], "conv_id")


def trie(turns: DataFrame, members: DataFrame, block: int = BLOCK, stretch: int = STRETCH) -> DataFrame:
    """Nodes of the trie of ``turns`` ``(conv_id, pos, a1, a2, bytes)``, from the textless root down.

    ``members``: every ``conv_id``, also of conversations without a turn.  Returns, per node,
    its key ``(depth, d1, d2)``, ``conv_id`` (least member), ``parent_conv_id``,
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.
    """
    spark = turns.sparkSession
    prepare(spark)
    members = members.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    root = members.agg(F.min("conv_id").alias("least"), F.count(F.lit(1)).alias("n")).first()
    blocks = _blocks(turns, block, stretch)
    plain = written(blocks.groupBy(*BLOCK_NODE).agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("m"), F.first("items").alias("items")), "block_nodes")
    found = written(_refined(plain, {"n": F.sum, "m": F.min}), "turn_nodes")
    kids = found.groupBy((F.col("depth") - 1).alias("depth"), F.col("e1").alias("d1"), F.col("e2").alias("d2")).agg(F.count(F.lit(1)).alias("n_children"))
    value = (F.col("n") - 1) * F.col("bytes")
    nodes = written(found.join(kids, NODE, "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "v": value}), "nodes")

    # what every owner owns, summed over the members of every node
    owned = nodes.groupBy(F.col("m").alias("conv_id")).agg(F.sum("v").alias("saved"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"))
    spread = (blocks.select("conv_id", *BLOCK_NODE).join(owned, "conv_id")
              .groupBy(*BLOCK_NODE).agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")))
    heavy = plain.select(*BLOCK_NODE, "items").join(spread, BLOCK_NODE, "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("saved", "leaves")})
    below = _refined(heavy, {"saved": F.sum, "leaves": F.sum}).select(*NODE, "saved", "leaves")
    above = _before(nodes.select(*NODE, "e1", "e2", "m", "n", "n_children", "v"), ["m"], "depth", {"_above": "v"}, F.sum, lambda a, b: a + b, F.lit(0).cast("long"), stretch)
    summed = written(above.join(below, NODE).select(
        *NODE, "e1", "e2", "m", "n", "n_children", F.col("leaves").alias("n_leaves"), (F.col("saved") - F.col("_above")).alias("saved_tokens")), "sums")

    # parents: the root's children know theirs, the others look theirs up
    up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("d1").alias("e1"), F.col("d2").alias("e2"), F.col("m").alias("parent_conv_id"))
    deep = summed.where("depth > 1").join(up, ["depth", "e1", "e2"])
    top = summed.where("depth = 1").withColumn("parent_conv_id", F.lit(root["least"]).cast("long"))
    cols = [*NODE, F.col("m").alias("conv_id"), "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens"]
    zero = F.lit(0).cast("long")
    whole = nodes.agg(F.coalesce(F.sum((F.col("depth") == 1).cast("long")), zero).alias("n_children"),
                      F.greatest(F.coalesce(F.sum((F.col("n_children") == 0).cast("long")), zero), F.lit(1)).alias("n_leaves"),
                      F.coalesce(F.sum("v"), zero).alias("saved_tokens")).select(
        *[zero.alias(c) for c in NODE], F.lit(root["least"]).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"),
        F.lit(root["n"]).cast("long").alias("n_convs"), "n_children", "n_leaves", "saved_tokens").where("n_convs > 0")
    every = deep.select(*cols).unionByName(top.select(*cols)).unionByName(whole)

    ends = _ends(blocks, members)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hashed = (ends.repartition(n, *NODE).sortWithinPartitions(*NODE, "conv_id")
              .mapInArrow(_hash_rows, "depth bigint, d1 bigint, d2 bigint, ends_sha256 string"))
    return every.join(hashed, NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))


def prefix_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """The trie of conversations ``(conv_id, turn, role, text)``; see :func:`trie`."""
    turns = placed(conversations)
    return trie(turns, turns.select("conv_id"), block)


def rebuilt(turns: DataFrame) -> DataFrame:
    """The contract's input from :func:`placed` turns: conversation c starts with the first h turns of
    c - c % 5 and goes on with its own after its first h, h = crc32(c as text) % 9."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).alias("_h")
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("_size")).select("conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("_base"), h, "_size")
    bases = convs.select(F.col("conv_id").alias("_base"), F.col("_size").alias("_base_size"))
    linked = convs.drop("_size").join(bases, "_base", "left").withColumn("_taken", F.least("_h", F.coalesce("_base_size", F.lit(0))))
    own = turns.join(linked.select("conv_id", "_h", "_taken"), "conv_id").where("pos > _h").select(
        "conv_id", (F.col("pos") - F.col("_h") + F.col("_taken")).alias("pos"), "a1", "a2", "bytes")
    # at most 8 turns of a base, for at most 9 conversations
    heads = turns.where("pos <= 8").withColumnRenamed("conv_id", "_base").join(linked.select("conv_id", "_base", "_h"), "_base").where("pos <= _h")
    return own.unionByName(heads.select("conv_id", "pos", "a1", "a2", "bytes"))


def digest(nodes: DataFrame) -> DataFrame:
    """The contract's columns."""
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def oracle() -> str:
    """DuckDB SQL of the contract: every prefix is a list of turns, every sum is taken over the members' paths."""
    # crc32 bit by bit: a byte b >= 0 enters, -1 stands for one shift
    steps = "[4294967295] || flatten(list_transform(string_split(conv_id::varchar, ''), lambda x: [ascii(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = (f"xor(list_reduce({steps}, lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)")
    return f"""
WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
),
convs AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {crc} % 9 AS h FROM (SELECT DISTINCT conv_id FROM own)),
parts AS (
  SELECT c.conv_id, 0 AS part, o.pos, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.base AND o.pos <= c.h
  UNION ALL
  SELECT c.conv_id, 1, o.pos, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.pos > c.h
),
turns AS (
  SELECT conv_id, row_number() OVER w AS depth, strlen(text)::bigint AS bytes, list({{'role': role, 'text': text}}) OVER w AS path
  FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
spots AS (
  SELECT conv_id, 0::bigint AS depth, 0::bigint AS bytes, []::struct(role varchar, text varchar)[] AS path FROM convs
  UNION ALL SELECT * FROM turns
),
named AS (SELECT *, min(conv_id) OVER (PARTITION BY depth, path) AS node FROM spots),
kept AS (SELECT node, depth, any_value(bytes) AS bytes, count(*) AS n FROM named GROUP BY ALL),
sizes AS (SELECT conv_id, max(depth) AS size FROM spots GROUP BY ALL),
-- the path of every node's least member names its parents
climb AS (SELECT k.node AS v, k.depth AS vd, s.node, s.depth FROM kept k JOIN named s ON s.conv_id = k.node AND s.depth <= k.depth),
kids AS (SELECT node, depth, count(*) FILTER (vd = depth + 1) AS n_children FROM climb GROUP BY ALL),
sums AS (
  SELECT c.node, c.depth, sum((k.n - 1) * k.bytes)::bigint AS saved, count(*) FILTER (l.n_children = 0) AS n_leaves
  FROM climb c JOIN kept k ON k.node = c.v AND k.depth = c.vd JOIN kids l ON l.node = c.v AND l.depth = c.vd GROUP BY ALL
),
ends AS (
  SELECT s.node, s.depth, string_agg(s.conv_id::varchar, ',' ORDER BY s.conv_id) AS ids
  FROM named s JOIN sizes z ON z.conv_id = s.conv_id AND z.size = s.depth GROUP BY ALL
)
SELECT k.node AS conv_id, k.depth, p.node AS parent_conv_id, k.n AS n_convs, l.n_children, u.n_leaves, u.saved AS saved_tokens,
       sha256(coalesce(e.ids, '')) AS ends_sha256
FROM kept k
JOIN kids l USING (node, depth) JOIN sums u USING (node, depth)
LEFT JOIN named p ON p.conv_id = k.node AND p.depth = k.depth - 1
LEFT JOIN ends e USING (node, depth)
"""
