"""Top-k similar vectors (V4, O4, M3): for one query vector, or for all at once.

One query vector enters as a scalar subquery; each task keeps its own top k
and Spark merges them (``TakeOrderedAndProject``), so no shuffle of the table.

For all vectors the table is cut into blocks of a fixed number of rows, a row of the
plan each.  Every block is a query block and a base block; both are dealt once, and a task
takes some query blocks and a part of the base blocks (``CartesianProduct``, which reads what was
dealt and copies nothing to disk).  It multiplies them two at a time as matrices and keeps the k best
for each query row, so memory is its query blocks, and what is shuffled is the
vectors and k rows a query and part.  Work is quadratic, the disk is not.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import cosine
from .numbering import number_rows


def similar_vectors(vectors: DataFrame, query_id, k: int = 5, key: str = "vec_id",
                    vector: str = "embedding", digits: int | None = 6) -> DataFrame:
    q = vectors.where(F.col(key) == query_id).select(vector).scalar()
    # the subquery is projected first: it may not appear inside a lambda
    with_q = vectors.where(F.col(key) != query_id).select(key, vector, q.alias("_q"))
    sim = cosine(F.col(vector), F.col("_q"))
    if digits is not None:
        sim = F.round(sim, digits) + F.lit(0.0)
    scored = with_q.select(key, sim.alias("similarity"))
    return scored.orderBy(F.col("similarity").desc(), F.col(key).asc()).limit(k)


QUERY_BLOCKS = 16        # query blocks of a task


def _best_of_blocks(k: int, digits: int | None, columns: list[str]):
    """For pairs of blocks, all query blocks for a base block in turn: the ``k`` best of every query row.

    What it uses is defined inside, so workers need not have this package.
    """
    def best_columns(sim: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Columns and values of the ``k`` greatest of each row, ties to the earlier column.  ``sim`` is used up."""
        n, rows = min(k, sim.shape[1]), np.arange(len(sim))
        if n > 16:
            best = np.argsort(-sim, axis=1, kind="stable")[:, :n]
            return best, np.take_along_axis(sim, best, axis=1)
        best, value = np.empty((len(sim), n), np.int64), np.empty((len(sim), n))
        for j in range(n):
            best[:, j] = sim.argmax(axis=1)
            value[:, j] = sim[rows, best[:, j]]
            sim[rows, best[:, j]] = -np.inf
        return best, value

    class Block:
        """A block's rows in the order of their keys: numbers, keys (an object array if one is null) and vectors."""

        def __init__(self, batch: pa.RecordBatch, i: int, side: str):
            def column(name):
                return batch.column(f"{side}{name}")[i]

            names, dims = column("names").values, column("dims").as_py()
            if len(dims) != 1:
                raise ValueError(f"vectors differ in length: {sorted(dims)}")
            self.names = np.array(names.to_pylist(), dtype=object) if names.null_count else names.to_numpy(zero_copy_only=False)
            self.known = ~pd.isnull(self.names)
            self.numbers = column("first").as_py() + np.arange(len(names))
            values, norms = (column(x).values.to_numpy(zero_copy_only=False) for x in ("values", "norms"))
            with np.errstate(invalid="ignore", over="ignore"):
                self.vectors = values.reshape(len(names), dims[0]) / norms[:, None]

        def as_base(self) -> Block:
            """Only vectors that have a similarity; those without a key come last, also in ties within the block."""
            good = np.isfinite(self.vectors).all(axis=1)
            if not (good & self.known).all():
                kept = np.concatenate([np.flatnonzero(good & self.known), np.flatnonzero(good & ~self.known)])
                self.names, self.known, self.numbers, self.vectors = (x[kept] for x in (self.names, self.known, self.numbers, self.vectors))
            return self

        def equal_keys(self, other: Block) -> np.ndarray | None:
            """Where a key equals one of the other block (null equals nothing); none if the blocks' keys lie apart."""
            a, b = self.names[self.known], other.names[other.known]
            if not len(a) or not len(b) or a[-1] < b[0] or b[-1] < a[0]:
                return None
            return (self.names[:, None] == other.names[None, :]) & self.known[:, None]

    class Best:
        """The ``k`` best neighbours so far of each row of a query block, best first."""

        def __init__(self, query: Block):
            self.keys = query.names
            size = (len(query.names), k)
            self.value, self.number, self.name = np.full(size, -np.inf), np.zeros(size, np.int64), np.zeros(size, query.names.dtype)

        def add(self, query: Block, base: Block) -> None:
            same = query.equal_keys(base)
            # only rows with a neighbour that may reach their k-th best, whose value is rounded
            least = self.value[:, -1:].max(axis=1, initial=-np.inf) - (0.0 if digits is None else 10.0 ** -digits)
            for at in range(0, len(query.names) if len(base.names) else 0, 256):        # few rows at a time stay in a core's cache
                part = slice(at, at + 256)
                sim = query.vectors[part] @ base.vectors.T
                if same is not None:
                    sim[same[part]] = -np.inf                      # never its own neighbour
                rows = np.flatnonzero(sim.max(axis=1) >= least[part])
                if len(rows):
                    self.merge(at + rows, sim[rows], base)

        def merge(self, rows: np.ndarray, sim: np.ndarray, base: Block) -> None:
            if digits is not None:
                sim = np.round(sim, digits) + 0.0
            best, value = best_columns(sim)
            value = np.concatenate([self.value[rows], value], axis=1)
            number = np.concatenate([self.number[rows], base.numbers[best]], axis=1)
            name = np.concatenate([self.name[rows], base.names[best]], axis=1)
            order = np.lexsort((number, -value))[:, :k]            # numbers rise with the keys: ties go to the lesser
            self.value[rows], self.number[rows] = (np.take_along_axis(x, order, axis=1) for x in (value, number))
            self.name = self.name.astype(name.dtype, copy=False)
            self.name[rows] = np.take_along_axis(name, order, axis=1)

        def table(self, kind: pa.DataType) -> pa.RecordBatch:
            good = np.isfinite(self.value)
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.keys, good.sum(axis=1)), kind), pa.array(self.name[good], kind),
                                               pa.array(self.value[good], pa.float64())], names=columns)

    def run(batches):
        found, at, base, kind = {}, None, None, None
        for batch in batches:
            kind = batch.schema.field("q_names").type.value_type
            for i in range(batch.num_rows):
                if at != batch.column("b_block")[i].as_py():       # all query blocks meet a base block in turn
                    at, base = batch.column("b_block")[i].as_py(), Block(batch, i, "b_").as_base()
                query, name = Block(batch, i, "q_"), batch.column("q_block")[i].as_py()
                if name not in found:
                    found[name] = Best(query)
                found[name].add(query, base)
        for best in found.values():
            yield best.table(kind)
    return run


def nearest_vectors(vectors: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding",
                    digits: int | None = 6, block: int = 2048) -> DataFrame:
    """M3, O4 for every vector: ``(key, rank, neighbour, similarity)``, its ``k`` nearest others by cosine similarity.

    Exact: every pair is compared, in blocks of ``block`` rows.  Ranks go by the (rounded)
    similarity, ties to the lesser key.  Vectors without length have no direction and no neighbours.
    """
    rows = vectors.select(key, F.col(vector).cast("array<double>").alias("_v"))
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))
    # divided by it where the blocks are read: in a lambda over the vector the norm would be summed up for every element
    placed = number_rows(rows.withColumn("_norm", norm).where("_norm > 0"), [key], name="_no")
    entries = F.sort_array(F.collect_list(F.struct("_no", F.col(key).alias("_k"), "_v", "_norm")))
    blocks = placed.groupBy(F.floor((F.col("_no") - 1) / F.lit(block)).alias("block")).agg(entries.alias("_e")).select(
        "block", F.get("_e._no", F.lit(0)).alias("first"), F.col("_e._k").alias("names"), F.col("_e._norm").alias("norms"),
        F.array_distinct(F.transform("_e._v", F.size)).alias("dims"), F.flatten("_e._v").alias("values"))
    n = -(-(placed.agg(F.max("_no")).first()[0] or 0) // block)
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, -(-n // QUERY_BLOCKS), min(n, 4 * math.isqrt(tasks)))      # of the query blocks
    query, base = (blocks.repartition(p).select(*[F.col(c).alias(f"{side}{c}") for c in blocks.columns])
                   for side, p in (("q_", parts), ("b_", max(1, min(n, tasks // parts)))))
    kind = T.StructType([T.StructField(key, placed.schema[key].dataType), T.StructField("neighbour", placed.schema[key].dataType),
                         T.StructField("similarity", T.DoubleType())])
    # the right side is held by a task, the left side passes through it
    found = base.hint("shuffle_replicate_nl").crossJoin(query).mapInArrow(_best_of_blocks(k, digits, kind.names), kind)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("similarity").desc(), "neighbour"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(key, "rank", "neighbour", "similarity")
