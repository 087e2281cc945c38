"""Window features (A7, A8, J4): template frequencies and mean embeddings, in long form.

Window contents arrive aggregated as ``(<window key>, template, cnt)``; the
dictionary join and all arithmetic work on that, never on per-line lists.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructField, StructType

from ..session import written

SENT_BYTES = 1 << 24      # of a table in memory that a join sends to every task


def _bytes(value: Column, kind: DataType) -> Column:
    """About the bytes of a value in a row in memory."""
    if isinstance(kind, StringType | BinaryType):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + 16
    if isinstance(kind, StructType):
        return sum((_bytes(value[f.name], f.dataType) for f in kind), F.lit(16).cast("long"))
    if isinstance(kind, ArrayType):
        if not isinstance(kind.elementType, StringType | BinaryType | StructType | ArrayType):
            return F.coalesce(F.size(value), F.lit(0)).cast("long") * 8 + 24
        each = F.aggregate(value, F.lit(0).cast("long"), lambda acc, x: acc + _bytes(x, kind.elementType))
        return F.coalesce(each, F.lit(0).cast("long")) + 24
    return F.lit(8).cast("long")


def join_smaller(large: DataFrame, small: DataFrame, on: str, how: str = "inner", most: int = SENT_BYTES) -> DataFrame:
    """Join with a table that has a row per key, at most as many as ``large``.

    Spark goes by the size of a table's files, where texts and contents that repeat are kept once:
    a log of millions of lines can seem smaller there than its dictionary, and then all of it goes through
    the driver to every task.  Here the bytes of ``small`` in memory are summed up (one row reaches the
    driver): ``most`` of them at most are sent, else both sides are shuffled.  ``large`` is never sent.
    """
    held = sum((_bytes(F.col(f.name), f.dataType) for f in small.schema), F.lit(16).cast("long"))
    sent = (small.agg(F.sum(held)).first()[0] or 0) <= most
    return large.join(F.broadcast(small) if sent else small.hint("merge"), on, how)


def with_index(contents: DataFrame, dictionary: DataFrame, oov: str = "skip") -> DataFrame:
    """Attach ``idx`` from the dictionary.

    ``skip``: templates outside the dictionary are left out (of numerators and
    denominators alike).  ``error``: the query fails when one is met.
    """
    if oov == "skip":
        return join_smaller(contents, dictionary, "template")
    if oov == "error":
        joined = join_smaller(contents, dictionary, "template", "left")
        check = F.when(F.col("idx").isNull(),
                       F.raise_error(F.concat(F.lit("template not in dictionary: "), F.col("template"))))
        return joined.withColumn("idx", F.coalesce(F.col("idx"), check.cast("int")))
    raise ValueError("oov must be 'skip' or 'error'")


def window_frequencies(contents: DataFrame, keys: list[str], dictionary: DataFrame | None = None,
                       oov: str = "skip") -> DataFrame:
    """Mean one-hot vector of a window = relative frequency of each template.

    ``freq = cnt / sum(cnt) over the window``; one division of integers.  The
    window partition holds at most one row per distinct template.
    """
    if dictionary is not None:
        contents = with_index(contents, dictionary, oov)
    total = F.sum("cnt").over(Window.partitionBy(*keys))
    return contents.withColumn("freq", F.col("cnt") / total)


def vector_dictionary(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Vector dictionary ``(idx, vec array<double>)``."""
    return embeddings.select(F.col(key).cast("int").alias("idx"), F.col(vector).cast("array<double>").alias("vec"))


def window_mean_vector(contents: DataFrame, keys: list[str], vectors: DataFrame,
                       digits: int | None = 6, oov: str = "skip", long: bool = True) -> DataFrame:
    """Element-wise mean of template vectors, weighted by line count.

    ``contents``: ``(*keys, idx, cnt)``; ``vectors``: ``(idx, vec)``.  Templates
    without a vector follow ``oov``: ``skip`` leaves them out of both sides of
    the mean, ``error`` fails the query (:func:`missing_vectors` lists them).
    Windows are packed to their sorted entries first, and windows with equal
    entries share one mean: vectors meet each distinct content once, not every
    window.  Returns ``(*keys, pos, val)``, or ``(*keys, mean)`` without ``long``.
    """
    entries = F.sort_array(F.collect_list(F.struct("idx", "cnt")))
    windows = written(contents.groupBy(*keys).agg(entries.alias("_e")), "contents")
    means = _content_means(windows.select("_e").distinct(), vectors, oov)
    if digits is not None:
        # + 0.0 turns -0.0 into 0.0
        means = means.withColumn("mean", F.transform("mean", lambda x: F.round(x, digits) + F.lit(0.0)))
    found = join_smaller(windows, written(means, "means"), "_e").drop("_e")
    return found.select(*keys, F.posexplode("mean").alias("pos", "val")) if long else found


def _content_means(distinct: DataFrame, vectors: DataFrame, oov: str) -> DataFrame:
    """``(_e, mean array<double>)`` of every distinct content ``_e`` with a vector."""
    contents = distinct.select("_e", F.explode("_e").alias("_x")).select("_e", "_x.idx", "_x.cnt")
    if oov == "error":
        contents = contents.join(vectors, "idx", "left")
        fail = F.raise_error(F.concat(F.lit("no vector for template "), F.col("idx").cast("string")))
        contents = contents.withColumn("vec", F.coalesce("vec", fail.cast("array<double>")))
    elif oov == "skip":
        contents = contents.join(vectors, "idx")
    else:
        raise ValueError("oov must be 'skip' or 'error'")
    mean = Summarizer.mean(array_to_vector("vec"), F.col("cnt").cast("double"))
    return contents.groupBy("_e").agg(vector_to_array(mean).alias("mean"))


def missing_vectors(contents: DataFrame, vectors: DataFrame) -> DataFrame:
    """Report of templates without a vector: ``(idx, cnt)``."""
    return (contents.groupBy("idx").agg(F.sum("cnt").alias("cnt"))
            .join(vectors.select("idx"), "idx", "left_anti"))


def coverage(counts: DataFrame, dictionary: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """J4, M10 report: how much of a log ``(*keys, template, cnt)`` a dictionary knows.

    ``(*keys, lines, known_lines, templates, known_templates, line_share)``; the rest is what ``oov="skip"`` leaves out.
    """
    known = dictionary.select("template", F.lit(1).alias("_known"))
    per = counts.groupBy(*keys, "template").agg(F.sum("cnt").alias("cnt")).join(known, "template", "left")
    has = F.col("_known").isNotNull()
    out = per.groupBy(*keys).agg(
        F.sum("cnt").alias("lines"), F.coalesce(F.sum(F.when(has, F.col("cnt"))), F.lit(0)).alias("known_lines"),
        F.count(F.lit(1)).alias("templates"), F.count_if(has).alias("known_templates"))
    return out.withColumn("line_share", F.col("known_lines") / F.col("lines"))


def sparse_features(freqs: DataFrame, keys: list[str], size) -> DataFrame:
    """M4 edge: long-form ``(*keys, idx, freq)`` -> one sparse vector ``features`` per window.

    A window holds an entry per distinct template in it, whatever the dictionary
    has.  The vector type has no SQL constructor, but it is stored as a struct:
    the windows are written once in that form and read back as vectors, so no
    row passes through Python.  Reading checks that a window's numbers rise and
    lie below ``size``.
    """
    entries = F.sort_array(F.collect_list(F.struct("idx", "freq")))
    n = F.lit(size) if isinstance(size, int) else size
    # numbers first: the aggregate sorts by its keys in turn, and texts often tie
    texts = {k for k, kind in freqs.dtypes if kind == "string"}
    packed = freqs.groupBy(*sorted(keys, key=lambda k: k in texts)).agg(entries.alias("_e"))
    parts = F.struct(F.lit(0).cast("tinyint").alias("type"), n.cast("int").alias("size"),      # 0: sparse
                     F.col("_e.idx").alias("indices"), F.col("_e.freq").alias("values"))
    stored = packed.select(*keys, parts.alias("features"))
    return written(stored, "vectors", StructType([*stored.schema.fields[:-1], StructField("features", VectorUDT())]))
