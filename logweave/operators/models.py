"""Models on ``pyspark.ml`` (M1-M11): the solvers are Spark's own.

Features come from the long-form window frequencies as sparse vectors: an entry
per distinct template of a window.
"""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .evaluation import confusion_matrix, with_rates
from .features import sparse_features
from .numbering import number_rows


def labelled_vectors(training_long: DataFrame, size, keys=("kind", "ws", "we", "label")) -> DataFrame:
    """M4: ``(kind, ws, we, label, idx, freq)`` -> ``(kind, ws, we, label, features)``, written once."""
    return sparse_features(training_long, list(keys), size)


def mean_vectors(means: DataFrame, keys: list[str]) -> DataFrame:
    """Window means -> one dense vector ``features`` per window (embedding size).

    ``means``: long form ``(*keys, pos, val)``, or packed ``(*keys, mean)`` as
    :func:`features.window_mean_vector` gives without ``long``.
    """
    if "mean" in means.columns:
        return means.select(*keys, array_to_vector("mean").alias("features"))
    entries = F.sort_array(F.collect_list(F.struct("pos", "val")))
    packed = means.groupBy(*keys).agg(entries.alias("_e"))
    return packed.select(*keys, array_to_vector(F.col("_e.val")).alias("features"))


def linear_svm(max_iter: int = 100) -> LinearSVC:
    """M5: linear SVM, 100 iterations (OWLQN here; the coefficients differ from SGD)."""
    return LinearSVC(maxIter=max_iter, featuresCol="features", labelCol="label")


def logistic_regression() -> LogisticRegression:
    """M6: logistic regression with L-BFGS and default settings."""
    return LogisticRegression(featuresCol="features", labelCol="label")


def decision_tree(max_depth: int = 5, max_bins: int = 32) -> DecisionTreeClassifier:
    """M7: two classes, gini impurity, depth 5, 32 bins, no categorical features."""
    return DecisionTreeClassifier(impurity="gini", maxDepth=max_depth, maxBins=max_bins,
                                  featuresCol="features", labelCol="label", seed=42)


def fit_and_evaluate(estimator, train: DataFrame, test: DataFrame | None = None):
    """Fit on ``train``, predict ``test`` (default: ``train``), return (model, metrics row).

    The solvers pass over their input many times: it should be read from a
    table, as :func:`labelled_vectors` gives it, so that no pass recomputes the
    window pipeline and a lost executor does not either.
    """
    model = estimator.fit(train)
    return model, with_rates(confusion_matrix(model.transform(train if test is None else test)))


def tree_description(model) -> str:
    """Text form of a fitted tree."""
    return model.toDebugString


def sentences(masked: DataFrame, group: str = "host", order: str = "line_id",
              max_len: int = 1000) -> DataFrame:
    """Word2Vec input ``(group, piece, sentence)``: a group's templates in ``order``, cut
    after every ``max_len`` of its own lines (where Word2Vec cuts a sentence anyway).

    Lines are numbered by (group, order) over all tasks; a line's position is its
    number less its group's first, so a group of any size is spread and every
    ``collect_list`` is bounded by ``max_len``.
    """
    numbered = number_rows(masked.select(group, order, "template"), [group, order], name="_no")
    first = numbered.groupBy(group).agg(F.min("_no").alias("_first"))
    placed = numbered.join(first, group).withColumn("_at", F.col("_no") - F.col("_first"))
    grouped = placed.groupBy(group, F.floor(F.col("_at") / max_len).alias("piece")).agg(
        F.sort_array(F.collect_list(F.struct("_at", "template"))).alias("_items"))
    return grouped.select(group, "piece", F.transform("_items", lambda x: x["template"]).alias("sentence"))


def word2vec(size: int = 50, seed: int = 42, min_count: int = 1, max_len: int = 1000,
             partitions: int = 4, iterations: int = 4) -> Word2Vec:
    """M1: template embedding; each template is a word, each sentence a log piece.

    ``partitions`` tasks train on their share of the sentences and are averaged
    after each of ``iterations`` passes (no more passes than partitions, as Spark
    advises); :func:`fit_word2vec` takes the partitions from the corpus.
    """
    return Word2Vec(vectorSize=size, seed=seed, minCount=min_count, maxSentenceLength=max_len,
                    numPartitions=partitions, maxIter=iterations, inputCol="sentence", outputCol="vec")


def fit_word2vec(sentences: DataFrame, size: int = 50, seed: int = 42, min_count: int = 1, per_task: int = 2000):
    """M1 on ``sentences``, written once: a task for every ``per_task`` pieces, four at least."""
    sentences = written(sentences, "sentences")
    partitions = max(4, -(-sentences.count() // per_task))
    return word2vec(size, seed, min_count, partitions=partitions).fit(sentences)


def embedding_table(model) -> DataFrame:
    """M2: ``(word, vector array<float>)``."""
    return model.getVectors().select("word", vector_to_array("vector", "float32").alias("vector"))


def synonyms(model, word: str, k: int = 5) -> DataFrame:
    """M3: the ``k`` nearest words by cosine similarity (the word itself left out)."""
    return model.findSynonyms(word, k).select("word", "similarity")
