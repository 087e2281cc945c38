import os
import tempfile

import pytest
from pyspark.sql import functions as F

from logweave.operators import files as FL
from logweave.operators import models as MD
from logweave.operators import similarity as SM
from logweave.session import scratch_path
from logweave.sources.text import read_dictionary, read_log_text, read_program_list
from tests.conftest import SF_SMALL, rows


def _separable(spark, n=400):
    # label 1 when the first feature outweighs the second: linearly separable
    data = [(float(i % 7 > 3), [float(i % 7), 3.5, float(i % 5)]) for i in range(n)]
    df = spark.createDataFrame(data, "label double, arr array<double>")
    from pyspark.ml.functions import array_to_vector
    return df.select("label", array_to_vector("arr").alias("features"))


@pytest.mark.parametrize("make", [lambda: MD.linear_svm(100), MD.logistic_regression, lambda: MD.decision_tree(5, 32)])
def test_models_beat_majority(spark, make):
    data = _separable(spark)
    majority = max(data.where("label = 1").count(), data.where("label = 0").count()) / data.count()
    _, m = MD.fit_and_evaluate(make(), data)
    r = m.first()
    assert r.n == 400 and r.tp + r.tn + r.fp + r.fn == 400
    assert 1 - r.error > majority


def test_tree_is_deterministic(spark):
    data = _separable(spark)
    a = MD.fit_and_evaluate(MD.decision_tree(), data)[1].first()
    b = MD.fit_and_evaluate(MD.decision_tree(), data)[1].first()
    assert a == b


def test_word2vec_shape_and_synonyms(spark):
    from logweave.plans import catalog
    emb = catalog.QUERIES["template_embeddings"](spark, SF_SMALL)
    got = emb.collect()
    assert len(got) == 15 and all(len(r.vector) == 50 for r in got)
    syn = catalog.QUERIES["template_synonyms"](spark, SF_SMALL).collect()
    assert len(syn) == 5 and all(-1.0 <= r.similarity <= 1.0 + 1e-6 for r in syn)


def test_sentences_are_cut_by_position_within_the_host(spark):
    lines = spark.createDataFrame([(i, "ab"[i % 3 == 0], f"t{i}") for i in range(1, 31)], "line_id long, host string, template string")
    got = {(r.host, r.piece): r.sentence for r in MD.sentences(lines, max_len=8).collect()}
    assert {k: len(v) for k, v in got.items()} == {("a", 0): 8, ("a", 1): 8, ("a", 2): 4, ("b", 0): 8, ("b", 1): 2}
    assert got["b", 0] == [f"t{i}" for i in range(3, 27, 3)] and got["b", 1] == ["t27", "t30"]
    assert MD.word2vec().getNumPartitions() > 1


def test_similar_vectors_excludes_query(spark):
    vecs = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (3, [-1.0, 0.0])],
                                 "vec_id long, embedding array<float>")
    got = SM.similar_vectors(vecs, 0, 2).collect()
    assert [r.vec_id for r in got] == [1, 2]
    assert got[0].similarity == pytest.approx(0.995037, abs=1e-6)


def test_text_source_numbers_in_file_order(spark):
    d = tempfile.mkdtemp(prefix="lw-text-")
    with open(os.path.join(d, "messages-a"), "w") as f:
        f.write("\n".join(f"line a{i}" for i in range(1, 6)) + "\n")
    with open(os.path.join(d, "messages-b"), "w") as f:
        f.write("\n".join(f"line b{i}" for i in range(1, 4)) + "\n")
    with open(os.path.join(d, "op"), "w") as f:
        f.write("cvcd\n-\n--  \nerd\n")
    got = rows(read_log_text(spark, os.path.join(d, "messages-*")), "line_id", "line")
    assert got == [(i + 1, t) for i, t in enumerate([f"line a{i}" for i in range(1, 6)] + [f"line b{i}" for i in range(1, 4)])]
    assert sorted(r.program for r in read_program_list(spark, os.path.join(d, "op")).collect()) == ["-", "--", "cvcd", "erd"]


def test_split_and_compact(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else "cold", f"l{i}") for i in range(1, 301)],
                               "line_id long, program string, line string")
    progs = spark.createDataFrame([("hot",)], "program string")
    path = FL.split_by_program(df, progs, scratch_path(spark, "t-split"))
    back = spark.read.parquet(path)
    assert back.count() == 200 and rows(back.select("program").distinct()) == [("hot",)]
    out = FL.compact(df, "program", scratch_path(spark, "t-compact"), rows_per_file=50, order="line_id")
    counts = {r.program: (r.n_lines, r.n_files) for r in FL.file_counts(spark, out, "program").collect()}
    assert counts["hot"][0] == 200 and counts["cold"][0] == 100
    assert counts["hot"][1] >= 4          # a big key is written as several files
    assert all(r.largest <= 50 for r in FL.file_counts(spark, out, "program").collect())


def test_sinks_round_trip(spark):
    from logweave.operators import evaluation as EV
    labels = spark.createDataFrame([(1, 1), (0, 0), (0, 1), (1, 0), (1, 1)], "label int, prediction int")
    metrics = EV.with_rates(EV.confusion_matrix(labels))
    mpath = FL.write_metrics(metrics, scratch_path(spark, "t-metrics"))
    back = spark.read.json(mpath).first()
    assert (back.tp, back.tn, back.fp, back.fn) == (2, 1, 1, 1)
    with pytest.raises(Exception):                       # K1 semantics: an existing result is not overwritten
        FL.write_metrics(metrics, mpath)
    d = spark.createDataFrame([("a *", 0), ("b mem_addr", 1)], "template string, idx int")
    dpath = FL.write_dictionary(d, scratch_path(spark, "t-dict"))
    assert rows(read_dictionary(spark, dpath)) == [("a *", 0), ("b mem_addr", 1)]
    rpath = FL.write_result(d, scratch_path(spark, "t-result"))
    assert rows(spark.read.parquet(rpath)) == rows(d)
    tpath = FL.write_text(spark, "If (feature 1 <= 0.5)\n Predict: 0.0", scratch_path(spark, "t-tree"))
    assert [r.value for r in spark.read.text(tpath).collect()] == ["If (feature 1 <= 0.5)", " Predict: 0.0"]
