import pytest
from pyspark.sql import functions as F

from logweave.operators import evaluation as EV
from logweave.operators import features as FT
from logweave.operators import labels as LB
from logweave.operators import templates as TP
from logweave.session import written
from tests.conftest import rows


def test_frequencies_and_oov(spark):
    contents = spark.createDataFrame([(1, "a", 3), (1, "b", 1), (1, "zz", 4), (2, "a", 2)],
                                     "win long, template string, cnt long")
    d = spark.createDataFrame([("a", 0), ("b", 1)], "template string, idx int")
    got = rows(FT.window_frequencies(contents, ["win"], d, "skip"), "win", "idx", "freq")
    assert got == [(1, 0, 0.75), (1, 1, 0.25), (2, 0, 1.0)]     # OOV out of both sides
    with pytest.raises(Exception):
        FT.window_frequencies(contents, ["win"], d, "error").collect()


def test_mean_vector_weighted(spark):
    contents = spark.createDataFrame([(1, 0, 3), (1, 1, 1), (1, 9, 5)], "win long, idx int, cnt long")
    vectors = FT.vector_dictionary(spark.createDataFrame(
        [(0, [1.0, 0.0]), (1, [0.0, 2.0])], "vec_id long, embedding array<float>"))
    got = rows(FT.window_mean_vector(contents, ["win"], vectors), "pos", "val")
    assert got == [(0, 0.75), (1, 0.5)]
    assert rows(FT.missing_vectors(contents, vectors)) == [(9, 5)]
    with pytest.raises(Exception):
        FT.window_mean_vector(contents, ["win"], vectors, oov="error").collect()


def test_sparse_features(spark):
    freqs = spark.createDataFrame([(1, 2, 0.5), (1, 0, 0.5)], "win long, idx int, freq double")
    got = FT.sparse_features(freqs, ["win"], 4).first().features
    assert got.size == 4 and got.indices.tolist() == [0, 2] and got.values.tolist() == [0.5, 0.5]


def test_sparse_features_without_python(spark, capsys):
    freqs = spark.createDataFrame([("b", 1, 3, 0.25), ("b", 1, 1, 0.75), ("a", 1, 0, 1.0), ("a", None, 2, 1.0)], "kind string, win long, idx int, freq double")
    found = FT.sparse_features(freqs, ["kind", "win"], F.lit(4))
    found.explain()
    assert "Python" not in capsys.readouterr().out
    assert found.columns == ["kind", "win", "features"]
    got = {(r.kind, r.win): (r.features.size, r.features.indices.tolist(), r.features.values.tolist()) for r in found.collect()}
    assert got == {("b", 1): (4, [1, 3], [0.75, 0.25]), ("a", 1): (4, [0], [1.0]), ("a", None): (4, [2], [1.0])}
    with pytest.raises(Exception):                          # a number past the size
        FT.sparse_features(freqs, ["kind", "win"], 3).collect()


def test_count_window_labels(spark):
    lines = spark.createDataFrame([(i, "x error y" if i in (1, 7, 15) else "a") for i in range(1, 16)], "line_id long, template string")
    from logweave.operators import windows as WN
    fixed = LB.labeled_count_windows(WN.count_window_contents(lines, 5), lines, " error ", 5, "fixed")
    assert rows(fixed) == [(1, 1.0), (2, 1.0), (3, 0.0)]        # line 7 is in window 2, line 15 in window 3, nothing is before window 1
    sliding = LB.labeled_count_windows(WN.count_window_contents(lines, 5, "sliding"), lines, " error ", 5, "sliding")
    assert [w for w, y in rows(sliding) if y] == [2, 10]


def test_labels_exact_and_horizon(spark):
    windows = spark.createDataFrame([(0, 0, 5), (1, 5, 10), (2, 10, 15)], "win long, ws long, we long")
    masked = spark.createDataFrame([(10, "x error y", 1)], "t long, template string, cnt long")
    exact = rows(LB.labeled_windows(windows, masked, " error ", 5), "win", "label")
    assert exact == [(0, 0.0), (1, 1.0), (2, 0.0)]
    horizon = rows(LB.labeled_windows(windows, masked, " error ", 5, mode="horizon", horizon=6),
                   "win", "label")
    assert horizon == [(0, 1.0), (1, 0.0), (2, 0.0)]


def test_confusion_fixture(spark):
    pairs = spark.createDataFrame([(1.0, 1.0), (0.0, 0.0), (0.0, 1.0), (1.0, 0.0), (1.0, 0.0)],
                                  "label double, prediction double")
    r = EV.with_rates(EV.confusion_matrix(pairs)).first()
    assert (r.tp, r.tn, r.fp, r.fn, r.n) == (1, 1, 1, 2, 5)
    assert r.error == pytest.approx(0.6)
    assert r.precision == pytest.approx(0.5) and r.recall == pytest.approx(1 / 3)


def test_equal_windows_share_one_mean(spark):
    # 300 windows of three contents: vectors meet three rows, whatever the windows
    contents = [(w, i, 1 + (w % 3) * i) for w in range(300) for i in (0, 1)] + [(300, 9, 1)]
    frame = spark.createDataFrame(contents, "win long, idx int, cnt long")
    vectors = spark.createDataFrame([(0, [1.0, -2.0]), (1, [4.0, 0.0])], "idx int, vec array<double>")
    got = {}
    for r in FT.window_mean_vector(frame, ["win"], vectors).collect():
        got.setdefault(r.win, {})[r.pos] = r.val
    assert sorted(got) == list(range(300))               # window 300 has no vector
    for w, v in got.items():
        c = 1 + w % 3
        assert v == {0: round((1 + 4 * c) / (1 + c), 6), 1: round(-2 / (1 + c), 6)}
    packed = FT.window_mean_vector(frame, ["win"], vectors, digits=None, long=False)
    assert packed.columns == ["win", "mean"] and packed.count() == 300
    assert packed.select("mean").distinct().count() == 3


def plan_of(df, capsys):
    got = rows(df)
    df.explain()
    return got, capsys.readouterr().out.split("Initial Plan")[0]


def test_joins_never_send_the_larger_table(spark, capsys):
    # 20000 lines of three templates: fewer bytes on disk than the plan expects of their dictionary
    log = written(spark.range(20000).select(F.lit("h").alias("host"), F.concat(F.lit("t"), F.col("id") % 3).alias("template")), "log")
    got, plan = plan_of(FT.with_index(log, TP.template_dictionary(TP.template_counts(log))).groupBy("idx").count(), capsys)
    assert got == [(0, 6666), (1, 6667), (2, 6667)]
    assert "BuildRight" in plan and "BuildLeft" not in plan
    # windows of three contents, whose means take more bytes than all windows
    contents = spark.range(3000).select("id", (F.col("id") % 3).cast("int").alias("idx"), F.lit(1).alias("cnt"))
    vectors = spark.createDataFrame([(i, [i + p / 7 for p in range(2000)]) for i in range(3)], "idx int, vec array<double>")
    got, plan = plan_of(FT.window_mean_vector(contents, ["id"], vectors, long=False).select("id", F.get("mean", F.lit(0)).alias("first")), capsys)
    assert got == [(i, float(i % 3)) for i in range(3000)]
    assert "BuildRight" in plan and "BuildLeft" not in plan


def test_tables_past_the_limit_are_not_sent(spark, capsys):
    large = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "zz")], "id int, name string")
    small = spark.createDataFrame([("a", [1, 2], [("x", 1)]), ("b", None, []), (None, [], None)],
                                  "name string, numbers array<int>, pairs array<struct<s:string,n:int>>")
    for most in (0, 1 << 20):
        got, plan = plan_of(FT.join_smaller(large, small, "name", "left", most).select("id", "numbers"), capsys)
        assert got == [(1, [1, 2]), (2, None), (3, None), (4, None)]
        assert ("Broadcast" in plan) == bool(most) and ("SortMergeJoin" in plan) != bool(most)
    assert rows(FT.join_smaller(large, small, "name", most=0), "id") == [(1,), (2,)]
