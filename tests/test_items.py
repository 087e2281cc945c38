"""Windows within controllers, calendar labels, coverage, file sentences and all nearest vectors against plain loops."""

import contextlib
import math
import os
import random
import re
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweave.operators import features as FT
from logweave.operators import labels as LB
from logweave.operators import sentences as SN
from logweave.operators import similarity as SM
from logweave.operators import windows as WN
from logweave.sources import text
from tests.conftest import rows

TARGET = " error "


# ---- calendar labels -------------------------------------------------------------------------

def test_calendar_labels_look_into_the_next_day(spark):
    rng = random.Random(4)
    start = datetime(2024, 12, 30, 1, 0)
    log = [(start + timedelta(minutes=rng.randrange(5000)), "a error b" if rng.random() < 0.1 else "fine") for _ in range(120)]
    log += [(datetime(2024, 12, 31, 22, 5), "fine"), (datetime(2025, 1, 1, 0, 30), "a error b")]
    masked = spark.createDataFrame(log, "ts timestamp_ntz, template string")
    got = rows(LB.labeled_calendar_windows(WN.calendar_window_contents(masked, "hour", 3), masked, TARGET, "hour", 3))

    def window(t):
        return datetime(t.year, t.month, t.day), t.hour // 3 + 1

    hit = {window(t - timedelta(hours=3)) for t, x in log if TARGET in x}
    want = sorted((*w, 1.0 if w in hit else 0.0) for w in {window(t) for t, _ in log})
    assert got == want and any(label for day, code, label in want if code == 8)


# ---- count windows within controllers ------------------------------------------------------------

def host_log(spark):
    rng = random.Random(6)
    lines = [(rng.choice(["h1", "h1", "h1", "h2", "h3"]), "x error y" if rng.random() < 0.2 else f"t{rng.randrange(3)}") for _ in range(150)]
    numbered, at = [], Counter()
    for h, t in lines:
        at[h] += 1
        numbered.append((h, at[h], t))
    return numbered, spark.createDataFrame(numbered, "host string, x long, template string")


@pytest.mark.parametrize("kind", ["fixed", "sliding"])
def test_count_windows_within_hosts(spark, kind):
    lines, df = host_log(spark)
    w = 5
    codes = (lambda x: [-(-x // w)]) if kind == "fixed" else (lambda x: [x] if x < w else range(x - w + 1, x))
    want = Counter((h, c, t) for h, x, t in lines for c in codes(x))
    contents = WN.count_window_contents(df, w, kind, x="x", keys=("host",))
    assert rows(contents, "host", "win", "template", "cnt") == sorted((*k, n) for k, n in want.items())
    hit = {(h, -(-x // w) - 1 if kind == "fixed" else x - w) for h, x, t in lines if TARGET in t}
    got = rows(LB.labeled_count_windows(contents, df, TARGET, w, kind, "x", ("host",)), "host", "win", "label")
    assert got == sorted((h, c, 1.0 if (h, c) in hit else 0.0) for h, c in {k[:2] for k in want})


# ---- vocabulary of the training side ---------------------------------------------------------------

def test_coverage_counts_unseen_templates(spark):
    counts = spark.createDataFrame([("train", 1, "a", 4), ("train", 2, "b", 1), ("test", 1, "a", 3), ("test", 5, "a", 2), ("test", 6, "new", 5), ("test", 7, "rare", 1)],
                                   "side string, t long, template string, cnt long")
    known = spark.createDataFrame([("a", 1), ("b", 0)], "template string, idx int")
    assert rows(FT.coverage(counts, known, ("side",))) == [("test", 11, 5, 3, 1, 5 / 11), ("train", 5, 5, 2, 2, 1.0)]
    assert rows(FT.coverage(counts, known.where("idx > 5"))) == [(16, 0, 4, 0, 0.0)]
    # what is unseen has no feature: it is left out of numerator and denominator
    freqs = FT.window_frequencies(counts.where("side = 'test'"), ["side"], known)
    assert sum(r.freq for r in freqs.collect()) == 1.0 and {r.template for r in freqs.collect()} == {"a"}


def test_missing_vectors_of_a_whole_table(spark):
    contents = spark.createDataFrame([(0, 3), (1, 2), (1, 4), (7, 1)], "idx int, cnt long")
    vectors = spark.createDataFrame([(0, [1.0]), (5, [2.0])], "idx int, vec array<double>")
    assert rows(FT.missing_vectors(contents, vectors)) == [(1, 6), (7, 1)]


# ---- file sentences ---------------------------------------------------------------------------------

FILES = {"a.log": "one 1\ntwo 0xff\n\nthree\n", "b.log": "no end", "c.log": "", "d.log": "\n", "e.log": "cr\r\nlf\n",
         "f.log": "".join(f"line {i} of a longer file é\n" for i in range(900)) + "last"}


@pytest.mark.parametrize("split", ["64b", "1g"])
def test_file_lines_equal_split_at_line_feeds(spark, tmp_path, split):
    for name, content in FILES.items():
        (tmp_path / name).write_bytes(content.encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    size = "2048b" if split == "64b" else "1g"
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = {}
        for r in text.read_file_lines(spark, f"{tmp_path}/*.log").collect():
            got.setdefault(os.path.basename(r.path), {})[r.pos] = r.line
        numbered = [(r.line_id, r.line) for r in text.read_log_text(spark, f"{tmp_path}/[ab].log").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    full = {name: content for name, content in FILES.items() if content}
    assert set(got) == set(full), "an empty file has no lines"
    for name, content in full.items():
        assert [got[name][i] for i in sorted(got[name])] == content.split("\n"), name
        assert sorted(got[name]) == list(range(1, len(got[name]) + 1))
    assert sorted(numbered) == list(enumerate(["one 1", "two 0xff", "", "three", "no end"], 1))


def test_file_sentences_are_cut(spark):
    lines = spark.createDataFrame([("f", i, f"n {i % 4} 0x{i:x}") for i in range(1, 24)] + [("f", 24, ""), ("g", 1, "")], "path string, pos long, line string")
    got = {(r.path, r.piece): r.sentence for r in SN.file_sentences(lines, 10).collect()}
    assert {k: len(v) for k, v in got.items()} == {("f", 0): 10, ("f", 1): 10, ("f", 2): 4, ("g", 0): 1}
    assert got["f", 2][-1] == "" and got["f", 0][0] == "n * mem_addr"


def test_word2vec_tasks_follow_the_corpus(spark):
    from logweave.operators import models as MD
    pieces = spark.createDataFrame([(i, [f"t{i % 5}", "x", f"t{i % 3}"]) for i in range(25)], "piece int, sentence array<string>")
    assert [MD.fit_word2vec(pieces, size=4, per_task=n).getNumPartitions() for n in (5, 2000)] == [5, 4]


# ---- nearest vectors ---------------------------------------------------------------------------------

@pytest.mark.parametrize("block", [3, 7, 1000])
def test_nearest_vectors_equal_all_pairs(spark, block):
    rng = random.Random(8)
    vecs = {i: [rng.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(4)] for i in rng.sample(range(100), 33)}
    vecs |= {200: [0.0] * 4, 201: list(vecs[min(vecs)])}
    got = {}
    for r in SM.nearest_vectors(spark.createDataFrame(list(vecs.items()), "vec_id long, embedding array<float>"), 4, block=block).collect():
        got.setdefault(r.vec_id, {})[r.rank] = (r.neighbour, r.similarity)

    def cos(a, b):
        return round(sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b)), 6) + 0.0

    real = {i: v for i, v in vecs.items() if any(v)}
    assert set(got) == set(real)
    for i, v in real.items():
        want = sorted(((-cos(v, u), j) for j, u in real.items() if j != i))[:4]
        assert [got[i][r] for r in (1, 2, 3, 4)] == [(j, -s + 0.0) for s, j in want]


def test_nearest_vectors_small_tables_and_words(spark):
    assert SM.nearest_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    words = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [2.0, 0.1]), ("c", [0.0, 3.0])], "word string, vector array<float>")
    got = rows(SM.nearest_vectors(words, 1, key="word", vector="vector").select("word", "neighbour"))
    assert got == [("a", "b"), ("b", "a"), ("c", "b")]
    assert SM.nearest_vectors(words.where(F.col("word") == "a"), 5, key="word", vector="vector").count() == 0


@contextlib.contextmanager
def dealt_over(spark, n):
    """Exchanges of ``n`` partitions that stay apart."""
    conf = {"spark.sql.shuffle.partitions": str(n), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {name: spark.conf.get(name) for name in conf}
    for name, value in conf.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)


@pytest.mark.parametrize("ties", [False, True])
def test_nearest_vectors_over_many_tasks(spark, ties):
    rng = random.Random(5)
    vecs = {i: [rng.choice([1.0, 2.0]) if ties else rng.gauss(0, 1) for _ in range(3)] for i in range(60)}
    frame = spark.createDataFrame([*vecs.items()], "vec_id long, embedding array<float>")
    with dealt_over(spark, 7):
        got = {(r.vec_id, r["rank"]): (r.neighbour, r.similarity) for r in SM.nearest_vectors(frame, 4, block=5).collect()}

    def cos(a, b):
        a, b = (np.array(v, dtype=np.float32).astype(float) for v in (a, b))
        return round(float(a @ b / math.sqrt((a @ a) * (b @ b))), 6) + 0.0

    for i in vecs:
        want = sorted((-cos(vecs[i], vecs[j]), j) for j in vecs if j != i)[:4]
        assert [got[i, r] for r in (1, 2, 3, 4)] == [(j, -s + 0.0) for s, j in want]
    assert len(got) == 240


def test_nearest_vectors_shuffle_follows_the_vectors(spark, capsys):
    rng = random.Random(6)
    frame = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(400)], "vec_id long, embedding array<float>")

    def moved(block):
        found = SM.nearest_vectors(frame, 1, block=block)
        assert len(found.collect()) == 400
        found.explain("formatted")
        units = {"B": 1, "KiB": 1 << 10, "MiB": 1 << 20}
        plan = capsys.readouterr().out.split("Initial Plan")[0]
        return sum(float(x) * units[u] for x, u in re.findall(r"ShuffleQueryStage.*?sizeInBytes=([\d.]+) (\w+)", plan))

    assert moved(10) < 1.5 * moved(100)                      # 40 blocks and 4


def test_nearest_vectors_odd_rows(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [1.0, 0.2]), (3, [0.0, 1.0]), (4, None), (5, [math.nan, 1.0]), (6, [math.inf, 1.0])],
                                  "vec_id long, embedding array<double>")
    for block in (1, 2, 100):
        got = rows(SM.nearest_vectors(frame, 2, block=block).select("vec_id", "rank", "neighbour"))
        assert got == [(1, 1, 2), (1, 2, 2), (2, 1, 1), (2, 2, 1), (3, 1, 2), (3, 2, 1)]
    with pytest.raises(Exception, match="differ in length"):
        SM.nearest_vectors(spark.createDataFrame([(1, [1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")).collect()
