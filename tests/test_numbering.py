"""Distributed numbering and running sums against plain loops."""

import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from logweave.operators.numbering import number_within, running_totals, sums_before
from tests.conftest import rows


def test_number_within_groups(spark):
    rng = random.Random(1)
    data = [(rng.choice("aaaaaab"), x) for x in rng.sample(range(10_000), 700)]
    got = rows(number_within(spark.createDataFrame(data, "g string, x long"), ["g"], ["x"], name="pos"), "g", "x", "pos")
    want = []
    for g in "ab":
        want += [(g, x, n) for n, x in enumerate(sorted(x for h, x in data if h == g), 1)]
    assert got == sorted(want)


def test_running_totals_over_all_rows(spark):
    data = [(f"f{i % 13:02d}", i * 37 % 1000, i % 5) for i in range(500)]
    got = rows(running_totals(spark.createDataFrame(data, "p string, b long, n long"), ["p", "b"], "n", "before"), "p", "b", "n", "before")
    ordered = sorted(data)
    assert got == [(*r, s) for r, s in zip(ordered, accumulate([0] + [r[2] for r in ordered]))]


@pytest.mark.parametrize("stretch", [1, 4, 1000])
def test_sums_before_by_stretches(spark, stretch):
    rng = random.Random(2)
    data = [(g, o, rng.randrange(9)) for g in "xyz" for o in rng.sample(range(-40, 90), 60)]
    got = rows(sums_before(spark.createDataFrame(data, "g string, o long, v long"), ["g"], "o", "v", "s", stretch), "g", "o", "v", "s")
    assert got == sorted((g, o, v, sum(w for h, p, w in data if h == g and p < o)) for g, o, v in data)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "g string, o long, v long")
    assert number_within(none, ["g"], ["o"]).count() == 0
    assert running_totals(none, ["o"], "v", "s").count() == 0
    assert sums_before(none, ["g"], "o", "v", "s").where(F.lit(True)).count() == 0
