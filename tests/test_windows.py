from itertools import count, takewhile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logweave.operators import windows as WN
from logweave.operators.numbering import number_rows
from tests.conftest import rows


def _lines(spark, xs):
    return spark.createDataFrame([(x, f"T{x}") for x in xs], "line_id long, template string")


def test_sliding_count_windows_reference(spark):
    df = _lines(spark, range(1, 13))
    got = df.select("line_id", F.explode(WN.sliding_count_windows(F.col("line_id"), 5)).alias("win"))
    members = {}
    for x, w in got.collect():
        members.setdefault(w, set()).add(x)
    assert members[1] == {1, 5}
    assert members[2] == {2, 5, 6}
    assert members[3] == {3, 5, 6, 7}
    assert members[4] == {4, 5, 6, 7, 8}
    assert members[5] == {6, 7, 8, 9}


def test_sliding_count_windows_full(spark):
    df = _lines(spark, range(1, 8))
    got = df.select("line_id", F.explode(WN.sliding_count_windows(F.col("line_id"), 3, "full")).alias("win"))
    members = {}
    for x, w in got.collect():
        members.setdefault(w, set()).add(x)
    assert members[1] == {1, 2, 3} and members[5] == {5, 6, 7}


def test_fixed_count_windows(spark):
    df = _lines(spark, [1, 5, 6, 10, 11])
    got = rows(df.select("line_id", WN.fixed_count_window(F.col("line_id"), 5).alias("w")))
    assert [w for _, w in got] == [1, 1, 2, 2, 3]


def _time_log(spark, ts):
    return spark.createDataFrame([(i + 1, t, "x") for i, t in enumerate(ts)], "line_id long, t long, template string")


def by_definition(ts, w, s):
    """Every stretch of ``w`` seconds that begins a whole number of steps after the first
    line and is over by the last line is a window; what begins one step later is the
    last window and lasts until the last line.  Borders belong to a window."""
    first, last = ts[0], ts[-1]
    starts = list(takewhile(lambda a: a + w <= last, count(first, s)))
    spans = [(a, a + w) for a in starts] + [(first + len(starts) * s, last)]
    return {(k, *span, n) for n, t in enumerate(ts, 1) for k, span in enumerate(spans) if span[0] <= t <= span[1]}


def arithmetic(spark, ts, w, s):
    got = WN.assign_time_windows(_time_log(spark, ts), w, s)
    return set(tuple(r) for r in got.select("win", "ws", "we", "line_id").collect())


def test_time_windows_fixture(spark):
    got = arithmetic(spark, [0, 5, 7, 12], 5, 2)
    by_win = {}
    for win, ws, we, lid in got:
        by_win.setdefault((win, ws, we), set()).add(lid)
    assert by_win == {(0, 0, 5): {1, 2}, (1, 2, 7): {2, 3}, (2, 4, 9): {2, 3}, (3, 6, 11): {3}, (4, 8, 12): {4}}


def test_short_span(spark):
    assert arithmetic(spark, [0, 2], 5, 2) == {(0, 0, 2, 1), (0, 0, 2, 2)}


@settings(max_examples=15, deadline=None)
@given(ts=st.lists(st.integers(0, 200), min_size=1, max_size=25, unique=True),
       w=st.integers(0, 40), s=st.integers(1, 30))
def test_time_windows_match_their_definition(spark, ts, w, s):
    ts = sorted(ts)
    assert arithmetic(spark, ts, w, s) == by_definition(ts, w, s)


def test_target_windows(spark):
    masked = spark.createDataFrame(
        [(1, 4, "a"), (2, 5, "b"), (3, 9, "c"), (4, 10, "x error y"), (5, 10, "x error y")],
        "line_id long, t long, template string")
    sec = WN.per_second(masked)
    got = rows(WN.target_window_contents(sec, " error ", 5))
    assert got == [(5, 10, "b", 1), (5, 10, "c", 1), (5, 10, "x error y", 2)]
    open_end = rows(WN.target_window_contents(sec, " error ", 5, include_target=False))
    assert open_end == [(5, 10, "b", 1), (5, 10, "c", 1)]


def test_calendar_windows(spark):
    df = spark.sql("""SELECT 1L AS line_id, TIMESTAMP_NTZ'2024-01-01 05:59:59' AS ts, 'a' AS template
                      UNION ALL SELECT 2L, TIMESTAMP_NTZ'2024-01-02 05:00:00', 'a'""")
    got = rows(WN.calendar_window_contents(df, "hour", 3), "code", "cnt")
    assert got == [(2, 1), (2, 1)]     # same code on two days stays two windows


def test_number_rows_consecutive(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7 % 5003).alias("k"))
    got = number_rows(df, ["k"], name="n", partitions=6)
    ordered = [r.n for r in got.orderBy("k").collect()]
    assert ordered == list(range(1, 5001))


@pytest.mark.parametrize("w", [0, 1, 5, 7, 30])
@pytest.mark.parametrize("include_target", [True, False])
def test_target_windows_match_brute_force(spark, w, include_target):
    per_sec = [(t, "x" if t % 3 else "y error z", 1 + t % 4) for t in range(0, 120, 2)] + [(5, "y error z", 2)]
    counts = spark.createDataFrame(per_sec, "t long, template string, cnt long")
    got = rows(WN.target_window_contents(counts, " error ", w, include_target))
    targets = sorted({t for t, p, _ in per_sec if " error " in p})
    want = {}
    for t0 in targets:
        for t, p, c in per_sec:
            if t0 - w <= t and (t <= t0 if include_target else t < t0):
                want[(t0 - w, t0, p)] = want.get((t0 - w, t0, p), 0) + c
    assert got == sorted((ws, we, p, c) for (ws, we, p), c in want.items())


def test_target_windows_share_lines(spark):
    # every second a target and a hot template: windows overlap in all but one second
    per_sec = [(t, "hot", 3) for t in range(300)] + [(t, "an error here", 1) for t in range(300)] + [(-50, "old", 7), (40, "once", 2)]
    counts = spark.createDataFrame(per_sec, "t long, template string, cnt long")
    got = {(r.we, r.template): r.cnt for r in WN.target_window_contents(counts, " error ", 60).collect()}
    for t0 in range(300):
        span = range(max(t0 - 60, 0), t0 + 1)
        assert got.pop((t0, "hot")) == 3 * len(span) and got.pop((t0, "an error here")) == len(span)
    assert got == {**{(t0, "once"): 2 for t0 in range(40, 101)}, **{(t0, "old"): 7 for t0 in range(0, 11)}}


def test_target_windows_carry_the_number_and_may_be_empty(spark):
    counts = spark.createDataFrame([(5, "x", 4, 2), (9, "b error c", 1, 7)], "t long, template string, cnt long, idx int")
    assert rows(WN.target_window_contents(counts, " error ", 4, key="idx")) == [(5, 9, 2, 4), (5, 9, 7, 1)]
    assert WN.target_window_contents(counts, "nothing", 4).count() == 0


@pytest.mark.parametrize("unit, w", [("hour", 3), ("hour", 5), ("minute", 7), ("second", 60)])
def test_calendar_window_before_crosses_the_border(spark, unit, w):
    from datetime import datetime, timedelta
    step = {"hour": timedelta(hours=1), "minute": timedelta(minutes=1), "second": timedelta(seconds=1)}[unit]
    at = [datetime(2024, 2, 28, 22, 57, 58) + i * step for i in range(160)]
    df = spark.createDataFrame([(t, "m") for t in at], "ts timestamp_ntz, template string")
    keyed = WN.calendar_window(df, unit, w)
    order = list(dict.fromkeys(tuple(r) for r in keyed.orderBy("ts").select("wkey", "code").collect()))
    before = WN.calendar_window_before(spark.createDataFrame(order[1:], "wkey timestamp_ntz, code int"), unit, w)
    # units without a gap: the window before a window is the one met before it
    assert [tuple(r) for r in before.collect()] == order[:-1]


def test_target_windows_take_more_tasks_for_more_rows(spark, monkeypatch):
    # 400 targets with 2 templates and 800 rows: the questions alone are over 800
    per_sec = [(t, "hot", 3) for t in range(400)] + [(t, "an error here", 1) for t in range(400)]
    counts = spark.createDataFrame(per_sec, "t long, template string, cnt long")
    want = rows(WN.target_window_contents(counts, " error ", 50))
    seen = []
    real = WN._target_tasks
    monkeypatch.setattr(WN, "_target_tasks", lambda *a: seen.append(real(*a)) or seen[-1])
    monkeypatch.setattr(WN, "ROWS_PER_TASK", 20)
    assert rows(WN.target_window_contents(counts, " error ", 50)) == want
    assert seen[0] >= 800 / 20 and len(want) == 800
