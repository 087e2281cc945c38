from pyspark.sql import functions as F

from logweave.functions.logline import mask
from logweave.operators import templates as TP
from tests.conftest import rows

GOOD = "<86>1 2031-08-19T04:55:36+02:00 rack7s2 pumpd 415 - -  valve 3 opened at 0x1c after 12 tries"


def test_mask_cases(spark):
    df = spark.createDataFrame([("a 0x1f b 12",), ("0xAB 7",), ("i2c rc=0x0",), ("c0-0c0s1",)], ["line"])
    got = [r[0] for r in df.select(mask("line")).collect()]
    assert got == ["a mem_addr b *", "*xAB *", "i*c rc=mem_addr", "c*-*c*s*"]


def test_parse_cases(spark):
    lines = spark.createDataFrame([
        (1, GOOD),
        (2, "<86>1 2031-08-19T04:55:36+02:00 rack7s2"),
        (3, "<86>1 2031-08-32T04:55:36+02:00 rack7s2 pumpd 1 - -  no such day"),
        (4, ""),
        (5, "<86>1 2031 rack7s2 pumpd 1 - -  year only"),
        (6, "<86>1 2031-08-19 rack7s2 pumpd 1 - -  date only"),
        (7, "<86>1 2031-08-19T04:55 rack7s2 pumpd 1 - -  no seconds"),
        (8, "<86>1 2031-08-19T25:55:36 rack7s2 pumpd 1 - -  no such hour"),
        (9, None),
    ], "line_id long, line string")
    good = TP.parse_log(lines).collect()
    assert len(good) == 1
    g = good[0]
    assert (g.pri, g.host, g.program, g.pid) == (86, "rack7s2", "pumpd", "415")
    assert str(g.ts) == "2031-08-19 04:55:36"
    assert g.t == 1944881736            # offset ignored: wall clock as UTC seconds
    assert g.message.startswith("valve 3 opened")
    bad = rows(TP.quarantined_lines(lines), "line_id", "reason")
    assert bad == [(2, "too few tokens"), (3, "bad timestamp"), (4, "too few tokens"), (5, "bad timestamp"),
                   (6, "bad timestamp"), (7, "bad timestamp"), (8, "bad timestamp"), (9, "too few tokens")]


def test_filters_on_fields_do_not_build_the_line_again(spark, capsys):
    lines = spark.range(3).select(F.col("id").alias("line_id"), F.concat(F.lit("<1>1 2031-08-19T04:55:36 r p 1 - -  0x"), F.hex("id")).alias("line"))
    counts = TP.mask_templates(TP.parse_log(lines)).groupBy("t", "template").count()
    counts.explain()
    assert capsys.readouterr().out.count("hex(") == 1
    assert [r["count"] for r in counts.collect()] == [3]


def test_fields_between_any_blanks(spark):
    words = GOOD.split()
    lines = spark.createDataFrame([(1, " \t" + "\t ".join(words)), (2, "\n".join(words)), (3, " " + " ".join(words[:3]) + "  "),
                                   (4, " ".join(words[:4]) + " ")], "line_id long, line string")
    assert rows(TP.parse_log(lines), "line_id", "pri", "host", "program", "pid", "t") == [
        (1, 86, "rack7s2", "pumpd", "415", 1944881736), (2, 86, "rack7s2", "pumpd", "415", 1944881736),
        (4, 86, "rack7s2", "pumpd", None, 1944881736)]
    assert rows(TP.quarantined_lines(lines), "line_id", "reason") == [(3, "too few tokens")]


def test_parse_independent_of_session_zone(spark):
    winter = GOOD.replace("2031-08-19", "2031-01-19")
    lines = spark.createDataFrame([(1, GOOD), (2, winter)], "line_id long, line string")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Chicago")
        got = rows(TP.parse_log(lines), "line_id", "t")
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == [(1, 1944881736), (2, 1944881736 - 212 * 86400)]


def test_counts_add_up(spark):
    from tests.conftest import SF_SMALL
    from logweave.plans import catalog
    m = catalog.masked(spark, SF_SMALL)
    total = m.count()
    counts = TP.template_counts(m)
    assert counts.agg(F.sum("cnt")).first()[0] == total
    by_host = TP.template_counts_by_host(m)
    assert by_host.where(F.col("host") == "ALL").agg(F.sum("cnt")).first()[0] == total
    assert by_host.where(F.col("host") != "ALL").agg(F.sum("cnt")).first()[0] == total


def test_dictionary_order(spark):
    counts = spark.createDataFrame([("b", 3), ("a", 3), ("c", 1)], "template string, cnt long")
    assert rows(TP.template_dictionary(counts), "idx", "template") == [(0, "c"), (1, "a"), (2, "b")]
    hot = rows(TP.one_hot_dictionary(TP.template_dictionary(counts)), "template", "idx", "size")
    assert hot == [("a", 1, 3), ("b", 2, 3), ("c", 0, 3)]


def test_rendered_time_ignores_session_zone(spark):
    from logweave.sources.tables import iso_seconds
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        # 02:30 on 2024-03-10 does not exist in New York (clocks jump 02:00 -> 03:00)
        df = spark.sql("SELECT timestamp_ntz'2024-03-10 02:30:05.250' AS ts")
        assert df.select(iso_seconds(F.col("ts")).alias("s")).first().s == "2024-03-10T02:30:05"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
