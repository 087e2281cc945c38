import os
import tempfile

from logweave.session import scratch_path
from logweave.streaming.templates import start_counts

LINES = [
    "<30>1 2031-08-19T04:55:36+02:00 rack7s2 pumpd 415 - -  valve 0x1c after 12",
    "<30>1 2031-08-19T04:55:39+02:00 rack7s2 pumpd 416 - -  valve 0x2d after 13",
    "<30>1 2031-08-19T04:56:02+02:00 rack8s1 fand 9 - -  idle",
    "garbage",
]


def test_streaming_counts(spark):
    d = tempfile.mkdtemp(prefix="lw-stream-")
    with open(os.path.join(d, "messages-1"), "w") as f:
        f.write("\n".join(LINES[:2]) + "\n")
    q = start_counts(spark, d, scratch_path(spark, "stream-ckpt"), sink="memory", name="lw_counts")
    try:
        q.processAllAvailable()
        with open(os.path.join(d, "messages-2"), "w") as f:
            f.write("\n".join(LINES[2:]) + "\n")
        q.processAllAvailable()
        got = sorted((r.template, r.cnt) for r in spark.sql("SELECT * FROM lw_counts").collect())
    finally:
        q.stop()
    counts = {t.split(" ")[3]: c for t, c in got}
    assert counts == {"fand": 1, "pumpd": 2}          # the unparseable line is left out
    assert sorted(t.split(" ", 2)[2] for t, _ in got) == ["rack*s* fand * - -  idle", "rack*s* pumpd * - -  valve mem_addr after *"]


def test_parquet_sink_keeps_the_latest_counts(spark):
    d = tempfile.mkdtemp(prefix="lw-stream-")
    out = scratch_path(spark, "stream-out")
    ckpt = scratch_path(spark, "stream-ckpt")
    for name, lines in (("a", LINES[:1]), ("b", LINES[1:])):
        with open(os.path.join(d, f"messages-{name}"), "w") as f:
            f.write("\n".join(lines) + "\n")
        q = start_counts(spark, d, ckpt, path=out)
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    got = sorted((r.batch, r.template.split(" ")[3], r.cnt) for r in spark.read.parquet(out).collect())
    assert got == [(0, "pumpd", 1), (1, "fand", 1), (1, "pumpd", 2)]
