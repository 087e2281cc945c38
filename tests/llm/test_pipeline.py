"""The pipeline's stages, one after the other, against brute force on the smallest tables."""

import numpy as np
import pytest

import __spark_entry__ as E
import corpus_pipeline as P
from logweave.llm import decontaminate, pii
from logweave.llm.shared import table, written
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = table(spark, SF, "documents")
    out = [docs]
    for name, stage in P.STAGES:
        docs = written(stage(spark, docs, SF), name)
        out.append(docs)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_follow_each_other(stages):
    docs = stages[0]
    assert [n for n, _ in P.STAGES] == ["language_id", "minhash_near_dedup", "decontamination", "pii", "packing"]
    assert all(s.columns == docs.columns for s in stages[1:-1])
    first, kept, clean, hidden = map(texts, stages[1:-1])
    assert len(first) >= 0.98 * docs.count()
    want = {i for i, _, _, k in brute.near_duplicates(sorted(first.items())) if k}
    assert set(kept) == want
    import re
    split = lambda t: re.findall(r"[^\W_]+", t.lower())
    items = [" ".join(split(r.text)) for r in table(docs.sparkSession, SF, "benchmark").collect()]
    leaks = {i for i, t in kept.items() if any(x in " ".join(split(t)) for x in items)}
    assert leaks and not leaks & set(clean) and len(kept) - len(clean) <= len(leaks) + 1
    assert hidden == {i: pii.redact(t, pii.find(t)) for i, t in clean.items()}
    assert not any(brute.base_spans(t) for t in hidden.values())
    packed = stages[-1].collect()
    assert {r.doc_id for r in packed} == set(hidden)
    fill = {}
    for r in packed:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 1024 and len(fill) <= np.ceil(sum(fill.values()) / 1024) + 2


def test_rows_with_null_and_repeated_ids_are_judged_one_by_one(spark):
    """A drop concerns the row itself, and one row of every group stays."""
    words = lambda tag: " ".join(f"{tag}{i}" for i in range(40))
    a, b, c, d, e = map(words, "abcde")
    rows = [(None, a + " x"), (1, a), (None, b), (None, c), (None, c), (2, d), (2, d), (3, e), (3, words("f")), (4, e), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = P.drop_near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(
        f"Row(doc_id={i}, text={t!r})" for i, t in [(1, a), (None, b), (None, c), (2, d), (3, e), (3, words("f")), (None, "")])

    bench = spark.createDataFrame([(1, a)], "item_id bigint, text string")
    clean = decontaminate.clean(spark.createDataFrame([(None, a), (None, b), (2, a), (2, d), (2, d)], "doc_id bigint, text string"), bench)
    assert sorted(str(r.doc_id) + r.text for r in clean.collect()) == sorted(["None" + b, "2" + d, "2" + d])


def test_registered():
    names = set(E.queries())
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


@pytest.mark.parametrize("name", ["op1_decontamination", "op2_url_filter"])
def test_queries_match_their_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = E.queries()[name](spark, SF)
    cur = con.execute(E.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    key = lambda r: tuple(map(str, r))
    assert sorted(key(r) for r in got.select(*cols).collect()) == sorted(map(key, cur.fetchall()))
