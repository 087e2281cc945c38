"""Periodic runs, the prefix trie and syncmer fingerprints against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logweave.llm import periodic, prefix_trie, syncmers
from tests.llm import brute
from tests.llm.conftest import messy_rows

MESSY = [(r[0], r[1]) for r in messy_rows()]


def bag(rows):
    return Counter(tuple(r) for r in rows)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- 11 periodic runs ---------------------------------------------------------------------

def brute_runs(w, least=6, times=4):
    """Every lag on its own, every maximal stretch, without those that have a smaller period."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = q
        while i < len(w):
            if w[i] != w[i - q]:
                i += 1
                continue
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            start, length = i - q, j - i + q
            if length >= max(least, times * q):
                found.setdefault((start, length), q)
            i = j
    return sorted((s, n, q) for (s, n), q in found.items())


def found_runs(texts, **options):
    names = {}
    h = np.array([names.setdefault(x, len(names)) for w in texts for x in w], np.uint64)
    row, start, length, period = periodic.runs(periodic.mix(h + np.uint64(7)), np.array([len(w) for w in texts]), **options)
    out = [[] for _ in texts]
    for r, *run in zip(row.tolist(), start.tolist(), length.tolist(), period.tolist()):
        out[r].append(tuple(run))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=40).map(lambda w: w * 2) | st.lists(st.sampled_from("abc"), max_size=90), max_size=4),
       st.sampled_from([(6, 4), (1, 3), (9, 5)]))
def test_runs_equal_every_lag(texts, rule):
    least, times = rule
    assert found_runs(texts, least=least, times=times) == [brute_runs(w, least, times) for w in texts]


def test_runs_of_planted_periods():
    rng = random.Random(3)
    texts = []
    for _ in range(60):
        w = [rng.choice("abcdef") for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(4)):
            unit = [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 23))]
            w += unit * rng.randrange(3, 8) + unit[:rng.randrange(len(unit))] + [rng.choice("abcdef") for _ in range(rng.randrange(9))]
        texts.append(w)
    got = found_runs(texts)
    assert got == [brute_runs(w) for w in texts]
    assert sum(map(len, got)) > 60


def test_runs_of_one_frequent_word_and_long_texts_stay_cheap():
    n = 300_000
    same, pair = ["x"] * n, ["x", "y"] * (n // 2)
    assert found_runs([same, [], pair, ["x"]]) == [[(0, n, 1)], [], [(0, n, 2)], []]
    with pytest.raises(ValueError):
        periodic.periodic_runs(None, times=2)


def expected_runs(rows):
    out = []
    for i, text in rows:
        w = brute.words(text)
        h = zlib.crc32(("" if i is None else str(i)).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (k - a) % p] if k >= a else x for k, x in enumerate(w)]
        found = brute_runs(w)
        best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
        gone = {k for s, length, q in found for k in range(s + q, s + length)}
        out.append((i, len(found), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
                    sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def test_periodic_runs_query(spark, messy, empty, small):
    texts = [(i, t) for i, t in MESSY if i != 8] + [(i, "a b c " * (i % 7) + "d e f g h i " * 9) for i in range(200, 260)]
    texts.append((8, "lorem ipsum dolor sit amet " * 400))
    got = periodic.digest(periodic.periodic_runs(periodic.with_repeats(spark.createDataFrame(texts, "doc_id bigint, text string")))).collect()
    assert bag(got) == bag(expected_runs(texts))
    assert sum(r.n_runs > 0 for r in got) > 50
    assert periodic.digest(periodic.periodic_runs(periodic.with_repeats(empty))).count() == 0
    assert periodic.digest(periodic.periodic_runs(periodic.with_repeats(messy))).count() == len(MESSY)
    rows = [(r.doc_id, r.text) for r in small.collect() if len(r.text or "") < 6000]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert bag(periodic.digest(periodic.periodic_runs(periodic.with_repeats(frame))).collect()) == bag(expected_runs(rows))


def test_periodic_runs_keep_other_columns(messy):
    got = periodic.periodic_runs(messy, keep=("doc_id", "score", "words", "spans"))
    assert got.columns == ["doc_id", "score", "words", "spans", "runs", "collapsed"]
    assert [(r.start, r.length, r.period) for r in got.where("doc_id = 8").first().runs] == [(0, 20000, 5)]


# ---- 12 prefix trie -------------------------------------------------------------------------

def sequences(rows, rebuild):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    seqs = {c: [t[2:] for t in sorted(v, key=lambda t: t[:2])] for c, v in convs.items()}
    if not rebuild:
        return seqs
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in seqs}
    return {c: seqs.get(c - c % 5, [])[:h[c]] + seqs[c][h[c]:] for c in seqs}


def brute_trie(seqs):
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids, leaves, saved = Counter(), Counter(), Counter()
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
             sha(",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(p)))))) for p, m in members.items()]


TURN = "conv_id bigint, turn bigint, role string, text string, depth string, n int, k int, pos int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], TURN)


def conversations():
    rng = random.Random(5)
    rows = [(None, 0, "user", "lost"), (None, None, None, None)]
    start = [("user" if i % 2 else "assistant", f"turn {i}") for i in range(70)]
    for c in range(60):
        kind = rng.randrange(5)
        if kind == 0:                              # copies that end at different depths
            s = start[:rng.choice([3, 8, 9, 16, 40, 70])]
        elif kind == 1:                            # a long common way, then a turn of their own
            s = start[:rng.choice([5, 17, 33])] + [("user", f"own é {rng.randrange(4)}")] + start[:2]
        else:
            s = [(rng.choice(["user", None]), rng.choice(["a", "b", "", None, "日"])) for _ in range(rng.randrange(1, 6))]
        rows += [(c, None if t == 0 and c % 7 == 0 else t, *x) for t, x in enumerate(s)]
    return [*rows, (500, 3, "user", "late"), (-4, 0, "user", "a"), *((c, 1, "user", "q") for c in range(506, 510))]


@pytest.mark.parametrize("block, stretch", [(8, 512), (2, 4), (1, 2), (64, 64)])
def test_trie_equals_all_prefixes(spark, block, stretch):
    rows = conversations()
    turns = prefix_trie.placed(frame(spark, rows))
    got = prefix_trie.digest(prefix_trie.trie(turns, turns.select("conv_id"), block, stretch)).collect()
    assert bag(got) == bag(brute_trie(sequences(rows, False)))


def test_trie_query_rebuilds_conversations(spark):
    rows = [r for r in conversations() if r[0] is None or r[0] >= 0]
    turns = prefix_trie.placed(frame(spark, rows))
    got = prefix_trie.digest(prefix_trie.trie(prefix_trie.rebuilt(turns), turns.select("conv_id"))).collect()
    seqs = sequences(rows, True)
    assert any(not s for s in seqs.values()), "a conversation without a turn belongs to the root alone"
    assert bag(got) == bag(brute_trie(seqs))


def test_trie_repeated_turns_empty_and_turnless(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "b"), (2, 0, "user", "b"), (2, 0, "user", "b"), (3, 0, None, None)]
    got = prefix_trie.digest(prefix_trie.prefix_trie(frame(spark, rows))).collect()
    assert bag(got) == bag(brute_trie(sequences(rows, False)))
    assert prefix_trie.prefix_trie(frame(spark, [])).count() == 0
    assert prefix_trie.prefix_trie(frame(spark, [(None, 1, "user", "x")])).count() == 0
    none = prefix_trie.placed(frame(spark, []))
    alone = prefix_trie.digest(prefix_trie.trie(none, spark.createDataFrame([(7,), (3,), (7,)], "conv_id bigint"))).collect()
    assert [tuple(r) for r in alone] == [(3, 0, None, 2, 0, 1, 0, sha("3,7"))]


def test_many_conversations_end_at_one_node(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(3000) for t in range(2)]
    got = {r.depth: r for r in prefix_trie.prefix_trie(frame(spark, rows)).collect()}
    assert got[2].n_convs == 3000 and got[2].ends_sha256 == sha(",".join(map(str, range(3000)))) and got[0].n_leaves == 1


# ---- 13 closed syncmers ----------------------------------------------------------------------

def by_id(spark, rows):
    return spark.createDataFrame([(*r, "x", [1], 2) for r in rows], "doc_id bigint, text string, edited string, anchors array<int>, _n int")


def test_syncmer_query_edits_and_pairs(spark, empty):
    rows = sorted({(i, t) for i, t in MESSY if i is not None}, key=str)      # repeated rows have tests of their own
    got = {r.doc_id: r for r in syncmers.digest(syncmers.edited_pairs(by_id(spark, rows))).collect()}
    order = sorted(rows, key=lambda r: r[0])
    prints = {r.doc_id: r.fingerprint for r in syncmers.fingerprints(by_id(spark, rows)).collect()}
    assert len(got) == len(rows)
    for (i, text), (j, other) in zip(order, order[1:] + order[:1]):
        text, other = text or "", other or ""
        m = len(text) // 4
        edited = text[:len(text) - m] + other[:m]
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint) == (len(text), sha(edited), prints[i])
        again = syncmers.fingerprints(by_id(spark, [(0, edited)])).first().fingerprint
        assert r.edited_fingerprint == again
        for value, a, b in ((r.near_edited, prints[i], again), (r.near_next, prints[i], prints[j])):
            x, y = ({p[k:k + 7] for k in range(0, len(p), 7)} for p in (a, b))
            assert value == (2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0)
    assert syncmers.edited_pairs(empty).count() == 0


def test_syncmer_query_keeps_repeated_rows_and_nulls(messy):
    got = syncmers.digest(syncmers.edited_pairs(messy)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in MESSY)
    assert sorted(r.near_next for r in got if r.doc_id == 1)[1] == 1.0       # a copy is followed by its like
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))


def test_one_document_is_its_own_successor(spark):
    r = syncmers.digest(syncmers.edited_pairs(by_id(spark, [(1, "abcdefgh")]))).first()
    assert (r.edited_sha256, r.near_next) == (sha("abcdefab"), 1.0)


def brute_anchors(h, k):
    """Places of closed syncmers from the hashes of word pairs."""
    m = k - 1
    return [i for i in range(len(h) - m + 1) if h[i] == min(h[i:i + m]) or all(h[i + m - 1] < x for x in h[i:i + m - 1])]


@pytest.mark.parametrize("k", [3, 5, 9])
def test_anchors_are_closed_syncmers(spark, k):
    rng = random.Random(k)
    w = [rng.choice(["red", "blue", "sun", "moon", "a", "of"]) for _ in range(400)]
    frame = spark.createDataFrame([(" ".join(w), w)], "text string, w array<string>")
    row = syncmers.with_anchors(frame, "text", "found", k).select(
        "found", F.expr("zip_with(slice(w, 1, size(w) - 1), slice(w, 2, size(w) - 1), (a, b) -> xxhash64(a, b))").alias("h")).first()
    places = np.cumsum([x >> 24 for x in row.found]).tolist()
    assert places == brute_anchors(row.h, k)
    assert max(b - a for a, b in zip([0, *places], places)) <= k - 1          # no gap without an anchor


def test_anchors_do_not_depend_on_context(spark):
    rng = random.Random(11)
    passage = [f"w{rng.randrange(500)}" for _ in range(200)]
    texts = [" ".join(passage), " ".join([f"x{i}" for i in range(37)] + passage + ["end"]), "  " + "\n".join(passage), " ".join(reversed(passage)),
             "日本語" * 400, "日本語" * 400 + "かな" * 30, "ß" * 15, " ", None]
    found = {r.doc_id: r for r in syncmers.fingerprints(by_id(spark, list(enumerate(texts)))).collect()}
    inside = set(found[0].anchors[1:])
    assert inside < set(found[1].anchors) and found[2].fingerprint == found[0].fingerprint
    assert not inside & set(found[3].anchors)
    assert len(set(found[4].anchors) & set(found[5].anchors)) >= len(set(found[4].anchors)) - 2    # words without a blank are cut to pieces
    assert found[7].fingerprint == found[8].fingerprint == "" and len(found[6].fingerprint) == 7
    with pytest.raises(ValueError):
        syncmers.with_anchors(by_id(spark, []), "text", "a", 2)


def test_fingerprint_likeness_of_edits_on_documents(small):
    rows = syncmers.digest(syncmers.edited_pairs(small)).where("n_chars >= 400").collect()
    assert np.mean([r.near_edited for r in rows]) > 0.7 and np.mean([r.near_next for r in rows]) < 0.1
