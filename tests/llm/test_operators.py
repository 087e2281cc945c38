"""Every operator against brute force on messy, empty and small tables."""

import itertools
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import public_tokenizers
from logweave.llm import class_lm, components, decontaminate, language_id, minhash, outliers, packing, pii, quality_crf, substring, url_filter
from logweave.llm.shared import crc_mod
from tests.llm import brute
from tests.llm.conftest import PROSE, messy_rows

MESSY = [(r[0], r[1]) for r in messy_rows()]
BPE = public_tokenizers.path("byte_bpe_50k.json")


def bag(rows):
    return Counter(tuple(r) for r in rows)


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# ---- 1 decontamination ------------------------------------------------------------------

ITEM = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo"


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string, words string, at int")


def test_decontamination_tolerates_substitutions(spark):
    w = ITEM.split()
    one = " ".join(w[:6] + ["ZZZ"] + w[7:])
    many = " ".join("zz" if i % 3 == 0 else x for i, x in enumerate(w))
    docs = spark.createDataFrame([
        (1, f"before it, {ITEM.upper()}. after"), (2, f"x {one} y"), (3, many), (4, PROSE), (5, " ".join(w[2:15])),
        (6, " ".join(w[:7])), (7, None), (8, ""), (None, ITEM), (1, f"before it, {ITEM.upper()}. after"),
    ], "doc_id bigint, text string")
    found = decontaminate.overlaps(docs, items(spark, [(10, ITEM, "c", 0), (10, ITEM, "c", 0), (11, None, "c", 0), (12, "", "c", 0), (None, "too short", "c", 0)]))
    assert sorted((str(r.doc_id), r.item_id, r.matched, r.compared) for r in found.collect()) == [
        ("1", 10, 13, 13), ("2", 10, 12, 13), ("5", 10, 13, 13), ("None", 10, 13, 13)]
    kept = decontaminate.clean(docs, items(spark, [(10, ITEM, "c", 0)])).collect()
    assert sorted(r.doc_id for r in kept) == [3, 4, 6, 7, 8]


def test_decontamination_large_benchmark_takes_the_other_plan(spark, monkeypatch):
    docs = spark.createDataFrame([(1, ITEM), (2, PROSE)], "doc_id bigint, text string")
    few = bag(decontaminate.overlaps(docs, items(spark, [(10, ITEM, "", 0)])).collect())
    monkeypatch.setattr(decontaminate, "SMALL", 0)
    assert bag(decontaminate.overlaps(docs, items(spark, [(10, ITEM, "", 0)])).collect()) == few


def test_masks_hit_every_window_with_two_substitutions():
    for gone in itertools.combinations(range(decontaminate.WINDOW), decontaminate.WINDOW - decontaminate.LEAST):
        assert any(not set(gone) & {at + o for o in m} for m in decontaminate.MASKS for at in range(decontaminate.WINDOW - m[-1])), gone


def test_decontamination_by_the_rule_alone(spark):
    bench, docs = [], []
    for m in [*range(1, 15), 17]:
        w = [f"i{m}w{k}" for k in range(m)]
        bench.append((m, w))
        for r in range(4 if m == 13 else 3):
            for gone in itertools.combinations(range(m), r):
                if r < 3 or sum(gone) % 9 == 0:
                    docs.append((len(docs), ["a", "b", *("zz" if k in gone else x for k, x in enumerate(w)), "c"][m % 3:]))
    docs.append((len(docs), []))
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id bigint, text string")
    got = decontaminate.overlaps(frame, items(spark, [(i, " ".join(w), "", 0) for i, w in bench])).collect()
    want = brute.overlaps(docs, bench)
    assert {i for _, i, _, _ in want} == {i for i, _ in bench}
    assert bag(got) == bag(want)
    # the SQL states the same rule
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [i for i, _ in docs], "text": [" ".join(w) for _, w in docs]}))
    con.register("benchmark", pa.table({"item_id": [i for i, _ in bench], "text": [" ".join(w) for _, w in bench]}))
    assert bag(con.execute(decontaminate.oracle()).fetchall()) == bag(want)


def test_decontamination_messy_and_empty(spark, messy, empty):
    bench = items(spark, [(1, PROSE, "", 0)])
    assert {r.doc_id for r in decontaminate.overlaps(messy, bench).collect()} == {1, 2, None}
    assert decontaminate.overlaps(empty, bench).count() == 0
    assert decontaminate.overlaps(messy, items(spark, [])).count() == 0
    assert decontaminate.clean(messy, bench).columns == messy.columns


# ---- 2 url rules -------------------------------------------------------------------------

def site_rule(host, path):
    fits = [(len(r), r, v) for r, v in url_filter.SITE_RULES
            if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits)[1:] if fits else None


def test_url_rules(spark):
    urls = ["http://www.EXAMPLE.com/en/x?y#z", "https://a.example.com/en/", "https://example.com/en", "http://notexample.com/en/", "http://x.net/fr/1",
            "http://x.net/EN/", "http://net/es/", "http://spam-farm.example.org/q", "ftp://com/", "http://com", "no scheme/com/", None, "", "://", "http://a.net/fr?x",
            "http://h.org/a/setup.EXE?x=1", "http://h.org/calendar/2024/05/", "http://user@x.com:80/", "http://user@x.com/p", "http://b.spam-farm.example.com/en/1"]
    rows = [(i, u, "h", "p") for i, u in enumerate(urls)] + [(None, urls[0], "h", "p"), (0, urls[0], "h", "p")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string")
    got = {r.page_id: r for r in url_filter.verdicts(pages).collect()}
    assert url_filter.verdicts(pages).count() == len(rows)
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        rest = rest.split("?")[0].split("#")[0]
        host, path = rest.split("/")[0], rest[len(rest.split("/")[0]):]
        host = host.translate(brute.FOLD)
        assert (got[i].host, got[i].path) == (host, path), u
        rule = site_rule(host, path)
        assert got[i].rule == (rule[0] if rule else None), u
        if rule:
            assert got[i].verdict == rule[1], u
    assert [got[i].verdict for i in (7, 15, 16, 19)] == ["block"] * 4
    assert got[8].verdict == "allow" and got[10].verdict == "allow"


def test_url_index_token_is_the_rarest(spark):
    assert url_filter.literal_tokens(r"/wp-login\.php\b") == ["wp", "login", "php"]
    assert url_filter.literal_tokens(r"(foo|bar)baz") == []
    assert url_filter.verdicts(spark.createDataFrame([], "page_id bigint, url string")).count() == 0


def test_thousands_of_rules_equal_every_rule_on_every_url(spark):
    rng = np.random.default_rng(9)
    names = [f"n{i}" for i in range(60)]
    sites = {}
    while len(sites) < 1500:
        host = ".".join(rng.choice(names, rng.integers(1, 3))) + "." + str(rng.choice(["com", "org", "net"]))
        path = "/".join(rng.choice(names[:6], rng.integers(0, 3)))
        sites[f"{host}/{path + '/' if path else ''}"] = str(rng.choice(["allow", "block"]))
    patterns = [f"/{a}/[0-9]{{{d}}}\\b" for a in names for d in (2, 3, 4)] + [f"[?&]{a}={b}\\b" for a in names[:30] for b in names[:30]]
    table = [("site", r, v, url_filter.site_pattern(r), [t for t in re.split("[^a-z0-9]+", r) if t]) for r, v in sites.items()]
    table += [("pattern", p, "block", p, url_filter.literal_tokens(p) or [""]) for p in patterns]
    urls = []
    for i in range(400):
        host = ".".join(rng.choice(names, rng.integers(1, 4))) + "." + str(rng.choice(["com", "org", "net"]))
        urls.append(f"https://{host}/" + "/".join(rng.choice([*names[:8], "123", "45"], rng.integers(0, 4))) + str(rng.choice(["", f"?{names[3]}={names[5]}", "/?x=1", "#a"])))
    rules = spark.createDataFrame(table, "kind string, rule string, verdict string, pattern string, tokens array<string>")
    got = {r.page_id: r for r in url_filter.verdicts(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string"), rules).collect()}
    ruled, matched = 0, 0
    for i, u in enumerate(urls):
        rest = re.split("[?#]", u.split("://", 1)[1])[0]
        host, path = rest.split("/", 1)[0], "/" + rest.split("/", 1)[1]
        fits = [(len(r), r, v) for r, v in sites.items()
                if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
        hit = any(re.search(p, u) for p in patterns)
        rule, verdict = max(fits)[1:] if fits else (None, "block" if hit else "allow")
        assert (got[i].rule, got[i].verdict) == (rule, verdict), u
        ruled, matched = ruled + bool(fits), matched + (hit and not fits)
    assert ruled > 20 and matched > 5


# ---- 3 language id ------------------------------------------------------------------------

def test_codewords_differ():
    for n in (2, 3, 4, 6, 12):
        code = language_id.codewords(n)
        assert len({tuple(r) for r in code}) == n and (np.abs(code.sum(axis=0)) < n).all()
    assert language_id.codewords(1).shape == (1, 0) and language_id.codewords(0).shape == (0, 0)


def test_language_id_on_held_out_documents(small):
    held = crc_mod(F.col("doc_id"), 4) == 2
    model = language_id.learn(small.where(~held))
    got = language_id.identify(small, model, ("doc_id", "lang")).collect()
    assert len(got) == small.count()
    share = np.mean([r.lang == r.lang_pred for r in got])
    assert share > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_id_messy_and_empty(messy, empty):
    model = language_id.learn(messy)
    assert model.languages == ["de", "en", "fr"]
    got = language_id.identify(messy, model).collect()
    assert len(got) == len(MESSY)
    letters = {i for i, t in MESSY if t and any(c.isalpha() for c in t)}
    for r in got:
        if r.doc_id is not None:
            assert (r.lang_pred != "und") == (r.doc_id in letters)
    assert {r.lang_pred for r in language_id.identify(messy, language_id.learn(empty)).collect()} == {"und"}
    assert language_id.identify(empty, model).count() == 0
    one = language_id.learn(messy.where("lang = 'de'"))
    assert {r.lang_pred for r in language_id.identify(messy.where("doc_id = 11"), one).collect()} == {"de"}


# ---- 4 personal data ------------------------------------------------------------------------

PIECE = st.sampled_from(["a@b.c", "@", ".", "..", "x.y", "+1 ", "+49 (0)30 1234567", "1.2.3.4", "255.256.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "0", "7",
                         " ", "-", "é", "日", "a-b", "%", "_", "://u:p@h.de/", "IBAN DE89 3704 0044 0532 0130 00", "ssn: 123-45-6789", "\n", "(", ")"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECE, max_size=14).map("".join))
def test_base_spans_equal_the_patterns(text):
    found = pii.find(text)
    assert [x for x in found if x[0] in pii.BASE_KINDS] == brute.base_spans(text)
    assert all(0 <= s < e <= len(text) for _, s, e in found)


def test_added_kinds_and_redaction():
    text = "IBAN DE89 3704 0044 0532 0130 00, ssn: 123-45-6789, https://bob:pw@host.de/x mail bob@host.de"
    assert {k for k, _, _ in pii.find(text)} == {"iban", "ident", "login", "email"}
    assert pii.redact("write to a@b.co now", pii.find("write to a@b.co now")) == "write to [EMAIL] now"
    assert pii.redact(None, []) is None
    long = "7" * 5000 + "@" * 1000 + "1.1" * 1000 + " a@b.c" * 100
    assert [x for x in pii.find(long) if x[0] in pii.BASE_KINDS] == brute.base_spans(long)


def test_pii_query_columns(messy, empty, small):
    import hashlib
    for df in (messy, small):
        got = bag((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.digest(pii.personal_data(df)).collect())
        want = []
        for i, t in texts_of(df):
            spans = brute.base_spans(t)
            text = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
            n = Counter(k for k, _, _ in spans)
            want.append((i, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(text.encode()).hexdigest()))
        assert got == bag(want)
    assert pii.digest(pii.personal_data(empty)).count() == 0
    out = pii.redacted(messy)
    assert out.columns == messy.columns and out.count() == len(MESSY)


# ---- 5 packing -----------------------------------------------------------------------------

@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "é", " ", "\n", "  ", "1", "²", "!", "'s", "\t", "\x85", "　", "<|endoftext|>", "日本", "\x1c", "_", " x"]), max_size=14).map("".join))
def test_encoder_equals_the_tokenizer(text):
    e = packing.encoder(BPE)
    assert e(text) == e.whole(text)


TEXTS = st.lists(st.lists(st.sampled_from(["a", "word", "B", "é", " ", "\n", "  ", "1", "!", "'s", "\t", "\x85", "日本", " x", " the", "\nof"]), max_size=9).map("".join)
                 | st.none(), max_size=6)


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=4), st.sampled_from([1, 6, 1000]))
def test_encoder_batches_and_bounded_memory(batches, known):
    e = packing.Encoder(BPE, known)
    for texts in batches:
        got = [x.tobytes() for x in e.texts(pa.array(["skipped", *texts], pa.string()).slice(1))]
        assert got == [e.whole(t) if t else b"" for t in texts]


def check_packing(df, capacity=packing.CAPACITY):
    pieces = packing.token_pieces(df, BPE, capacity)
    got = packing.pack(pieces, capacity).collect()
    e = packing.encoder(BPE)
    want = Counter()
    for i, t in texts_of(df):
        ids = (e.whole(t) if t else b"") + np.array([2], "<u4").tobytes()
        n = len(ids) // 4
        start = 0
        for k, (s, length) in enumerate(packing.cut(n, capacity)):
            assert s == start and (length == capacity or k == 0)
            start += length
            want[i, k, s, length, zlib.crc32(ids[4 * s:4 * (s + length)])] += 1
        assert start == n
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= capacity
    return len(by), sum(r.length for r in got)


def test_packing_round_trip(messy, small, empty):
    used, total = check_packing(small)
    assert used <= math.ceil(total / packing.CAPACITY) + 2
    check_packing(messy, 16)
    assert packing.pack(packing.token_pieces(empty, BPE)).count() == 0


def test_children_keep_every_item_in_one_bin():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 101, 300)
    pop = packing.evolve(lengths, [], 100, rng, 6, 10)
    for p in pop:
        assert len(p) == 300 and np.bincount(p, weights=lengths).max() <= 100
    first = packing._start(lengths, 100, rng, True)
    assert pop[0].max() <= first.max()


# ---- 6 near-duplicates -------------------------------------------------------------------------

def test_near_duplicates(messy, small, empty):
    for df in (messy, small):
        got = bag((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect())
        assert got == bag(brute.near_duplicates(texts_of(df)))
    assert minhash.near_duplicates(empty).count() == 0


def test_chain_of_near_copies_is_one_group(spark):
    w = [f"w{i}" for i in range(120)]
    rows, now = [], list(w)
    for i in range(30):                                   # neighbours are alike, the ends are not
        rows.append((100 - i, " ".join(now)))
        now = now[2:] + [f"n{i}a", f"n{i}b"]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = bag((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect())
    assert got == bag(brute.near_duplicates(rows))


@pytest.mark.parametrize("shared, own", [(3, 0), (6, 1), (9, 1), (12, 2)])
def test_long_signature_keeps_pairs_of_short_texts(shared, own):
    """Pairs at 75% or a little above must pass the filter of the last stage, sets of few shingles too."""
    rng = np.random.default_rng(shared)
    ones = sum(1 << i for i in range(0, 64, minhash.FINE_BITS))
    lost = 0
    for _ in range(300):
        x = rng.integers(0, 1 << 63, shared + 2 * own + (own == 0), dtype=np.uint64)
        one, two = x[:shared + own], np.concatenate([x[:shared], x[shared + own:]])
        low = minhash.packed(np.array([minhash.minima(s, minhash._FINE_FACTOR, minhash._FINE_SHIFT) for s in (one, two)]), minhash.FINE_BITS)
        differ = low[0].view(np.uint64) ^ low[1].view(np.uint64)
        differ = (differ | (differ >> np.uint64(1))) & np.uint64(ones)
        equal = 1 - sum(int(d).bit_count() for d in differ) / minhash.FINE
        chance = 1 / (1 << minhash.FINE_BITS)
        lost += (equal - chance) / (1 - chance) < minhash.PERCENT / 100 - minhash.FINE_MARGIN
    assert lost == 0


def test_bucket_of_many_short_texts(spark):
    rng = np.random.default_rng(3)
    stem = [f"s{i}" for i in range(8)]                    # 4 shingles; every text changes a word at either end or adds one
    rows = []
    for i in range(300):
        w = list(stem)
        for _ in range(rng.integers(0, 3)):
            w = w + [f"e{rng.integers(0, 6)}"] if rng.random() < 0.5 else [f"b{rng.integers(0, 6)}"] + w
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = bag((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect())
    assert got == bag(brute.near_duplicates(rows))


def test_rest_step_grows_with_its_rows(spark, monkeypatch):
    """Variants of one text that stay under the threshold, and texts that share one long passage: what the last step
    compares and hands on follows the number of texts, and the groups are those of all pairs."""
    seen = []

    def counted(members, *rest, of=minhash._rest_pairs):
        pairs = of(members, *rest)
        seen.append((members.count(), pairs.count()))
        return pairs

    monkeypatch.setattr(minhash, "_rest_pairs", counted)
    for n in (150, 300):
        rng = np.random.default_rng(5)
        base, passage = [f"b{i}" for i in range(200)], [f"p{i}" for i in range(120)]
        rows = []
        for i in range(n):
            w = list(base)
            for k in rng.choice(200, 1 + i % 7, replace=False):
                w[k] = f"x{i}_{k}"
            rows.append((2 * i, " ".join(w)))
            rows.append((2 * i + 1, " ".join(passage + [f"o{i}_{k}" for k in range(40)])))
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        got = bag((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect())
        assert got == bag(brute.near_duplicates(rows))
    (m1, p1), (m2, p2) = seen
    assert m2 <= 2.2 * m1 + 50 and p2 <= 2.2 * p1 + 50


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(300, 301), (5, 5)], "u bigint, v bigint")
    got = {r.u: r.component for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(201)} | {300: 300, 301: 300}
    assert components.components(links.where("u < 0")).count() == 0


# ---- 7 substrings ------------------------------------------------------------------------------

def test_without_repeats(messy, small, empty):
    for df in (messy, small):
        got = bag((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.without_repeats(df).collect())
        assert got == bag(brute.without_repeats(texts_of(df)))
    assert substring.without_repeats(empty).count() == 0


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_repeats_in_tangled_texts(spark, seed):
    rng = np.random.default_rng(seed)
    passages = [[f"p{k}_{j}" for j in range(n)] for k, n in enumerate((34, 35, 36, 50, 90))]
    rows = []
    for i in range(25):
        text = []
        for _ in range(rng.integers(0, 5)):
            text += [f"u{x}" for x in rng.integers(0, 10 ** 6, rng.integers(0, 40))]
            p = passages[rng.integers(0, 5)]
            a = rng.integers(0, 4)
            text += p[a:len(p) - rng.integers(0, 4)] if rng.random() < 0.5 else p
            text += ["tick"] * rng.integers(0, 50) if rng.random() < 0.3 else ["a", "b"] * rng.integers(0, 30)
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for bits in (25, 6):                                  # a full bit set changes nothing
        texts = df.withColumn("_key", F.xxhash64("text"))
        spans = substring.repeated_spans(texts, filter_bits=bits).collect()
        gone = {i: set() for i, _ in rows}
        for s in spans:
            gone[s.doc_id].update(range(s.start, s.end))
        assert {i: len(g) for i, g in gone.items()} == {r[0]: r[2] for r in brute.without_repeats(rows)}


@pytest.mark.parametrize("window, k", [(5, 3), (70, 7)])
def test_other_windows(spark, window, k):
    rng = np.random.default_rng(window)
    passage = [f"p{i}" for i in range(90)]
    rows = [(i, " ".join([*(f"o{i}_{x}" for x in range(rng.integers(0, 9))), *passage[int(rng.integers(0, 15)):], *rng.choice(list("abc"), 12)])) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = bag((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.without_repeats(df, window, k).collect())
    assert got == bag(brute.without_repeats(rows, window))
    with pytest.raises(ValueError):
        substring.without_repeats(df, k + 64, k)


# ---- 8 quality ------------------------------------------------------------------------------------

def test_quality_on_held_out_documents(spark, small):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality_crf.learn(small, labels)
    got = {r.doc_id: r.score for r in quality_crf.scored(small, model).collect()}
    known = {r.doc_id: r.quality for r in labels.collect()}
    assert np.mean([(got[i] >= 0.3) == (q == 1) for i, q in known.items() if i in got]) > 0.95


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    per = np.array([1, 4, 2, 5])
    score, t = rng.normal(size=per.sum()), rng.normal(size=(2, 2))
    got, pair = quality_crf.marginals(score, per, t)
    at, total = 0, np.zeros((2, 2))
    for n in per:
        z, p, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
        for state in np.ndindex(*[2] * n):
            w = math.exp(sum(score[at + i] * s for i, s in enumerate(state)) + sum(t[a, b] for a, b in zip(state, state[1:])))
            z += w
            p += w * np.array(state)
            for a, b in zip(state, state[1:]):
                pairs[a, b] += w
        assert np.allclose(got[at:at + n], p / z, atol=1e-6)
        total += pairs / z
        at += n
    assert np.allclose(pair, total, atol=1e-6)


def test_quality_messy_and_empty(spark, messy, empty):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    one = spark.createDataFrame([(1, 1), (2, 1), (None, 0), (3, None)], "doc_id bigint, quality int")
    two = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (8, 0), (3, 1)], "doc_id bigint, quality int")
    assert {r.score for r in quality_crf.scored(messy, quality_crf.learn(messy, none)).collect()} == {0.5}
    assert {r.score for r in quality_crf.scored(messy, quality_crf.learn(messy, one)).collect()} == {1.0}
    got = quality_crf.scored(messy, quality_crf.learn(messy, two)).collect()
    assert len(got) == len(MESSY) and all(0 <= r.score <= 1 for r in got)
    assert quality_crf.scored(empty, quality_crf.learn(messy, two)).count() == 0
    assert quality_crf.line_features(pa.array([""]))[2].tolist() == [1]


# ---- 9 language model ----------------------------------------------------------------------------

def test_class_lm(messy, small, empty):
    for df in (messy, small):
        docs = df.withColumn("held", crc_mod(F.col("doc_id"), 10) == 0)
        model, counts = class_lm.learn(docs.where(~F.col("held")), words=40, endings=16, classes=6, sweeps=3, known=60)
        got = class_lm.scored(docs, model, counts, ("doc_id", "held")).collect()
        rows = texts_of(df)
        held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows]
        want = brute.unigram_scores(rows, held)
        key = lambda i, h, n, k, t, b: (str(i), h, n, k, t, round(b, 6))
        assert Counter(key(r.doc_id, r.held, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got) == \
            Counter(key(i, h, *w) for (i, _), h, w in zip(rows, held, want))
    model, counts = class_lm.learn(empty)
    assert [r.base_score for r in class_lm.scored(messy.where("doc_id = 6").limit(1), model, counts).collect()] == [0.0]
    assert class_lm.scored(empty, model, counts).count() == 0


def test_class_lm_beats_unigrams_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held", crc_mod(F.col("doc_id"), 10) == 0)
    model, counts = class_lm.learn(docs.where(~F.col("held")))
    r = class_lm.scored(docs.where("held"), model, counts).agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (r[0] - r[1]) / r[2] > 0.1


def test_class_model_is_a_distribution(small):
    model, _ = class_lm.learn(small, words=40, endings=16, classes=6, sweeps=2, known=60)
    assert np.allclose((10 ** model.transition).sum(axis=1), 1)
    assert np.allclose(np.bincount(model.cls, weights=10 ** model.emission), 1)


def test_best_class_gain_equals_recomputation():
    rng = np.random.default_rng(5)
    size, both = 12, 4
    n = rng.integers(0, 5, (size, size))
    cls = np.r_[rng.integers(0, 3, size - 1), 3]
    one = np.eye(both)[cls]
    m = one.T @ n @ one
    for w in range(size - 1):
        left, right = (n[:, w] @ one).astype(float), (n[w] @ one).astype(float)
        b, gain = class_lm.best_class(int(cls[w]), left, right, n[w, w], m)
        totals = []
        for c in range(both - 1):
            moved = cls.copy()
            moved[w] = c
            o = np.eye(both)[moved]
            totals.append(class_lm.information(o.T @ n @ o))
        assert np.isclose(gain, max(totals) - totals[cls[w]]) and np.isclose(totals[b], max(totals))


# ---- 10 rules -------------------------------------------------------------------------------------

def test_base_rules(messy, small, empty):
    for df in (messy, small):
        got = bag((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in outliers.quality_rules(df).collect())
        want = []
        for i, t in texts_of(df):
            b = brute.base_rules(t)
            want.append((i, *b, b[0] < 50 or 100 * b[4] > 50 * b[0]))
        assert got == bag(want)
    assert outliers.quality_rules(empty).count() == 0
    assert all(not r.kept for r in outliers.quality_rules(messy).collect() if r.base_failed)


def plain_mcd(x, floors, share, steps):
    """Concentration from the three starts on one group; squared distances by the least determinant."""
    def quantile(values, p):
        return np.sort(values)[max(int(np.ceil(p * len(values))) - 1, 0)]

    centre = np.array([quantile(c, 0.5) for c in x.T])
    spread = np.array([quantile(np.abs(c - m), 0.5) for c, m in zip(x.T, centre)])
    z = (x - centre) / (1.4826 * spread + floors)
    best = None
    for d in ((z * z).sum(axis=1), (np.tanh(z / 2) ** 2).sum(axis=1), np.abs(z).max(axis=1)):
        for _ in range(steps + 1):
            core = x[d <= quantile(d, share)]
            cov = np.cov(core.T, bias=True) + np.diag(np.square(floors))
            off = x - core.mean(axis=0)
            d = np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off)
        if best is None or np.linalg.det(cov) < best[0] * (1 - 1e-9):
            best = np.linalg.det(cov), d
    return best[1] / max(quantile(best[1], 0.5) / outliers.CHI2_MEDIAN, 1.0)


def test_robust_distance_takes_the_least_determinant(spark):
    rng = np.random.default_rng(12)
    groups = {"a": rng.normal(0, 1, (150, 3)) @ rng.normal(0, 1, (3, 3)), "b": np.r_[rng.normal(0, 1, (110, 3)), rng.normal(6, 0.2, (45, 3))]}
    rows = [(g, i, *map(float, v)) for g, x in groups.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "g string, i int, x double, y double, z double")
    floors = (0.05, 0.05, 0.05)
    got = {(r.g, r.i): r.robust_distance for r in outliers.robust_distance(df, ("g",), ("x", "y", "z"), floors).collect()}
    for g, x in groups.items():
        want = plain_mcd(x, np.array(floors), outliers.SHARE, outliers.STEPS)
        assert np.allclose([got[g, i] for i in range(len(x))], want, rtol=1e-6)


def test_rules_reject_one_extreme_statistic_each(spark):
    rng = np.random.default_rng(4)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 9))) for _ in range(4000)]

    def prose(n=120):
        w = list(rng.choice(vocabulary, n, replace=False))
        return "\n".join(" ".join(["The", *w[k:k + 12]]) for k in range(0, n, 12))

    rows = [(i, prose()) for i in range(400)]
    half = prose(60)
    planted = {
        1000: " ".join(x * 4 for x in prose().split()),                                        # long words
        1001: " # ".join(prose().split()),                                                     # symbols
        1002: half + "\n" + "\n".join(["one line"] * 9) + "\n" + prose(60),                     # equal lines
        1003: prose(96) + " " + " ".join(vocabulary[:30] * 2),                                 # repeated words
        1004: prose().upper(),                                                                 # upper case
    }
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in [*rows, *planted.items()]], "doc_id bigint, text string, lang string, source string")
    got = {r.doc_id: r for r in outliers.quality_rules(df).collect()}
    assert not any(got[i].base_failed for i in planted)
    assert not any(got[i].kept for i in planted)
    assert all(got[i].kept for i, _ in rows)


def test_robust_distance_finds_planted_outliers(spark):
    rng = np.random.default_rng(2)
    rows = []
    for g in ("a", "b", None):
        for i in range(300):
            x = rng.normal(size=2)
            rows.append((g, f"{i}", float(x[0] * 3 + 5), float(x[0] + 0.2 * x[1]), False))
        rows += [(g, "o", 5.0 + 3 * k, -4.0 - k, True) for k in range(30)]
    df = spark.createDataFrame(rows, "g string, id string, x double, y double, planted boolean")
    got = outliers.robust_distance(df, ("g",), ("x", "y"), (0.01, 0.01)).collect()
    assert min(r.robust_distance for r in got if r.planted) > 3 * max(r.robust_distance for r in got if not r.planted)
    assert {r.g for r in got} == {"a", "b", None} and len(got) == len(rows)
