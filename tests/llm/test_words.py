import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from logweave.llm import words as W
from tests.llm import brute

TEXT = st.lists(st.sampled_from(["a", "A", "ab", "é", "日本", " ", "\n", "\t\x0b", "  ", "x" * 30, "\x1c", "\x85"]), max_size=30).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6), st.booleans())
def test_words_and_hashes_follow_the_texts(texts, lower):
    h, counts = W.word_hashes(pa.array(texts, pa.string()), lower=lower)
    expected = [brute.words(t, lower) for t in texts]
    assert counts.tolist() == [len(x) for x in expected]
    pairs = list(zip([w for x in expected for w in x], h.tolist()))
    assert len({w for w, _ in pairs}) == len(set(pairs)) == len({x for _, x in pairs})


def test_blocks_do_not_change_hashes(monkeypatch):
    texts = pa.array(["alpha beta gamma " * 50, None, "delta", "x" * 300 + " y"])
    whole = W.word_hashes(texts)
    monkeypatch.setattr(W, "BLOCK", 7)
    blocks = W.word_hashes(texts)
    assert (whole[0] == blocks[0]).all() and (whole[1] == blocks[1]).all()


def test_sequence_hashes_depend_on_order_and_content_only():
    h, _ = W.word_hashes(pa.array(["a b c d e f g h i j a b c d e f g h i j b a"]))
    for k in (2, 3, 9, 10):
        s = W.sequence_hashes(h, k)
        for i in range(len(s)):
            for j in range(len(s)):
                assert (s[i] == s[j]) == (h[i:i + k] == h[j:j + k]).all()
    assert len(W.sequence_hashes(h[:3], 5)) == 0
    long = np.tile(h[:10], 20000)                       # over several stretches
    s = W.sequence_hashes(long, 35)
    assert (s[:10] == s[65530:65540]).all() and len(set(s.tolist())) == 10


def test_groups_cover_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 10, None, "y" * 100, "", "z"])], ["text"])
    parts = list(W.groups(batch, size=20))
    assert sum(len(p) for p in parts) == 5 and [p.column(0).to_pylist() for p in parts][0] == ["x" * 10, None]
