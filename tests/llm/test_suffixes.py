import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from urbanloom.llm.suffixes import _induce, _induce_singly, permuted_prefixes, suffix_array


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 5).flatmap(lambda k: st.lists(st.integers(1, k), min_size=1, max_size=120)), st.integers(1, 4))
def test_order_and_prefixes(symbols, times):
    data = np.array(symbols * times, dtype=np.uint8)
    sa = suffix_array(np.append(data.astype(np.int32), 0), int(data.max()) + 1)
    raw = data.tobytes()
    want = sorted(range(len(raw) + 1), key=lambda i: raw[i:])
    assert sa.tolist() == want
    got = permuted_prefixes(data, sa)
    for a, b in zip(want[1:], want[2:]):
        n = next((k for k in range(len(raw)) if a + k >= len(raw) or b + k >= len(raw) or raw[a + k] != raw[b + k]), len(raw))
        assert got[b] == n


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=2, max_size=150), st.integers(1, 40))
def test_both_inductions_agree(symbols, kinds):
    s = np.append(np.array(symbols, dtype=np.int32) % kinds + 1, 0).astype(np.int32)
    ends = np.cumsum(np.bincount(s, minlength=kinds + 2))
    heads = np.r_[0, ends[:-1]]
    order = sorted(range(len(s)), key=lambda i: s[i:].tolist())
    rank = {p: k for k, p in enumerate(order)}
    rank[len(s)] = len(s)
    lms = np.array([i for i in order if i and rank[i - 1] > rank[i] < rank[i + 1]], dtype=np.int32)
    assert _induce(s, lms, heads, ends).tolist() == order == _induce_singly(s, lms, heads, ends).tolist()


def test_long_texts_recurse_on_their_names():
    rng = np.random.default_rng(5)
    data = np.concatenate([rng.integers(97, 123, 40_000), np.tile(rng.integers(97, 123, 700), 20), np.full(5000, 97)]).astype(np.uint8)
    sa = suffix_array(np.append(data.astype(np.int32), 0), 257)
    raw = data.tobytes()
    for a, b in zip(sa[1:].tolist(), sa[2:].tolist()):
        k = 8
        while raw[a : a + k] == raw[b : b + k]:
            k *= 2
        assert raw[a : a + k] < raw[b : b + k]
    assert sorted(sa.tolist()) == list(range(len(raw) + 1))
