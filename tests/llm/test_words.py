import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from vitalgrid.llm import words as w
from vitalgrid.llm.sharding import _probe_keys, _sort_key

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbB é\x85\x1c\t\n\x0b日 ", max_size=30)), max_size=6)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.booleans())
def test_words_are_those_of_a_bytes_split(texts, lower):
    words = w.Words(pa.array(texts, pa.string()), lower)
    expected = [(t or "").encode().split() for t in texts]
    if lower:
        expected = [[x.lower() for x in some] for some in expected]
    assert words.counts.tolist() == [len(x) for x in expected]
    by_hash = {}
    for word, h in zip([x for some in expected for x in some], words.hashes.tolist(), strict=True):
        assert by_hash.setdefault(word, h) == h
    assert len(set(by_hash.values())) == len(by_hash)


def test_slices_do_not_change_hashes(monkeypatch):
    texts = pa.array(["ab cd " * 50, None, "x" * 300 + " y", "ab"])
    whole = w.Words(texts)
    monkeypatch.setattr(w, "SLICE", 16)
    assert (w.Words(texts).hashes == whole.hashes).all()
    assert (w.Words(texts).starts == whole.starts).all()


def test_sort_keys_compare_as_pairs_of_signed_longs():
    pairs = [(-5, 0), (-5, 3), (0, -(1 << 63)), (0, 1), (1, -1), ((1 << 63) - 1, (1 << 63) - 1)]
    keys = _sort_key(*np.array(pairs, np.int64).T.copy())
    assert sorted(keys.tolist()) == keys.tolist()
    assert _probe_keys([0])[0] <= keys[0]
