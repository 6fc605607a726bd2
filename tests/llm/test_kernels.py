import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from rankweave.llm import kernels as K

from tests.llm.conftest import ODD, words_of

texts = st.lists(st.one_of(st.none(), st.text(st.sampled_from("aB \t\né日.")), st.sampled_from([x for x in ODD if x is not None])), max_size=6)


@given(texts, st.sampled_from([7, 64, 1 << 20]))
@settings(max_examples=80, deadline=None)
def test_words_in_pieces_of_any_size(batch, chunk):
    held, K.CHUNK = K.CHUNK, chunk
    try:
        data, offs = K.text_column(pa.array(batch, pa.string()))
        hashes, start, end, counts = K.words(data, offs, lower=True)
    finally:
        K.CHUNK = held
    expected = [words_of(t) for t in batch]
    assert counts.tolist() == [len(w) for w in expected]
    raw = [bytes(data[a:b]).decode() for a, b in zip(start, end)]
    assert raw == [w for t in batch for w in words_of(t, fold=False)]
    flat = [w for e in expected for w in e]
    by_word = {}
    for w, h in zip(flat, hashes.tolist()):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_packing(values):
    v = np.array(values, np.uint64)
    assert (K.unpack_all(K.pack_all(v, np.sort(v)))[0] == v).all()
    assert (np.cumsum(K.deltas(np.sort(v)), dtype=np.uint64) == np.sort(v)).all()


def test_slices_cover_all_rows():
    data, offs = K.text_column(pa.array(["a" * 10, "", "b" * 100, None, "c"], pa.string()))
    assert [x for a, b in K.slices(data, offs, 12) for x in range(a, b)] == list(range(5))
