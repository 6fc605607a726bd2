import hashlib
import random
from itertools import groupby

import numpy as np
import pytest

from rankweave.llm import substring_dedup as S
from tests.llm.conftest import ODD, words_of


def brute(texts, ids):
    first, out = {}, {}
    runs = [(i, words_of(t, fold=False)) for i, t in zip(ids, texts)]
    for i, w in runs:
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, i), i)
    for n, (i, w) in enumerate(runs):
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        lengths = [len(list(x)) for g, x in groupby(gone) if g]
        out[n] = [x for x, g in zip(w, gone) if not g], len(w), len(lengths), max(lengths, default=0)
    return out


def corpus():
    rng = random.Random(31)
    shared = [[f"s{k}_{i}" for i in range(rng.choice([12, 13, 14, 60]))] for k in range(6)]
    texts = [*ODD, "z " * 40, "z " * 13, "z " * 12]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts += [f"u{rng.randrange(10**6)}" for _ in range(rng.randint(0, 30))] + rng.choice(shared)
        texts.append("  ".join(parts))
    return texts + texts[20:30]


@pytest.mark.parametrize("block_bytes", [300, 1 << 20])
def test_against_brute_force(make, block_bytes):
    texts = corpus()
    ids = random.Random(1).sample(range(-500, 500), len(texts))
    ids[-1] = ids[-2]
    df = make([*texts], ids).withColumnRenamed("size", "n").withColumn("place", S.F.monotonically_increasing_id())
    want = sorted((i, n, n - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest(), *more) for i, (kept, n, *more) in zip(ids, brute(texts, ids).values()))
    rows = S.remove_repeats(df, keep=("doc_id", "lang"), with_text=True, group=50, block_bytes=block_bytes).collect()
    assert max(r.longest for r in rows) > 13
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.n_stretches, r.longest) for r in rows) == want
    assert all(hashlib.sha256((r.text or "").encode()).hexdigest() == r.kept_sha256 for r in rows)


def test_a_prefix_of_eight_words_that_fills_several_groups(make):
    """All passages begin with the same eight words; groups part them by all thirteen, and repeats still meet."""
    texts = ["the same eight words all the way down " + " ".join(f"x{k % 150}_{i}" for i in range(6)) for k in range(300)]
    want = brute(texts, list(range(len(texts))))
    rows = S.remove_repeats(make(texts), group=10, block_bytes=500).collect()
    assert {r.doc_id: (r.n_removed, r.longest) for r in rows} == {i: (n - len(kept), longest) for i, (kept, n, _, longest) in want.items()}
    head, tail = np.full(1000, 7, np.uint64), np.arange(1000, dtype=np.uint64)
    parts = S.group_of(head, tail, np.array([3, 7, 7, 7, 7, 9], np.uint64))
    assert set(parts) == {1, 2, 3, 4} and np.bincount(parts).max() < 400
    assert S.group_of(np.array([0, 3, 5, 8, 10], np.uint64), head[:5], np.array([3, 7, 7, 9], np.uint64)).tolist() == [0, 0, 1, 3, 4]


def test_odd_tables(make):
    assert S.remove_repeats(make([])).isEmpty()
    w = " ".join(f"a{i}" for i in range(20))
    rows = S.remove_repeats(make([w, w, None, w], [None, 4, 5, 3]), with_text=True).collect()
    assert sorted((r.doc_id or -1, r.n_removed, r.text) for r in rows) == [(-1, 20, ""), (3, 0, w), (4, 20, ""), (5, 0, None)]


def test_common_prefixes_and_deep_nodes():
    head = np.array([0x0102030405060708, 0x0102030405060708, 0x0102030405060708, 0x0102FF0405060708], np.uint64)
    tail = np.array([0x0102030405, 0x0102030405, 0x01020304FF, 0x0102030405], np.uint64)
    shared = S.common_prefixes(head, tail)
    assert shared.tolist() == [0, 13, 12, 2]
    assert S.deep_nodes(shared, 13).tolist() == [0, 2, 3] and S.deep_nodes(shared, 12).tolist() == [0, 3]
