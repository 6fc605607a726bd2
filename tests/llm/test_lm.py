import io
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from rankweave.llm import elias_fano as E
from rankweave.llm import lm
from tests.llm.conftest import ODD, words_of


@given(st.lists(st.integers(0, 10**6), max_size=200), st.lists(st.integers(0, 2 * 10**6), max_size=50), st.integers(0, 40))
@settings(max_examples=150, deadline=None)
def test_elias_fano(values, wanted, wide):
    values = np.sort(np.array(values, np.uint64)) << np.uint64(wide)
    wanted = np.array(wanted + values.tolist()[:20], np.uint64)
    ef = E.EliasFano.build(values, int(values[-1]) + 1 if len(values) else 1)
    at, found = ef.find(wanted)
    assert (at == np.searchsorted(values, wanted)).all() and (found == np.isin(wanted, values)).all()
    assert (ef.at(np.arange(len(values))) == values).all()
    for chunk in (3, 1 << 18):
        in_order = ef.merge(np.sort(wanted), chunk)
        assert all((a == b).all() for a, b in zip(in_order, ef.find(np.sort(wanted)), strict=True))
    if len(values):
        bits = 8 * (ef.low.nbytes + ef.high.nbytes)
        assert bits <= len(values) * (3 + math.log2((int(values[-1]) + 1) / len(values) + 1)) + 200


def build_trie(keys, count, unigram, kappa):
    """Trie and arrays p2[root, word], from sorted (root, context, word)."""
    v = len(unigram)
    want = np.zeros((v, v, v))
    want[keys[:, 0], keys[:, 1], keys[:, 2]] = count
    p2 = (want.sum(1) + kappa[0] * unigram) / (want.sum((1, 2))[:, None] + kappa[0])
    p3 = (want + kappa[1] * p2[:, None, :]) / (want.sum(2)[:, :, None] + kappa[1])
    pairs, pair_of = np.unique(keys[:, 0] * v + keys[:, 2], return_inverse=True)
    ctx, ctx_of = np.unique(keys[:, 0] * v + keys[:, 1], return_inverse=True)
    back = kappa[1] / (want.sum(2).ravel()[ctx] + kappa[1])
    trie = E.Trie.build(v, v, pairs, np.log10(p2).ravel()[pairs], ctx, np.log10(back), ctx_of, pair_of, np.log10(p3[keys[:, 0], keys[:, 1], keys[:, 2]]))
    return trie, p2, p3


def ask(trie, r, t, w, p2):
    place, shorter = trie.pairs(r, w, np.log10(p2[r, w]))
    at, back = trie.contexts(r, t)
    return trie.trigrams(at, place, back, shorter)


def test_trie_saves_and_maps(tmp_path):
    rng = np.random.Generator(np.random.PCG64(5))
    keys = np.unique(rng.integers(0, 20, (400, 3)), axis=0)
    count = rng.integers(1, 9, len(keys)).astype(float)
    unigram = rng.random(20)
    unigram /= unigram.sum() * 1.1
    trie, p2, p3 = build_trie(keys, count, unigram, (3.0, 2.0))
    r, t, w = (x.ravel() for x in np.meshgrid(np.arange(20), np.arange(20), np.arange(20), indexing="ij"))
    one = ask(trie, r, t, w, p2)
    path = tmp_path / "trie"
    with path.open("w+b") as f:
        trie.save(f)
        again = E.Trie.open(f)
    assert (ask(again, r, t, w, p2) == one).all() and (ask(trie.mapped(), r, t, w, p2) == one).all()
    assert np.abs(one - np.log10(p3).ravel()).max() < 6e-4
    assert (p3.sum(2) < 1).all()  # no context gives out more than one


def test_rare_events_keep_their_probability():
    assert E.restore(E.quantise(np.array([-23.456]))) == pytest.approx(-23.456, abs=3e-4)
    with pytest.raises(OverflowError):
        E.quantise(np.array([-40.0]))


def brute(docs, held, kappa):
    c, pairs, triples, starts, ctx = Counter(), Counter(), Counter(), Counter(), Counter()
    tokens = {k: [*words_of(t), None] for k, t in docs.items()}
    for k, w in tokens.items():
        if not held(k):
            c.update(w)
            for i in range(1, len(w)):
                t = w[i - 2] if i > 1 else 0
                pairs[w[i - 1], w[i]] += 1
                starts[w[i - 1]] += 1
                triples[t, w[i - 1], w[i]] += 1
                ctx[t, w[i - 1]] += 1
    n, v = sum(c.values()), len(c)
    out = {}
    for k, w in tokens.items():
        base = [math.log10((c[x] + 1) / (n + v + 1)) for x in w]
        s = base[0]
        for i in range(1, len(w)):
            t, u, x = (w[i - 2] if i > 1 else 0), w[i - 1], w[i]
            if not c[u]:
                s += base[i]
                continue
            p2 = (pairs[u, x] + kappa[0] * (c[x] + 1) / (n + v + 1)) / (starts[u] + kappa[0])
            s += math.log10((triples[t, u, x] + kappa[1] * p2) / (ctx[t, u] + kappa[1]))
        out[k] = len(w), sum(c[x] > 0 for x in w), n, sum(base), s
    return out


def corpus():
    rng = random.Random(14)
    line = "the common line of all".split()
    texts = [*ODD]
    for _ in range(120):
        w = [rng.choice("the a of cat dog runs far home".split()) if rng.random() < 0.7 else f"r{rng.randrange(300)}" for _ in range(rng.randint(0, 30))]
        texts.append(" ".join(w + line * (rng.random() < 0.3)))
    return texts


@pytest.mark.parametrize("block_bytes", [400, 6 << 20])
def test_against_brute_force(make, block_bytes):
    texts = corpus()
    held = lambda k: zlib.crc32(str(k).encode()) % 7 == 2
    want = brute(dict(enumerate(texts)), held, lm.KAPPA)
    for r in lm.score(make(texts), block_bytes=block_bytes).collect():
        n, known, train, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, train, held(r.doc_id))
        assert r.base_score == pytest.approx(base, rel=1e-9) and abs(r.score - score) < 1e-3 * n


def test_scores_do_not_depend_on_shards(make):
    """Roots in many parts, and a handful of tokens a shard: the same scores, to the last bit."""
    texts = corpus()
    one = {r.doc_id: (r.score, r.base_score) for r in lm.score(make(texts), block_bytes=2000).collect()}
    for shards, part in (((50, 30, 40), 5), ((5000, 5000, 5000), 1)):
        again = {r.doc_id: (r.score, r.base_score) for r in lm.score(make(texts), block_bytes=2000, shards=shards, part=part).collect()}
        assert again == one


def test_parts_spread_a_root():
    """A root that is everywhere goes to many shards, and every question to just one."""
    tokens = lm._Tokens(lm._describe(*_block([" ".join(f"the w{k}" for k in range(500))]))[0])
    count = np.full(len(tokens.names), 10, np.uint64)
    number = np.arange(len(tokens.names), dtype=np.uint64) + np.uint64(50)
    whole, spread = (lm._Grams(tokens, count, number, 1, (64, 64), part).with_trigrams() for part in (100, 1))
    for g in (whole, spread):
        assert sorted(g.order) == list(range(len(g.pair))) and sum(j - i for _, i, j in g.runs) == len(g.pair)
        assert g.seen.sum() == len(g.asks)
    the = np.bincount(whole.a).argmax()
    shards = lambda g: {s for s, i, j in g.runs if (g.a[g.pair[g.order[i:j]]] == the).any()}
    assert len(shards(whole)) == 1 and len(shards(spread)) > 8


def _block(texts):
    import pyarrow as pa

    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([True] * len(texts)), pa.array(texts)], ["doc_id", "train", "text"])
    return (*lm.K.text_column(rows.column(2)), rows)


def test_odd_tables(make):
    assert lm.score(make([])).isEmpty()
    (r,) = lm.score(make(["a b c"], [None])).collect()
    assert r.doc_id is None and not r.held_out and r.n_tokens == 4
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    (r,) = lm.score(make(["a b c"], [held])).collect()
    assert (r.train_tokens, r.n_known, r.base_score, r.score) == (0, 0, 0.0, 0.0)
