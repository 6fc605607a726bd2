import random
import re
import zlib

import numpy as np
import pytest

from rankweave.llm import toxicity as X
from tests.llm.conftest import ODD

BAD = ["vileword", "nastier", "slurring"]


def corpus(n=400):
    rng = random.Random(12)
    texts, toxic, quality = [], [], []
    for k in range(n):
        t = [rng.choice("apple river stone cloud bread night paper green".split()) for _ in range(rng.randint(5, 60))]
        bad = k % 5 == 0
        if bad:
            t[rng.randrange(len(t))] = rng.choice(BAD).upper() + "!"
        low = k % 3 == 0
        if low:
            t += ["CLICK", "here"]
        texts.append(" ".join(t))
        toxic.append(int(bad))
        quality.append(1 - int(low))
    return texts, toxic, quality


def labels(spark, toxic, quality):
    return spark.createDataFrame([(k, q, t) for k, (t, q) in enumerate(zip(toxic, quality))], "doc_id long, quality int, toxic int")


def test_finds_toxic_and_keeps_clean(spark, make):
    texts, toxic, quality = corpus()
    half = labels(spark, toxic, quality).filter("doc_id % 2 = 0")
    rows = X.classify(make([*texts, *ODD]), half).orderBy("doc_id").collect()
    assert [r.toxic for r in rows] == [bool(t) for t in toxic] + [False] * len(ODD)
    low = np.array([r.p_low_quality for r in rows[: len(texts)]])
    assert ((low > 0.5) == (np.array(quality) == 0)).all()


def test_chain_uses_out_of_fold_probabilities(spark, make):
    texts, toxic, quality = corpus(200)
    chain = X.fit(make(texts), X.category_labels(labels(spark, toxic, quality)), X.CATEGORIES)
    assert chain.names == ["low_quality", "toxic"] and [len(m.chained) for m in chain.models] == [0, 1]
    data, offs = X.K.text_column(__import__("pyarrow").array(texts))
    fitted = chain.probabilities(data, offs)[:, 0]
    assert chain.out_of_fold.shape == (200, 2) and not np.allclose(np.sort(fitted), np.sort(chain.out_of_fold[:, 0]))


def test_gradient_vanishes_at_the_fit():
    rng = np.random.Generator(np.random.PCG64(4))
    dense = rng.random((300, 6)) < 0.4
    before = rng.normal(size=(300, 1))
    label = (rng.random(300) < 1 / (1 + np.exp(-(dense @ rng.normal(size=6) + before[:, 0])))).astype(float)
    row, feature = np.nonzero(dense)
    m = X.fit_linear(row, feature, np.ones(6, bool), before, label, rounds=4000)
    p = m.probability(row, feature, 300, before)
    g = dense.T @ (p - label) + 0.3 * m.weight
    assert np.abs(g).max() < 1e-3 and abs((p - label).sum()) < 1e-3 and abs((before[:, 0] * (p - label)).sum() + 0.3 * m.chained[0]) < 1e-3


def test_degenerate_labels(spark, make):
    texts, toxic, quality = corpus(30)
    clean = X.classify(make(texts), labels(spark, [0] * 30, quality)).collect()
    assert not any(r.toxic for r in clean)
    none = X.classify(make(texts), labels(spark, toxic, quality).limit(0)).collect()
    assert len(none) == 30 and not any(r.toxic for r in none)
    twice = labels(spark, toxic, quality).unionByName(spark.createDataFrame([(0, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int"))
    assert X.classify(make(texts), twice.unionByName(twice)).count() == 30
    assert X.classify(make([]), labels(spark, toxic, quality)).isEmpty()


def test_sample_bound(spark, make):
    texts, toxic, quality = corpus(300)
    chain = X.fit(make(texts), X.category_labels(labels(spark, toxic, quality)), X.CATEGORIES, rows=100)
    assert 50 < len(chain.out_of_fold) < 160


def naive_chain(texts, columns):
    """The chain written out plainly: sets of strings, dense matrices, Newton's method."""

    def has(text):
        words = re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
        return {(0, w) for w in words} | {(k, w[:k]) for k in X.PREFIXES for w in words if len(w) > k}

    sets = [has(t) for t in texts]
    every = sorted(set().union(*sets))
    dense = np.array([[f in s for f in every] for s in sets], float)
    fold = np.array([zlib.crc32(str(k).encode()) % X.FOLDS for k in range(len(texts))])

    def choose(rows, y):
        n, n_pos = rows.sum(), y[rows].sum()
        seen, pos = dense[rows].sum(0), dense[rows & (y == 1)].sum(0)
        p, out = n_pos / n, np.zeros(len(every), bool)
        for j in range(len(every)):
            a, b = pos[j], seen[j] - pos[j]
            gain = (a * np.log(a / (seen[j] * p)) if a else 0) + (b * np.log(b / (seen[j] * (1 - p))) if b else 0)
            out[j] = a >= X.SUPPORT and a >= p * seen[j] and gain > 3.0
        return out

    def fit(x, y, penalty):
        w = np.zeros(x.shape[1])
        for _ in range(200):
            q = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
            step = np.linalg.solve(x.T @ (x * (q * (1 - q))[:, None]) + np.diag(penalty) + 1e-9 * np.eye(len(w)), x.T @ (q - y) + penalty * w)
            w -= step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        return w

    logit = lambda p: np.log(np.clip(p, 1e-4, 1 - 1e-4) / (1 - np.clip(p, 1e-4, 1 - 1e-4)))
    oof, final = [], []
    for y in columns:
        def model(rows, before, y=y):
            keep = choose(rows, y)
            x = np.column_stack([np.ones(len(y)), dense[:, keep], *before])
            return keep, fit(x[rows], y[rows], np.array([0.0] + [0.3] * (x.shape[1] - 1)))

        def said(keep, w, before):
            return 1 / (1 + np.exp(-np.column_stack([np.ones(len(texts)), dense[:, keep], *before]) @ w))

        earlier, p = [logit(o) for o in oof], np.zeros(len(texts))
        for f in range(X.FOLDS):
            p[fold == f] = said(*model(fold != f, earlier), earlier)[fold == f]
        final.append(said(*model(np.ones(len(texts), bool), earlier), [logit(q) for q in final]))
        oof.append(p)
    return np.array(oof).T, np.array(final).T


def test_against_a_naive_chain(spark, make, monkeypatch):
    monkeypatch.setattr(X.fit_linear, "__defaults__", (0.3, 4000))
    texts, toxic, quality = corpus(150)
    chain = X.fit(make(texts), X.category_labels(labels(spark, toxic, quality)), X.CATEGORIES)
    want_oof, want = naive_chain(texts, [1 - np.array(quality), np.array(toxic)])
    got = np.array([[r.p_low_quality, r.p_toxic] for r in X.score(make(texts), chain).orderBy("doc_id").collect()])
    assert np.abs(got - want).max() < 0.01
    assert np.abs(np.sort(chain.out_of_fold, 0) - np.sort(want_oof, 0)).max() < 0.01


def test_repeated_ids_train_with_one_text_and_long_texts_are_bounded(spark, make):
    texts, toxic, quality = corpus(120)
    twice, ids = [*texts, *(t + " vileword" for t in texts)], [*range(120), *range(120)]
    told = X.category_labels(labels(spark, toxic, quality))
    one, two = (X.score(make(texts), X.fit(make(t, i).repartition(n), told, X.CATEGORIES)).orderBy("doc_id").collect() for t, i, n in ((twice, ids, 2), (twice[::-1], ids[::-1], 5)))
    assert one == two
    small = X.fit(make(texts), told, X.CATEGORIES, size=sum(map(len, texts)) // 2)
    assert 30 < len(small.out_of_fold) < 90
