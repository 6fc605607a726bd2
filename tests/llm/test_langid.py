import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from rankweave.llm import kernels as K
from rankweave.llm import langid
from tests.llm.conftest import ODD


def brute_bits(train, text):
    """Code length of `text` under PPM-C with frozen counts of `train`, symbol by symbol."""
    counts = defaultdict(Counter)
    for t in train:
        raw = bytes(3) + t.encode()
        for i in range(3, len(raw)):
            for k in range(4):
                counts[k, raw[i - k : i]][raw[i]] += 1
    raw, bits = bytes(3) + text.encode(), 0.0
    for i in range(3, len(raw)):
        for k in (3, 2, 1, 0):
            c = counts.get((k, raw[i - k : i]))
            if c is None:
                continue
            n, d = sum(c.values()), len(c)
            if raw[i] in c:
                bits -= math.log2(c[raw[i]] / (n + d))
                break
            bits -= math.log2(d / (n + d))
        else:
            bits += 8
    return bits


def words(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 5))) for _ in range(n))


def test_code_lengths_are_exact(monkeypatch):
    rng = random.Random(6)
    trains = {"aa": [words(rng, "abc", 30) for _ in range(3)], "bb": [words(rng, "bcdé", 30)]}
    tables = []
    for texts in trains.values():
        data, offs = K.text_column(pa.array(texts))
        tables.append(np.unique(langid.byte_strings(data, offs), return_counts=True))
    model = langid.Model.freeze(list(trains), tables)
    tests = [words(rng, "abcdé", 20), "", "zzz q", "a", words(rng, "bc", 50)]
    data, offs = K.text_column(pa.array(tests))
    for chunk in (5, 1 << 20):
        monkeypatch.setattr(K, "CHUNK", chunk)
        got = model.bits(data, offs)
        for k, texts in enumerate(trains.values()):
            assert got[k] == pytest.approx([brute_bits(texts, t) for t in tests], rel=1e-5, abs=1e-4)


def test_held_out_accuracy_and_odd_rows(make):
    rng = random.Random(9)
    texts, langs = [], []
    for k in range(200):
        texts.append(words(rng, "aeiout" if k % 2 else "xyzkrt", 12))
        langs.append(["vow", "con"][k % 2 == 0] if k % 7 else None)
    texts += [*ODD, "123 ...", None]
    langs += [None] * (len(ODD) + 1) + ["vow"]
    rows = langid.identify(make(texts, lang=langs)).orderBy("doc_id").collect()
    for r, text in zip(rows, texts, strict=True):
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
    assert all(r.lang_pred == ["vow", "con"][r.doc_id % 2 == 0] for r in rows[:200])
    assert {r.lang_pred for r in langid.identify(make(["abc", None], lang=[None, None])).collect()} == {"und"}
    assert {r.lang_pred for r in langid.identify(make(["", "abc", "q"] * 3, lang=["x"] * 9)).collect()} == {"und", "x"}
    assert langid.identify(make([])).isEmpty()


def test_no_language_is_left_out_of_the_sample(make):
    """Documents far beyond a language's share of the bytes: one of each is still learned."""
    texts = ["aeiou " * 400, "xyzkr " * 400, "", "bcdfg " * 400]
    docs = make(texts * 2, lang=["vow", "con", "con", "mid"] * 2)
    model = langid.fit(docs, size=1)
    assert model.langs == ["con", "mid", "vow"]
    assert [r.lang_pred for r in langid.predict(make(["aeiou aeiou", "xyzkr xyz", "bcd fg"]), model).orderBy("doc_id").collect()] == ["vow", "con", "mid"]
