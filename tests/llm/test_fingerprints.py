import hashlib
import struct

import pytest

from rankweave.llm import fingerprints as fp
from tests.llm.conftest import ODD, words_of

xxhash = pytest.importorskip("xxhash")


def h_text(s):
    return xxhash.xxh64_intdigest(s.encode(), 42)


def h_pair(a, b):
    first = xxhash.xxh64_intdigest(struct.pack("<Q", a), 42)
    return first if b is None else xxhash.xxh64_intdigest(struct.pack("<Q", b), first)


def brute(text):
    """Entries of a text: (hash, position) of each window's least gram, the rightmost of equals."""
    h = [h_text(w) for w in words_of(text, fold=False)]
    if not h:
        return []
    at = lambda x, i: x[i] if i < len(x) else None
    two = [h_pair(h[i], at(h, i + 1)) for i in range(len(h))]
    four = [h_pair(two[i], at(two, i + 2)) for i in range(len(h))]
    five = [h_pair(four[i], at(h, i + 4)) for i in range(max(1, len(h) - 4))]
    grams = [(x >> 27, -i) for i, x in enumerate(five)]
    out = []
    for k in range(max(1, len(grams) - 7)):
        v, i = min(grams[k : k + 8])
        if (v, -i) not in out:
            out.append((v, -i))
    return out


def test_against_brute_force(make):
    texts = [*ODD, " ".join(f"w{i % 7}" for i in range(90)), " ".join(f"w{i * i % 31}" for i in range(60)), "one"]
    got = fp.edit_fingerprints(make(texts)).orderBy("doc_id").collect()
    order = list(range(len(texts)))[::-1]
    for r in got:
        text, after = texts[r.doc_id] or "", texts[order[(order.index(r.doc_id) + 1) % len(order)]] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        show = lambda t: " ".join(f"{v:x}:{i}" for v, i in brute(t))
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == show(text) and r.edited_fingerprint == show(edited)
        for other, near in ((edited, r.near_edited), (after, r.near_next)):
            a, b = ({v for v, _ in brute(t)} for t in (text, other))
            assert near == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)


def test_shared_passages_are_found():
    shared = " ".join(f"s{i}" for i in range(12))
    a, b = (brute(f"{x} {shared} {y}") for x, y in (("p q r", "t"), ("u", "v w x y z")))
    assert {v for v, _ in a} & {v for v, _ in b}


@pytest.mark.parametrize("rows", [1, 3, 100])
def test_neighbours_across_cells(make, monkeypatch, rows):
    """Clustered ids, repeated ids and rows without one, in cells of any size: one chain of all rows."""
    monkeypatch.setattr(fp, "CELL_ROWS", rows)
    ids = [5, 1000, 7, 7, -3, 88, 2000000, 90, 91, 92, 93, None, None, None, 7]
    texts = [f"t{i}" for i in range(len(ids) - 1)] + ["t3"]
    docs = make(texts, ids)
    got = fp.with_next(docs, fp.F.col("text"), fp.F.struct("doc_id", fp.F.col("_text").alias("text"))).collect()
    h = {r.text: r.h for r in docs.select("text", fp.F.xxhash64("text").alias("h")).collect()}
    order = sorted((i for i in range(len(ids)) if ids[i] is not None), key=lambda i: (-ids[i], h[texts[i]]))
    want = [((ids[i], texts[i]), (ids[j], texts[j])) for i, j in zip(order, order[1:])]
    pairs = [(tuple(r.v), tuple(r.next_v)) for r in got]
    assert all(pairs.count(w) == want.count(w) for w in want)
    # rows without an id follow the last one with an id, each once, and lead back to the first
    loose = [p for p in pairs if p not in want]
    at, seen = (ids[order[-1]], texts[order[-1]]), []
    for _ in range(4):
        at = next(b for a, b in loose if a == at)
        seen.append(at)
    assert sorted(t for _, t in seen[:3]) == ["t11", "t12", "t13"] and seen[3] == (ids[order[0]], texts[order[0]]) and len(pairs) == len(ids)


def test_one_and_none(make):
    (only,) = fp.edit_fingerprints(make(["a b c d e f"])).collect()
    assert only.near_next == 1.0
    assert fp.edit_fingerprints(make([])).isEmpty()
