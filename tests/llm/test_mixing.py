import random
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import pytest

from rankweave.llm import mixing
from tests.llm.conftest import ODD


def corpus():
    rng = random.Random(3)
    texts, sources = list(ODD), ["a"] * len(ODD)
    for k in range(300):
        texts.append("w " * rng.choice([0, 1, 5, 5, 5, 40]))
        sources.append("hot" if k % 3 == 0 else rng.choice(["b", "é", "B", None, "zero"]))
        if sources[-1] == "zero":
            texts[-1] = " "
    return texts, sources


def test_against_sql(make):
    texts, sources = corpus()
    got = mixing.assign(make(texts, source=sources)).toPandas()
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "source": sources})  # noqa: F841
    want = duckdb.sql(mixing.oracle()).df()
    columns = sorted(got.columns)
    order = lambda df: df[columns].sort_values(["doc_id"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False, check_exact=True)


def test_targets_are_filled_to_their_limits(make):
    texts, sources = corpus()
    rows = mixing.assign(make(texts, source=sources)).collect()
    total = sum(r["size"] for r in rows)
    by = {r.source: r for r in rows}
    order = sorted((s for s in by if s is not None)) + ([None] if None in by else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    want, full = {}, set()
    while True:  # hand out by weight, fill up, hand out what is over again
        left = 1.5 * total - sum(2 * by[s].source_size for s in full)
        share = left / sum(weight[s] for s in by if s not in full) if len(full) < len(by) else 0
        over = {s for s in by if s not in full and weight[s] * share >= 2 * by[s].source_size}
        if not over:
            break
        full |= over
    for s, r in by.items():
        want[s] = 2 * r.source_size if s in full else weight[s] * share
        assert r.target == pytest.approx(want[s])
    assert sum(want.values()) == pytest.approx(1.5 * total)
    taken = defaultdict(int)
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    for s, r in by.items():
        assert abs(taken[s] - r.target) <= max((x["size"] for x in rows if x.source == s), default=0)


def test_reruns_and_partitions_agree(make):
    texts, sources = corpus()
    df = make(texts, source=sources)
    one, two = (Counter(map(tuple, mixing.assign(x).collect())) for x in (df, df.repartition(7)))
    assert one == two


def test_emitted_rows(make):
    texts, sources = corpus()
    df = make(texts, source=sources)
    copies = {r.doc_id: r.copies for r in mixing.assign(df).collect()}
    out = mixing.mix(df)
    assert out.columns == df.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({k: v for k, v in copies.items() if v})
    assert mixing.assign(make([])).isEmpty() and mixing.mix(make([])).isEmpty()


def test_ranges_of_documents(make, monkeypatch):
    texts, sources = corpus()
    want = Counter(map(tuple, mixing.assign(make(texts, source=sources)).collect()))
    monkeypatch.setattr(mixing, "RANGE_ROWS", 10)
    assert Counter(map(tuple, mixing.assign(make(texts, source=sources)).collect())) == want
