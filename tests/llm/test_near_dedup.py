import random
import re

import numpy as np
import pytest

from rankweave.llm import near_dedup as N
from rankweave.llm import components as C
from rankweave.llm import skew, storage
from rankweave.llm.components import components, merged
from tests.llm.conftest import ODD, words_of


def sets_of(texts):
    out = []
    for t in texts:
        w = words_of(t)
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute(texts, ids, percent):
    sets, root = sets_of(texts), {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(ids[a]), top(ids[b])))
                root[y] = x
    return {i: top(i) for i in ids}, {i: len(s) for i, s in zip(ids, sets)}


def corpus():
    rng = random.Random(21)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.choice([6, 14, 40, 300, 900]))] for _ in range(25)]
    texts = list(ODD)
    for words in base:
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 7)):
            copy = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, max(1, len(words) // 60)])):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(99)}"
            texts.append(" ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("percent", [80, 85])
def test_against_brute_force(make, percent):
    texts = corpus()
    ids = [7 * k + 3 for k in range(len(texts))]
    component, size = brute(texts, ids, percent)
    rows = N.link(make(texts, ids), percent).collect()
    assert {r.doc_id: r.component_id for r in rows} == component
    assert {r.doc_id: r.n_shingles for r in rows} == size
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    kept = N.deduplicate(make(texts, ids), percent)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(component.values()))
    assert kept.columns == make(texts, ids).columns


def chain(n):
    """Each text is similar to its neighbours only; a star around any one misses most links."""
    words = [f"c{i}" for i in range(120)]
    return [" ".join(words[2 * k :] + [f"t{i}" for i in range(2 * k)]) for k in range(n)]


@pytest.mark.parametrize("centres", [1, 8])
def test_chains_through_blocks(make, monkeypatch, centres):
    monkeypatch.setattr(N, "BLOCK_BYTES" if centres == 1 else "BLOCK", 4000 if centres == 1 else 4)
    monkeypatch.setattr(N, "CENTRES", centres)
    texts = chain(30)
    component, _ = brute(texts, list(range(30)), 85)
    assert set(component.values()) == {0}
    assert {r.component_id for r in N.link(make(texts), 85).collect()} == {0}


def test_hot_classes_and_centres_are_spread(make, monkeypatch):
    """With three rows as the most of a key in one task, and one more centre: the same links."""
    monkeypatch.setattr(skew, "ROWS", 3)
    monkeypatch.setattr(N, "CENTRES", 1)
    monkeypatch.setattr(N, "BLOCK_BYTES", 4000)
    texts = corpus()
    texts += [texts[-1]] * 20
    component, _ = brute(texts, list(range(len(texts))), 85)
    assert {r.doc_id: r.component_id for r in N.link(make(texts), 85).collect()} == component


def test_join_spread_is_a_join(spark, monkeypatch):
    monkeypatch.setattr(skew, "ROWS", 3)
    rows = spark.createDataFrame([(1, k) for k in range(50)] + [(2, 7), (3, 8)], "k int, v int")
    table = spark.createDataFrame([(1, "a"), (2, "b")], "k int, w string")
    counts = rows.groupBy("k").count().withColumnRenamed("count", "n")
    for how in ("inner", "left"):
        got = skew.join_spread(rows, table, "k", counts.filter("n > 0"), *skew.sizes(counts), "v", how)
        assert sorted(map(str, got.select("k", "v", "w").collect())) == sorted(map(str, rows.join(table, "k", how).select("k", "v", "w").collect()))


@pytest.mark.parametrize("limit", [3, 500])
def test_join_spread_broadcasts_no_list_by_a_binary_key(spark, monkeypatch, limit):
    """Each of those takes a memory page of every executor until the driver drops it."""
    monkeypatch.setattr(skew, "ROWS", limit)
    rows = spark.createDataFrame([(b"a", k) for k in range(50)] + [(b"b", 7), (b"c", 8), (None, 9)], "k binary, v int")
    table = spark.createDataFrame([(b"a", "x"), (b"b", "y"), (None, "z")], "k binary, w string")
    counts = rows.groupBy("k").count().withColumnRenamed("count", "n")
    for how in ("inner", "left"):
        got = skew.join_spread(rows, table, "k", counts, *skew.sizes(counts), "v", how, merge=True).select("k", "v", "w")
        assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(table, "k", how).select("k", "v", "w").collect()))
        kinds = set(re.findall(r"HashedRelationBroadcastMode\(List\(input\[\d+, (\w+)", got._jdf.queryExecution().executedPlan().toString()))
        assert kinds == ({"bigint"} if limit == 3 else set())


def test_join_spread_of_hot_keys_with_one_hash(spark, monkeypatch):
    monkeypatch.setattr(skew, "ROWS", 3)
    monkeypatch.setattr(skew.F, "xxhash64", lambda key: skew.F.length(key).cast("long"))
    rows = spark.createDataFrame([("a", k) for k in range(50)] + [("b", k) for k in range(20)] + [("cc", 8), ("d", 9)], "k string, v int")
    table = spark.createDataFrame([("a", "x"), ("b", "y"), ("cc", "z")], "k string, w string")
    counts = rows.groupBy("k").count().withColumnRenamed("count", "n")
    got = skew.join_spread(rows, table, "k", counts, *skew.sizes(counts), "v", "left", merge=True).select("k", "v", "w")
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(table, "k", "left").select("k", "v", "w").collect()))


def test_small_tables_are_few_files(make, spark, monkeypatch):
    """Each file starts processes from its executor; partitions may be many."""
    made = []

    def told(df, name, most=None):
        out = storage.written(df, name, most)
        made.append((name, len(out.inputFiles())))
        return out

    for module in (N, C):
        monkeypatch.setattr(module, "written", told)
    texts = corpus()
    component, _ = brute(texts, list(range(len(texts))), 85)
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "31")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert {r.doc_id: r.component_id for r in N.link(make(texts), 85).collect()} == component
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert {name for name, _ in made} >= {"classes", "keys", "buckets", "pairs", "stars", "components", "named"}
    assert not [x for x in made if x[1] > 1 and x[0] not in ("signatures", "sets", "links", "sizes")]


def test_recall_at_the_threshold():
    rng = np.random.Generator(np.random.PCG64(2))
    for percent in (80, 85):
        signer, missed = N.Signer(percent), 0
        for n in (1, 2, 12, 60, 400, 550, 700, 1500):
            for _ in range(150):
                # |a & b| = n, |a | b| = n * 100 / percent rounded down
                extra = n * 100 // percent - n
                a = rng.integers(0, 2**63, n + extra, dtype=np.uint64)
                left = int(rng.integers(0, extra + 1))
                one, two = np.unique(a[: n + left]), np.unique(np.concatenate((a[:n], a[n + left :])))
                keys = signer.keys([one, two])
                missed += not (keys[0] == keys[1]).any()
        assert missed == 0


def test_one_permutation_and_densification():
    """Against a plain version: least hash of each bin, empty bins by the drawn bins in turn."""
    signer = N.Signer(85)
    rng = np.random.Generator(np.random.PCG64(3))
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 2, 3, 7, 40, 400)]
    first = np.cumsum([0, *map(len, sets)])[:-1]
    for band in (0, 5):
        got = signer.minima(np.concatenate(sets), first, band)
        for k, found in enumerate(sets):
            h = [int(x) for x in found]
            h = [(x * int(signer.odd[band]) + int(signer.add[band])) % 2**64 for x in h]
            h = [(x ^ x >> 32) * 0xD6E8FEB86659FD93 % 2**64 for x in h]
            bins = [min((x for x in h if j * 2**64 // N.ROWS <= x < (j + 1) * 2**64 // N.ROWS), default=None) for j in range(N.ROWS)]
            want = [b if b is not None else next(bins[a[j]] for a in signer.borrow[band] if bins[a[j]] is not None) for j, b in enumerate(bins)]
            assert got[:, k].tolist() == want
    assert (signer.keys(sets)[2:3] == signer.keys(sets[2:3])).all()  # a set's keys don't depend on its neighbours


def test_odd_tables(make):
    assert N.link(make([])).isEmpty() and N.deduplicate(make([])).isEmpty()
    rows = N.link(make(["a b c d e f"] * 3 + [None, ""], [5, 5, 2, None, 9])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in rows) == [(-1, -1, True), (2, 2, True), (5, 2, False), (5, 2, False), (9, 9, True)]
    assert sorted(r.doc_id or -1 for r in N.deduplicate(make(["a b c d e f"] * 3 + [None, ""], [5, 5, 2, None, 9])).collect()) == [-1, 2, 9]


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (7, 9), (6, 6)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7, 9: 7}
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_merged_components(spark):
    comps = components(spark.createDataFrame([(2, 1), (4, 3), (9, 8)], "a long, b long"))
    got = {r.node: r.comp for r in merged(comps, spark.createDataFrame([(2, 4), (4, 7), (6, 5)], "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 7: 1, 5: 5, 6: 5, 8: 8, 9: 8}


def test_rows_of_one_id_are_judged_by_their_own_text(make):
    """A clean text stays beside a copy that has its doc_id; linked rows of one id are one."""
    a, b, c = (" ".join(f"{w}{k}" for k in range(60)) for w in "abc")
    texts = [a, a, b, c, c + " end", c, None, ""]
    ids = [3, 7, 7, 8, 8, 9, 7, 7]
    first = sorted((r.doc_id, r.text or "") for r in N.deduplicate(make(texts, ids)).collect())
    assert [r for r in first if r[0] != 8] == [(3, a), (7, ""), (7, b)] and len(first) == 4
    again = sorted((r.doc_id, r.text or "") for r in N.deduplicate(make(texts[::-1], ids[::-1]).repartition(5)).collect())
    assert first == again
