"""Planning functions against brute force and their definitions."""

import math

import pytest
from hypothesis import given, settings, strategies as st

from rankweave.plans import levels as L
from rankweave.plans.assignment import assign, most_messages, small_limit
from rankweave.plans.packing import Bucket, cuts, fill, fits, least_capacity, overlaps, splits_of

buckets = st.lists(st.builds(Bucket, st.integers(0, 30), st.booleans()), max_size=12)


@given(buckets, st.integers(1, 6))
@settings(max_examples=300, deadline=None)
def test_least_capacity_is_least(bs, slots):
    best = least_capacity(bs, slots)
    assert best == next(c for c in range(1000) if c >= -(-sum(b.size for b in bs) // slots) and fits(bs, slots, c))


@given(buckets, st.integers(1, 6))
@settings(max_examples=200, deadline=None)
def test_cuts_respect_whole_buckets_and_capacity(bs, slots):
    total, cap, bounds = sum(b.size for b in bs), least_capacity(bs, slots), cuts(bs, slots)
    edges = [0, *bounds, total]
    assert len(edges) <= slots + 1 and all(0 <= b - a <= cap for a, b in zip(edges, edges[1:]))
    at = 0
    for b in bs:
        if not b.divisible:
            assert not any(at < e < at + b.size for e in bounds)
        at += b.size


def test_fill_refuses_a_bucket_larger_than_the_capacity():
    assert fill([Bucket(5)], 4) == []
    assert fill([Bucket(5, True)], 4) == [4, 1]


@given(st.integers(0, 500), st.integers(1, 17))
def test_even_split_is_a_bijection(n, p):
    sizes = L.even_sizes(n, p)
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)
    expected = [(s, o) for s, size in enumerate(sizes) for o in range(size)]
    assert [L.slot_of(r, n, p) for r in range(n)] == expected
    assert [L.rank_of_slot(s, n, p) for s in range(p)] == [sum(sizes[:s]) for s in range(p)]


@given(st.integers(1, 300), st.integers(2, 9))
def test_level_plan_ends_in_single_slots(p, k):
    plan = L.level_plan(p, k)
    assert all(sum(sizes) == p for sizes in plan)
    assert not plan or max(plan[-1]) == 1


def test_level_plan_refuses_too_few_groups():
    with pytest.raises(ValueError):
        L.level_plan(10, [3, 3])
    assert L.level_plan(9, [3, 3])[-1] == [1] * 9


def test_formulas():
    assert L.splitter_sizes(8, 8, 0.10) == (20, 159, 2 * 8 * 20)
    assert L.groups_for_levels(16, 2) == 4 and L.groups_for_levels(1, 3) == 1
    assert L.pivot_samples(0, 4) == -1 and L.pivot_samples(100, 4) == 65
    assert [L.pow2_at_most(p) for p in (1, 2, 3, 4, 7, 8, 16)] == [1, 2, 2, 4, 4, 8, 16]
    assert math.isclose(L.level_imbalance(0.1, 1, 0, 100, 100), 0.1)


@given(st.lists(st.integers(0, 50), min_size=1, max_size=8), st.integers(0, 200), st.integers(0, 99))
def test_quota_totals(sizes, total, seed):
    quota = L.multinomial_quota(sizes, total, seed)
    assert sum(quota) == (total if sum(sizes) else 0)
    assert all(q == 0 for q, s in zip(quota, sizes) if s == 0)
    assert sum(L.equal_quota(len(sizes), total, seed)) == total


@given(st.lists(st.integers(0, 9), max_size=8), st.lists(st.integers(0, 9), max_size=8))
def test_overlaps_against_brute_force(x, y):
    spans = lambda v: [(i, sum(v[:i]), sum(v[: i + 1])) for i in range(len(v))]
    expected = [(i, j, min(b, d) - max(a, c)) for i, a, b in spans(x) for j, c, d in spans(y) if min(b, d) > max(a, c)]
    assert overlaps(x, y) == expected


def test_split_table_of_four_buckets_over_three_parts():
    # parts hold 3, 4, 3 | 12, 12, 6 | 2, 3, 1 | 3, 1, 1 rows of four buckets
    sizes = [[3, 12, 2, 3], [4, 12, 3, 1], [3, 6, 1, 1]]
    out = splits_of(sizes, [22, 40])
    assert out[0][1] == [12, 0, 0] and out[1][1] == [0, 12, 0] and out[2][1] == [0, 6, 0]
    assert [sum(out[p][b][s] for p in range(3) for b in range(4)) for s in range(3)] == [22, 18, 11]


@given(st.lists(st.integers(0, 60), max_size=30), st.integers(1, 6), st.integers(0, 9))
@settings(max_examples=300, deadline=None)
def test_messages_fit_and_small_ones_stay_whole(sizes, receivers, spare):
    capacity = [-(-sum(sizes) // receivers) + spare] * receivers
    parts = assign(sizes, capacity)
    for k, size in enumerate(sizes):
        own = [n for m, _, n in parts if m == k]
        assert sum(own) == size and (len(own) <= 1 or size > small_limit(len(sizes), capacity))
    for r in range(receivers):
        assert sum(n for _, to, n in parts if to == r) <= capacity[r]
        assert sum(to == r for _, to, _ in parts) <= most_messages(len(sizes), receivers)
    with pytest.raises(ValueError):
        assign([sum(capacity) + 1], capacity)


@given(st.integers(1, 10**12), st.integers(2, 5))
@settings(max_examples=200, deadline=None)
def test_roots_and_logarithms(n, k):
    r, e = L.ceil_root(n, k), L.floor_log(n, k)
    assert r**k >= n > (r - 1) ** k and k**e <= n < k ** (e + 1)
    assert L.ternary_levels(28) == [27, 9, 3, 1] and L.ternary_levels(0) == []


def test_pivot_samples_cut_each_term_off():
    assert L.pivot_samples(3 * 535, 3, 1, added=True) == 35 and L.pivot_samples(0, 3) == -1
