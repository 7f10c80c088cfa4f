"""The packing kernels against plain best fit decreasing."""

import random
from collections import Counter

import pytest

from wirewarden.llm.packing import RemainingTree, cut_lengths, plan
from wirewarden.llm.sharding import CapacityTree, best_fit_decreasing, level_bins


def plain(items, capacity):
    bins = []
    for x in sorted(items, reverse=True):
        open_bins = [b for b in bins if capacity - sum(b) >= x]
        if open_bins:
            min(open_bins, key=lambda b: capacity - sum(b)).append(x)
        else:
            bins.append([x])
    return sorted(map(sum, bins))


@pytest.mark.parametrize("seed", range(60))
def test_plan_and_tree_equal_plain_best_fit(seed):
    r = random.Random(seed)
    capacity = r.choice([1, 8, 30, 100])
    items = [r.randint(1, capacity) for _ in range(r.randint(0, 200))]
    fill = {}
    for length, first, count, begin, per, offset in plan(dict(Counter(items)), capacity):
        for k in range(count):
            fill.setdefault(begin + k // per, []).append((offset + k % per * length, length))
    for parts in fill.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for p, n in parts if p < o) for o, _ in sorted(parts)]
    assert sorted(sum(n for _, n in parts) for parts in fill.values()) == plain(items, capacity)
    assert sorted(n for parts in fill.values() for _, n in parts) == sorted(items)
    loads = Counter()
    for size, b in zip(sorted(items, reverse=True), best_fit_decreasing(sorted(items, reverse=True), capacity)):
        loads[b] += size
    assert sorted(loads.values()) == plain(items, capacity)


def test_capacity_tree_equals_a_sorted_set():
    r, tree, held = random.Random(1), CapacityTree(), set()
    for _ in range(5000):
        key = (r.randint(0, 20), r.randint(0, 20))
        (tree.remove if key in held else tree.add)(key)
        held ^= {key}
        q = r.randint(0, 20)
        assert tree.ceiling(q) == min((k for k in held if k[0] >= q), default=None)
        assert tree.largest() == max(held, default=None)


def test_remaining_tree():
    tree, held = RemainingTree(37), set()
    r = random.Random(2)
    for _ in range(3000):
        c = r.randint(0, 37)
        held ^= {c}
        tree.set(c, c in held)
        q = r.randint(0, 37)
        assert tree.tightest(q) == min((x for x in held if x >= q), default=None)


def test_level_bins_isolates_giants_and_levels_the_rest():
    sizes = sorted([10_000, 3_000, *[random.Random(3).randint(1, 50) for _ in range(2000)]], reverse=True)
    loads = Counter()
    for size, b in zip(sizes, level_bins(sizes, 10)):
        loads[b] += size
    rest = [v for b, v in loads.items() if v not in (10_000,)]
    assert len(loads) == 10 and max(loads.values()) == 10_000
    assert max(rest) - min(v for v in rest) <= 50 or 3_000 in loads.values()


def test_cut_lengths():
    assert cut_lengths(1024, 1024) == [1024] and cut_lengths(5, 1024) == [5]
    assert cut_lengths(2049, 1024) == [1, 1024, 1024] and cut_lengths(0, 8) == []
