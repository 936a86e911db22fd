"""Merge trees against hand-computed cases and an independent brute force."""

import numpy as np
import pytest

from spatialcc.operators import tree


def path(n):
    return [[j for j in (i - 1, i + 1) if 0 <= j < n] for i in range(n)]


def labels(values, neighbours, min_size, **kw):
    return tree.component_labels(values, neighbours, min_size, **kw).tolist()


def test_two_peaks_on_a_path():
    t = tree.build([5, 3, 4], path(3))
    assert (t.birth, t.death, t.children) == ([5, 4, 3], [3, 3, 0], [[], [], [0, 1]])
    assert labels([5, 3, 4], path(3), 1) == [1, 0, 2]
    assert labels([5, 3, 4], path(3), 2) == [1, 1, 1]  # node 1 is small: the parent takes both
    assert labels([5, 3, 4], path(3), 3) == [1, 1, 1]


def test_plateaus():
    assert len(tree.build([2, 2, 2], path(3)).birth) == 1
    # Three peaks joined by one plateau: one node with three children.
    star = [[3], [3], [3], [0, 1, 2]]
    t = tree.build([5, 4, 6, 1], star)
    assert t.children[-1] == [0, 1, 2] and t.sizes()[-1] == 4
    # Two plateau spots that touch no one and each other are one leaf.
    assert labels([0, 3, 3, 0, 3], path(5), 1) == [0, 1, 1, 0, 2]


def test_first_component_is_exempt():
    values = [9, 1, 5, 5, 5, 1, 4, 4, 4]
    found = labels(values, path(9), 3)
    strict = labels(values, path(9), 3, strict_min_size=True)
    assert found[0] == 1 and strict[0] == 0
    assert [x > 0 for x in found[2:5]] == [True] * 3


def test_small_later_peak_is_absorbed():
    # Big first peak, small second one: the parent takes the big one's place.
    assert labels([9, 9, 9, 1, 5], path(5), 2) == [1, 1, 1, 1, 1]


def test_small_root_and_nothing():
    assert labels([0, 0, 0], path(3), 1) == [0, 0, 0]
    assert labels([7], [[]], 5) == [1]  # node 0
    assert labels([7, 0, 6], path(3), 2) == [1, 0, 0]  # the second root is small and goes


def brute_leaves(values, neighbours):
    """Leaves of the tree: regional maxima, by flooding each plateau."""
    n, seen, out = len(values), set(), []
    for i in range(n):
        if i in seen or values[i] <= 0:
            continue
        flat, stack, top = {i}, [i], True
        while stack:
            for j in neighbours[stack.pop()]:
                if values[j] == values[i] and j not in flat:
                    flat.add(j)
                    stack.append(j)
                top &= values[j] <= values[i]
        seen |= flat
        if top:
            out.append(sorted(flat))
    return sorted(out)


def brute_components(values, neighbours, level):
    keep, seen, out = [v >= level and v > 0 for v in values], set(), []
    for i in range(len(values)):
        if keep[i] and i not in seen:
            found, stack = {i}, [i]
            while stack:
                for j in neighbours[stack.pop()]:
                    if keep[j] and j not in found:
                        found.add(j)
                        stack.append(j)
            seen |= found
            out.append(sorted(found))
    return sorted(out)


@pytest.mark.parametrize("seed", range(60))
def test_random_grids(seed):
    rng = np.random.default_rng(seed)
    h, w = rng.integers(2, 9, 2)
    cols, rows = np.meshgrid(range(w), range(h))
    cols, rows = cols.ravel(), rows.ravel()
    values = rng.integers(0, 6, h * w).astype(float)
    near = tree.four_neighbours(cols, rows)
    t = tree.build(values, near)
    # Every superlevel set's components are the nodes alive at that level.
    for level in sorted(set(values[values > 0])):
        alive = [k for k in range(len(t.birth)) if t.birth[k] >= level > t.death[k]]
        grown = []
        for k in alive:
            grown.append(sorted(s for s in t.members(k) if values[s] >= level))
        assert sorted(grown) == brute_components(values, near, level)
    leaves = [k for k, kids in enumerate(t.children) if not kids]
    peaks = sorted(sorted(s for s in t.members(k) if values[s] == t.birth[k]) for k in leaves)
    assert peaks == brute_leaves(values, near)
    # The pruning rule as stated equals the one-pass rule without the exemption of node 0.
    for size in (1, 2, 3, 5):
        assert sorted(tree.prune(t, size, strict_min_size=True).leaves()) == tree.leaves_one_pass(t, size)
        found = tree.component_labels(values, near, size)
        for label in range(2, found.max() + 1):
            assert (found == label).sum() >= size


def test_worked_label_example():
    spots = np.zeros(5, int)
    for label, members in enumerate([[3, 4], [1, 2]], 1):
        spots[members] = label
    assert spots.tolist() == [0, 2, 2, 1, 1]


def test_nearest_neighbours_of_a_hexagonal_lattice():
    k = np.arange(100)
    row = k // 10
    col = 2 * (k % 10) + row % 2
    near = tree.nearest_neighbours(col * 0.5, row * 3**0.5 / 2, 2.5)
    assert max(map(len, near)) == 6 and min(map(len, near)) >= 2
    assert tree.nearest_neighbours([0, 10], [0, 0], 2.5) == [[], []]


def test_nearest_of_spots_by_brute_force(monkeypatch):
    rng = np.random.default_rng(6)
    for _ in range(20):
        n = int(rng.integers(0, 60))
        x, y = rng.integers(-8, 8, n) * 0.5, rng.integers(-8, 8, n) * 0.5
        d = np.round(np.hypot(x[:, None] - x, y[:, None] - y), 4)
        apart = (d > 0) & (d <= 2.5)
        want = [np.flatnonzero(apart[i] & (d[i] <= d[apart].min())).tolist() if apart.any() else [] for i in range(n)]
        for pairs in (2_000_000, 64, 10):
            monkeypatch.setattr(tree, "PAIRS", pairs)
            found = tree.nearest_of_spots(x, y, 2.5)
            assert [sorted(found[i]) for i in range(len(found))] == want
