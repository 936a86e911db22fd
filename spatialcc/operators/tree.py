"""Merge trees of superlevel sets and their pruning, on one feature of one group (OP-T06..T11; survey 2.9).

Pure numpy and Python, independent of Spark. Values are swept from high to low; each plateau (spots of one value) is
added at once. A plateau cluster that touches no component starts a node, one grows the component it touches, or joins
several components under a new node.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np


@dataclass
class MergeTree:
    """Nodes in order of creation, so a child's number is below its parent's."""

    birth: list[float] = field(default_factory=list)
    death: list[float] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    own: list[list[int]] = field(default_factory=list)  # spots that joined at this node, without its children's

    def add(self, birth: float, children: list[int], spots: list[int]) -> int:
        node = len(self.birth)
        self.birth.append(birth)
        self.death.append(0.0)
        self.parent.append(-1)
        self.children.append(children)
        self.own.append(spots)
        for child in children:
            self.parent[child] = node
            self.death[child] = birth
        return node

    def sizes(self) -> list[int]:
        size = [len(spots) for spots in self.own]
        for node, up in enumerate(self.parent):  # children come first, so each is complete when it is passed on
            if up >= 0:
                size[up] += size[node]
        return size

    def members(self, node: int) -> list[int]:
        found, stack = [], [node]
        while stack:
            at = stack.pop()
            found += self.own[at]
            stack += self.children[at]
        return sorted(found)

    def layers(self) -> list[int]:
        """0 for leaves, else one above the highest child."""
        layer = [0] * len(self.birth)
        for node, kids in enumerate(self.children):
            if kids:
                layer[node] = 1 + max(layer[k] for k in kids)
        return layer


class _Sets:
    """Disjoint sets over whatever keys are asked for; a set is named by its smallest key."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, key):
        self.up.setdefault(key, key)
        path = []
        while self.up[key] != key:
            path.append(key)
            key = self.up[key]
        for k in path:
            self.up[k] = key
        return key

    def join(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def build(values: Sequence[float], neighbours: Sequence[Sequence[int]]) -> MergeTree:
    """The merge tree of the positive values; spots at or below zero never enter."""
    values = np.asarray(values, float)
    positive = np.flatnonzero(values > 0)
    order = positive[np.argsort(-values[positive], kind="stable")]
    tree = MergeTree()
    node_of = [-1] * len(values)  # the node at which a spot joined
    top: list[int] = []  # towards the node that holds a node now

    def holder(node: int) -> int:
        while top[node] != node:
            top[node] = top[top[node]]
            node = top[node]
        return node

    levels, order = values[order].tolist(), order.tolist()
    start = 0
    while start < len(order):
        level = levels[start]
        stop = start + 1
        while stop < len(order) and levels[stop] == level:
            stop += 1
        plateau = order[start:stop]
        if stop == start + 1:  # most plateaus are one spot
            spot = plateau[0]
            held = sorted({holder(node_of[other]) for other in neighbours[spot] if node_of[other] >= 0})
            if len(held) == 1:
                tree.own[held[0]].append(spot)
                node_of[spot] = held[0]
            else:
                node_of[spot] = len(top)
                top.append(tree.add(level, held, plateau))
                for child in held:
                    top[child] = node_of[spot]
            start = stop
            continue
        inside = set(plateau)
        # Keys: (0, node) for components, (1, spot) for the plateau; components name a cluster before spots do.
        sets = _Sets()
        for spot in plateau:
            sets.find((1, spot))
            for other in neighbours[spot]:
                if other in inside:
                    sets.join((1, spot), (1, other))
                elif node_of[other] >= 0:
                    sets.join((1, spot), (0, holder(node_of[other])))
        clusters: dict[tuple[int, int], tuple[list[int], list[int]]] = {}
        for key in sets.up:
            held, spots = clusters.setdefault(sets.find(key), ([], []))
            (spots if key[0] else held).append(key[1])
        for _, (held, spots) in sorted(clusters.items()):
            if len(held) == 1:
                node = held[0]
                tree.own[node] += spots
            else:
                node = tree.add(level, sorted(held), spots)
                top.append(node)
                for child in held:
                    top[child] = node
            for spot in spots:
                node_of[spot] = node
        start = stop
    return tree


@dataclass
class Pruned:
    """A pruned tree: which nodes live, their children and parents now, and births and deaths as absorbed."""

    alive: list[bool]
    children: list[list[int]]
    parent: list[int]
    birth: list[float]
    death: list[float]

    def leaves(self) -> list[int]:
        return [n for n, lives in enumerate(self.alive) if lives and not self.children[n]]


def prune(tree: MergeTree, min_size: int, strict_min_size: bool = False) -> Pruned:
    """Remove components below min_size, from the leaves up and by number within a layer.

    A small node without a parent goes. If it has at most one sibling (itself included) of min_size, the parent takes
    the place of all its children and inherits the big one's; otherwise only the small node goes. Node 0 never starts a
    removal, unless strict_min_size is set.
    """
    n, size, layer = len(tree.birth), tree.sizes(), tree.layers()
    out = Pruned([True] * n, [list(c) for c in tree.children], list(tree.parent), list(tree.birth), list(tree.death))

    def below(top: int) -> list[int]:
        found, stack = [], [top]
        while stack:
            at = stack.pop()
            found.append(at)
            stack += tree.children[at]
        return found

    def remove(nodes: list[int]) -> None:
        for node in nodes:
            out.alive[node], out.children[node] = False, []

    for node in sorted(range(n), key=lambda k: (layer[k], k)):
        if not out.alive[node] or size[node] >= min_size or (node == 0 and not strict_min_size):
            continue
        up = out.parent[node]
        if up < 0:
            remove([node])
            continue
        siblings = out.children[up]
        big = [s for s in siblings if size[s] >= min_size]
        if len(big) > 1:
            remove([node])
            out.children[up] = [s for s in siblings if s != node]
            continue
        taken = big or siblings
        out.birth[up] = max([out.birth[up], *(out.birth[s] for s in taken)])
        out.death[up] = min([out.death[up], *(out.death[s] for s in taken)])
        heirs = out.children[big[0]] if big else []
        remove([x for s in siblings if s not in big for x in below(s)] + big)
        out.children[up] = heirs
        for heir in heirs:
            out.parent[heir] = up
    return out


def leaves_one_pass(tree: MergeTree, min_size: int) -> list[int]:
    """The leaves after strict pruning, by the equivalent rule in one pass from the leaves up."""
    size = tree.sizes()
    kept: list[list[int]] = []
    for node, kids in enumerate(tree.children):
        big = [k for k in kids if size[k] >= min_size]
        if size[node] < min_size:
            kept.append([])
        elif not big:
            kept.append([node])
        elif len(big) == 1:
            kept.append([node] if len(kept[big[0]]) == 1 else kept[big[0]])
        else:
            kept.append([x for k in big for x in kept[k]])
    return sorted(x for node, up in enumerate(tree.parent) if up < 0 for x in kept[node])


def component_labels(values: Sequence[float], neighbours: Sequence[Sequence[int]], min_size: int, strict_min_size: bool = False) -> np.ndarray:
    """Label 1..k of each spot's final component, in order of node numbers; 0 outside (OP-T11, T12)."""
    tree = build(values, neighbours)
    labels = np.zeros(len(values), int)
    leaves = prune(tree, min_size, strict_min_size).leaves()
    for label, leaf in enumerate(sorted(leaves), 1):
        labels[tree.members(leaf)] = label
    return labels


def bars(tree: MergeTree, pruned: Pruned) -> list[dict]:
    """Dendrogram bars of the living nodes: layer, horizontal place, birth and death (OP-T10).

    Leaves stand side by side in order of number; a joined node stands in the middle of its children.
    """
    place: dict[int, float] = {leaf: float(i) for i, leaf in enumerate(sorted(pruned.leaves()))}
    layer: dict[int, int] = {leaf: 0 for leaf in place}
    for node in range(len(tree.birth)):
        if pruned.alive[node] and pruned.children[node]:
            kids = [k for k in pruned.children[node] if k in place]
            place[node] = sum(place[k] for k in kids) / len(kids) if kids else 0.0
            layer[node] = 1 + max((layer[k] for k in kids), default=0)
    return [{"node": k, "layer": layer[k], "place": place[k], "birth": pruned.birth[k], "death": pruned.death[k]} for k in sorted(place)]


def four_neighbours(cols: Sequence[int], rows: Sequence[int]) -> list[list[int]]:
    """Neighbours on a square grid among the given spots."""
    at = {(int(c), int(r)): i for i, (c, r) in enumerate(zip(cols, rows, strict=True))}
    steps = ((1, 0), (-1, 0), (0, 1), (0, -1))
    return [[at[c + i, r + j] for i, j in steps if (c + i, r + j) in at] for c, r in ((int(c), int(r)) for c, r in zip(cols, rows, strict=True))]


#: Pairs of spots whose distances are held at once.
PAIRS = 2_000_000


class Neighbours:
    """Neighbours of each spot, held as numbers of 4 or 8 bytes and given as a list when asked for."""

    def __init__(self, starts: np.ndarray, others: np.ndarray) -> None:
        self.starts, self.others = starts, others

    def __len__(self) -> int:
        return len(self.starts) - 1

    def __getitem__(self, spot: int) -> list[int]:
        if not 0 <= spot < len(self):
            raise IndexError(spot)
        return self.others[self.starts[spot] : self.starts[spot + 1]].tolist()


def nearest_of_spots(x: Sequence[float], y: Sequence[float], fwhm: float, decimals: int = 4) -> Neighbours:
    """Spots at the smallest distance within fwhm that any two spots have; none if no two are that near.

    Spots are sorted by cells of side fwhm; three runs of cells hold all that can be near a spot. Only pairs at the
    smallest distance so far are kept.
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    n = len(x)
    kind = np.int32 if n < 2**31 else np.int64
    cx, cy = (np.floor(v / fwhm).astype(np.int64) for v in (x, y))
    cx, cy = (v - v.min() + 1 if n else v for v in (cx, cy))
    wide = int(cy.max()) + 2 if n else 1
    key = cx * wide + cy
    order = np.argsort(key, kind="stable")
    held, least, found = key[order], np.inf, []
    step = max(1, PAIRS // 64)
    for lo in range(0, n, step):
        spots = order[lo : lo + step]
        for i in (-1, 0, 1):
            first, last = np.searchsorted(held, key[spots] + i * wide - 1, "left"), np.searchsorted(held, key[spots] + i * wide + 1, "right")
            counts = last - first
            for part in np.split(np.arange(len(spots)), np.flatnonzero(np.diff(np.cumsum(counts) // PAIRS)) + 1):
                c = counts[part]
                a = np.repeat(spots[part], c)
                b = order[np.repeat(first[part] - np.cumsum(c) + c, c) + np.arange(c.sum())]
                d = np.round(np.hypot(x[b] - x[a], y[b] - y[a]), decimals)
                fits = (d > 0) & (d <= min(fwhm, least))
                if fits.any():
                    low = d[fits].min()
                    if low < least:
                        least, found = low, []
                    near = fits & (d <= least)
                    found.append((a[near].astype(kind), b[near].astype(kind)))
    a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, kind) for k in (0, 1))
    by = np.argsort(a, kind="stable")
    return Neighbours(np.searchsorted(a[by], np.arange(n + 1)), b[by])


def nearest_neighbours(x: Sequence[float], y: Sequence[float], fwhm: float, decimals: int = 4) -> list[list[int]]:
    """nearest_of_spots() as lists."""
    near = nearest_of_spots(x, y, fwhm, decimals)
    return [near[spot] for spot in range(len(near))]
