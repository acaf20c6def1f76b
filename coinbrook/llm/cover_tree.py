"""Cover trees over a few thousand points, as arrays, for assigning points to their nearest entry.

Each node has a centre, which is one of its points, and a radius that covers its points. The children
of a node halve its radius at least: their centres lie further apart than half of it, and each point
goes to the first child that reaches it. Points are kept in the order of the tree, so those of a node
are neighbours and sums over them are differences of cumulative sums.
"""

from __future__ import annotations

import numpy as np

NODE = np.dtype([("begin", "<i4"), ("end", "<i4"), ("radius", "<f8"), ("child", "<i4"), ("last", "<i4")])
#: Nodes of so many points are not divided further.
LEAF = 16
#: Up to this size of a component, squared distances are whole numbers that a double holds.
EXACT_IN_DOUBLE = 1 << 22


def _distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    away = points - centre
    return np.sqrt(np.einsum("ij,ij->i", away, away))


def build(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Order of the points and the nodes, level by level; the children of a node are neighbours. The
    centre of a node comes first among its points."""
    points = points.astype(np.float64)
    order = np.arange(len(points), dtype=np.int32)
    away = _distances(points, points[0])
    nodes = [(0, len(points), away.max(), 0, 0)]
    done = 0
    while done < len(nodes):
        begin, end, radius, _, _ = nodes[done]
        if end - begin > leaf and radius > 0:
            first, at = len(nodes), begin
            rest, rest_away = order[begin:end].copy(), away[begin:end].copy()
            while len(rest):
                near = rest_away <= radius / 2
                own, own_away = rest[near], rest_away[near]
                order[at : at + len(own)], away[at : at + len(own)] = own, own_away
                nodes.append((at, at + len(own), own_away.max(), 0, 0))
                at += len(own)
                rest = rest[~near]
                if len(rest):
                    rest_away = _distances(points[rest], points[rest[0]])
            nodes[done] = (begin, end, radius, first, len(nodes))
        done += 1
    return order, np.array(nodes, NODE)


def nearest(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Index of the nearest entry of each point, of equal ones the lowest, in whole numbers."""
    largest = max(np.abs(points).max(initial=0), np.abs(entries).max(initial=0))
    if largest < EXACT_IN_DOUBLE:
        e = entries.astype(np.float64)
        return np.argmin((e * e).sum(axis=1) - 2 * (points.astype(np.float64) @ e.T), axis=1)
    away = points[:, None, :].astype(np.int64) - entries[None, :, :].astype(np.int64)
    return np.argmin((away * away).sum(axis=2), axis=1)


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    sizes = end - begin
    starts = np.repeat(begin - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    return starts + np.arange(sizes.sum())


def assign(points: np.ndarray, nodes: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, int]:
    """The nearest entry of each point, points being in the order of the tree, and how many points
    were assigned without a comparison of their own.

    With ``d`` the distance of a node's centre to its nearest entry and ``r`` the radius, an entry
    further than ``d + 2 r`` from the centre is nearest to none of the points. A node left with one
    entry is assigned as a whole; others pass their entries on to their children. Distances carry
    rounding errors, so an entry goes only if it is further by more than those; what remains
    undecided is compared in whole numbers.
    """
    found = np.empty(len(points), np.int64)
    centres_of, floats = points.astype(np.float64), entries.astype(np.float64)
    whole = 0
    level = np.zeros(1, np.int64)
    possible = np.ones((1, len(entries)), bool)
    while len(level):
        own = nodes[level]
        away = centres_of[own["begin"]][:, None, :] - floats[None, :, :]
        distance = np.sqrt((away * away).sum(axis=2))
        distance[~possible] = np.inf
        reach = distance.min(axis=1) + 2 * own["radius"]
        possible = distance <= (reach + 1e-9 * (reach + 1))[:, None]
        alone = possible.sum(axis=1) == 1
        settled = own[alone]
        spots = _ranges(settled["begin"], settled["end"])
        sizes = settled["end"] - settled["begin"]
        found[spots] = np.repeat(possible[alone].argmax(axis=1), sizes)
        whole += int(sizes.sum())
        leaf = ~alone & (own["child"] == own["last"])
        spots = _ranges(own[leaf]["begin"], own[leaf]["end"])
        found[spots] = nearest(points[spots], entries)
        inner = ~alone & ~leaf
        children = own[inner]
        level = _ranges(children["child"], children["last"])
        possible = np.repeat(possible[inner], children["last"] - children["child"], axis=0)
    return found, whole


def sums(points: np.ndarray, found: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Number and componentwise sum of the points of each entry, points in the order of the tree:
    differences of cumulative sums at the places where the entry changes."""
    turns = np.flatnonzero(np.diff(found)) + 1
    begin, end = np.concatenate([[0], turns]), np.concatenate([turns, [len(found)]])
    cumulative = np.zeros((len(points) + 1, points.shape[1]), np.int64)
    np.cumsum(points, axis=0, out=cumulative[1:])
    count, total = np.zeros(entries, np.int64), np.zeros((entries, points.shape[1]), np.int64)
    np.add.at(count, found[begin], end - begin)
    np.add.at(total, found[begin], cumulative[end] - cumulative[begin])
    return count, total
