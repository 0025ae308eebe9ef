"""Forests as numpy arrays: one array gives for each node the index of its parent, -1 for a root.

All passes double the distance they cover, so that long chains cost no more than bushy trees.
"""

from __future__ import annotations

import numpy as np


def parent_index(node: np.ndarray, parent: np.ndarray, has_parent: np.ndarray) -> np.ndarray:
    """The index of each node's parent; ``node`` is sorted and unique.  A parent that is no node counts as none."""
    at = np.minimum(np.searchsorted(node, parent), max(len(node) - 1, 0))
    return np.where(has_parent & (node[at] == parent), at, -1) if len(node) else np.empty(0, np.int64)


def depths(up: np.ndarray) -> np.ndarray:
    """The number of ancestors, -1 for a node in or below a circle."""
    jump, depth = up.copy(), (up >= 0).astype(np.int64)
    left = np.flatnonzero(jump >= 0)
    while len(left):
        to = jump[left]
        more, further = depth[to], jump[to]
        depth[left] += more
        jump[left] = further
        still = left[further >= 0]
        if len(still) == len(left):  # depths have no gaps: who has not ended by now never will
            break
        left = still
    depth[jump >= 0] = -1
    return depth


def _moving(up: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes that are not roots and end at one, and a copy of the parents to jump with."""
    return np.flatnonzero((up >= 0) & (depth >= 0)), up.copy()


def subtree_sums(up: np.ndarray, depth: np.ndarray, own: np.ndarray) -> np.ndarray:
    """For each node the sum of ``own`` over its subtree, nodes of circles left out."""
    out = own.astype(np.int64)
    live, jump = _moving(up, depth)
    while len(live):
        to = jump[live]
        given, further = out[live].copy(), jump[to]
        np.add.at(out, to, given)
        jump[live] = further
        live = live[further >= 0]
    return out


def before_siblings(up: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each node the sum of ``value`` over its siblings before it; the roots are siblings."""
    order = np.argsort(up, kind="stable")
    total = np.cumsum(value[order]) - value[order]
    first = np.concatenate([[True], np.diff(up[order]) != 0]) if len(order) else np.empty(0, bool)
    starts = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    out = np.empty(len(order), np.int64)
    out[order] = total - total[starts]
    return out


def down(up: np.ndarray, depth: np.ndarray, step: np.ndarray) -> np.ndarray:
    """For each node the sum of ``step`` over its path from the root; works for objects that can be added as well."""
    out = step.copy()
    live, jump = _moving(up, depth)
    while len(live):
        to = jump[live]
        out[live], jump[live] = out[to] + out[live], jump[to]
        live = live[jump[live] >= 0]
    return out


def roots(up: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The index of each node's root; of nodes in or below a circle their own."""
    out = np.arange(len(up))
    live, jump = _moving(up, depth)
    while len(live):
        to = jump[live]
        out[live], jump[live] = out[to], jump[to]
        live = live[jump[live] >= 0]
    return out
