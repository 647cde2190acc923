"""Walking many binary trees at once: all rows and trees of a chunk go down one level together.

Nodes of all trees lie in one array; a row goes to `left` or to the node after it, when its feature is above the split.
A leaf points at itself and has an infinite split, so rows that have arrived stay. A missing value is never above a
split and goes left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 18  # places (rows x trees) held at once


def leaves(x: np.ndarray, roots: np.ndarray, feature: np.ndarray, split: np.ndarray, left: np.ndarray, depth: int) -> Iterator[tuple[slice, np.ndarray]]:
    """(rows, leaf of each of these rows in each tree) chunk by chunk."""
    step = max(1, CHUNK // max(1, len(roots)))
    feature, left = feature.astype(np.int32), left.astype(np.int32)
    for start in range(0, len(x), step):
        rows = slice(start, min(start + step, len(x)))
        flat = np.ascontiguousarray(x[rows]).ravel()
        first = (np.arange(rows.stop - start, dtype=np.int32) * x.shape[1])[:, None]
        at = np.broadcast_to(roots.astype(np.int32), (rows.stop - start, len(roots)))
        for _ in range(depth):
            at = left[at] + (flat[first + feature[at]] > split[at])
        yield rows, at


def joined(trees: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(roots, feature, split, left, value) of trees given as (feature, split, left, value), one after another."""
    sizes = np.array([len(t[0]) for t in trees], np.int64)
    roots = np.append(0, np.cumsum(sizes)[:-1]) if len(trees) else np.zeros(0, np.int64)
    parts = [np.concatenate([t[i] for t in trees]) if trees else np.zeros(0) for i in range(4)]
    return roots, parts[0], parts[1], parts[2] + np.repeat(roots, sizes), parts[3]
