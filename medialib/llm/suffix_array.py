"""A sparse suffix array: suffixes at selected places, sorted, neighbours compared, matches extended to the left."""

from __future__ import annotations

import numpy as np


def _sorted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of symbols, and how many symbols each shares with the one before it (the first: -1)."""
    order = np.argsort(np.ascontiguousarray(rows.astype(">i4")).view(f"V{4 * rows.shape[1]}").ravel(), kind="stable")
    same = rows[order[1:]] == rows[order[:-1]]
    shared = np.where(same.all(1), rows.shape[1], same.argmin(1))
    return order, np.concatenate([[-1], shared]) if len(order) else np.empty(0, np.int64)


def windows_shared(
    words: np.ndarray, sizes: np.ndarray, places: np.ndarray, lowest: np.ndarray, highest: np.ndarray, window: int
) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each word sequence (words: one after the other): the lowest and highest document among the sequences that have it.

    Every window must hold its sequence's selected place. The suffixes that
    start there are sorted, and so are the words before it, read backwards; runs
    of neighbours that share r words on, and runs that share l words back, with
    l + r = window, together give the sequences that have the window with l
    words before the place.
    """
    n = len(sizes)
    _, symbols = np.unique(words, return_inverse=True)
    begins = np.cumsum(sizes) - sizes
    ahead, behind = np.minimum(window, sizes - places), np.minimum(window, places)
    step = np.arange(window)
    past = -np.arange(1, n + 1)[:, None]  # past the ends: equal to nothing else
    limit = max(0, len(symbols) - 1)
    right = np.where(step < ahead[:, None], symbols[np.minimum((begins + places)[:, None] + step, limit)], past)
    left = np.where(step < behind[:, None], symbols[np.maximum((begins + places)[:, None] - 1 - step, 0)], past)
    counts = np.maximum(0, sizes - window + 1)
    first = np.cumsum(counts) - counts
    low, high = np.repeat(lowest, counts), np.repeat(lowest, counts)  # not found: shared with none
    order_r, shared_r = _sorted(right)
    order_l, shared_l = _sorted(left)
    run_r, run_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for back in range(min(window - 1, int(behind.max(initial=0))) + 1):
        have = np.flatnonzero((behind >= back) & (ahead >= window - back))
        if not len(have):
            continue
        run_r[order_r] = np.cumsum(shared_r < window - back)
        run_l[order_l] = np.cumsum(shared_l < back)
        _, group = np.unique(run_r[have] * (n + 1) + run_l[have], return_inverse=True)
        least, most = np.full(group.max() + 1, np.iinfo(np.int64).max), np.full(group.max() + 1, np.iinfo(np.int64).min)
        np.minimum.at(least, group, lowest[have])
        np.maximum.at(most, group, highest[have])
        at = first[have] + places[have] - back
        low[at], high[at] = least[group], most[group]
    return low, high
