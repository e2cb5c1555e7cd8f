"""Counting earlier-and-smaller pairs without forming them (small numpy helper).

For every query (a, b) the weight of the facts of the same group with ``a`` strictly
smaller and ``b`` not larger.  Elements are put in order of ``b`` and then split by
the bits of their position in order of ``a``, from the highest bit down; at each bit
a query standing in the upper half adds the facts of the lower half that precede it.
Work is n log n over whole arrays, for many groups at once.
"""

from __future__ import annotations

import numpy as np


def count_below(group: np.ndarray, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Per element: total weight of the same group's elements with smaller a and b <= its own.

    Facts carry a positive weight, pure queries weight 0.
    """
    n = len(group)
    result = np.zeros(n, dtype=np.int64)
    if n == 0:
        return result
    is_query = weight == 0

    # Position inside the group in order of a; equal a: queries come first (strictness).
    by_a = np.lexsort((~is_query, a, group))
    g_sorted = group[by_a]
    starts = np.flatnonzero(np.r_[True, g_sorted[1:] != g_sorted[:-1]])
    sizes = np.diff(np.r_[starts, n])
    position = np.empty(n, dtype=np.int64)
    position[by_a] = np.arange(n) - np.repeat(starts, sizes)

    # Start in order of b; equal b: facts come first (inclusiveness).
    order = np.lexsort((is_query, b, group))
    segment_start = np.repeat(starts, sizes)  # groups occupy the same ranges in either order
    bits = int(sizes.max() - 1).bit_length()
    for bit in range(bits - 1, -1, -1):
        upper = ((position[order] >> bit) & 1).astype(bool)
        w = np.where(upper, 0, weight[order])
        before = np.r_[0, np.cumsum(w)]
        gained = before[1:] - before[segment_start]
        result[order[upper]] += gained[upper]

        # Stable split of every segment into lower and upper half for the next bit.
        lower_before = np.r_[0, np.cumsum(~upper)]
        upper_before = np.r_[0, np.cumsum(upper)]
        index = np.arange(n)
        last = np.r_[segment_start[1:] != segment_start[:-1], True]
        segment_end = np.repeat(np.flatnonzero(last) + 1, np.diff(np.r_[0, np.flatnonzero(last) + 1]))
        lowers = lower_before[segment_end] - lower_before[segment_start]
        middle = segment_start + lowers
        target = np.where(
            upper,
            middle + upper_before[index] - upper_before[segment_start],
            segment_start + lower_before[index] - lower_before[segment_start],
        )
        new_order = np.empty_like(order)
        new_order[target] = order
        new_start = np.empty_like(segment_start)
        new_start[target] = np.where(upper, middle, segment_start)
        order, segment_start = new_order, new_start
    return result
