"""Moving-frame statistics over sorted sample arrays: the helper run inside Arrow tasks."""

from __future__ import annotations

import numpy as np


def frame_bounds(group: np.ndarray, time: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray]:
    """Half-open row ranges of the frames ``(t - period, t]``, never leaving the row's group.

    Rows are sorted by (group, time). Groups are laid behind each other on one axis, each by its own
    length and further apart than a frame is long, so that one binary search serves all of them.
    """
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(time)])
    offset = time - np.repeat(time[starts], sizes)
    lengths = offset[starts + sizes - 1] + period + 1
    axis = offset + np.repeat(np.cumsum(lengths) - lengths, sizes)
    low = np.searchsorted(axis, axis - period, side="right")
    high = np.searchsorted(axis, axis, side="right")
    return low, high


def frame_extreme(values: np.ndarray, low: np.ndarray, high: np.ndarray, pick) -> np.ndarray:
    """Minimum or maximum (``pick`` is ``np.minimum``/``np.maximum``) per frame, NaN for no sample.

    Level k holds the extreme of 2**k neighbours; a frame is covered by two overlapping runs of the
    largest power of two it holds.
    """
    worst = np.inf if pick is np.minimum else -np.inf
    empty = np.isnan(values)
    level = np.where(empty, worst, values)
    size = high - low
    power = np.frexp(size)[1] - 1
    result = np.empty(len(values))
    for k in range(int(power.max()) + 1):
        rows = np.flatnonzero(power == k)
        if len(rows):
            result[rows] = pick(level[low[rows]], level[high[rows] - (1 << k)])
        step = 1 << k
        if step < len(level):
            level = pick(level[:-step], level[step:])
    if empty.any():
        filled = np.concatenate([[0], np.cumsum(~empty)])
        result[filled[high] == filled[low]] = np.nan
    return result


def frame_moments(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sample count, mean and sum of squared deviations per frame.

    A frame is put together from disjoint runs of 2**k neighbours, one per binary digit of its
    size; runs merge pairwise as (count, mean, squares), so nothing large is ever subtracted.
    """
    present = ~np.isnan(values)
    complete = bool(present.all())
    # Runs of a complete channel all hold 2**k samples: one number instead of an array.
    count = 1.0 if complete else present.astype(np.float64)
    mean = values if complete else np.where(present, values, 0.0)
    squares = np.zeros(len(values))
    size = high - low
    at = low.copy()
    total = (np.zeros(len(values)), np.zeros(len(values)), np.zeros(len(values)))
    for k in range(int(size.max()).bit_length()):
        digit = ((size >> k) & 1).astype(bool)
        rows = slice(None) if digit.all() else np.flatnonzero(digit)
        if digit.any():
            run = at[rows]
            run_count = count if complete else count[run]
            merged = _merge(*(t[rows] for t in total), run_count, mean[run], squares[run], complete)
            for target, part in zip(total, merged, strict=True):
                target[rows] = part
            at[rows] += 1 << k
        step = 1 << k
        if step < len(mean):
            left, right = (count, count) if complete else (count[:-step], count[step:])
            count, mean, squares = _merge(
                left, mean[:-step], squares[:-step], right, mean[step:], squares[step:], complete
            )
    return total


def _merge(n1, mean1, squares1, n2, mean2, squares2, complete):
    n = n1 + n2
    share = n2 / n if complete else np.divide(n2, n, out=np.zeros_like(n), where=n > 0)
    shift = mean2 - mean1
    return n, mean1 + shift * share, squares1 + squares2 + shift * shift * (n1 * share)


def frame_statistics(values: np.ndarray, low: np.ndarray, high: np.ndarray, stats: list[str]) -> list[np.ndarray]:
    """One array per statistic, NaN where the statistic has no value."""
    out = {}
    if "mean" in stats or "std" in stats:
        count, mean, squares = frame_moments(values, low, high)
        out["mean"] = np.where(count > 0, mean, np.nan)
        out["std"] = np.sqrt(np.divide(squares, count - 1, out=np.full_like(squares, np.nan), where=count > 1))
    if "min" in stats:
        out["min"] = frame_extreme(values, low, high, np.minimum)
    if "max" in stats:
        out["max"] = frame_extreme(values, low, high, np.maximum)
    if "first" in stats:
        out["first"] = values[low]
    if "last" in stats:
        out["last"] = values[high - 1]
    return [out[s] for s in stats]
