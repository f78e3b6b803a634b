"""Suffix arrays by induced sorting, on whole numpy arrays.

Induced sorting scans an array once from each side and lets every suffix place its predecessor. All suffixes of
one first symbol can do so together, since their predecessors stay in order, so a scan takes a step per symbol
(and per run of it) instead of a step per suffix. The order of the leftmost-smaller suffixes is found from the ranks
of their substrings by joining the ranks of neighbours, of pairs, of pairs of pairs, down to a given depth.
"""

from __future__ import annotations

import numpy as np


def smaller_types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the end counts as smallest."""
    n = len(s)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(s[1:].astype(np.int32) - s[:-1])
    step[-1] = -1
    at = np.where(step != 0, np.arange(n), n)
    decides = np.minimum.accumulate(at[::-1])[::-1]
    return step[decides] > 0


def _deal(places: np.ndarray, symbols: np.ndarray, into: dict[int, list[np.ndarray]]) -> None:
    """Append places to their symbols' lists, in order."""
    order = np.argsort(symbols, kind="stable")
    places, symbols = places[order], symbols[order]
    cuts = np.flatnonzero(np.diff(symbols)) + 1
    for part, symbol in zip(np.split(places, cuts), symbols[np.r_[0, cuts]].tolist(), strict=True):
        into.setdefault(symbol, []).append(part)


def induce(s: np.ndarray, small: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """The suffix array, from the leftmost-smaller suffixes in order."""
    none = np.zeros(0, np.int64)
    symbols = np.unique(s).tolist()
    seeds: dict[int, list[np.ndarray]] = {}
    large: dict[int, list[np.ndarray]] = {}
    tail: dict[int, list[np.ndarray]] = {}
    if len(leftmost):
        _deal(leftmost, s[leftmost], seeds)
    last = len(s) - 1
    large[int(s[last])] = [np.array([last])]  # its predecessor is the end, the smallest suffix
    ordered: dict[int, np.ndarray] = {}

    def scan(front: np.ndarray, c: int, kind: bool, into: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
        """Place predecessors of one kind; those of the same symbol go on in turn."""
        out = []
        while len(front):
            out.append(front)
            before = front[front > 0] - 1
            before = before[small[before] == kind]
            other = s[before] != c
            if other.any():
                _deal(before[other], s[before[other]], into)
            front = before[~other]
        return out

    for c in symbols:
        for part in (out := large.get(c, [])) and [np.concatenate(out)]:
            ordered[c] = np.concatenate(scan(part, c, False, large))
        for part in seeds.get(c, []):
            scan_once = part[part > 0] - 1
            scan_once = scan_once[~small[scan_once]]
            if len(scan_once):
                _deal(scan_once, s[scan_once], large)
    parts: list[np.ndarray] = []
    for c in reversed(symbols):
        found = scan(np.concatenate(tail.get(c, [none])), c, True, tail)
        parts += found  # from the largest down
        behind = ordered.get(c, none)[::-1]
        if len(behind):
            before = behind[behind > 0] - 1
            before = before[small[before]]
            if len(before):
                _deal(before, s[before], tail)
            parts.append(behind)
    return np.concatenate(parts)[::-1]


def ranks_to_depth(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of ``names`` by their first ``depth`` names at least."""
    m, k, rank = len(names), 1, names.astype(np.int64)
    order = np.argsort(rank)  # equals may stand in any order: their ranks are equal
    while k < depth:
        follow = np.zeros(m, np.int64)
        follow[:-k] = rank[k:] + 1
        key = rank * (m + 2) + follow
        order = np.argsort(key)
        rank = np.zeros(m, np.int64)
        rank[order[1:]] = np.cumsum(np.diff(key[order]) != 0)
        if rank.max() == m - 1:
            break
        k *= 2
    return order


def suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of small whole numbers, in the order of their first ``depth`` symbols at least."""
    small = smaller_types(s)
    leftmost = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if not len(leftmost):
        return induce(s, small, leftmost)
    found = induce(s, small, leftmost)
    is_leftmost = np.zeros(len(s) + 1, bool)
    is_leftmost[leftmost] = True
    by_substring = found[is_leftmost[found]]
    # a substring goes from one leftmost-smaller place to the next
    number = np.zeros(len(s), np.int64)
    number[leftmost] = np.arange(len(leftmost))
    ends = np.r_[leftmost[1:] + 1, len(s)]
    a, b = by_substring[:-1], by_substring[1:]
    size_a, size_b = ends[number[a]] - a, ends[number[b]] - b
    same = size_a == size_b
    k, live = 0, np.flatnonzero(same)
    while len(live):
        live = live[size_a[live] > k]
        equal = s[a[live] + k] == s[b[live] + k]
        same[live[~equal]] = False
        live, k = live[equal], k + 1
    names = np.zeros(len(leftmost), np.int64)
    names[number[by_substring]] = np.cumsum(np.r_[0, ~same])
    if names.max() < len(leftmost) - 1:
        leftmost = leftmost[ranks_to_depth(names, depth // 2 + 1)]  # a name stands for two symbols at least
    else:
        leftmost = by_substring
    return induce(s, small, leftmost)


def permuted_prefixes(s: np.ndarray, found: np.ndarray, most: int, places: np.ndarray | None = None) -> np.ndarray:
    """By place in the text: common prefix of a suffix with the one before it in the array, up to ``most``; with
    ``places``, of the suffixes there, and 0 elsewhere. Symbols are compared packed into words, as many as fit."""
    n, out = len(s), np.zeros(len(s), np.int64)
    before = np.full(n, -1, np.int32 if n < 1 << 31 else np.int64)
    before[found[1:]] = found[:-1]
    live = np.arange(n) if places is None else places
    live = live[before[live] >= 0]
    if not len(live):
        return out
    bits = int(int(s.max()) - int(s.min()) + 1).bit_length()
    per = 63 // bits
    padded = np.zeros(n + most + 2 * per, np.int64)  # 0 stands behind the end only
    padded[:n] = s.astype(np.int64) - int(s.min()) + 1
    packed = np.zeros(n + most + per, np.int64)
    for j in range(per):
        packed = (packed << bits) | padded[j : j + len(packed)]
    k = 0
    while len(live) and k < most:
        differ = packed[live + k] ^ packed[before[live] + k]
        ends = differ != 0
        last = differ[ends]
        out[live[ends]] = k + sum((last >> bits * (per - j) == 0).astype(np.int64) for j in range(1, per))
        live = live[~ends]
        k += per
    out[live] = most
    return np.minimum(out, most)
