"""Cutting stock by column generation over a histogram of lengths; all sizes here are bounded by the capacity."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


GAP = 0.005  # of the bound: how near to it the linear program must come
SEVERAL = 2  # patterns that a knapsack prices at most


class Pattern(NamedTuple):
    """A way to fill a sequence: how many pieces of which lengths, and how many sequences are filled so."""

    lengths: tuple[int, ...]
    counts: tuple[int, ...]
    times: int


def filled(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack by dynamic programming over the capacity: the largest value of each room, and the length last put
    into it (-1: none). lengths ascend."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    reach = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := reach[c]:
            gains = best[c - lengths[:k]] + values[:k]
            i = int(gains.argmax())
            if gains[i] > best[c] + 1e-12:
                best[c], last[c] = gains[i], i
    return best, last


def pattern(last: np.ndarray, lengths: np.ndarray, room: int) -> np.ndarray:
    """How many of each length fill the room best, by filled()."""
    counts = np.zeros(len(lengths))
    while room > 0:
        if last[room] >= 0:
            counts[last[room]] += 1
            room -= lengths[last[room]]
        else:
            room -= 1
    return counts


def best_pattern(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of the largest value."""
    best, last = filled(values, lengths, capacity)
    return float(best[capacity]), pattern(last, lengths, capacity)


def priced(prices: np.ndarray, lengths: np.ndarray, capacity: int, several: int) -> tuple[float, list[np.ndarray]]:
    """The largest value of a pattern, and up to `several` patterns worth more than a sequence: the best ones that hold this
    or that length, the most valuable first."""
    values = np.maximum(prices, 0)
    best, last = filled(values, lengths, capacity)
    worth = values + best[capacity - lengths]
    found, seen = [], set()
    for i in np.argsort(-worth, kind="stable"):
        if worth[i] <= 1 + 1e-9 or len(found) == several:
            break
        counts = pattern(last, lengths, capacity - int(lengths[i]))
        counts[i] += 1
        if counts.tobytes() not in seen:
            seen.add(counts.tobytes())
            found.append(counts)
    return float(best[capacity]), found


def first_basis(demand: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns that meet the demand, one for each length: each is used until it exhausts a length, so later
    patterns lack that length and the columns are independent."""
    rest, m = demand.astype(float), len(lengths)
    columns, x = np.zeros((m, m)), np.zeros(m)
    open_ = np.ones(m, dtype=bool)
    while open_.any():
        top = int(np.flatnonzero(open_)[-1])
        counts = np.zeros(m)
        counts[top] = 1
        few = np.where(open_, np.maximum(1, np.floor(rest)), 0)
        few[top] -= 1
        for i in _fullest(few, lengths, capacity - int(lengths[top])):
            counts[i] += 1
        used = np.flatnonzero(counts)
        times = (rest[used] / counts[used]).min()
        gone = used[rest[used] <= times * counts[used] * (1 + 1e-12)]
        rest = np.maximum(rest - times * counts, 0)
        columns[:, gone[0]], x[gone[0]] = counts, times
        for i in gone[1:]:
            columns[i, i] = capacity // lengths[i]
        rest[gone] = 0
        open_[gone] = False
    return columns, x


def relaxed(demand: np.ndarray, lengths: np.ndarray, capacity: int, gap: float) -> tuple[np.ndarray, np.ndarray, float]:
    """The linear program min sum(x), A x >= demand, x >= 0 over all patterns, by column generation.

    Each round solves the knapsack once; the patterns that it prices enter one after another while they still improve the
    plan. Surplus, a column of one -1, enters only when no pattern does. Ends at the optimum, where the bound shows that
    no plan has a sequence less, or within `gap` of the bound, which is the larger of the tokens' own need and of Farley's
    bound, demand at the prices over the most valuable pattern's value. Returns the basis' patterns as columns, their
    amounts, and the bound.
    """
    m = len(lengths)
    columns, x = first_basis(demand, lengths, capacity)
    inverse, cost, least = np.linalg.inv(columns), np.ones(m), float(lengths @ demand / capacity)
    whole = lambda v: np.ceil(v - 1e-6)
    while True:
        prices = np.einsum("i,ij->j", cost, inverse)  # small products: einsum starts no threads
        value, patterns = priced(prices, lengths, capacity, SEVERAL)
        least = max(least, float(demand @ np.maximum(prices, 0)) / value)
        total = float(cost @ x)
        if whole(total) <= whole(least) or total - least <= gap * least:
            break
        entering = [(p, 1.0) for p in patterns]
        if not entering and prices.min() < -1e-9:
            entering = [(-np.eye(m)[prices.argmin()], 0.0)]
        moved = False
        for enters, price in entering:
            gain = float(prices @ enters) - price
            if gain <= 1e-9:
                continue
            step = np.einsum("ij,j->i", inverse, enters)
            up = step > 1e-9
            if not up.any():
                continue
            ratios = np.full(m, np.inf)
            ratios[up] = x[up] / step[up]
            out = int(ratios.argmin())
            amount = ratios[out]
            x = np.maximum(x - amount * step, 0)
            x[out] = amount
            row = inverse[out] / step[out]
            inverse -= np.outer(step, row)
            inverse[out] = row
            prices = prices - gain * row
            columns[:, out], cost[out], moved = enters, price, True
        if not moved:
            break
    return columns, x, least


def fill_best(rest: np.ndarray, lengths: np.ndarray, capacity: int) -> list[Pattern]:
    """What rounding leaves, sequence by sequence: the longest piece left, then the pieces that fill the room best."""
    rest, found = rest.copy(), []
    while rest.any():
        top = int(np.flatnonzero(rest)[-1])
        counts, room = {top: 1}, capacity - int(lengths[top])
        rest[top] -= 1
        for i in _fullest(rest, lengths, room):
            counts[i] = counts.get(i, 0) + 1
            rest[i] -= 1
        times = 1 + int(min(rest[i] // n for i, n in counts.items()))
        for i, n in counts.items():
            rest[i] -= (times - 1) * n
        found.append(Pattern(tuple(int(lengths[i]) for i in counts), tuple(counts.values()), times))
    return found


def _fullest(rest: np.ndarray, lengths: np.ndarray, room: int) -> list[int]:
    """Pieces of the rest whose sum comes nearest to room: a subset sum over bits, at most a few of a length."""
    reached, steps = 1, []
    mask = (1 << room + 1) - 1
    for i in np.flatnonzero(rest)[::-1]:
        w = int(lengths[i])
        if w > room:
            continue
        for _ in range(min(int(rest[i]), room // w)):
            steps.append((int(i), w, reached))
            reached |= reached << w & mask
        if reached >> room & 1:
            break
    at, chosen = reached.bit_length() - 1, []
    for i, w, before in reversed(steps):
        if not before >> at & 1:
            chosen.append(i)
            at -= w
    return chosen


def plan(histogram: dict[int, int], capacity: int, gap: float = GAP) -> list[Pattern]:
    """Patterns whose pieces are exactly those of the histogram (length -> how many; 1 <= length <= capacity)."""
    full = histogram.get(capacity, 0)
    found = [Pattern((capacity,), (1,), full)] if full else []
    lengths = np.array(sorted(x for x, n in histogram.items() if n and x < capacity), dtype=np.int64)
    if not len(lengths):
        return found
    demand = np.array([histogram[int(x)] for x in lengths], dtype=np.int64)
    columns, x, _ = relaxed(demand.astype(float), lengths, capacity, gap)
    rest = demand.copy()
    for j in np.argsort(-x, kind="stable"):
        counts, times = columns[:, j].astype(np.int64), int(np.floor(x[j] + 1e-9))
        if counts.min() < 0 or not times:
            continue
        used = counts > 0
        times = min(times, int((rest[used] // counts[used]).min()))
        if times:
            rest -= counts * times
            found.append(Pattern(tuple(map(int, lengths[used])), tuple(map(int, counts[used])), times))
    return found + fill_best(rest, lengths, capacity)
