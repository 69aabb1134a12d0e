"""One-dimensional cutting stock by column generation: which lengths share a sequence, and how often.

The master linear program (fewest sequences that hold every length as often as it occurs) is solved by the revised
simplex method over patterns; a knapsack by dynamic programming prices the best new pattern from the dual values, until
none improves or the bound z / value of that pattern shows the plan to be within ``GAP`` of the optimum. Whole parts of
the fractional plan are kept, and the rest, less than one sequence a pattern, is packed best fit decreasing.

The input is a histogram, so time and memory depend on the number of distinct lengths, not on the number of pieces.
"""

from __future__ import annotations

import numpy as np

GAP = 5e-4
#: The search also ends when as many steps as there are sizes make the plan shorter by less than this share.
STALL = 1e-4
#: Steps after which the inverse is computed anew.
_REFACTOR = 500


def _price(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of the greatest value whose sizes (ascending) fit the capacity."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(int(sizes[0]), capacity + 1):
        n = fits[c]
        found = best[c - sizes[:n]] + values[:n]
        k = int(found.argmax())
        if found[k] > best[c - 1]:
            best[c], choice[c] = found[k], k
        else:
            best[c] = best[c - 1]
    pattern = np.zeros(len(sizes))
    c = capacity
    while c > 0:
        if choice[c] < 0 or best[c] == best[c - 1]:
            c -= 1
            continue
        pattern[choice[c]] += 1
        c -= int(sizes[choice[c]])
    return float(best[capacity]), pattern


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination with row pivots, a few hundred rows at most."""
    m = len(matrix)
    work = np.hstack([matrix.astype(float), np.eye(m)])
    for k in range(m):
        pivot = k + int(np.abs(work[k:, k]).argmax())
        if pivot != k:
            work[[k, pivot]] = work[[pivot, k]]
        work[k] /= work[k, k]
        others = work[:, k].copy()
        others[k] = 0
        rows = np.flatnonzero(others)
        work[rows] -= others[rows, None] * work[k]
    return work[:, m:]


def relaxed(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP, rounds: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often each is used, fractional.

    Small different amounts are added to the demands while searching, so that ties between them cannot make it cycle;
    what the patterns then hold of the real demands is left to :func:`plan`.
    """
    real, demand = demand, demand + 1e-4 * ((np.arange(len(demand)) + 1) * 0.6180339887 % 1)
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(basis))
    used = (inverse * demand).sum(axis=1)
    before = used.sum()
    for step in range(1, rounds + 1):
        if step % m == 0:
            if used.sum() > before * (1 - STALL):
                break
            before = used.sum()
        value, pattern = _price(sizes, inverse.sum(axis=0), capacity)
        if value <= 1 + gap:
            break
        some = np.flatnonzero(pattern)  # few, so that no library's threads are woken for a product
        move = (inverse[:, some] * pattern[some]).sum(axis=1)
        grows = move > 1e-9
        ratio = np.full(m, np.inf)
        ratio[grows] = np.maximum(used[grows], 0) / move[grows]
        out = int(ratio.argmin())
        basis[:, out] = pattern
        if step % _REFACTOR == 0:
            inverse = _inverse(basis)
        else:
            row = inverse[out] / move[out]
            inverse -= np.outer(move, row)
            inverse[out] = row
        used = used - ratio[out] * move
        used[out] = ratio[out]
        if step % _REFACTOR == 0:
            used = (inverse * demand).sum(axis=1)
    return basis, np.maximum((_inverse(basis) * real).sum(axis=1), 0)


def _best_fit(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> dict[tuple, int]:
    """Patterns for the few items left: each, longest first, goes where it leaves the least room."""
    rooms, bins = np.empty(0, np.int64), []
    for k in np.argsort(-sizes):
        for _ in range(int(demand[k])):
            fits = np.flatnonzero(rooms >= sizes[k])
            if len(fits):
                at = int(fits[rooms[fits].argmin()])
            else:
                at = len(bins)
                bins.append(np.zeros(len(sizes), np.int64))
                rooms = np.append(rooms, capacity)
            rooms[at] -= sizes[k]
            bins[at][k] += 1
    out: dict[tuple, int] = {}
    for b in bins:
        out[tuple(b.tolist())] = out.get(tuple(b.tolist()), 0) + 1
    return out


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(pattern: size to copies, sequences)] that hold every size of ``histogram`` exactly as often as it occurs."""
    sizes = np.array(sorted(s for s, n in histogram.items() if n), dtype=np.int64)
    if not len(sizes):
        return []
    if sizes[0] < 1 or sizes[-1] > capacity:
        raise ValueError("sizes must lie between 1 and the capacity")
    demand = np.array([histogram[s] for s in sizes.tolist()], dtype=np.int64)
    patterns, used = relaxed(sizes, demand.astype(float), capacity)
    whole = np.floor(used + 1e-7).astype(np.int64)
    counts = patterns.round().astype(np.int64)
    rest = demand - counts @ whole
    while (rest < 0).any():  # a pattern was taken once too often
        k = int(np.flatnonzero(rest < 0)[0])
        column = int(np.flatnonzero((counts[k] > 0) & (whole > 0))[0])
        whole[column] -= 1
        rest = demand - counts @ whole
    chosen = {}
    for column in np.flatnonzero(whole):
        key = tuple(counts[:, column].tolist())
        chosen[key] = chosen.get(key, 0) + int(whole[column])
    for key, n in _best_fit(sizes, rest, capacity).items():
        chosen[key] = chosen.get(key, 0) + n
    return [({int(s): c for s, c in zip(sizes, key, strict=True) if c}, n) for key, n in chosen.items()]
