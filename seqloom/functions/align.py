"""Alignment of two short strings, edit by edit: plain Python, for what expressions cannot say."""

from __future__ import annotations


def operations(read: str, g: str) -> str:
    """Edits from the read's 5' end: of all alignments with fewest errors, then fewest indels, the one that edits first.

    A letter for each step of =, X, I (base only in the read) and D (base only in the genome).
    """
    n, m = len(read), len(g)
    wide = n + m + 1  # an error weighs more than all indels: cost = errors * wide + indels
    # cost of the suffixes, row by row from the last
    best = [[(m - j) * (wide + 1) for j in range(m + 1)]]
    for i in range(n - 1, -1, -1):
        below, row = best[-1], [0] * m + [(n - i) * (wide + 1)]
        base = read[i]
        for j in range(m - 1, -1, -1):
            across = below[j + 1] + (wide if base != g[j] else 0)
            gap = (below[j] if below[j] < row[j + 1] else row[j + 1]) + wide + 1
            row[j] = across if across < gap else gap
        best.append(row)
    best.reverse()
    out, i, j = [], 0, 0
    while i < n or j < m:
        cost = best[i][j]
        if i < n and j < m and read[i] != g[j] and best[i + 1][j + 1] == cost - wide:
            out.append("X")
        elif i < n and best[i + 1][j] == cost - wide - 1:
            out.append("I")
        elif j < m and best[i][j + 1] == cost - wide - 1:
            out.append("D")
        else:
            out.append("=")
        i += out[-1] != "D"
        j += out[-1] != "I"
    return "".join(out)


def run_lengths(steps: str) -> str:
    out, at = [], 0
    for k in range(1, len(steps) + 1):
        if k == len(steps) or steps[k] != steps[at]:
            out.append(f"{k - at}{steps[at]}")
            at = k
    return "".join(out)
