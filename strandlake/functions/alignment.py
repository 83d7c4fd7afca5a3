"""Pairwise alignment with affine gaps: local, and free at the ends (overlaps), a row of the matrix at a time."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL, OVERLAP, GLOBAL = "local", "overlap", "global"
_NEVER = -(1 << 28)


@dataclass(frozen=True)
class Scores:
    """A gap of n letters costs gap_open + n * gap_extend."""

    match: int = 2
    mismatch: int = -5
    gap_open: int = 2
    gap_extend: int = 1


ALIGNED = "score int, q_beg int, q_end int, t_beg int, t_end int, cigar string"


def align(query: str, target: str, how: str = LOCAL, s: Scores = Scores()) -> tuple[int, int, int, int, int, str]:
    """(score, q_beg, q_end, t_beg, t_end, cigar) of a best alignment, ends exclusive.

    local: of any parts of both. overlap: a letter run off either end of either string costs
    nothing. global: of both whole. Cigars have M, I (of the query only) and D (of the target
    only). Of equal scores the alignment that ends first on the query, then on the target;
    no alignment of positive score is (0, 0, 0, 0, 0, "*"), but for global ones.

    A row's gaps along the target are the running maximum of what a gap could begin from,
    so the row is a few array operations; the matrix of choices is kept for the trace.
    """
    n, m = len(query), len(target)
    if not n or not m:
        if how != GLOBAL or not n + m:
            return 0, 0, 0, 0, 0, "*"
        k = n + m
        return -s.gap_open - k * s.gap_extend, 0, n, 0, m, f"{k if k > 1 else ''}{'I' if n else 'D'}"
    other = np.frombuffer(target.encode("utf-32-le"), np.uint32)
    letters = np.frombuffer(query.encode("utf-32-le"), np.uint32)
    along = np.arange(m + 1) * s.gap_extend
    edge = -s.gap_open - along
    edge[0] = 0
    h = np.zeros((n + 1, m + 1), np.int32)
    down, right = np.full((n + 1, m + 1), _NEVER, np.int32), np.full((n + 1, m + 1), _NEVER, np.int32)
    if how == GLOBAL:
        h[0], right[0, 1:] = edge, edge[1:]
    for i in range(1, n + 1):
        down[i] = np.maximum(h[i - 1] - s.gap_open, down[i - 1]) - s.gap_extend
        row = np.full(m + 1, _NEVER, np.int32)
        row[1:] = h[i - 1, :-1] + np.where(other == letters[i - 1], s.match, s.mismatch)
        row[0] = 0 if how != GLOBAL else -s.gap_open - i * s.gap_extend
        np.maximum(row, down[i], out=row)
        if how == LOCAL:
            np.maximum(row, 0, out=row)
        right[i, 1:] = np.maximum.accumulate(row + along)[:-1] - along[1:] - s.gap_open
        h[i] = np.maximum(row, right[i])
    if how == LOCAL:
        i, j = divmod(int(h.argmax()), m + 1)
    elif how == OVERLAP:
        i, j = max([(int(h[k, m]), -k, -m) for k in range(n + 1)] + [(int(h[n, k]), -n, -k) for k in range(m + 1)])[1:]
        i, j = -i, -j
    else:
        i, j = n, m
    score, q_end, t_end = int(h[i, j]), i, j
    if how != GLOBAL and score <= 0:
        return 0, 0, 0, 0, 0, "*"
    ops, state = [], "M"
    while i or j:
        if state == "M":
            if how == LOCAL and h[i, j] == 0 or how == OVERLAP and not (i and j):
                break
            if i and j and h[i, j] == h[i - 1, j - 1] + (s.match if letters[i - 1] == other[j - 1] else s.mismatch):
                ops.append("M")
                i, j = i - 1, j - 1
                continue
            state = "I" if i and (not j or h[i, j] == down[i, j]) else "D"
        ops.append(state)
        if state == "I":
            longer = i > 1 and down[i, j] == down[i - 1, j] - s.gap_extend if j else i > 1
            i -= 1
        else:
            longer = j > 1 and right[i, j] == right[i, j - 1] - s.gap_extend if i else j > 1
            j -= 1
        if not longer:
            state = "M"
    runs: list[list] = []
    for op in reversed(ops):
        if runs and runs[-1][1] == op:
            runs[-1][0] += 1
        else:
            runs.append([1, op])
    return score, i, q_end, j, t_end, "".join(f"{k if k > 1 else ''}{op}" for k, op in runs)


def aligned(query: Column, target: Column, how: str = LOCAL, scores: Scores = Scores()) -> Column:
    """struct<score, q_beg, q_end, t_beg, t_end, cigar> of two string columns; null if either is."""

    @F.pandas_udf(ALIGNED)
    def each(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = [align(x, y, how, scores) if isinstance(x, str) and isinstance(y, str) else (None,) * 6 for x, y in zip(a, b, strict=True)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in ALIGNED.split(", ")])

    return each(query, target)
