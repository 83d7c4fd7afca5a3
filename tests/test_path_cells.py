"""Cells that no path joins with another aren't aligned, and what is aligned gives the same overlaps."""

import random
from dataclasses import replace

import numpy as np

from strandlake.config import SMALL
from strandlake.operators import overlaps as ov


def cells(seed):
    r = random.Random(seed)
    return sorted({(r.randrange(5), r.randrange(30) + 40 * r.randrange(3), r.randrange(30)) for _ in range(80)})


def test_cells_that_meet_by_brute_force():
    for seed in range(30):
        found, reach = cells(seed), seed % 5
        run, row, col = np.array(found).T
        far = reach + 1
        want = [any(x != y and x[0] == y[0] and abs(x[1] - y[1]) <= far and abs(x[2] - y[2]) <= far for y in found) for x in found]
        assert ov.meeting(run, row, col, reach).tolist() == want


def test_paths_of_more_cells_need_none_that_stand_alone():
    longer = 0
    for seed in range(40):
        p = replace(SMALL, max_bgap=seed % 5, min_mat=25)
        run, row, col = np.array(cells(seed)).T
        run = np.unique(run, return_inverse=True)[1]
        kcnt, kmat = np.arange(len(run)) % 3 + 1, np.arange(len(run)) % 40 + 15
        kept = ov.meeting(run, row, col, p.max_bgap)
        whole = [f for f in ov.bin_paths(run, row, col, kcnt, kmat, p) if f[6] > 1]
        ids, of = np.unique(run[kept], return_inverse=True)
        part = [(int(ids[f[0]]), *f[1:]) for f in ov.bin_paths(of, row[kept], col[kept], kcnt[kept], kmat[kept], p) if f[6] > 1]
        assert part == whole
        longer += len(whole)
    assert longer > 50


def test_runs_go_together_by_antidiagonals(monkeypatch):
    """Runs that lie apart take as many steps as one of them."""
    steps = []
    plain = np.argmax
    monkeypatch.setattr(ov.np, "argmax", lambda *a, **b: steps.append(1) or plain(*a, **b))
    n = 50
    run, at = np.repeat(np.arange(n), 4), np.tile(np.arange(4), n)
    found = ov.bin_paths(run, at + 1_000 * run, at + 70 * run, np.full(4 * n, 2), np.full(4 * n, 40), SMALL)
    assert [(f[0], f[1], f[3], f[9]) for f in found] == [(k, 70 * k, 1_000 * k, "4M") for k in range(n)]
    assert len(steps) <= 7
