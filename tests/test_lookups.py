"""Nearest targets and sets with common members, where many rows lie close together or far away."""

import numpy as np

from driftmesh.operators import kd
from driftmesh.operators import tracking as K
from driftmesh.operators import unstructured as U

POINTS, TARGETS = "pid long, px double, py double", "vid long, x double, y double"


def brute(points, targets):
    """One row a pid: least (d2, vid)."""
    best = {}
    for pid, px, py in points:
        for vid, x, y in targets:
            best[pid] = min(best.get(pid, (float("inf"), float("inf"))), ((px - x) * (px - x) + (py - y) * (py - y), vid))
    return {pid: (vid, d2) for pid, (d2, vid) in best.items()}


def test_nearest_of_far_points(spark):
    """Points far beyond all targets, rows that share a pid, equal distances and repeated targets."""
    rng = np.random.default_rng(5)
    xy = rng.integers(0, 40, (900, 2)).astype(float)
    targets = [(int(v), *map(float, p)) for v, p in zip(rng.permutation(900), xy)]
    far = [(k, float(x), float(y)) for k, (x, y) in enumerate([(1e7, 20.0), (-1e7, 3.0), (20.5, 20.5), (0.5, -4e6), (1e160, 0.0), (19.0, 7.0)])]
    points = [*far, (2, -3.0, -3.0), (None, 1e6, 1e6), *far[:2]]
    for cell in (kd.CELL, 50):
        got = U.nearest(spark.createDataFrame(points, POINTS), spark.createDataFrame(targets, TARGETS), 1.0, cell=cell).collect()
        assert len(got) == 7 and {r.pid: (r.vid, r.d2) for r in got} == brute(points, targets)


def test_a_far_place_meets_few_targets():
    """By the grid's last bucket each of them met all targets."""
    rng = np.random.default_rng(6)
    xy, px, py = rng.random((20_000, 2)), 1e3 * (1 + rng.random(500)), rng.random(500)
    tree = kd.Tree(xy, xy, kd.LEAF)
    found, d2 = kd.nearest_of(tree, xy[:, 0], xy[:, 1], px, py, np.full(500, np.inf))
    assert sum(len(rows) * len(places) for rows, places in tree.visit(px, py, d2)) < 20 * kd.LEAF * 500
    for k in range(0, 500, 50):
        all_d2 = (px[k] - xy[:, 0]) ** 2 + (py[k] - xy[:, 1]) ** 2
        assert (found[k], d2[k]) == (all_d2.argmin(), all_d2.min())


def test_nearest_among_crowded_targets(spark, monkeypatch):
    """All targets and points in one bucket of the former grid: cells hold few of them, wherever they lie, and a crowded cell is there more than once."""
    monkeypatch.setattr(kd, "PASSING", 40)
    rng = np.random.default_rng(8)
    targets = [(k, float(x), 100.0 * (k % 5)) for k, x in enumerate(np.round(rng.normal(0, 3, 1200) ** 3, 2))]
    points = [(k, float(x), 100.0 * (k % 5) + 40 * (k % 2)) for k, x in enumerate(np.round(rng.normal(0, 2, 400) ** 3, 2))]
    got = U.nearest(spark.createDataFrame(points, POINTS), spark.createDataFrame(targets, TARGETS), 1e6, cell=100)
    assert {r.pid: (r.vid, r.d2) for r in got.collect()} == brute(points, targets)
    x, y = np.concatenate([rng.normal(0, 1e-6, 30_000), rng.random(30_000) * 1e6]), 100.0 * rng.integers(0, 25, 60_000)
    picked = rng.choice(60_000, 64 * 60, replace=False)
    cells = kd.Cells(x[picked], y[picked], 64)
    assert np.bincount(cells.of(x, y)).max() < 2000 and 60 <= cells.n <= 130


def test_set_overlap_makes_each_pair_once(spark, monkeypatch):
    """Sets of one and of several members, a member of many sets, repeated rows and nulls; pairs of one-member sets are not shuffled."""
    monkeypatch.setattr(K, "BLOCK", 16)
    monkeypatch.setattr(K, "TASK_PAIRS", 500)
    rng = np.random.default_rng(7)

    def sets(n: int, several: bool) -> list:
        rows = [(int(c), int(m)) for c, m in zip(range(n), rng.choice([0, 0, 0, 1, 2, 3], n))]
        rows += [(int(c), int(m)) for c, m in zip(rng.integers(0, n, n // 2), rng.integers(0, 4, n // 2))] if several else []
        return [*rows, *rows[:20], (None, 1), (n, None)]

    for one_a, one_b in ((True, True), (True, False), (False, False)):
        a, b = sets(90, not one_a), sets(120, not one_b)
        got = K.set_overlap(*(spark.createDataFrame(s, "component long, member long") for s in (a, b)))
        rows = [(r.ca, r.cb) for r in got.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == {(ca, cb) for ca, ma in a for cb, mb in b if ma is not None and ma == mb}
        assert ("Aggregate" in got._jdf.queryExecution().executedPlan().toString()) == (not (one_a or one_b))
