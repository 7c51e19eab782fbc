"""Boosted trees of all cells side by side."""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pytest

from undertow.functions.labels import LAUNDERING
from undertow.operators import boosting_grid as grid
from undertow.operators.features import FEATURES
from undertow.operators.split import stratified_split
from undertow.plans import workflows


def naive_margins(bins, y, learnt, rounds, leaf=10):
    """Margins of all rows after boosting by the rows that are learnt from, one row and one cut after the other."""
    positive = sum(y[i] for i in learnt)
    margin = [math.log(positive / (len(learnt) - positive))] * len(y)
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        add = [0.0] * len(y)

        def grow(train, every, depth, p=p, add=add):
            mean = lambda rows: sum(y[i] - p[i] for i in rows) / len(rows)
            best = None
            for f in range(len(bins[0])) if depth else ():
                for b in sorted({bins[i][f] for i in train}):
                    low, high = [i for i in train if bins[i][f] <= b], [i for i in train if bins[i][f] > b]
                    if len(low) >= leaf and len(high) >= leaf:
                        gain = round(len(low) * len(high) / len(train) ** 2 * (mean(low) - mean(high)) ** 2, 9)
                        if gain > 0 and (best is None or gain > best[0]):
                            best = gain, f, b
            if best:
                for over in (False, True):
                    side = lambda rows, over=over: [i for i in rows if (bins[i][best[1]] > best[2]) is over]
                    grow(side(train), side(every), depth - 1)
            else:
                slope = sum(p[i] * (1 - p[i]) for i in train)
                for i in every:
                    add[i] = 0.1 * mean(train) * len(train) / slope

        grow(learnt, list(range(len(y))), 3)
        margin = [m + a for m, a in zip(margin, add, strict=True)]
    return margin


@pytest.fixture
def noisy(spark):
    """A table of 160 rows whose values are few, so that each is a bin, and three cells."""
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(0, 6, 160), rng.integers(0, 9, 160)])
    label = {"a": (x.sum(1) > 6) ^ (rng.random(160) < 0.2), "b": (x[:, 1] % 3 == 0) ^ (rng.random(160) < 0.1), "one class": np.zeros(160, bool)}
    table = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "node long, x double, y double")
    rows = [(i, 0.1, c, int(label[c][i])) for c in label for i in range(160)]
    return x, label, table, spark.createDataFrame(rows, "node long, cutoff double, target string, label int")


def test_boosting_matches_brute_force(spark, noisy, monkeypatch):
    """The areas of every cell, over more than one task and with margins written between the rounds."""
    x, label, table, labels = noisy
    monkeypatch.setattr(grid, "FEW_ROWS", 50)
    monkeypatch.setattr(grid, "KEPT", 2)
    got = {r.target: r for r in grid.boosting_grid(table, ["x", "y"], labels, rounds=15).collect()}
    edges = grid.bin_edges(table, ["x", "y"])
    bins = [[sum(int(v > e) for e in edges[c]) for v, c in zip(r, ("x", "y"), strict=True)] for r in x]
    for i, c in enumerate(("a", "b")):
        y = label[c].astype(int)
        split = stratified_split(labels.where(f"target = '{c}'").selectExpr("node", "label", f"{2 * i} + label as stratum"), label="stratum")
        test = {r.node for r in split.where("is_test").collect()}
        margin = naive_margins(bins, y, [n for n in range(160) if n not in test], 15)
        tp, fp, pos = (sum(f(n) for n in test) for f in (lambda n: margin[n] >= 0 and y[n], lambda n: margin[n] >= 0 and not y[n], lambda n: y[n]))  # noqa: B023
        neg = len(test) - pos
        assert 0 < tp < pos
        assert got[c].roc == pytest.approx((tp / pos + 1 - fp / neg) / 2)
        assert got[c].pr == pytest.approx(tp / pos * tp / (tp + fp) + (pos - tp) / pos * pos / len(test))
        assert got[c].imbalance == pytest.approx(y.mean())
    assert got["one class"].roc is None and got["one class"].pr is None and got["one class"].imbalance == 0


def test_margins_match_brute_force(spark, noisy):
    x, label, _, _ = noisy
    y = label["a"].astype(np.uint8)
    start = math.log(y[:120].mean() / (1 - y[:120].mean()))
    rows = [(bytes(x[at].T.astype(np.uint8).tobytes()), (y[at] + 2 * (np.arange(160)[at] >= 120)).astype(np.uint8).tobytes(), np.full(40, start).tobytes()) for at in (slice(i, i + 40) for i in range(0, 160, 40))]
    blocks = spark.createDataFrame([tuple(map(bytearray, r)) for r in rows], grid.BLOCK).coalesce(1)
    moved = grid._moved(*((lambda b, t: (b, 2, 1, t))(*grid.fitted(blocks, 2, 1, 7))))
    got = np.concatenate([np.frombuffer(r.margin) for r in moved.collect()])
    assert got == pytest.approx(np.array(naive_margins(x.tolist(), y.astype(int), list(range(120)), 7)), abs=1e-6)


def test_more_cells_take_no_more_jobs(spark, noisy, monkeypatch):
    """Cells used to be fitted one after the other, with hundreds of jobs each."""
    monkeypatch.setattr(workflows, "boosting_grid", partial(grid.boosting_grid, rounds=6))
    _, _, table, labels = noisy
    wide = table.selectExpr("node", *(f"{'x' if i % 2 else 'y'} as {f}" for i, f in enumerate(FEATURES)))
    wide = wide.join(labels.where("target = 'a'").selectExpr("node", f"label * 0.5 as `{LAUNDERING}`"), "node")

    def jobs(cutoffs: list[float]) -> int:
        group = f"cells-{len(cutoffs)}"
        spark.sparkContext.setJobGroup(group, group)
        found = workflows.supervised_grid(wide, [(c, LAUNDERING) for c in cutoffs], "boosting")
        assert len({r[3:] for r in found}) == 1 and 0.5 < found[0][3] <= 1
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    try:
        assert jobs([0.1, 0.2, 0.3]) < 1.2 * jobs([0.1])
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
