"""Nodes of few rows are grown on by one task each, by the same rule as the rounds."""

from __future__ import annotations

import numpy as np
import pytest

from tests.test_network_sizes import naive_tree
from undertow.operators import tree_grid


@pytest.mark.parametrize("few", [0, 60, 1000])
def test_trees_dont_depend_on_the_rounds(spark, monkeypatch, few):
    """Nodes of more than few rows take rounds, and no others do."""
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.integers(0, 6, 200), rng.integers(0, 9, 200)])
    label = {"a": (x.sum(1) > 6) ^ (rng.random(200) < 0.2), "b": x[:, 1] % 3 == 0}
    rows = [(c, i, int(label[c][i]), i >= 150, x[i].tolist()) for c in label for i in range(200)]
    rounds, cuts = [], tree_grid.best_cuts
    monkeypatch.setattr(tree_grid, "best_cuts", lambda now, by, leaf: rounds.append(now.count()) or cuts(now, by, leaf))
    table = spark.createDataFrame(rows, "cell string, node long, label int, is_test boolean, bins array<int>")
    got = {(r.cell, r.node): r.code for r in tree_grid.fitted(table, ["cell"], 10, few=few).collect()}
    assert len(got) == len(rows)
    assert sum(rounds) == 0 if few == 1000 else len(rounds) > 1
    for c in label:
        assert [got[c, i] for i in range(150)] == naive_tree(x[:150], label[c][:150].astype(float), 10).tolist()
        for i in range(150, 200):
            code, alike = got[c, i], {got[c, j] for j in range(150) if (x[j] == x[i]).all()}
            assert alike <= {code}
