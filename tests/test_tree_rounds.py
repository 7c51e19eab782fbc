"""What growing trees asks of the driver: no rounds for cells that fit a task, and rounds that write nothing."""

from __future__ import annotations

from pathlib import Path

import numpy as np

from undertow.functions.metrics import areas
from undertow.operators import tree_grid
from undertow.sources.stage import session_dir


def test_a_cell_that_fits_a_task_takes_no_round(spark, monkeypatch):
    """Each round is several jobs and plans for the driver. Cells of 90,000 rows used to take eleven."""
    monkeypatch.setattr(tree_grid, "best_cuts", lambda *_: (_ for _ in ()).throw(AssertionError("a round")))
    table = spark.range(30_000).selectExpr("id as node", "cast(id % 20 as double) as x", "cast(id % 7 as double) as y")
    labels = table.selectExpr("node", "0.1 as cutoff", "'good' as target", "cast(x > 10 and y > 2 as int) as label")
    found = tree_grid.tree_grid(table, ["x", "y"], labels).collect()
    assert [(r.target, r.roc, r.pr) for r in found] == [("good", 1.0, 1.0)]


def test_rounds_write_nothing(spark):
    """Every level used to leave three tables."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 8, (200, 2))
    rows = [(c, i, int(x[i].sum() % (c + 2) == 0), i >= 150, x[i].tolist()) for c in (0, 1) for i in range(200)]
    table = spark.createDataFrame(rows, "cell int, node long, label int, is_test boolean, bins array<int>")
    files = lambda: {str(p) for p in Path(session_dir(spark).removeprefix("file:")).rglob("*")}
    before = files()
    assert {r.code.bit_length() for r in tree_grid.fitted(table, ["cell"], 10, few=0).collect()} > {3}
    assert files() == before


def test_hard_areas_are_the_general_ones(spark):
    """Also for cells whose held-out rows have one class, or whose leaves all say the same."""
    rng = np.random.default_rng(6)
    rows = [(int(c), int(code), int(rng.random() < share), bool(rng.random() < 0.4)) for c, share in enumerate((0.5, 0.02, 0.9, 0.3)) for code in rng.integers(4, 9, 150)]
    rows += [(9, 1, 0, True), (9, 1, 0, False), (9, 1, 1, False), (10, 1, 1, True), (10, 1, 0, True)]
    table = spark.createDataFrame(rows, "cell int, code long, label int, is_test boolean")
    leaves = table.where("not is_test").groupBy("cell", "code").agg({"label": "avg"}).selectExpr("cell", "code", "cast(`avg(label)` > 0.5 as int) as score")
    want = {r.cell: (r.roc, r.pr) for r in areas(table.where("is_test").join(leaves, ["cell", "code"]), ["cell"]).collect()}
    got = {r.cell: (r.roc, r.pr) for r in tree_grid.hard_areas(table).collect()}
    assert got == want and want[9] == (None, None) and 10 not in want and sum(x[0] is not None for x in want.values()) == 4
