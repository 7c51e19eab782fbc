"""Hubs, triangles, and models of many cells, against brute force."""

from __future__ import annotations

import time
from itertools import combinations

import numpy as np
import pytest

from undertow.operators import blocks, ego, graph, models, tree_grid
from undertow.plans.fixtures import reduced_graph
from undertow.sources.stage import staged

LEAVES = 50_000


def test_a_star_beside_a_network(spark, sf):
    """Its leaves are twins: what is measured around one holds for all, and the paths of one are made."""
    v, e = reduced_graph(spark, sf)
    hub = 10_000_000
    star = spark.range(1, LEAVES + 1).selectExpr(f"{hub}L as src", f"{hub} + id as dst")
    nodes = v.union(spark.range(hub, hub + LEAVES + 1))
    both = staged(e.select("src", "dst").union(star), "star")
    same = staged(ego.twins(nodes, both), "twins")
    assert same.count() == nodes.count()
    assert [r.twin for r in same.where(f"node > {hub}").select("twin").distinct().collect()] == [hub + 1]
    egos = same.selectExpr("twin as node").distinct()
    alone = graph.wedges(e, ego.twins(v, e).selectExpr("twin as node").distinct()).first()[0]
    # The hub's leaves have one neighbour each, and a leaf's neighbour has all leaves.
    assert graph.wedges(both, egos).first()[0] == alone + 2 * LEAVES
    began = time.time()
    found = staged(blocks.measures(nodes, both, True), "measures")
    assert found.count() == nodes.count() and time.time() - began < 120
    got = {r[0]: r[1:] for r in found.where(f"node < {hub}").collect()}
    assert got == {r[0]: r[1:] for r in blocks.measures(v, e, True).collect()}
    leaf = found.where(f"node > {hub}").select(*(c for c in found.columns if c != "node")).distinct().collect()
    assert len(leaf) == 1
    # The other leaves are reached by mixed directions only: role 0; the hub has role 1.
    assert (leaf[0].size_00, leaf[0].size_10, leaf[0].measure_10) == ((LEAVES - 1) * (LEAVES - 2), LEAVES, 1.0)


@pytest.mark.parametrize("seed", range(3))
def test_twins_and_triangles_match_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 24, (90, 2)) if a != b} | {(0, i) for i in range(24, 44)} | {(50, 51), (52, 51)}
    v = spark.range(60).withColumnRenamed("id", "node")
    e = spark.createDataFrame(sorted(pairs), "src long, dst long")
    near = {x: frozenset((b, (x, b) in pairs, (b, x) in pairs) for b in range(60) if (x, b) in pairs or (b, x) in pairs) for x in range(60)}
    want = {x: x if len(n) > ego.TWIN_NEIGHBOURS else min(y for y, m in near.items() if m == n) for x, n in near.items()}
    assert {r.node: r.twin for r in ego.twins(v, e).collect()} == want
    links = lambda a, b: ((a, b) in pairs) + ((b, a) in pairs)
    found = {frozenset(t): links(t[0], t[1]) + links(t[0], t[2]) + links(t[1], t[2]) for t in combinations(range(60), 3) if links(t[0], t[1]) and links(t[0], t[2]) and links(t[1], t[2])}
    assert {frozenset((r.a, r.b, r.c)): r.w_ab + r.w_ac + r.w_bc for r in graph.triangles(e).collect()} == found
    for directed, name in ((True, "11"), (False, "3")):
        full = {r.node: (r[f"measure_{name}"], r[f"size_{name}"]) for r in blocks.measures(v, e, directed).collect()}
        assert {r.node: (r[f"measure_{name}"], r[f"size_{name}"]) for r in blocks.first_order_measures(v, e, directed).collect()} == full


def test_forest_table_matches_its_trees(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 5, (300, 9)) / 4
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "node long, " + ", ".join(f"{m} double" for m in models.MEASURES))
    forest = models.IsolationForest(trees=7, sample=64).fit(rows)
    trees: dict = {}
    for t in forest.forest.collect():
        trees.setdefault(t.tree, {})[t.code] = t
    assert len(trees) == 7
    scale = models.average_path(64) * 7

    def depth(tree, row):
        code = 1
        while tree[code].column >= 0:
            code = 2 * code + int(row[tree[code].column] > tree[code].cut)
        return tree[code].path

    for r in forest.transform(rows).collect():
        assert r.anomaly_score == pytest.approx(-(2.0 ** (-sum(depth(t, r[1:10]) for t in trees.values()) / scale)))


def test_forest_of_few_or_equal_rows(spark):
    one = "node long, " + ", ".join(f"{m} double" for m in models.MEASURES)
    for rows in ([(1, *[0.5] * 9)], [(i, *[0.5] * 9) for i in range(20)]):
        df = spark.createDataFrame(rows, one)
        assert models.IsolationForest(trees=3).fit(df).transform(df).count() == len(rows)


def naive_tree(bins, y, leaf, code=1, depth=30):
    """Leaf codes of all rows by the same rule, one node after the other."""
    out = np.full(len(y), code)
    best = None
    gini = lambda v: 2 * v.mean() * (1 - v.mean())
    for f in range(bins.shape[1]):
        for b in np.unique(bins[:, f]):
            under = bins[:, f] <= b
            if under.sum() >= leaf and (~under).sum() >= leaf:
                gain = round(gini(y) - under.mean() * gini(y[under]) - (~under).mean() * gini(y[~under]), 12)
                if gain > 0 and (best is None or (gain, -f, -b) > best[0]):
                    best = (gain, -f, -b), under
    if best and depth:
        under = best[1]
        out[under] = naive_tree(bins[under], y[under], leaf, 2 * code, depth - 1)
        out[~under] = naive_tree(bins[~under], y[~under], leaf, 2 * code + 1, depth - 1)
    return out


def test_trees_of_cells_match_brute_force(spark):
    rng = np.random.default_rng(2)
    n, cells = 240, ["a", "b", "one class"]
    x = np.column_stack([rng.integers(0, 6, n), rng.integers(0, 9, n)])
    label = {"a": (x[:, 0] + x[:, 1] > 6) ^ (rng.random(n) < 0.1), "b": x[:, 1] % 3 == 0, "one class": np.zeros(n, bool)}
    rows = spark.createDataFrame([(c, i, int(label[c][i]), False, x[i].tolist()) for c in cells for i in range(n)], "cell string, node long, label int, is_test boolean, bins array<int>")
    got = {(r.cell, r.node): r.code for r in tree_grid.fitted(rows.repartition(5), ["cell"], 10).collect()}
    for c in cells:
        assert [got[c, i] for i in range(n)] == naive_tree(x, label[c].astype(float), 10).tolist()


def test_grid_of_trees(spark):
    table = spark.range(400).selectExpr("id as node", "cast(id % 20 as double) as x", "cast(id % 7 as double) as y")
    labels = table.selectExpr("node", "0.1 as cutoff", "'good' as target", "cast(x > 10 as int) as label").union(
        table.selectExpr("node", "0.1", "'none'", "0")
    )
    got = {r.target: r for r in tree_grid.tree_grid(table, ["x", "y"], labels).collect()}
    assert got["good"].roc == 1.0 and got["good"].pr == 1.0 and got["none"].roc is None and got["none"].imbalance == 0
