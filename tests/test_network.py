from __future__ import annotations

import numpy as np
import pytest

from tests.brute import directed_measures, undirected_measures
from undertow.functions.scores import WEIGHTED, scores, scores_directed, scores_undirected
from undertow.operators import blocks, ego, features, graph

SMURF = [(0, 2), (0, 3), (0, 4), (2, 1), (3, 1), (4, 1)]
KEYS = blocks.PAIRS


def network(spark, pairs, n=None):
    raw = spark.createDataFrame(pairs or [(None, None)], "src long, dst long")
    v = graph.nodes(raw) if n is None else spark.range(n).withColumnRenamed("id", "node")
    return v, graph.edges(raw)


def measured(spark, pairs, directed=True, n=None):
    v, e = network(spark, pairs, n)
    return {r.node: r for r in blocks.measures(v, e, directed).collect()}, v, e


def pair(row, key):
    return round(row[f"measure_{key}"], 9), row[f"size_{key}"]


def test_golden_smurfing(spark):
    rows, v, e = measured(spark, SMURF)
    assert [pair(rows[0], k) for k in KEYS] == [(0, 0), (1, 3), (0, 0), (0, 3), (0, 6), (1, 3), (0, 0), (0, 3), (0, 0)]
    assert [pair(rows[1], k) for k in KEYS] == [(0, 0), (0, 3), (0, 0), (1, 3), (0, 6), (0, 3), (0, 0), (1, 3), (0, 0)]
    assert [pair(rows[2], k) for k in KEYS] == [(0, 2), (0.5, 6), (0, 0), (0.5, 6), (0, 2), (1, 0), (0.2, 15), (0.3, 10), (0.24, 25)]
    m = blocks.measures_directed(v, e)
    basic, weighted = ({r.node: r for r in scores_directed(m, *k).collect()} for k in ((), (WEIGHTED,)))
    assert (basic[0].score, basic[0].score_transposed) == pytest.approx((1, -2 / 7))
    assert (basic[1].score, basic[1].score_transposed, basic[1].score_max) == pytest.approx((-2 / 7, 1, 1))
    assert (basic[2].score, basic[2].score_transposed) == pytest.approx((0.75 - 1.24 / 7, 0.4 - 1.94 / 7))
    assert (weighted[0].score, weighted[0].score_transposed) == pytest.approx((1, -0.5))
    assert (weighted[2].score, weighted[2].score_transposed) == pytest.approx((0.25, 0.135))
    und = {r.node: r for r in blocks.measures_undirected(v, e).collect()}
    assert [pair(und[0], k) for k in "123"] == [(0, 0), (1, 3), (0, 6)]
    assert [pair(und[2], k) for k in "123"] == [(0, 2), (1, 4), (0, 2)]


def test_isolated_loop_and_single_edge(spark):
    rows, v, e = measured(spark, [(0, 1), (0, 1), (7, 7)])
    assert [pair(rows[7], k) for k in KEYS] == [(0, 0), (1, 0), (0, 0), (0, 0), (0, 0), (1, 0), (0, 1), (0, 0), (0, 1)]
    assert [pair(rows[0], k) for k in KEYS] == [(0, 0), (1, 1), (0, 0), (0, 1), (0, 0), (1, 0), (0, 2), (0.5, 2), (0.25, 4)]
    s = {r.node: r for r in scores_directed(blocks.measures_directed(v, e)).collect()}
    w = {r.node: r for r in scores_directed(blocks.measures_directed(v, e), WEIGHTED).collect()}
    assert (s[7].score, s[7].score_transposed, w[7].score, w[7].score_transposed) == pytest.approx((1, -2 / 7, 1, 0))
    und = blocks.measures_undirected(v, e)
    assert {r.node: r.score for r in scores_undirected(und).collect()} == {0: 1, 1: 1, 7: 1}
    assert {r.node: r.score for r in scores_undirected(und, WEIGHTED).collect()} == {0: -1, 1: -1, 7: -1}


@pytest.mark.parametrize(("seed", "n", "p"), [(1, 25, 0.06), (2, 18, 0.15), (3, 30, 0.03)])
def test_random_graphs_match_matrices(spark, seed, n, p):
    a = (np.random.default_rng(seed).random((n, n)) < p).astype(int)
    np.fill_diagonal(a, 0)
    pairs = [(int(i), int(j)) for i, j in zip(*np.nonzero(a), strict=True)]
    rows, v, e = measured(spark, pairs, n=n)
    und = {r.node: r for r in blocks.measures_undirected(v, e).collect()}
    one = spark.range(n).selectExpr("id as node", "0L as community")
    dense = {r.node: r for r in blocks.measures_directed(v, e, strategy="pandas", communities=one).collect()}
    for x in range(n):
        want = directed_measures(a, x)
        assert {k: pair(rows[x], k) for k in KEYS} == {k: (round(m, 9), z) for k, (m, z) in want.items()}
        assert {k: pair(dense[x], k) for k in KEYS} == {k: (round(m, 9), z) for k, (m, z) in want.items()}
        assert {k: pair(und[x], k) for k in "123"} == {k: (round(m, 9), z) for k, (m, z) in undirected_measures(a, x).items()}


def test_reversing_swaps_scores_with_role_two(spark):
    a = (np.random.default_rng(5).random((20, 20)) < 0.15).astype(int)
    np.fill_diagonal(a, 0)
    pairs = [(int(i), int(j)) for i, j in zip(*np.nonzero(a), strict=True)]
    v, e = network(spark, pairs, 20)
    one, two = ({r.node: r for r in scores_directed(blocks.measures_directed(v, x)).collect()} for x in (e, graph.reverse(e)))
    sizes = {r.ego for r in ego.roles_directed(v, e).where("role = 2").select("ego").distinct().collect()}
    assert sizes
    for x in sizes:
        assert (one[x].score, one[x].score_transposed) == pytest.approx((two[x].score_transposed, two[x].score))


def test_without_compat_empty_blocks_are_zero(spark):
    v, e = network(spark, [(0, 1)])
    row = {r.node: r for r in blocks.measures_directed(v, e, compat=False).collect()}[0]
    assert [pair(row, k) for k in ("20", "21", "22")] == [(0, 0)] * 3


def test_degree_and_hubs(spark):
    v, e = network(spark, [(0, i) for i in range(1, 40)] + [(1, 0), (50, 50)])
    d = {r.node: r.degree for r in graph.degree(v, e).collect()}
    assert (d[0], d[1], d[2], d[50]) == (40, 2, 1, 0)
    left, kept = graph.without_hubs(v, e, 0.01)
    assert kept.count() == 0
    assert left.count() == 40


def test_neighbour_summary(spark):
    v, e = network(spark, [(0, 1), (0, 2), (1, 2)])
    values = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 4.0)], "node long, score double")
    rows = {r.node: r for r in features.neighbour_summary(v, e, values, "score").collect()}
    assert (rows[0].score_min, rows[0].score_mean, rows[0].score_max, rows[0].score_std) == (2, 3, 4, 1)
    assert (rows[2].score_min, rows[2].score_mean, rows[2].score_max, rows[2].score_std) == (0, 0, 0, 0)
    with pytest.raises(Exception, match="no value for neighbour"):
        features.neighbour_summary(v, e, values.where("node <> 2"), "score").collect()


def test_large_communities_are_computed_by_joins(spark, monkeypatch):
    """With the same result as dense matrices."""
    pairs = [(i, (i * 7 + j) % 12) for i in range(12) for j in (1, 2)] + [(20 + i, 20 + (i + 1) % 4) for i in range(4)]
    v, e = network(spark, pairs)
    place = v.selectExpr("node", "node div 20 as community")
    want = sorted(map(tuple, blocks.measures_directed(v, e).collect()))
    for most in (2000, 6, 1):
        monkeypatch.setattr(blocks, "DENSE_NODES", most)
        assert sorted(map(tuple, blocks.measures_directed(v, e, strategy="pandas", communities=place).collect())) == want


def test_too_many_paths_are_an_error(spark):
    _, e = network(spark, [(0, i) for i in range(1, 11)])
    assert ego.check_paths(e, 110) == 110
    with pytest.raises(ValueError, match="110 two-step paths"):
        ego.check_paths(e, 109)


def test_unknown_options(spark):
    v, e = network(spark, SMURF)
    with pytest.raises(ValueError, match="score type"):
        scores(blocks.measures(v, e, True), True, "other")
    with pytest.raises(ValueError, match="strategy"):
        blocks.measures_directed(v, e, strategy="other")


def test_empty_graph(spark):
    v = spark.createDataFrame([], "node long")
    e = spark.createDataFrame([], "src long, dst long")
    assert blocks.measures_directed(v, e).count() == 0
    assert features.score_graph(v, e).count() == 0
