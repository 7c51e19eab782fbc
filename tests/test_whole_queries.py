"""Registered queries that take the whole network."""

from __future__ import annotations

from undertow.functions import labels
from undertow.functions.labels import TARGETS
from undertow.plans import fixtures, label_queries, registry


def test_components_of_the_whole_network(spark, sf):
    v, e = fixtures.raw_graph(spark, sf)
    root = {r.node: r.node for r in v.collect()}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for r in e.collect():
        a, b = sorted((find(r.src), find(r.dst)))
        root[b] = a
    got = {r.node: r.component for r in registry.queries()["connected_components"](spark, sf).collect()}
    assert got == {x: find(x) for x in root}


def test_all_scores_are_joined(spark, sf):
    score = {r.node: r.score for r in label_queries._scores(spark, sf).collect()}
    senders = {r.node for r in label_queries.rates(spark, sf, "sender").select("node").collect()}
    assert any(x % 3 == 0 for x in senders & set(score))
    for how, want in (("outer", senders | set(score)), ("lookup", senders), ("inner", senders & set(score))):
        got = {r.node: r.score for r in registry.queries()[f"labels_scores_{how}"](spark, sf).collect()}
        assert got == {x: score.get(x, {"outer": -1, "lookup": -2}.get(how)) for x in want}


def test_missing_scores(spark):
    rates = spark.createDataFrame([(x, *[0.5] * len(TARGETS)) for x in (1, 3)], ["node", *TARGETS])
    scores = spark.createDataFrame([(1, 0.25), (2, 0.75)], "node long, score double")
    for how, want in (("outer", {1: 0.25, 2: 0.75, 3: -1}), ("lookup", {1: 0.25, 3: -2}), ("inner", {1: 0.25})):
        assert {r.node: r.score for r in labels.join_scores(rates, scores, how).collect()} == want


def test_models_take_every_cell(spark, sf):
    for name, targets in (("isolation_areas", TARGETS), ("tree_auc", TARGETS[:-1])):
        got = {(r.cutoff, r.target) for r in registry.queries()[name](spark, sf).collect()}
        assert got == {(c, t) for c in fixtures.CUTOFFS for t in targets}
