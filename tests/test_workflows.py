from __future__ import annotations

import math

import pytest

from undertow.functions import labels
from undertow.functions.labels import LAUNDERING
from undertow.operators.models import MEASURES, fit_evaluate, tree
from undertow.plans import fixtures, workflows
from undertow.plans.fixtures import communities, labelled, reduced_graph
from undertow.operators.blocks import measures


def test_measures_of_a_file(spark, tmp_path):
    path = tmp_path / "edges.csv"
    path.write_text("source,target\n0,2\n0,3\n0,4\n2,1\n3,1\n4,1\n9,9\n")
    found = workflows.measure_file(spark, str(path), str(tmp_path / "out"), True, str(tmp_path / "log"), edge_list=True, reduce=False)
    assert found.count() == 6
    scored = {r.node: r.score for r in workflows.score_source(spark.read.parquet(str(tmp_path / "out")), "direct").collect()}
    assert scored[0] == scored[9] == 1
    assert spark.read.text(str(tmp_path / "log")).count() == 1
    again = workflows.anomaly_scores(spark, str(tmp_path / "out"))
    assert again.columns == ["node", *MEASURES, "anomaly_score"]
    with pytest.raises(ValueError, match="score source"):
        workflows.score_source(found, "odd")


def test_evaluation_grid(spark, sf):
    v, e = reduced_graph(spark, sf)
    scored = workflows.score_source(measures(v, e, True), "direct")
    rates = labels.account_rates(labelled(spark, sf))
    cells = workflows.evaluate(rates, scored, targets=[LAUNDERING, "CYCLE"], cutoffs=[0.1, 0.9]).collect()
    assert len(cells) == 4
    assert all(c.roc is None or 0 <= c.roc <= 1 for c in cells)
    lift, bins = workflows.lift_and_histograms(rates, scored, [0.1])
    assert lift.where(f"target = '{LAUNDERING}'").count() == 100
    assert bins.count() > 0


def test_supervised_grid(spark, sf):
    v, e = reduced_graph(spark, sf)
    table = workflows.supervised_table(v, e, measures(v, e, True), labels.account_rates(labelled(spark, sf)))
    grid = workflows.supervised_grid(table, [(0.05, LAUNDERING), (2.0, LAUNDERING)], "tree")
    assert 0 <= grid[0][3] <= 1
    assert math.isnan(grid[1][3])
    assert workflows.supervised_grid(table, [(2.0, LAUNDERING)], "tree", synthetic=True)[0][3] == 0


def test_a_tree_learns_and_is_saved(spark, tmp_path):
    rows = spark.range(400).selectExpr("id as node", "cast(id % 2 as int) as label", "cast(id % 2 as double) + rand(1) / 4 as x")
    model, (roc, pr) = fit_evaluate(rows, ["x"], tree(), str(tmp_path / "model"))
    assert (roc, pr) == (1, 1)
    assert (tmp_path / "model").exists()
    assert fit_evaluate(rows, ["x"], tree(), probabilities=True)[1] == (1, 1)
    assert model.depth >= 1


def test_dataset_names():
    assert labels.dataset_kind("synthetic_x") == "generated"
    assert labels.dataset_kind("HI-Small") == "transactions"


def test_fixture_communities(spark, sf):
    v, _ = fixtures.raw_graph(spark, sf)
    assert communities(v, 4).where("community <> node % 4").count() == 0
