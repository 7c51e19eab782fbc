"""Queries through files, against their SQL; and the operators beside them."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from undertow.functions import labels, metrics
from undertow.operators import models
from undertow.plans import file_queries, registry, workflows
from undertow.sources import tables

TABLES = ("customer", "orders", "events", "region")


@pytest.mark.parametrize(
    "name",
    sorted(
        {
            *file_queries.ORACLES,
            "model_order",
            "induced_edges",
            "result_log",
            "time_log",
            "pattern_file_rows",
            "louvain_checks",
            "louvain_first_moves",
            "isolation_scores",
            "tree_first_cuts",
            "triangles",
            "twins",
            "connected_components",
            "synthetic_assembled_counts",
            "loaded_measures",
        }
    ),
)
def test_matches_sql(spark, sf, name):
    with duckdb.connect() as c:
        for t in TABLES:
            c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
        want = c.execute(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, sf).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    one, two = (sorted(map(tuple, d[columns].astype(str).to_numpy())) for d in (got, want))
    assert one == two


def test_range_tail_matches_known_quantiles():
    """The quantiles at 0.05 of the studentised range with infinite degrees of freedom, as tables have them."""
    for k, q in ((2, 2.772), (3, 3.314), (5, 3.858), (10, 4.474)):
        assert metrics.range_tail(q, k) == pytest.approx(0.05, abs=2e-4)
    assert metrics.range_tail(1.5, 2) == pytest.approx(math.erfc(1.5 / 2), abs=1e-9)
    assert metrics.range_tail(0, 4) == 1


def test_nemenyi_p_agrees_with_the_critical_difference(spark):
    ranks = spark.createDataFrame([("a", 1.2), ("b", 2.0), ("c", 2.8)], "method string, mean_rank double")
    rows = metrics.nemenyi(ranks, 3, 12).collect()
    assert len(rows) == 3
    for r in rows:
        assert (r.p <= 0.05) == r.significant


def test_order_of_models_with_ties(spark):
    rows = spark.createDataFrame(
        [("d", "x", 1.0), ("d", "y", 2.0), ("d", "z", 1.0), ("d", "other", 9.0)], "dataset string, method string, score double"
    )
    got = {r.method: r["rank"] for r in metrics.model_order(rows, ["z", "y", "x"]).collect()}
    assert got == {"y": 1, "z": 2, "x": 3}


def test_merged_results_and_counts(spark):
    a = spark.createDataFrame([("p", 1, 2), ("q", 3, 4)], "pattern string, roc int, n int")
    b = spark.createDataFrame([("p", 5), ("r", 6)], "pattern string, roc int")
    assert [tuple(r) for r in tables.merged_results(a, b, "pattern").collect()] == [("p", 1, 2, 5)]
    assert tables.merged_results(a, b, "pattern").columns == ["pattern", "roc_x", "n", "roc_y"]
    nodes = spark.createDataFrame([(1, True), (2, False), (3, None)], "node int, laundering boolean")
    assert tuple(labels.labelled_count(nodes).first()) == (3, 1)


def test_a_cell_that_cant_be_fitted(spark):
    """A fit that raises an error gives the cell's value on failure, and the other cells go on."""
    rows = spark.range(200).selectExpr("id as node", "id / 200.0 as x", "0.1 as cutoff", "'a' as target", "cast(id % 2 as int) as label")
    broken = rows.selectExpr("node", "cast('nan' as double) as x", "cutoff", "'b' as target", "label")
    with pytest.warns(UserWarning, match="can't be fitted"):
        grid = models.model_grid(rows.union(broken), ["x"], [(0.1, "b"), (0.1, "a")], models.tree(), on_failure=-1.0)
    assert grid[0][3:] == (-1.0, -1.0)
    assert 0 <= grid[1][3] <= 1


def test_ids_and_sizes_over_32_bits(spark, tmp_path):
    spark.createDataFrame([(3_000_000_000, 1), (1, 2)], "source long, target long").write.option("header", True).csv(str(tmp_path / "edges"))
    v, e = tables.graph_from_edge_list(spark, str(tmp_path / "edges"), directed=True)
    assert sorted(map(tuple, e.collect())) == [(1, 2), (3_000_000_000, 1)]
    assert sorted(r.node for r in v.collect()) == [1, 2, 3_000_000_000]
    found = spark.createDataFrame([(3_000_000_000, 0.5, 3_000_000_000)], "node long, measure_22 double, size_22 long")
    tables.write_table(found, str(tmp_path / "m.csv"), as_csv=True)
    assert [tuple(r) for r in tables.read_measures(spark, str(tmp_path / "m.csv")).collect()] == [("3000000000", 0.5, 3_000_000_000)]


def test_labels_by_position_from_many_tasks(spark, tmp_path, monkeypatch):
    """Files are read in blocks of a few lines; a position counts over blocks and files, without headers and blank lines."""
    names = ["laundering", "separate", "new_mules", "existing_mules"]
    rows = [[i % 3 == 0, i % 5 == 0, i % 7 == 0, i % 2 == 0] for i in range(500)]
    for name, part in (("a", rows[:300]), ("b", []), ("c", rows[300:])):
        lines = [",".join(names), *(",".join(str(x).lower() for x in r) for r in part)]
        (tmp_path / f"{name}.csv").write_text("\n\n".join(lines) + ("\n" if name == "a" else ""))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        assert tables.line_numbers(spark, str(tmp_path)).select("number").distinct().count() == 500
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = tables.read_synthetic_labels(spark, str(tmp_path)).orderBy("node").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r.node for r in got] == list(range(500))
    assert [[r[n] for n in names] for r in got] == rows


def test_targets_of_nodes_without_a_score(spark):
    """A missing score is -1, a missing label false."""
    nodes = spark.createDataFrame([(1, True), (2, False), (3, True)], "node long, laundering boolean").selectExpr(
        "*", "false as separate", "laundering as new_mules", "not laundering as existing_mules"
    )
    scored = spark.createDataFrame([(1, 0.5), (4, -2.0)], "node long, score double")
    got = {r.target: r.roc for r in workflows.evaluate_synthetic(scored, nodes).collect()}
    # Scores 0.5, -1, -1, -2 with labels true, false, true, false.
    assert got["laundering"] == pytest.approx(3.5 / 4) and got["separate"] is None


def test_exact_quantiles(spark):
    rng = np.random.default_rng(0)
    values = {"a": [1e12, *rng.integers(0, 40, 400).tolist()], "b": rng.normal(size=333).tolist(), "c": [7.5], "d": [None]}
    rows = spark.createDataFrame([(k, float(x) if x is not None else None) for k, v in values.items() for x in v], "k string, x double")
    fractions = [0.0, 0.25, 0.5, 0.99, 1.0]
    got = {r.k: r.q for r in metrics.quantiles(rows, "x", fractions, ["k"]).collect()}
    assert sorted(got) == ["a", "b", "c"]
    for k, q in got.items():
        assert q == pytest.approx(np.quantile(values[k], fractions).tolist())
    assert metrics.quantiles(rows.where("k = 'c'"), "x", [0.3]).first().q == [7.5]


def test_ranges_hold_even_shares(spark):
    """One far value doesn't put the others into one range."""
    rows = spark.range(40_000).selectExpr("if(id = 0, 1e12, id / 7.0) as score", "cast(id % 2 as int) as label")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in metrics.in_ranges(rows, "score").groupBy("range_").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) <= 2 * 10_000
    assert metrics.areas(rows).first().roc == pytest.approx(0.5, abs=1e-3)


def test_rounding_as_python_rounds(spark):
    rng = np.random.default_rng(0)
    values = [i / 20 for i in range(-2001, 2001)] + [i / 8 for i in range(-99, 99)] + (rng.normal(size=100_000) * 3).tolist() + [1e15 + 0.25, -4e14 - 0.05, 1e300]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", labels.rounded_once(F.col("x")).alias("y")).collect()
    assert all(r.y == round(r.x, 1) for r in got)
