"""End-to-end workflows: measures of a transaction file, score evaluation, supervised and unsupervised grids."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undertow.functions import labels, metrics
from undertow.functions.scores import BASIC, scores
from undertow.operators.blocks import measures
from undertow.operators.boosting_grid import boosting_grid
from undertow.operators.communities import reduce_by_community
from undertow.operators.ego import check_paths, twins
from undertow.operators.features import FEATURES, summarise_scores
from undertow.operators.graph import both_ways
from undertow.operators.models import MEASURES, IsolationForest
from undertow.operators.synthetic import dataset_name, parameter_grid, synthetic_network
from undertow.operators.tree_grid import tree_grid
from undertow.sources import tables
from undertow.sources.stage import staged

#: The cut-offs of the evaluation grid, and the labels of generated nodes.
CUTOFFS = [0.1, 0.2, 0.3, 0.5, 0.9]
#: Two-step paths that a file's measures may take: a network with more has to be reduced.
MOST_PATHS = 10**12
SYNTHETIC_TARGETS = ["laundering", "separate", "new_mules", "existing_mules"]


def measure_file(
    spark: SparkSession,
    path: str,
    out: str,
    directed: bool,
    log: str | None = None,
    edge_list: bool = False,
    reduce: bool = True,
    most_paths: int = MOST_PATHS,
) -> DataFrame:
    """Measures of a transaction (or edge-list) file, written to out; the time, without the last write, goes to log."""
    began = time.time()
    v, e = (tables.graph_from_edge_list if edge_list else tables.graph_from_transactions)(spark, path, directed)
    if reduce:
        v, e = reduce_by_community(v, e)
    check_paths(e, most_paths, twins(v, e).select(F.col("twin").alias("node")).distinct())
    found = staged(measures(v, e, directed), "measures")
    if log:
        tables.append_log(spark, log, path, f"{time.time() - began:.3f}")
    tables.write_table(found, out)
    return found


def labelled_transactions(spark: SparkSession, transactions: str, patterns: str) -> DataFrame:
    """A transaction file with the flags of its pattern file."""
    rows = tables.read_transactions(spark, transactions)
    money = rows.select(*(labels.money(F.col(c)).alias(c) if c in ("amount_received", "amount_paid") else F.col(c) for c in rows.columns))
    return labels.with_patterns(
        money.withColumn("identifier", labels.identifier(*tables.TRANSACTIONS.fieldNames())), tables.read_patterns(spark, patterns)
    )


def score_source(found: DataFrame, kind: str, directed: bool = True, score_type: str = BASIC) -> DataFrame:
    """node, score: direct scores of measures, or the negated anomaly score."""
    if kind == "direct":
        return scores(found, directed, score_type).select("node", "score")
    if kind == "anomaly":
        return found.select("node", (-F.col("anomaly_score")).alias("score"))
    raise ValueError(f"unknown score source: {kind}")


def evaluate(
    rates: DataFrame, scored: DataFrame, how: str = "outer", cutoffs: list[float] | None = None, targets: list[str] | None = None
) -> DataFrame:
    """cutoff, target, imbalance, roc, pr, divergence for every cell, in one job over all cells."""
    by = ["cutoff", "target"]
    long = labels.threshold_labels(staged(labels.join_scores(rates, scored, how), "rated"), cutoffs or CUTOFFS, targets)
    return metrics.areas(long, by).join(metrics.divergence(long, by), by).join(metrics.imbalance(long, by), by)


def lift_and_histograms(rates: DataFrame, scored: DataFrame, cutoffs: list[float] | None = None) -> tuple[DataFrame, DataFrame]:
    """The tables behind the plots: lift curves and score histograms by cell."""
    long = labels.threshold_labels(staged(labels.join_scores(rates, scored), "rated"), cutoffs or CUTOFFS)
    return metrics.lift(long, ["cutoff", "target"]), metrics.histogram(long, ["cutoff", "target"])


def evaluate_synthetic(scored: DataFrame, nodes: DataFrame) -> DataFrame:
    """target, roc, pr of generated nodes' four targets; missing scores and labels are -1 and false."""
    joined = nodes.join(scored, "node", "full_outer").fillna(-1, ["score"]).fillna(False, SYNTHETIC_TARGETS)
    stacked = F.explode(F.array(*(F.struct(F.lit(t).alias("target"), F.col(t).cast("int").alias("label")) for t in SYNTHETIC_TARGETS))).alias("t")
    return metrics.areas(joined.select("score", stacked).select("score", "t.*"), ["target"])


def supervised_table(
    v: DataFrame, e: DataFrame, found: DataFrame, rates: DataFrame, directed: bool = True, undirected_summaries: bool = True
) -> DataFrame:
    """node, the ten features and the rates of every labelled node; features of unscored nodes are -2."""
    links, way = (both_ways(e), False) if undirected_summaries else (e, directed)
    return labels.join_scores(
        rates, summarise_scores(v, links if way else links.where("src < dst"), score_source(found, "direct", directed), directed=way), "lookup"
    )


def supervised_grid(table: DataFrame, cells: list[tuple[float, str]], method: str = "tree", synthetic: bool = False) -> list[tuple]:
    """(cutoff, target, imbalance, roc, pr) of a tree or of boosting, all cells side by side; a cell that can't be fitted is NaN (0 for
    synthetic data)."""
    targets = sorted({t for _, t in cells})
    table = staged(table.select("node", *FEATURES, *targets), "supervised")
    missing = 0.0 if synthetic else float("nan")
    grid = tree_grid if method == "tree" else boosting_grid
    # A row a cell is collected.
    found = grid(table, FEATURES, labels.threshold_labels(table.select("node", *targets), sorted({c for c, _ in cells}), targets)).collect()
    at = {(r.cutoff, r.target): (r.imbalance, *(missing if x is None else x for x in (r.roc, r.pr))) for r in found}
    return [(c, t, *at.get((c, t), (None, missing, missing))) for c, t in cells]


def anomaly_scores(spark: SparkSession, path: str | None, v: DataFrame | None = None, e: DataFrame | None = None, seed: int = 1997) -> DataFrame:
    """node, the nine measures and anomaly_score; measures are read from path if it holds them, else computed."""
    rows = None
    if path and spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(
        spark._jvm.org.apache.hadoop.fs.Path(path)
    ):
        rows = tables.read_measures(spark, path, ["node", *MEASURES])
    if rows is None:
        rows = staged(measures(v, e, True, include_size=False), "measures")
    return IsolationForest(seed=seed).fit(rows).transform(rows)


def anomaly_areas(rates: DataFrame, scored: DataFrame, cutoffs: list[float] | None = None) -> DataFrame:
    """Areas of the negated anomaly score over nodes that have both."""
    return evaluate(rates, score_source(scored, "anomaly"), "inner", cutoffs)


def synthetic_benchmark(spark: SparkSession, grid: list[tuple] | None = None, directed: bool = True, seed: int = 1997) -> DataFrame:
    """dataset, target, roc, pr over generated datasets."""
    out = None
    for generator, n, m, p, patterns in parameter_grid() if grid is None else grid:
        nodes, edges = synthetic_network(spark, generator, n, m, p, patterns, seed=seed)
        v, e = nodes.select("node"), staged(edges.select(F.col("source").alias("src"), F.col("target").alias("dst")), "synthetic")
        v, e = reduce_by_community(v, e)
        found = score_source(staged(measures(v, e, directed), "measures"), "direct", directed)
        areas = evaluate_synthetic(found, nodes).withColumn("dataset", F.lit(dataset_name(generator, n, m, p, patterns)))
        out = areas if out is None else out.union(areas)
    return out.select("dataset", "target", "roc", "pr")
