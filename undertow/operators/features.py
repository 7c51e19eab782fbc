"""Neighbourhood summaries and the feature table of scored nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.functions.scores import BASIC, scores
from undertow.operators.blocks import measures
from undertow.operators.graph import both_ways, degree
from undertow.sources.stage import staged

STATISTICS = ("min", "mean", "max", "std")
FEATURES = ["score", *(f"score_{s}" for s in STATISTICS), "degree", *(f"degree_{s}" for s in STATISTICS)]


def neighbour_summary(v: DataFrame, e: DataFrame, values: DataFrame, value: str, directed: bool = True, strict: bool = True) -> DataFrame:
    """node, and min, mean, max and population deviation of the neighbours' values (node, value); zeros for none.

    Neighbours of a directed graph are successors. With strict, a neighbour without a value is an error.
    """
    links = e if directed else both_ways(e)
    own = F.col("value")
    if strict:
        own = F.when(
            F.col("found").isNull(), F.raise_error(F.concat(F.lit("no value for neighbour "), F.col("dst").cast("string")))
        ).otherwise(own).cast("double")
    found = links.join(
        values.select(F.col("node").alias("dst"), F.col(value).cast("double").alias("value"), F.lit(1).alias("found")), "dst", "left"
    ).select("src", own.alias("value"))
    stats = found.groupBy(F.col("src").alias("node")).agg(
        F.min("value").alias(f"{value}_min"),
        F.avg("value").alias(f"{value}_mean"),
        F.max("value").alias(f"{value}_max"),
        F.stddev_pop("value").alias(f"{value}_std"),
    )
    return v.join(stats, "node", "left").fillna(0.0, [f"{value}_{s}" for s in STATISTICS])


def summarise_scores(v: DataFrame, e: DataFrame, scored: DataFrame, columns: list[str] | None = None, directed: bool = True) -> DataFrame:
    """node and the feature columns of scored nodes: score, degree, and their summaries over neighbours."""
    d = degree(v, e)
    known = scored.select("node")
    table = scored.select("node", "score").join(
        neighbour_summary(known, e, scored, "score", directed), "node"
    ).join(d, "node").join(neighbour_summary(known, e, d, "degree", directed), "node")
    return table.select("node", *(columns or FEATURES))


def score_graph(v: DataFrame, e: DataFrame, directed: bool = True) -> DataFrame:
    """The whole-graph entry: measures, basic score (the larger of both directions if directed), and all features."""
    found = scores(measures(v, e, directed), directed, BASIC)
    if directed:
        found = found.select("node", F.col("score_max").alias("score"))
    found = staged(found, "scores")
    return summarise_scores(v, e, found, directed=directed)


def extremes(scored: DataFrame, score: str = "score") -> DataFrame:
    """Two rows (which, node, score): the highest and the lowest score, ties to the smaller node."""
    top = scored.orderBy(F.desc(score), "node").limit(1).select(F.lit("highest").alias("which"), "node", F.col(score).alias("score"))
    return top.union(scored.orderBy(F.asc(score), "node").limit(1).select(F.lit("lowest"), "node", F.col(score)))
