"""Models over block densities and features: trees, boosting, isolation forest, and the evaluation grid."""

from __future__ import annotations

import warnings
import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undertow.functions.metrics import areas, quantiles
from undertow.operators.blocks import PAIRS
from undertow.operators.split import stratified_split
from undertow.sources.stage import staged

SEED, LEAF = 1997, 10
MEASURES = [f"measure_{p}" for p in PAIRS]
TREES, SAMPLE = 100, 256


def tree(seed: int = SEED) -> DecisionTreeClassifier:
    return DecisionTreeClassifier(minInstancesPerNode=LEAF, maxDepth=30, seed=seed, labelCol="label", featuresCol="features")


def boosting(seed: int = SEED) -> GBTClassifier:
    return GBTClassifier(minInstancesPerNode=LEAF, maxIter=100, maxDepth=3, stepSize=0.1, seed=seed, labelCol="label", featuresCol="features")


def assembled(rows: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features").transform(rows.withColumn("label", F.col("label").cast("double")))


def fit_evaluate(
    rows: DataFrame, columns: list[str], model, path: str | None = None, probabilities: bool = False, test: float = 0.3, seed: int = SEED
):
    """The fitted model, and one row (roc, pr) on the held-out rows of a stratified split: of hard predictions, or of
    probabilities. path: where the model is saved."""
    split = stratified_split(rows, test=test, seed=seed)
    table = assembled(split, columns).persist()
    try:
        fitted = model.fit(table.where("not is_test"))
        if path:
            fitted.write().overwrite().save(path)
        scored = fitted.transform(table.where("is_test"))
        if probabilities:
            from pyspark.ml.functions import vector_to_array

            scored = scored.withColumn("prediction", vector_to_array("probability")[1])
        result = areas(scored.select("label", F.col("prediction").alias("score"))).collect()[0]
    finally:
        table.unpersist()
    return fitted, (result.roc, result.pr)


def model_grid(
    labels: DataFrame,
    columns: list[str],
    cells: list[tuple[float, str]],
    model,
    on_failure: float | None = float("nan"),
    by: tuple[str, str] = ("cutoff", "target"),
) -> list[tuple]:
    """(cutoff, target, imbalance, roc, pr) per cell. labels: the features beside cutoff, target and label. A cell that can't be
    fitted, because it has one class or since fitting raises an error, gets on_failure; the error is told in a warning."""
    found = []
    for cutoff, target in cells:
        rows = labels.where((F.col(by[0]) == cutoff) & (F.col(by[1]) == target))
        share = rows.agg(F.avg("label")).first()[0]
        if not share or share == 1:
            found.append((cutoff, target, share, on_failure, on_failure))
            continue
        try:
            roc, pr = fit_evaluate(rows, columns, model)[1]
        except (PySparkException, Py4JJavaError) as error:
            warnings.warn(f"cell {cutoff}, {target} can't be fitted: {str(error)[:200]}", stacklevel=2)
            roc = pr = None
        found.append((cutoff, target, share, on_failure if roc is None else roc, on_failure if pr is None else pr))
    return found


def average_path(n: float) -> float:
    """The mean depth of an unsuccessful search in a binary tree of n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


#: Fixed values of the multiplicative hash: its factor, the step between trees, and its range.
FACTOR, STEP, HASHES = 2654435761, 1000003, 1 << 31


def drawn(tree: int, code: int) -> int:
    """The pseudo-random number of a tree's node, below HASHES."""
    return (tree * STEP + code) * FACTOR % HASHES


def grow_isolation_tree(x: np.ndarray, tree: int, limit: int) -> list[tuple[int, int, float, float]]:
    """Nodes (code, column, cut, path): the root is 1, and the nodes under i are 2 * i, up to the cut, and 2 * i + 1. Column -1 marks
    a leaf, whose path is its depth with the rest of the path of its rows.

    The column is one of those that differ, by the drawn number's rest, and the cut divides its range by the number's share.
    """
    nodes: list[tuple[int, int, float, float]] = []

    def grow(rows: np.ndarray, code: int, depth: int) -> None:
        low, high = rows.min(0), rows.max(0)
        some = np.flatnonzero(high > low)
        if depth >= limit or not len(some):
            nodes.append((code, -1, 0.0, depth + average_path(len(rows))))
            return
        number = drawn(tree, code)
        column = int(some[number % len(some)])
        cut = float(low[column] + number / HASHES * (high[column] - low[column]))
        under = rows[:, column] <= cut
        nodes.append((code, column, cut, 0.0))
        grow(rows[under], 2 * code, depth + 1)
        # A cut may round to the upper end.
        if not under.all():
            grow(rows[~under], 2 * code + 1, depth + 1)
        else:
            nodes.append((2 * code + 1, -1, 0.0, float(depth + 1)))

    grow(x, 1, 0)
    return nodes


class IsolationForest:
    """An isolation forest as a table of nodes: tree, code, column, cut, path.

    Each tree is grown from a bounded sample, the trees side by side; rows go down all trees by joins with the table, which is of
    fixed size and sent to all tasks. Everything that is drawn comes from a multiplicative hash, so SQL can follow.
    """

    def __init__(self, columns: list[str] | None = None, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> None:
        self.columns, self.trees, self.sample, self.seed = columns or MEASURES, trees, sample, seed
        self.limit = int(np.ceil(np.log2(max(2, sample))))
        self.forest: DataFrame | None = None
        self.size = 0

    def fit(self, rows: DataFrame, node: str = "node", key: Column | None = None) -> IsolationForest:
        """Grow from at most trees * sample rows, those with the least hashes of key (a whole number that tells nodes apart; by
        default a hash of the node). Each tree takes the sample rows whose hashes follow its own start."""
        key = F.xxhash64(node) if key is None else key
        place = lambda tree: F.pmod(F.pmod("key_", F.lit(HASHES)) * FACTOR + tree.cast("long") * (STEP * FACTOR % HASHES), F.lit(HASHES))
        own = rows.select(key.cast("long").alias("key_"), F.array(*(F.col(c).cast("double") for c in self.columns)).alias("x"))
        chosen = staged(own.orderBy(place(F.lit(self.seed)), "key_").limit(self.trees * self.sample), "sample")
        self.size = min(self.sample, chosen.count())
        each = chosen.select("*", F.explode(F.sequence(F.lit(0), F.lit(self.trees - 1))).alias("tree"))
        rank = F.row_number().over(Window.partitionBy("tree").orderBy(place(F.col("tree") + self.seed), "key_"))
        limit = int(np.ceil(np.log2(max(2, self.size))))

        def grow(frame: pd.DataFrame) -> pd.DataFrame:
            tree = int(frame["tree"].iloc[0])
            nodes = grow_isolation_tree(np.stack(frame["x"].to_numpy()), tree, limit)
            return pd.DataFrame([(tree, *n) for n in nodes], columns=["tree", "code", "column", "cut", "path"])

        picked = each.withColumn("rank", rank).where(F.col("rank") <= self.sample).select("tree", "x")
        schema = "tree int, code int, column int, cut double, path double"
        self.forest = staged(picked.groupBy("tree").applyInPandas(lambda f: grow(f), schema), "forest")
        return self

    def transform(self, rows: DataFrame, node: str = "node") -> DataFrame:
        """node and the columns, with anomaly_score between -1 (most anomalous) and 0."""
        own = rows.select(node, *self.columns)
        down = own.select("*", F.array(*(F.col(c).cast("double") for c in self.columns)).alias("x_"), F.explode(F.sequence(F.lit(0), F.lit(self.trees - 1))).alias("tree"))
        down = down.withColumn("code", F.lit(1))
        inner = F.broadcast(self.forest.where("column >= 0").select("tree", "code", "column", "cut"))
        for _ in range(self.limit):
            over = (F.get("x_", F.col("column")) > F.col("cut")).cast("int")
            down = down.join(inner, ["tree", "code"], "left").withColumn("code", F.when(F.col("column").isNull(), F.col("code")).otherwise(F.col("code") * 2 + over))
            down = down.drop("column", "cut")
        leaves = F.broadcast(self.forest.where("column < 0").select("tree", "code", "path"))
        scale = max(average_path(self.size), 1e-12) * max(1, self.trees)
        # A row's trees follow each other in its task, so they are added up before anything is sent.
        depth = down.join(leaves, ["tree", "code"]).groupBy(node, *self.columns).agg(F.sum("path").alias("depth_"))
        return depth.select(node, *self.columns, (-F.pow(F.lit(2.0), -F.col("depth_") / scale)).alias("anomaly_score"))

    def predict(self, scored: DataFrame, contamination: float | None = None) -> DataFrame:
        """scored with prediction: -1 below the threshold, else 1. The threshold is -0.5, or the exact quantile."""
        if contamination is None:
            return scored.withColumn("prediction", F.when(F.col("anomaly_score") < -0.5, -1).otherwise(1))
        limit = quantiles(scored, "anomaly_score", [contamination]).select(F.col("q")[0].alias("limit_"))
        return scored.join(F.broadcast(limit)).withColumn(
            "prediction", F.when(F.col("anomaly_score") < F.col("limit_"), -1).otherwise(1)
        ).drop("limit_")
