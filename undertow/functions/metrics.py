"""Evaluation: tie-aware areas, lift, divergence, histograms, ranks and tests. ``by`` columns keep cells apart in one job.

Curves first add up each distinct score (with map-side combine), so that windows run over distinct scores only.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undertow.sources.stage import staged


def _score_counts(rows: DataFrame, by: list[str], label: str, score: str) -> DataFrame:
    return rows.groupBy(*by, F.col(score).alias("score")).agg(
        F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("n")
    )


def in_ranges(rows: DataFrame, *order: str | Column) -> DataFrame:
    """rows, written, with range_: runs of about as many rows each in the given order, from sampled bounds. Equal keys share a
    range. What follows adds up exact counts of the ranges, so the sample tells only how rows are dealt."""
    return staged(rows.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()), "ranges")


def curves(rows: DataFrame, by: list[str] | None = None, label: str = "label", score: str = "score") -> DataFrame:
    """Per distinct score, from the highest: true and false positives so far, and both curves' coordinates.

    Running totals are taken within ranges of about as many distinct scores, on top of the totals of the ranges above, so that no
    task holds a cell.
    """
    by = by or []
    cell = [*by, "cell_"]
    counts = in_ranges(_score_counts(rows.withColumn("cell_", F.lit(0)), cell, label, score), *cell, "score")
    above = Window.partitionBy(*cell).orderBy(F.desc("range_")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*cell)
    totals = counts.groupBy(*cell, "range_").agg(F.sum("p").alias("p_"), F.sum("n").alias("n_"))
    totals = totals.select(
        *cell,
        "range_",
        F.coalesce(F.sum("p_").over(above), F.lit(0)).alias("tp_"),
        F.coalesce(F.sum("n_").over(above), F.lit(0)).alias("fp_"),
        F.sum("p_").over(whole).alias("pos"),
        F.sum("n_").over(whole).alias("neg"),
    )
    down = Window.partitionBy(*cell, "range_").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = counts.join(totals, [*cell, "range_"]).withColumn(
        "tp", F.col("tp_") + F.sum("p").over(down)
    ).withColumn("fp", F.col("fp_") + F.sum("n").over(down))
    ratio = lambda a, b: F.when(b > 0, a / b)
    return c.select(
        *by,
        "score",
        "p",
        "n",
        "tp",
        "fp",
        "pos",
        "neg",
        ratio(F.col("tp"), F.col("pos")).alias("tpr"),
        ratio(F.col("fp"), F.col("neg")).alias("fpr"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
    )


def areas(rows: DataFrame, by: list[str] | None = None, label: str = "label", score: str = "score") -> DataFrame:
    """roc (ties count half) and pr (average precision) per cell; null where a class is missing."""
    by = by or []
    c = curves(rows, by, label, score)
    below = F.col("neg") - F.col("fp") + F.col("n") / 2
    two = (F.max("pos") > 0) & (F.max("neg") > 0)
    roc = F.when(two, F.sum(F.col("p") * below) / F.when(two, F.max("pos") * F.max("neg")))
    pr = F.when(two, F.sum(F.col("p") * F.col("precision")) / F.when(two, F.max("pos")))
    return c.groupBy(*by).agg(roc.alias("roc"), pr.alias("pr")) if by else c.agg(roc.alias("roc"), pr.alias("pr"))


def lift(rows: DataFrame, by: list[str] | None = None, label: str = "label", score: str = "score", steps: int = 100) -> DataFrame:
    """step and lift: the share of positives among all rows that score at least as high as the row at ceil(step * n), over the
    overall share. Ties are all in."""
    by = by or []
    c = curves(rows, by, label, score).withColumn("seen", F.col("tp") + F.col("fp")).withColumn("from", F.col("seen") - F.col("p") - F.col("n"))
    k = F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("k")
    at = _at(F.col("k"), F.col("pos") + F.col("neg"), steps)
    found = c.select("*", k).where((at > F.col("from")) & (at <= F.col("seen")))
    return found.select(*by, (F.col("k") / steps).alias("step"), _lift(F.col("tp"), F.col("seen")).alias("lift"))


def _at(k: Column, n: Column, steps: int) -> Column:
    """ceil(k * n / steps), in whole numbers."""
    return F.floor((k.cast("long") * n + (steps - 1)) / steps).cast("long")


def _lift(positives: Column, seen: Column) -> Column:
    return F.when(F.col("pos") > 0, positives / seen / (F.col("pos") / (F.col("pos") + F.col("neg"))))


def lift_top(rows: DataFrame, tie: str, by: list[str] | None = None, label: str = "label", score: str = "score", steps: int = 100) -> DataFrame:
    """The same over exactly the first ceil(step * n) rows; equal scores go by the tie column."""
    cell = [*(by or []), "cell_"]
    down = (F.desc("score_"), F.asc("tie_"))
    rows = rows.select(*(by or []), F.lit(0).alias("cell_"), F.col(label).cast("long").alias("y"), F.col(score).alias("score_"), F.col(tie).alias("tie_"))
    rows = in_ranges(rows, *cell, *down)
    above = Window.partitionBy(*cell).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*cell)
    totals = rows.groupBy(*cell, "range_").agg(F.count("*").alias("n_"), F.sum("y").alias("p_"))
    totals = totals.select(
        *cell,
        "range_",
        F.coalesce(F.sum("n_").over(above), F.lit(0)).alias("seen_"),
        F.coalesce(F.sum("p_").over(above), F.lit(0)).alias("tp_"),
        F.sum("p_").over(whole).alias("pos"),
        F.sum(F.col("n_") - F.col("p_")).over(whole).alias("neg"),
    )
    order = Window.partitionBy(*cell, "range_").orderBy(*down)
    c = rows.join(totals, [*cell, "range_"]).withColumn("seen", F.col("seen_") + F.row_number().over(order)).withColumn(
        "tp", F.col("tp_") + F.sum("y").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    by = by or []
    n = F.col("pos") + F.col("neg")
    # The steps that end at this row; usually none, and their number is bounded by steps.
    first, last = F.floor((F.col("seen") - 1) * steps / n).cast("int") + 1, F.floor(F.col("seen") * steps / n).cast("int")
    found = c.withColumn(
        "k", F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>")))
    ).where((F.col("k") >= 1) & (F.col("k") <= steps) & (_at(F.col("k"), n, steps) == F.col("seen")))
    return found.select(*by, (F.col("k") / steps).alias("step"), _lift(F.col("tp"), F.col("seen")).alias("lift"))


def divergence(rows: DataFrame, by: list[str] | None = None, label: str = "label", score: str = "score") -> DataFrame:
    """(mean0 - mean1) ** 2 + (var0 + var1) / 2 with population variances; null where a class is missing."""
    by = by or []
    of = lambda k: F.when(F.col(label) == k, F.col(score).cast("double"))
    gap = F.avg(of(0)) - F.avg(of(1))
    return rows.groupBy(*by).agg((gap * gap + (F.var_pop(of(0)) + F.var_pop(of(1))) / 2).alias("divergence"))


def histogram(rows: DataFrame, by: list[str] | None = None, label: str = "label", score: str = "score", bins: int = 20) -> DataFrame:
    """bin (1 to bins), label, n, density: equal bins over the pooled range, the highest score in the last bin."""
    by = by or []
    ends = rows.groupBy(*by).agg(F.min(score).cast("double").alias("low"), F.max(score).cast("double").alias("high"))
    # A range of one value is widened by half on both sides.
    ends = ends.select(
        *by,
        F.when(F.col("low") == F.col("high"), F.col("low") - 0.5).otherwise(F.col("low")).alias("low"),
        F.when(F.col("low") == F.col("high"), F.col("high") + 0.5).otherwise(F.col("high")).alias("high"),
    )
    spread = rows.join(ends, by) if by else rows.join(F.broadcast(ends))
    bin_ = F.least(F.floor((F.col(score) - F.col("low")) * bins / (F.col("high") - F.col("low"))) + 1, F.lit(bins)).cast("int")
    counts = spread.groupBy(*by, F.col(label).alias("label"), bin_.alias("bin"), "low", "high").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by, "label"))
    return counts.select(*by, "label", "bin", "n", (F.col("n") / (total * (F.col("high") - F.col("low")) / bins)).alias("density"))


def imbalance(rows: DataFrame, by: list[str] | None = None, label: str = "label") -> DataFrame:
    return rows.groupBy(*(by or [])).agg(F.avg(label).alias("imbalance"))


def average_ranks(rows: DataFrame, dataset: str = "dataset", score: str = "score") -> DataFrame:
    """Rows with rank: descending within a dataset, ties share their average rank."""
    ties = F.count("*").over(Window.partitionBy(dataset, score))
    return rows.withColumn("rank", F.rank().over(Window.partitionBy(dataset).orderBy(F.desc(score))) + (ties - 1) / 2)


def ordinal_ranks(rows: DataFrame, tie: str, dataset: str = "dataset", score: str = "score") -> DataFrame:
    """Rows with rank 1, 2, ... descending within a dataset, ties in the order of the tie column."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(dataset).orderBy(F.desc(score), F.col(tie))))


def model_order(rows: DataFrame, models: list[str], dataset: str = "dataset", method: str = "method", score: str = "score") -> DataFrame:
    """Rows of the models with rank 1, 2, ... descending within a dataset; ties stand in the order of the list."""
    place = F.array_position(F.array(*map(F.lit, models)), F.col(method))
    listed = rows.where(F.col(method).isin(models))
    return listed.withColumn("rank", F.row_number().over(Window.partitionBy(dataset).orderBy(F.desc(score), place)))


def mean_ranks(ranked: DataFrame, method: str = "method") -> DataFrame:
    return ranked.groupBy(method).agg(F.avg("rank").alias("mean_rank"))


def friedman(rows: DataFrame, dataset: str = "dataset", method: str = "method", score: str = "score") -> DataFrame:
    """One row: datasets, methods, statistic (with tie correction)."""
    ranked = average_ranks(rows, dataset, score)
    ties = ranked.groupBy(dataset, score).agg(F.count("*").alias("t")).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    sums = ranked.groupBy(method).agg(F.sum("rank").alias("r"), F.count("*").alias("b")).agg(
        F.sum(F.col("r") * F.col("r")).alias("squares"), F.count("*").alias("k"), F.max("b").alias("b")
    )
    b, k = F.col("b").cast("double"), F.col("k").cast("double")
    plain = F.col("squares") * 12 / (b * k * (k + 1)) - 3 * b * (k + 1)
    return sums.join(ties).select(
        F.col("b").cast("long").alias("datasets"),
        F.col("k").cast("long").alias("methods"),
        (plain / (1 - F.col("ties") / (b * (k * k * k - k)))).alias("statistic"),
    )


def chi_square_tail(x: float, degrees: int) -> float:
    """The chance of a chi-square value above x: the regularised upper incomplete gamma function."""
    a, x = degrees / 2, x / 2
    if x <= 0:
        return 1.0
    lead = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-15:
            n += 1
            term *= x / n
            total += term
        return 1 - total * lead
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        factor = -i * (i - a)
        b += 2
        d = 1 / ((factor * d + b) or tiny)
        c = (b + factor / c) or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * lead


#: Quantiles at 0.05 of the studentised range over the root of two, for 2 to 10 methods.
NEMENYI_05 = [1.960, 2.343, 2.569, 2.728, 2.850, 2.949, 3.031, 3.102, 3.164]


def critical_difference(methods: int, datasets: int) -> float:
    """The least difference of mean ranks that is significant at 0.05."""
    if not 2 <= methods <= 10:
        raise ValueError("quantiles are known for 2 to 10 methods")
    return NEMENYI_05[methods - 2] * math.sqrt(methods * (methods + 1) / (6 * datasets))


def range_tail(q: float, k: int) -> float:
    """The chance that the range of k standard normal values exceeds q, by Simpson's rule over the least value."""
    if q <= 0:
        return 1.0
    below = lambda x: 0.5 * math.erfc(-x / math.sqrt(2))
    n, low, high = 4000, -9.0, 9.0
    h = (high - low) / n
    total = 0.0
    for i in range(n + 1):
        z = low + i * h
        total += (1 if i in (0, n) else 4 if i % 2 else 2) * math.exp(-z * z / 2) * (below(z + q) - below(z)) ** (k - 1)
    return min(1.0, max(0.0, 1 - k * total * h / 3 / math.sqrt(2 * math.pi)))


def nemenyi(mean_rank: DataFrame, methods: int, datasets: int, method: str = "method") -> DataFrame:
    """Pairs of methods, their difference of mean ranks, whether it is significant at 0.05, and its p-value from the
    studentised range with infinite degrees of freedom. The pairs are of methods, a handful."""
    a, b = (mean_rank.select(F.col(method).alias(f"method_{x}"), F.col("mean_rank").alias(f"rank_{x}")) for x in "ab")
    gap = F.abs(F.col("rank_a") - F.col("rank_b"))
    step = math.sqrt(methods * (methods + 1) / (12 * datasets))

    @F.pandas_udf("double")
    def tail(gaps: pd.Series) -> pd.Series:
        return gaps.map(lambda g: range_tail(g / step, methods))

    pairs = a.join(b, F.col("method_a") < F.col("method_b"))
    return pairs.select(
        "method_a", "method_b", gap.alias("difference"), (gap >= critical_difference(methods, datasets)).alias("significant"), tail(gap).alias("p")
    )


def correlation_test(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, r and its t statistic."""
    stats = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.count("*").alias("n"), F.corr(x, y).alias("r"))
    return stats.withColumn("t", F.when(F.abs("r") < 1, F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r")))))


def t_tail(t: float, degrees: int) -> float:
    """The two-sided p-value of a t statistic, by Simpson's rule on the density over the angle."""
    if t != t or math.isinf(t):
        return 0.0 if math.isinf(t) else math.nan
    top = math.atan(abs(t) / math.sqrt(degrees))
    n = 20_000
    h = top / n
    area = sum((1 if i in (0, n) else 4 if i % 2 else 2) * math.cos(i * h) ** (degrees - 1) for i in range(n + 1)) * h / 3
    scale = math.exp(math.lgamma((degrees + 1) / 2) - math.lgamma(degrees / 2)) / math.sqrt(math.pi)
    return max(0.0, 1 - 2 * scale * area)


def quantiles(rows: DataFrame, value: str, fractions: list[float], by: list[str] | None = None) -> DataFrame:
    """The by columns and q, an array: exact quantiles of each cell, linearly between the two values next to rank (n - 1) * fraction.
    Nulls are left out.

    Distinct values are counted first and dealt by ranges; from the ranges' counts follows which values stand at the ranks, so no
    task holds a column, whatever its distribution.
    """
    cell = [*(by or []), "cell_"]
    plain = rows.where(F.col(value).isNotNull()).select(*(by or []), F.lit(0).alias("cell_"), F.col(value).cast("double").alias("v_"))
    counts = in_ranges(plain.groupBy(*cell, "v_").agg(F.count("*").alias("c_")), *cell, "v_")
    before = lambda w: F.coalesce(F.sum("c_").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = counts.groupBy(*cell, "range_").agg(F.sum("c_").alias("c_")).select(
        *cell, "range_", before(Window.partitionBy(*cell).orderBy("range_")).alias("start_"), F.sum("c_").over(Window.partitionBy(*cell)).alias("n_")
    )
    placed = counts.join(totals, [*cell, "range_"]).withColumn(
        "from_", F.col("start_") + before(Window.partitionBy(*cell, "range_").orderBy("v_"))
    )
    ranks = [(F.col("n_") - 1) * F.lit(float(f)) for f in fractions]
    at = lambda rank: F.max(F.when((F.col("from_") <= rank) & (rank < F.col("from_") + F.col("c_")), F.col("v_")))
    found = placed.groupBy(*cell).agg(
        F.max("n_").alias("n_"), *(x for i, r in enumerate(ranks) for x in (at(F.floor(r)).alias(f"low_{i}"), at(F.ceil(r)).alias(f"high_{i}")))
    )
    between = lambda i, r: F.col(f"low_{i}") + (F.col(f"high_{i}") - F.col(f"low_{i}")) * (r - F.floor(r))
    return found.select(*(by or []), F.array(*(between(i, r) for i, r in enumerate(ranks))).alias("q"))


def box_statistics(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Quartiles, mean and range per cell."""
    ends = rows.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"))
    return ends.join(quantiles(rows, value, [0.25, 0.5, 0.75], by), by).select(
        *by, "low", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "high", "mean"
    )
