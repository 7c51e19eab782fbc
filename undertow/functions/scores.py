"""Smurfing scores from block densities, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocks that are full in a smurfing pattern seen from its source, and from its target.
FORWARD, BACKWARD = ("01", "12"), ("10", "21")
#: The order in which the other blocks are averaged, so that sums of doubles agree.
REST_FORWARD, REST_BACKWARD = ("10", "21", "00", "02", "11", "20", "22"), ("01", "12", "00", "20", "11", "02", "22")
BASIC, WEIGHTED = "basic", "weighted_average"


def _total(columns: list[Column]) -> Column:
    total = columns[0]
    for c in columns[1:]:
        total = total + c
    return total


def _mean(blocks: tuple[str, ...]) -> Column:
    return _total([F.col(f"measure_{b}") for b in blocks]) / len(blocks)


def _weighted(blocks: tuple[str, ...]) -> Column:
    size = _total([F.col(f"size_{b}") for b in blocks])
    return F.when(size > 0, _total([F.col(f"size_{b}") * F.col(f"measure_{b}") for b in blocks]) / size).otherwise(_mean(blocks))


def _checked(score_type: str) -> str:
    if score_type not in (BASIC, WEIGHTED):
        raise ValueError(f"unknown score type: {score_type}")
    return score_type


def forward_score(score_type: str = BASIC) -> Column:
    average = _mean if _checked(score_type) == BASIC else _weighted
    return average(FORWARD) - average(REST_FORWARD)


def transposed_score(score_type: str = BASIC) -> Column:
    average = _mean if _checked(score_type) == BASIC else _weighted
    return average(BACKWARD) - average(REST_BACKWARD)


def undirected_score(score_type: str = BASIC) -> Column:
    m1, m2, m3 = (F.col(f"measure_{k}") for k in (1, 2, 3))
    if _checked(score_type) == BASIC:
        return m2 - (m1 + m3) / 2
    z1, z2, z3 = (F.col(f"size_{k}") for k in (1, 2, 3))
    return F.when(z1 + z3 > 0, m2 - (z1 * m1 + z3 * m3) / (z1 + z3)).when(z2 > 0, m2).otherwise(F.lit(-1.0))


def scores_directed(measures: DataFrame, score_type: str = BASIC) -> DataFrame:
    """node, score (forward), score_transposed, score_max; consumers take score."""
    found = measures.select("node", forward_score(score_type).alias("score"), transposed_score(score_type).alias("score_transposed"))
    return found.withColumn("score_max", F.greatest("score", "score_transposed"))


def scores_undirected(measures: DataFrame, score_type: str = BASIC) -> DataFrame:
    return measures.select("node", undirected_score(score_type).alias("score"))


def scores(measures: DataFrame, directed: bool, score_type: str = BASIC) -> DataFrame:
    return scores_directed(measures, score_type) if directed else scores_undirected(measures, score_type)
