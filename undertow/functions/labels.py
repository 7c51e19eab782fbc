"""Transaction labels: money text, row identifiers, pattern flags, and rates per account."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertow.sources.tables import PATTERNS

NOT_CLASSIFIED = "Not Classified"
LAUNDERING = "Is Laundering"
TARGETS = [LAUNDERING, *PATTERNS, NOT_CLASSIFIED]
#: No score: of either side of an outer join, and of a lookup.
NO_MATCH, NO_SCORE = -1, -2


def money(text: Column) -> Column:
    """The text of an amount if two or more characters follow its first point, else the amount with two decimals."""
    decimals = F.try_element_at(F.split(text, r"\."), F.lit(2))
    return F.when(F.length(decimals) >= 2, text).otherwise(F.format_string("%.2f", text.try_cast("double")))


def identifier(*columns: str | Column) -> Column:
    """All columns as text, joined by commas; a null is the text nan."""
    return F.concat_ws(",", *(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("nan")) for c in columns))


def with_patterns(transactions: DataFrame, patterns: DataFrame, laundering: str = "is_laundering") -> DataFrame:
    """Transactions (with a column identifier) and their pattern flags; repeated identifiers fan out."""
    found = transactions.join(patterns, "identifier", "left").fillna(0, PATTERNS)
    any_pattern = sum((F.col(p) for p in PATTERNS[1:]), F.col(PATTERNS[0]))
    return found.withColumn(
        NOT_CLASSIFIED, F.when((F.col(laundering) == 1) & (any_pattern == 0), 1).otherwise(0)
    ).withColumn(LAUNDERING, F.col(laundering).cast("int"))


def account_rates(labelled: DataFrame, side: str = "combined", sender: str = "from_account", receiver: str = "to_account") -> DataFrame:
    """node and the mean of each flag over the transactions it sends, receives, or both (a self-transaction counts twice)."""
    ends = {"sender": [sender], "receiver": [receiver], "combined": [sender, receiver]}[side]
    rows = labelled.select(F.explode(F.array(*ends)).alias("node"), *TARGETS)
    return rows.groupBy("node").agg(*(F.avg(t).alias(t) for t in TARGETS))


def join_scores(labels: DataFrame, scores: DataFrame, how: str = "outer") -> DataFrame:
    """Labels and scores by node. outer keeps both sides and fills with -1; lookup keeps the labels and gives -2 where there is
    no score; inner keeps what has both."""
    if how == "outer":
        return labels.join(scores, "node", "full_outer").fillna(NO_MATCH)
    if how == "lookup":
        return labels.join(scores, "node", "left").fillna(NO_SCORE, [c for c in scores.columns if c != "node"])
    if how == "inner":
        return labels.join(scores, "node")
    raise ValueError(f"unknown join: {how}")


def labels_of(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """Each score's label; a node without a label is an error."""
    found = scores.join(labels.withColumn("known_", F.lit(1)), "node", "left")
    lost = F.raise_error(F.concat(F.lit("no label for node "), F.col("node").cast("string"))).cast("int")
    return found.withColumn("known_", F.when(F.col("known_").isNull(), lost).otherwise(F.col("known_"))).where("known_ = 1").drop("known_")


def threshold_labels(rates: DataFrame, cutoffs: list[float], targets: list[str] | None = None) -> DataFrame:
    """node, cutoff, target, label for every cut-off and target in one pass: label is rate > cutoff."""
    wanted = targets or TARGETS
    stacked = F.explode(F.array(*(F.struct(F.lit(t).alias("target"), F.col(f"`{t}`").cast("double").alias("rate")) for t in wanted))).alias("t")
    others = [c for c in rates.columns if c not in wanted]
    return rates.select(*others, stacked).select(*others, "t.*", F.explode(F.array(*map(F.lit, cutoffs))).alias("cutoff")).select(
        *others, "cutoff", "target", (F.col("rate") > F.col("cutoff")).cast("int").alias("label")
    )


def rounded_once(x: Column) -> Column:
    """A double rounded to one decimal by its exact binary value, as Python rounds: 0.35 lies under its half and gives 0.3, 0.25 is
    a tie and goes to the even digit."""
    # Twenty times x is s + rest without any error: both products are exact, and rest is what their sum leaves out. From 2 ** 49 on
    # doubles are eighths, each its own nearest to one decimal.
    a, b = x * 16, x * 4
    s = a + b
    other = s - a
    rest = (a - (s - other)) + (b - other)
    half = F.floor(s / 2).cast("double")
    tenths = F.when((half * 2 == s) & (rest < 0), half - 1).otherwise(half)
    over = (s - tenths * 2 - 1) + rest
    up = (over > 0) | ((over == 0) & (tenths % 2 != 0))
    return F.when(F.abs(x) < F.lit(2.0**49), (tenths + F.when(up, 1.0).otherwise(0.0)) / 10).otherwise(x)


def rates_by_bin(scored: DataFrame, score: str = "score") -> DataFrame:
    """bin (the score rounded to one decimal) and the mean of each flag, in bin order, without unscored rows."""
    return scored.where(F.col(score) != NO_SCORE).groupBy(rounded_once(F.col(score)).alias("bin")).agg(*(F.avg(t).alias(t) for t in TARGETS)).orderBy("bin")


def account_banks(transactions: DataFrame) -> DataFrame:
    """Distinct account and bank of either side."""
    ends = F.array(
        F.struct(F.col("from_account").alias("account"), F.col("from_bank").alias("bank")),
        F.struct(F.col("to_account").alias("account"), F.col("to_bank").alias("bank")),
    )
    return transactions.select(F.explode(ends).alias("e")).select("e.*").distinct()


def outlier_label(prediction: Column) -> Column:
    """1 for an outlier (-1), 0 for an inlier (1)."""
    return ((1 - prediction) / 2).cast("int")


def node_kind() -> Column:
    """The first of separate, new_mules, existing_mules that holds, else regular."""
    return F.when(F.col("separate"), "separate").when(F.col("new_mules"), "new_mules").when(
        F.col("existing_mules"), "existing_mules"
    ).otherwise("regular")


def dataset_parts(name: Column) -> dict[str, Column]:
    """The parameters in a generated dataset's name."""
    parts = F.split(name, "_")
    at = lambda i: F.try_element_at(parts, F.lit(i))
    return {
        "generator": at(2),
        "n_nodes": at(3).try_cast("int"),
        "m_edges": at(4).try_cast("int"),
        "p_edges": at(5).try_cast("double"),
        "n_patterns": at(6).try_cast("int"),
    }


def dataset_kind(name: str) -> str:
    """generated or transactions, by the name's prefix."""
    return "generated" if name.startswith("synthetic") else "transactions"


def labelled_count(nodes: DataFrame, flag: str = "laundering") -> DataFrame:
    """One row: how many nodes there are, and how many carry the flag."""
    return nodes.agg(F.count("*").alias("nodes"), F.count_if(F.coalesce(F.col(flag).cast("boolean"), F.lit(False))).alias("labelled"))
