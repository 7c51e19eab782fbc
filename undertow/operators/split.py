"""A deterministic stratified split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS, HIGH = 31, 19


def stratified_split(
    rows: DataFrame, label: str = "label", node: str = "node", test: float = 0.3, seed: int = 1997, key: Column | None = None
) -> DataFrame:
    """Rows with is_test: of each label, round(test * n) rows with the smallest keys (a hash of the node, below 2 ** 31).

    Keys are counted by their leading bits first; only the rows of the one range in which a label's count is reached are
    ranked, so no task holds a label.
    """
    key = F.pmod(F.xxhash64(F.col(node), F.lit(seed)), F.lit(1 << BITS)) if key is None else key
    keyed = rows.withColumn("key_", key.cast("long")).withColumn("range_", F.shiftright("key_", HIGH))
    before = F.sum("n_").over(Window.partitionBy(label).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1))
    counts = keyed.groupBy(label, "range_").agg(F.count("*").alias("n_"))
    counts = counts.withColumn("before_", F.coalesce(before, F.lit(0))).withColumn(
        "wanted_", F.round(F.sum("n_").over(Window.partitionBy(label)) * test).cast("long")
    )
    at = keyed.join(counts, [label, "range_"]).withColumn(
        "cut_", (F.col("before_") < F.col("wanted_")) & (F.col("before_") + F.col("n_") > F.col("wanted_"))
    )
    rank = F.row_number().over(Window.partitionBy(label, "range_").orderBy("key_", node))
    ranked = at.where("cut_").withColumn("is_test", rank <= F.col("wanted_") - F.col("before_"))
    plain = at.where("not cut_").withColumn("is_test", F.col("before_") + F.col("n_") <= F.col("wanted_"))
    return ranked.unionByName(plain).select(*rows.columns, "is_test")
