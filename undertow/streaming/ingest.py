"""Incremental ingest: a stream of transactions keeps the edge table and the scores of touched communities up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from undertow.functions.scores import scores_directed
from undertow.operators.blocks import measures_directed
from undertow.sources.stage import staged


#: Folders that the edges are dealt to by community, so that a batch reads those of the communities that it touches.
FOLDERS = 256


def new_edges(transactions: DataFrame, watermark: str | None = None, time: str = "ts") -> DataFrame:
    """The edges of a stream. With a watermark, repeats are left out for that long; without, they stay, and no state grows:
    each batch's edges are made distinct, and so are those that are read."""
    pairs = transactions.select(
        F.col("from_account").alias("src"), F.col("to_account").alias("dst"), *([time] if watermark else [])
    ).where("src <> dst")
    return pairs.withWatermark(time, watermark).dropDuplicatesWithinWatermark(["src", "dst"]) if watermark else pairs


def placed(nodes: DataFrame, communities: DataFrame) -> DataFrame:
    """node and place, the name of its community; a node without one is a community of its own."""
    named = communities.select("node", F.concat(F.lit("c"), F.col("community").cast("string")).alias("place"))
    return nodes.join(named, "node", "left").select("node", F.coalesce("place", F.concat(F.lit("n"), F.col("node").cast("string"))).alias("place"))


def _folder():
    return F.pmod(F.xxhash64("place"), F.lit(FOLDERS)).cast("int")


def rescore(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Scores of the members (node, place) from their communities' edges (src, dst, place); an ego never leaves its community."""
    return scores_directed(measures_directed(members.select("node"), edges.select("src", "dst").distinct()))


def run(transactions: DataFrame, communities: DataFrame, edge_path: str, score_path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append each batch's new edges to edge_path (by batch, so that a repeated batch replaces itself) and write the scores of
    touched communities to score_path. Only the touched communities' folders of edges are read."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        pairs = staged(batch.select("src", "dst").distinct(), "batch")
        ends = placed(pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), communities)
        of = lambda end: ends.select(F.col("node").alias(end), F.col("place").alias(f"{end}_place"))
        inside = pairs.join(of("src"), "src").join(of("dst"), "dst").where("src_place = dst_place")
        inside.select(
            "src", "dst", F.col("src_place").alias("place")
        ).withColumn("folder", _folder()).write.mode("overwrite").partitionBy("folder").parquet(f"{edge_path}/batch={number}")
        touched = staged(ends.select("place").distinct(), "touched")
        folders = [r.folder for r in touched.select(_folder().alias("folder")).distinct().collect()]  # at most FOLDERS
        # The schema is given, since a batch may hold no edge within a community.
        kinds = f"src {dict(pairs.dtypes)['src']}, dst {dict(pairs.dtypes)['dst']}, place string, batch int, folder int"
        edges = spark.read.schema(kinds).option("basePath", edge_path).parquet(edge_path).where(F.col("folder").isin(folders)).join(touched, "place", "left_semi")
        everyone = communities.select("node").union(ends.select("node")).distinct()
        members = placed(everyone, communities).join(touched, "place", "left_semi")
        rescore(edges, members).write.mode("overwrite").parquet(f"{score_path}/batch={number}")

    return new_edges(transactions).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})
    ).start()


def latest_scores(spark, score_path: str) -> DataFrame:
    """Each node's scores from the last batch that touched it."""
    rows = spark.read.parquet(score_path)
    names = [c for c in rows.columns if c not in ("node", "batch")]
    return rows.groupBy("node").agg(F.max_by(F.struct(*names), "batch").alias("s")).select("node", "s.*")
