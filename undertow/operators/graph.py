"""Simple graphs as edge tables: edges(src, dst) distinct and without loops, nodes(node) with every endpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.functions.metrics import quantiles
from undertow.sources.stage import staged


def edges(pairs: DataFrame, src: str = "src", dst: str = "dst", directed: bool = True) -> DataFrame:
    """The simple graph of raw pairs: loops go, parallel pairs collapse; undirected edges have src < dst."""
    found = pairs.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src <> dst")
    if not directed:
        found = found.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return found.distinct()


def nodes(pairs: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Every endpoint of the raw pairs, including nodes whose only edge is a loop."""
    return pairs.select(F.explode(F.array(src, dst)).alias("node")).where("node is not null").distinct()


def reverse(e: DataFrame) -> DataFrame:
    return e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def both_ways(e: DataFrame) -> DataFrame:
    """Each edge in both directions, once."""
    return e.select(
        F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")
    ).select("e.*").distinct()


def directions(e: DataFrame) -> DataFrame:
    """src, dst, fwd, bwd: neighbours in either direction, and which of src -> dst and dst -> src are edges."""
    both = e.select("src", "dst", F.lit(True).alias("fwd"), F.lit(False).alias("bwd")).union(e.select("dst", "src", F.lit(False), F.lit(True)))
    return both.groupBy("src", "dst").agg(F.max("fwd").alias("fwd"), F.max("bwd").alias("bwd"))


def degree(v: DataFrame, e: DataFrame) -> DataFrame:
    """node, degree: in plus out, so a reciprocal pair counts twice in a directed graph; 0 for isolated nodes."""
    counts = e.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    return v.join(counts, "node", "left").select("node", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def without_hubs(v: DataFrame, e: DataFrame, degree_cutoff: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the nodes whose degree reaches the exact (1 - cutoff) quantile, linearly interpolated."""
    d = degree(v, e)
    limit = quantiles(d, "degree", [1 - degree_cutoff]).select(F.col("q")[0].alias("limit"))
    hubs = d.join(F.broadcast(limit)).where("degree >= limit").select("node")  # one row is broadcast
    kept = e.join(hubs.withColumnRenamed("node", "src"), "src", "left_anti").join(hubs.withColumnRenamed("node", "dst"), "dst", "left_anti")
    return v.join(hubs, "node", "left_anti"), kept.select("src", "dst")


def within_communities(e: DataFrame, communities: DataFrame) -> DataFrame:
    """Edges whose ends share a community (node, community); nodes are not touched."""
    of = lambda end: communities.select(F.col("node").alias(end), F.col("community").alias(f"{end}_community"))
    return e.join(of("src"), "src").join(of("dst"), "dst").where("src_community = dst_community").select("src", "dst")


def wedges(e: DataFrame, egos: DataFrame | None = None) -> DataFrame:
    """One row: how many two-step paths the neighbourhood joins will make (the sum of squared degrees, or of the egos' neighbours'
    degrees)."""
    u = directions(e)
    degrees = u.groupBy("src").agg(F.count("*").alias("n"))
    if egos is None:
        return degrees.agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0)).cast("long").alias("wedges"))
    first = u.join(egos.select(F.col("node").alias("src")), "src", "left_semi").groupBy(F.col("dst").alias("src")).agg(F.count("*").alias("egos"))
    return first.join(degrees, "src").agg(F.coalesce(F.sum(F.col("n") * F.col("egos")), F.lit(0)).cast("long").alias("wedges"))


def triangles(e: DataFrame) -> DataFrame:
    """a, b, c of each triangle of neighbours, once, and how many edges (1 or 2) join a to b, a to c and b to c: w_ab, w_ac, w_bc.

    Pairs point from the end with fewer neighbours to the other, so a hub's pairs are not paired with each other: rows grow with
    the edges to the power of 1.5 at most, whatever the degrees.
    """
    u = directions(e)
    degrees = u.groupBy("src").agg(F.count("*").alias("n"))
    rank = lambda end: degrees.select(F.col("src").alias(end), F.struct("n", F.col("src").alias("id")).alias(f"r_{end}"))
    pairs = u.where("src < dst").select("src", "dst", (F.col("fwd").cast("int") + F.col("bwd").cast("int")).alias("w"))
    ranked = pairs.join(rank("src"), "src").join(rank("dst"), "dst")
    low, high = F.least("r_src", "r_dst"), F.greatest("r_src", "r_dst")
    o = staged(ranked.select(low["id"].alias("a"), high["id"].alias("b"), high.alias("rank"), "w"), "oriented")
    ab = o.select("a", "b", F.col("rank").alias("rank_b"), F.col("w").alias("w_ab"))
    ac = o.select("a", F.col("b").alias("c"), F.col("rank").alias("rank_c"), F.col("w").alias("w_ac"))
    bc = o.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("w").alias("w_bc"))
    return ab.join(ac, "a").where("rank_b < rank_c").join(bc, ["b", "c"]).select("a", "b", "c", "w_ab", "w_ac", "w_bc")


def neighbour_links(e: DataFrame) -> DataFrame:
    """node, links: how many edges join two of its neighbours; nodes with none are left out."""
    ends = F.array(*(F.struct(F.col(x).alias("node"), F.col(w).alias("w")) for x, w in (("a", "w_bc"), ("b", "w_ac"), ("c", "w_ab"))))
    return triangles(e).select(F.explode(ends).alias("t")).groupBy("t.node").agg(F.sum("t.w").alias("links"))
