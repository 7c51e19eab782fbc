"""Second-order ego networks of all nodes at once, as role tables (ego, node, role)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.operators.graph import directions, wedges


#: Neighbours up to which nodes are compared as twins.
TWIN_NEIGHBOURS = 16


def twins(v: DataFrame, e: DataFrame) -> DataFrame:
    """node, twin: the least node with the same neighbours by the same directions. Two such nodes can change places without changing
    the network, so all that is measured around one holds for the other; the leaves of a hub need to be looked at once.

    Nodes with more than TWIN_NEIGHBOURS neighbours are their own twins.
    """
    u = directions(e)
    few = u.groupBy("src").count().where(F.col("count") <= TWIN_NEIGHBOURS).select("src")
    near = u.join(few, "src").groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_list(F.struct("dst", "fwd", "bwd"))).alias("near"))
    many = u.groupBy("src").count().where(F.col("count") > TWIN_NEIGHBOURS).select(F.col("src").alias("node"))
    # Nodes without neighbours are twins, too.
    alone = v.select("node").join(u.select(F.col("src").alias("node")), "node", "left_anti")
    alike = near.unionByName(alone.withColumn("near", F.array().cast(near.schema["near"].dataType)))
    least = alike.groupBy("near").agg(F.min("node").alias("twin"))
    return alike.join(least, "near").select("node", "twin").union(many.select("node", F.col("node").alias("twin")))


def _steps(e: DataFrame, egos: DataFrame | None = None) -> DataFrame:
    """ego, node, near (an edge apart), path (joined by a directed two-step path); one aggregation, no anti-join."""
    u = directions(e)
    from_ego = u if egos is None else u.join(egos.select(F.col("node").alias("src")), "src", "left_semi")
    one = from_ego.select(F.col("src").alias("ego"), F.col("dst").alias("node"), F.lit(True).alias("near"), F.lit(False).alias("path"))
    first = from_ego.select(F.col("src").alias("ego"), F.col("dst").alias("via"), F.col("fwd").alias("f1"), F.col("bwd").alias("b1"))
    second = u.select(F.col("src").alias("via"), F.col("dst").alias("node"), F.col("fwd").alias("f2"), F.col("bwd").alias("b2"))
    two = first.join(second, "via").where("ego <> node").select(
        "ego", "node", F.lit(False).alias("near"), ((F.col("f1") & F.col("f2")) | (F.col("b1") & F.col("b2"))).alias("path")
    )
    return one.union(two).groupBy("ego", "node").agg(F.max("near").alias("near"), F.max("path").alias("path"))


def check_paths(e: DataFrame, most: int, egos: DataFrame | None = None) -> int:
    """How many two-step paths the joins over e will make (from the egos alone, if given); an error if they are more than most,
    before any is made."""
    found = wedges(e, egos).first()[0]
    if found > most:
        raise ValueError(f"{found} two-step paths, more than {most}: reduce the network by communities or hubs first")
    return found


def _selves(v: DataFrame) -> DataFrame:
    return v.select(F.col("node").alias("ego"), "node", F.lit(0).alias("role"))


def roles_directed(v: DataFrame, e: DataFrame, egos: DataFrame | None = None) -> DataFrame:
    """Role 1: neighbours. Role 2: second-order nodes on a directed path out of or into the ego. Role 0: the ego and the
    second-order nodes that only mixed directions reach. egos: the nodes of v whose networks are wanted, if not all."""
    v = v if egos is None else egos
    role = F.when(F.col("near"), 1).when(F.col("path"), 2).otherwise(0)
    return _steps(e, egos).select("ego", "node", role.alias("role")).union(_selves(v))


def roles_undirected(v: DataFrame, e: DataFrame, egos: DataFrame | None = None) -> DataFrame:
    """Role 0: the ego. Role 1: neighbours. Role 2: nodes at distance two."""
    v = v if egos is None else egos
    return _steps(e, egos).select("ego", "node", F.when(F.col("near"), 1).otherwise(2).alias("role")).union(_selves(v))


def roles(v: DataFrame, e: DataFrame, directed: bool = True) -> DataFrame:
    return roles_directed(v, e) if directed else roles_undirected(v, e)


def reach(e: DataFrame, backward: bool = False) -> DataFrame:
    """ego, node: what lies within two directed steps out of the ego (or into it), without the ego."""
    a, b = ("dst", "src") if backward else ("src", "dst")
    step = e.select(F.col(a).alias("ego"), F.col(b).alias("node"))
    two = step.select("ego", F.col("node").alias("via")).join(
        step.select(F.col("ego").alias("via"), "node"), "via"
    ).where("ego <> node").select("ego", "node")
    return step.union(two).distinct()


def induced(r: DataFrame, e: DataFrame) -> DataFrame:
    """ego, src, dst: the edges with both ends in the ego's network."""
    ends = lambda name: r.select("ego", F.col("node").alias(name))
    return ends("src").join(e, "src").join(ends("dst"), ["ego", "dst"]).select("ego", "src", "dst")
