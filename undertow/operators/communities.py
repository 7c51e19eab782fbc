"""Connected components and Louvain communities of an undirected graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from undertow.operators.graph import both_ways
from undertow.sources.stage import folder, for_rounds, remove, staged, staged_in

RESOLUTION, SEED = 10.0, 1997
#: A level ends when a round moves no more than this share of its nodes, the last rounds over single nodes at a lower one. Every
#: round raises the modularity, so the bounds on rounds and levels only cut off what is left then.
SETTLED, POLISHED, ROUNDS, LEVELS = 0.05, 0.03, 100, 50
#: Candidates for one community, or out of one, that a round looks at; the others wait for the next rounds.
QUEUE = 100_000


def connected_components(v: DataFrame, e: DataFrame) -> DataFrame:
    """node, component: the least node that it reaches. Large-star and small-star steps until nothing changes."""
    found = e.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    edges, before = for_rounds(found, "components", 2), None

    def least(links: DataFrame) -> DataFrame:
        # The second key has both sides dealt anew, so that a hub can be split.
        key = F.xxhash64("u").alias("key")
        return links.select("u", "v", key).join(links.groupBy("u").agg(F.min("v").alias("least")).select("u", "least", key), ["key", "u"])

    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "least").alias("v")).distinct()
        small = least(large)
        edges = staged(
            small.where("v <> least").select(
                F.col("v").alias("u"), F.col("least").alias("v")
            ).union(small.select("u", F.col("least").alias("v"))).distinct(),
            "components",
        )
    roots = staged_in(v.sparkSession, edges.select(F.col("u").alias("node"), F.col("v").alias("root")), "components")
    return v.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("component"))


def modularity(e: DataFrame, communities: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: the modularity of a partition of undirected edges (each once, unit weight)."""
    of = lambda end: communities.select(F.col("node").alias(end), F.col("community").alias(f"c_{end}"))
    placed = e.join(of("src"), "src").join(of("dst"), "dst")
    inside = placed.agg(F.sum((F.col("c_src") == F.col("c_dst")).cast("long")).alias("inside"), F.count("*").alias("m"))
    degrees = placed.select(F.explode(F.array("c_src", "c_dst")).alias("c")).groupBy("c").count().agg(
        F.sum(F.col("count").cast("double") * F.col("count")).alias("squares")
    )
    return inside.join(degrees).select(
        (F.col("inside") / F.col("m") - resolution * F.col("squares") / (4.0 * F.col("m") * F.col("m"))).alias("modularity")
    )


def candidates(links: DataFrame, state: DataFrame, m: int, resolution: float, turn: int, seed: int) -> DataFrame:
    """node, k, own, target, gain, place: the nodes that would gain by a move to a neighbour's community, by themselves. Gains are
    changes of the modularity times twice the square of m; place is the order of a round, a hash of node and turn."""
    totals = state.groupBy("community").agg(F.sum("k").alias("total"))
    # A link of a contracted node to itself moves with the node.
    near = links.where("src <> dst").join(state.select(F.col("node").alias("dst"), "community"), "dst").select(F.col("src").alias("node"), "community", "w")
    own = state.select("node", "k", F.col("community").alias("own"))
    # A node looks at its own community also where it has no link there.
    all_ = near.union(state.select("node", "community", F.lit(0).cast("long")))
    rows = all_.groupBy("node", "community").agg(F.sum("w").alias("w")).join(totals, "community").join(own, "node")
    left = F.col("total") - F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(0)
    value = 2.0 * m * F.col("w") - resolution * F.col("k") * left
    stays = F.col("community") == F.col("own")
    best = rows.groupBy("node", "k", "own").agg(
        F.max(F.when(stays, value)).alias("stay"),
        # Of equal values the least community.
        F.max(F.when(~stays, value)).alias("go"),
        F.min_by("community", F.when(~stays, F.struct(-value, F.col("community")))).alias("target"),
    )
    place = F.md5(F.concat_ws(":", F.col("node").cast("string"), F.lit(str(turn)), F.lit(str(seed))))
    return best.where("go > stay").select("node", "k", "own", "target", (F.col("go") - F.col("stay")).alias("gain"), place.alias("place"))


def without_conflict(found: DataFrame, links: DataFrame, m: int, resolution: float) -> DataFrame:
    """node, target: candidates that gain whatever the candidates before them do.

    From a candidate's gain goes all that earlier candidates could cost it: the degrees of those that join its target or leave its
    own community, and the links to neighbours that leave its target or join its own. What could only help is left out. So the
    modularity rises by every move that is left, as if they were made one after the other; the first candidate always moves.
    """
    earlier = lambda side: F.coalesce(
        F.sum("k").over(Window.partitionBy(side).orderBy("place", "node").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    ranked = found.withColumn("joined", earlier("target")).withColumn("left_", earlier("own"))
    a = found.select(F.col("node").alias("src"), F.col("own").alias("own_a"), F.col("target").alias("to_a"), F.col("place").alias("place_a"))
    b = found.select(F.col("node").alias("dst"), F.col("own").alias("own_b"), F.col("target").alias("to_b"), F.col("place").alias("place_b"))
    before = F.struct("place_b", "dst") < F.struct("place_a", "src")
    lost = (F.col("own_b") == F.col("to_a")).cast("long") + (F.col("to_b") == F.col("own_a")).cast("long")
    met = links.where("src <> dst").join(a, "src").join(b, "dst").where(before).groupBy(F.col("src").alias("node")).agg(F.sum(F.col("w") * lost).alias("lost"))
    cost = resolution * F.col("k") * (F.col("joined") + F.col("left_")) + 2.0 * m * F.coalesce("lost", F.lit(0))
    return ranked.join(met, "node", "left").where(F.col("gain") - cost > 0).select("node", "target")


def _queued(found: DataFrame, turn: int) -> DataFrame:
    """Candidates so thinned that no community has many more than QUEUE to come or to go; another part of them each round."""
    for side in ("target", "own"):
        many = found.groupBy(side).agg(F.ceil(F.count("*") / QUEUE).alias("parts")).where("parts > 1")
        if not many.isEmpty():
            part = F.pmod(F.xxhash64("node", F.lit(turn)), F.coalesce("parts", F.lit(1)))
            found = found.join(many, side, "left").where(part == 0).drop("parts")
    return found


def moved(links: DataFrame, m: int, resolution: float, seed: int, settled: float, start: DataFrame | None = None) -> tuple[DataFrame, int]:
    """node, k, community after rounds of moves, and how many moves there were. start: node and community at first; without it
    every node is a community."""
    degrees = links.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k"))
    state = staged(degrees.withColumn("community", F.col("node")) if start is None else degrees.join(start, "node"), "louvain")
    n, moves, last = state.count(), 0, None
    for turn in range(ROUNDS):
        # A round's table goes when the next one is written.
        with folder(links.sparkSession, "round") as path:
            # Written, so that its size is known where it is joined.
            found, watch = staged(candidates(links, state, m, resolution, turn, seed), "louvain"), Observation()
            # A community has no more candidates than its level has nodes.
            going = without_conflict(found if n <= QUEUE else _queued(found, turn), links, m, resolution)
            after = state.join(going, "node", "left").select("node", "k", F.coalesce("target", "community").alias("community"), "target")
            state = staged(after.observe(watch, F.count("target").alias("n")), "louvain").drop("target")
        if last:
            remove(links.sparkSession, last)
        last, now = path, watch.get["n"]
        moves += now
        if now <= settled * n:
            break
    return state, moves


def connected(found: DataFrame, links: DataFrame) -> DataFrame:
    """node, community, where communities are cut into parts that hang together; no link is lost, so the modularity never falls."""
    of = lambda end: found.select(F.col("node").alias(end), F.col("community").alias(f"c_{end}"))
    inner = links.join(of("src"), "src").join(of("dst"), "dst").where("c_src = c_dst").select("src", "dst")
    return connected_components(found.select("node"), inner).withColumnRenamed("component", "community")


def louvain(v: DataFrame, e: DataFrame, resolution: float = RESOLUTION, seed: int = SEED) -> DataFrame:
    """node, community of every node; direction is ignored. A community is named by one of its nodes.

    Every size is treated alike: in each round all nodes look for their best neighbouring community at once, and those move that
    gain whatever the others do, so every round raises the modularity. A level's communities become the nodes of the next. When
    no level changes anything, single nodes move once more, and communities are cut into connected parts. All sums are of whole
    numbers, so the result doesn't depend on the number of tasks.
    """
    edges = staged(both_ways(e).where("src < dst"), "louvain")
    m = edges.count()
    names = v.select("node", F.col("node").alias("community"))
    if not m:
        return names
    one = F.lit(1).cast("long").alias("w")
    single = for_rounds(edges.select("src", "dst", one).union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), one)), "louvain")
    links, member = single, None
    for level in range(LEVELS):
        found, moves = moved(links, m, resolution, seed + level, SETTLED)
        if not moves:
            break
        above = found.select(F.col("node").alias("community"), F.col("community").alias("next"))
        member = found.select("node", "community") if member is None else staged(
            member.join(above, "community").select("node", F.col("next").alias("community")), "louvain"
        )
        ends = lambda end: found.select(F.col("node").alias(end), F.col("community").alias(f"c_{end}"))  # noqa: B023, E731
        links = staged(
            links.join(ends("src"), "src").join(ends("dst"), "dst").groupBy(F.col("c_src").alias("src"), F.col("c_dst").alias("dst")).agg(F.sum("w").alias("w")),
            "louvain",
        )
    if member is None:
        return names
    found = moved(single, m, resolution, seed + LEVELS, POLISHED, member)[0].select("node", "community")
    parts = staged(connected(staged_in(v.sparkSession, found, "louvain"), edges), "louvain")
    return v.join(parts, "node", "left").select("node", F.coalesce("community", "node").alias("community"))


def reduce_by_community(v: DataFrame, e: DataFrame, resolution: float = RESOLUTION, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """All nodes, and the edges within Louvain communities."""
    from undertow.operators.graph import within_communities

    return v, within_communities(e, staged(louvain(v, e, resolution, seed), "communities"))
