"""Synthetic networks with planted smurfing patterns: edges point from source over mules to target."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from undertow.sources.tables import row_numbers

BARABASI, ERDOS, WATTS = "Barabasi-Albert", "Erdos-Renyi", "Watts-Strogatz"
KINDS = ["separate", "new_mules", "existing_mules"]
FEWEST, MOST = 2, 10
EDGE = StructType([StructField("source", LongType()), StructField("target", LongType())])
#: Pairs of a random graph that one task draws from.
BLOCK = 1 << 24


def erdos_renyi(spark: SparkSession, n: int, p: float, seed: int) -> DataFrame:
    """Each of the n (n - 1) / 2 pairs with chance p: seeded geometric skips through blocks of the pairs' numbering."""
    pairs = n * (n - 1) // 2

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for block in frame["id"]:
                low, high = int(block) * BLOCK, min(pairs, (int(block) + 1) * BLOCK)
                rng = np.random.default_rng([seed, int(block)])
                at, found = low - 1, []
                while at < high and p > 0:
                    skips = rng.geometric(min(p, 1.0), 4096).cumsum() + at
                    found.append(skips[skips < high])
                    at = int(skips[-1])
                index = np.concatenate(found) if found else np.array([], np.int64)
                # Pair number -> (larger, smaller) node, corrected for the rounding of the root.
                big = ((1 + np.sqrt(1 + 8 * index.astype(float))) / 2).astype(np.int64)
                big -= big * (big - 1) // 2 > index
                big += big * (big + 1) // 2 <= index
                yield pd.DataFrame({"source": index - big * (big - 1) // 2, "target": big})

    return spark.range(0, max(1, -(-pairs // BLOCK))).mapInPandas(draw, EDGE)


def watts_strogatz(spark: SparkSession, n: int, neighbours: int, p: float, seed: int) -> DataFrame:
    """A ring where each node links to its next neighbours; each link's far end is drawn anew with chance p."""
    unit = lambda salt: F.pmod(F.xxhash64("id", "step", F.lit(seed), F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    links = spark.range(0, n).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(neighbours))))
    target = F.when(unit(1) < p, F.floor(unit(2) * n)).otherwise((F.col("id") + F.col("step")) % n)
    return links.select(F.col("id").alias("source"), target.cast("long").alias("target"))


def barabasi_albert(spark: SparkSession, n: int, m: int, seed: int) -> DataFrame:
    """Preferential attachment, m links a new node. It is sequential by nature, so one task makes one graph."""

    def grow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _ in frame["id"]:
                rng = np.random.default_rng(seed)
                ends = np.zeros(2 * m * n + 1, np.int64)
                filled, source, target = 1, [], []
                for node in range(1, n):
                    chosen = np.unique(ends[rng.integers(0, filled, m)])
                    source += [node] * len(chosen)
                    target += chosen.tolist()
                    ends[filled : filled + len(chosen)] = chosen
                    ends[filled + len(chosen) : filled + 2 * len(chosen)] = node
                    filled += 2 * len(chosen)
                yield pd.DataFrame({"source": np.array(source, np.int64), "target": np.array(target, np.int64)})

    return spark.range(1).mapInPandas(grow, EDGE)


def base_graph(spark: SparkSession, generator: str, n: int, m: int, p: float, seed: int = 1997) -> DataFrame:
    if generator == BARABASI:
        return barabasi_albert(spark, n, m, seed)
    if generator == ERDOS:
        return erdos_renyi(spark, n, p / 10, seed)
    if generator == WATTS:
        return watts_strogatz(spark, n, m, p, seed)
    raise ValueError(f"unknown generator: {generator}")


def mule_counts(n: int, mules: list[int] | None, seed: int) -> list[int]:
    """Mules of each of n patterns: given for all, one for each, or drawn from 2 to 10."""
    mules = list(mules or [])
    if len(mules) not in (0, 1, n):
        raise ValueError("give no, one, or one mule count for each pattern")
    if not mules:
        return np.random.default_rng(seed).integers(FEWEST, MOST + 1, n).tolist()
    return mules * n if len(mules) == 1 else mules


def plan_patterns(
    spark: SparkSession, n: int, patterns: int, mules: list[int] | None = None, seed: int = 1997, kinds: tuple[str, ...] = tuple(KINDS)
) -> DataFrame:
    """One row per pattern: kind, mules, first_new (its first new node), first_existing (its first place in the order of
    existing nodes), and how many of both it takes. The table has one row a pattern."""
    rows, new, used = [], n, 0
    for k, kind in enumerate(kinds):
        if kind not in KINDS:
            raise ValueError(f"unknown pattern: {kind}")
        for count in mule_counts(patterns, mules, seed + k):
            fresh = {"separate": count + 2, "new_mules": count, "existing_mules": 0}[kind]
            old = {"separate": 0, "new_mules": 2, "existing_mules": count + 2}[kind]
            rows.append((kind, int(count), new, used, fresh, old))
            new, used = new + fresh, used + old
    if used > n:
        raise ValueError("more existing nodes are needed than there are")
    return spark.createDataFrame(rows, "kind string, mules int, first_new long, first_existing long, fresh int, old int")


def planted(plan: DataFrame, order: DataFrame) -> DataFrame:
    """kind, source, target of all planted edges. order: place and node of the existing nodes, each used once."""
    slots = plan.select("*", F.explode(F.sequence(F.lit(0), F.col("mules") - 1)).alias("i"))
    new = lambda offset: F.col("first_new") + offset
    old = lambda offset: F.col("first_existing") + offset
    kind = F.col("kind")
    # Each end is a new node, or a place among the existing ones.
    ends = {
        "source": (F.when(kind == "separate", new(0)), F.when(kind != "separate", old(0))),
        "target": (F.when(kind == "separate", new(F.col("mules") + 1)), F.when(kind != "separate", old(1))),
        "mule": (F.when(kind == "separate", new(F.col("i") + 1)).when(kind == "new_mules", new(F.col("i"))), F.when(kind == "existing_mules", old(F.col("i") + 2))),
    }
    found = slots.select("kind", *(c[0].alias(f"{e}_new") for e, c in ends.items()), *(c[1].alias(f"{e}_at") for e, c in ends.items()))
    for end in ends:
        found = found.join(
            order.select(F.col("place").alias(f"{end}_at"), F.col("node").alias(f"{end}_old")), f"{end}_at", "left"
        ).withColumn(end, F.coalesce(f"{end}_new", f"{end}_old"))
    step = F.explode(
        F.array(
            F.struct(F.col("source").alias("source"), F.col("mule").alias("target")),
            F.struct(F.col("mule").alias("source"), F.col("target").alias("target")),
        )
    ).alias("e")
    return found.select("kind", step).select("kind", "e.source", "e.target")


def shuffled(nodes: DataFrame, seed: int) -> DataFrame:
    """place and node: the nodes in a pseudo-random order."""
    keyed = nodes.withColumn("key", F.xxhash64("node", F.lit(seed)))
    return row_numbers(keyed, "key", "node").select(F.col("row_index").alias("place"), "node")


def synthetic_network(
    spark: SparkSession, generator: str, n: int, m: int, p: float, patterns: int, mules: list[int] | None = None, seed: int = 1997
) -> tuple[DataFrame, DataFrame]:
    """nodes (node, laundering, and a flag per kind) and edges (source, target, laundering), without loops and repeats."""
    plan = plan_patterns(spark, n, patterns, mules, seed)
    extra = planted(plan, shuffled(spark.range(n).select(F.col("id").alias("node")), seed))
    edges = base_graph(spark, generator, n, m, p, seed).withColumn("laundering", F.lit(False)).union(extra.select("source", "target", F.lit(True)))
    edges = edges.where("source <> target").groupBy("source", "target").agg(F.max("laundering").alias("laundering"))
    total = n + plan.agg(F.sum("fresh")).first()[0]
    marks = extra.select(
        "kind", F.explode(F.array("source", "target")).alias("node")
    ).groupBy("node").agg(*(F.max(F.col("kind") == k).alias(k) for k in KINDS))
    nodes = spark.range(total).select(F.col("id").alias("node")).join(marks, "node", "left").select(
        "node", F.col("separate").isNotNull().alias("laundering"), *(F.coalesce(k, F.lit(False)).alias(k) for k in KINDS)
    )
    return nodes, edges


def dataset_name(generator: str, n: int, m: int, p: float, patterns: int) -> str:
    return f"synthetic_{generator}_{n}_{m}_{p}_{patterns}"


def parameter_grid(
    sizes: tuple[int, ...] = (100, 10_000, 100_000),
    patterns: tuple[int, ...] = (3, 5),
    links: tuple[int, ...] = (1, 2, 5),
    chances: tuple[float, ...] = (0.001, 0.01),
) -> list[tuple[str, int, int, float, int]]:
    """The benchmark's datasets: generator, nodes, links, chance, patterns."""
    shapes = [(BARABASI, m, 0) for m in links] + [(ERDOS, 0, p) for p in chances] + [(WATTS, m, p) for m, p in product(links, chances)]
    return [(g, n, m, p, k) for n, k in product(sizes, patterns) if k <= 0.06 * n for g, m, p in shapes]


def expected_edges(n: int, p: float) -> float:
    return n * (n - 1) / 2 * p if n > 1 else math.nan
