"""Connected components of an edge table, by alternating large-star and small-star steps.

Each round first contracts edges within the tasks (union-find over bounded blocks) and then lets every node point to the
smallest node it knows. Rounds are written to the shared folder. Nothing is collected but a row count and a hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.llm.common import written

SCHEMA = "u long, v long"
BLOCK_EDGES = 500_000
#: Edges, two numbers each, that one task takes whole.
ONE_TASK = 200_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges that isn't the smallest of its component, and that smallest node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        # Hook the roots of both ends to the smaller label, then shorten the paths.
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        while True:
            short = label[label]
            if (short == label).all():
                break
            label = short
        if (label[a] == label[b]).all():
            break
    child = label != np.arange(len(nodes))
    return nodes[child], nodes[label[child]]


def contracted(edges: DataFrame) -> DataFrame:
    """The edges of each block of a task replaced by the stars of its components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if sum(len(x) for x, _ in held) > BLOCK_EDGES:
                held = [stars(*map(np.concatenate, zip(*held, strict=True)))]
                if len(held[0][0]) > BLOCK_EDGES // 2:
                    yield _batch(*held.pop())
        if held:
            yield _batch(*stars(*map(np.concatenate, zip(*held, strict=True))))

    return edges.select("u", "v").mapInArrow(run, SCHEMA)


def _batch(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _with_least(edges: DataFrame) -> DataFrame:
    """Each edge with the least neighbour of u. The extra key has both sides dealt anew, so that a hub can be split."""
    key = F.xxhash64("u").alias("key")
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    return edges.select("u", "v", key).join(least.select("u", "least", key), ["key", "u"])


def components(edges: DataFrame) -> DataFrame:
    """node, root: every node of an edge but the least one of its component, with that least node. Edges: u, v (longs).

    Up to ONE_TASK edges one task solves what is left after the first contraction; more take rounds over all tasks.
    """
    edges, before = written(contracted(edges.where("u <> v").coalesce(max(1, edges.sparkSession.sparkContext.defaultParallelism))), "edges"), None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now[0] <= ONE_TASK:
            last = contracted(edges.coalesce(1))
            return written(last, "roots").select(F.col("u").alias("node"), F.col("v").alias("root"))
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "least").alias("v")).distinct()
        small = _with_least(large)
        links = small.where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v")).union(small.select("u", F.col("least").alias("v")))
        edges = written(contracted(links.distinct().repartition("u")).distinct(), "edges", per_core=1)
