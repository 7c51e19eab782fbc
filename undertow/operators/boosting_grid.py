"""Gradient boosting of many cells at once: one pass over the rows a level for all cells, three a round.

Features are binned once for all cells. A row holds its bins and, side by side, its label and margin in every cell; rows lie in
blocks. A pass counts rows and adds up residuals and their slopes by cell, tree node, feature and bin within its task; a task for
some cells adds the tasks' histograms, of fixed size whatever the number of rows, and picks the cuts. What is collected are the
cuts, a few numbers a cell. Residuals are added as whole multiples of 2 ** -30, so that neither the tasks nor their order matter.

The model is binomial deviance: margins begin at the training rows' log odds, a tree of DEPTH levels follows the residuals with the
greatest gain in squared error, and a leaf adds RATE times its Newton step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.functions.metrics import areas
from undertow.operators.split import stratified_split
from undertow.operators.tree_grid import BINS, LEAF, SEED, bin_edges, binned
from undertow.sources.stage import folder, for_rows, remove, staged, staged_in

DEPTH, ROUNDS, RATE = 3, 100, 0.1
#: Residuals are multiples of 1 / UNIT.
UNIT = 1 << 30
#: Rounds whose trees each pass follows anew before the margins are written.
KEPT = 5
#: Rows that make a task of their own, and most rows of a task.
FEW_ROWS, TASK_ROWS = 5_000, 100_000
#: What a row is in a cell: its label if it is learnt from, 2 more if it is held out; or not there.
HELD_OUT, ABSENT = 2, 4
#: The bin of a node that isn't cut: no row lies above it.
UNCUT = 255
BLOCK = "bins binary, state binary, margin binary"
CUT = "cell int, leaf int, f int, b int, g0 long, h0 long, g1 long, h1 long"

#: One round's trees of all cells: features and bins by node (the root is 1, the nodes under i are 2 * i and 2 * i + 1), and what
#: each leaf adds, by place.
Trees = tuple[np.ndarray, np.ndarray, np.ndarray]


def _blocks(batch: pa.RecordBatch, features: int, cells: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """bins by feature, state and margin by cell."""
    for bins, state, margin in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
        yield np.frombuffer(bins, np.uint8).reshape(features, -1), np.frombuffer(state, np.uint8).reshape(cells, -1), np.frombuffer(margin).reshape(cells, -1)


def _leaf(bins: np.ndarray, at: np.ndarray, f: np.ndarray, b: np.ndarray, levels: int) -> np.ndarray:
    """The node that each row of one cell's tree reaches after so many levels. at: which rows."""
    code = np.ones(len(at), np.int64)
    for _ in range(levels):
        code = 2 * code + (bins[f[code], at] > b[code])
    return code


def _grown(margin: np.ndarray, bins: np.ndarray, at: np.ndarray, cell: int, trees: list[Trees]) -> np.ndarray:
    for f, b, adds in trees:
        margin = margin + adds[cell][_leaf(bins, at, f[cell], b[cell], DEPTH) - (1 << DEPTH)]
    return margin


def _laid_out(rows: DataFrame, features: int, starts: list[float]) -> DataFrame:
    """Blocks of rows (bins, and cells: an array of cell and state)."""
    cells = len(starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            bins = batch.column(0).flatten().to_numpy().astype(np.uint8).reshape(n, features)
            own = batch.column(1)
            state = np.full((cells, n), ABSENT, np.uint8)
            cell, found = (x.to_numpy() for x in own.flatten().flatten())
            state[cell, np.repeat(np.arange(n), np.diff(own.offsets.to_numpy()))] = found
            margin = np.repeat(np.array(starts), n)
            columns = [pa.array([x.tobytes()], pa.binary()) for x in (bins.T, state, margin)]
            yield pa.RecordBatch.from_arrays(columns, names=["bins", "state", "margin"])

    return rows.mapInArrow(run, BLOCK)


def _cuts(blocks: DataFrame, features: int, cells: int, level: int, since: list[Trees], now: Trees, leaf: int, tasks: int) -> DataFrame:
    """CUT: for each node of a level the best cut (f is -1 if there is none), with the sums of residuals and slopes up to it and above."""
    width = 1 << level
    shape = width, features, BINS, 3

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((cells, *shape), np.int64)
        for batch in batches:
            for bins, state, margin in _blocks(batch, features, cells):
                for cell in range(cells):
                    at = np.flatnonzero(state[cell] < HELD_OUT)
                    p = 1 / (1 + np.exp(-_grown(margin[cell, at], bins, at, cell, since)))
                    g, h = np.rint((state[cell, at] - p) * UNIT), np.rint(p * (1 - p) * UNIT)
                    place = (_leaf(bins, at, now[0][cell], now[1][cell], level) - width) * BINS
                    for f in range(features):
                        index = place + bins[f, at]
                        for i, weights in enumerate((None, g, h)):
                            total[cell, :, f, :, i] += np.bincount(index, weights, width * BINS).astype(np.int64).reshape(width, BINS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(cells), pa.int32()), pa.array([x.tobytes() for x in total], pa.binary())], names=["cell", "sums"]
        )

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for cell, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[cell] = total.get(cell, 0) + np.frombuffer(sums, np.int64).reshape(shape)
        rows = [(cell, place, *best_cut(sums[place], leaf)) for cell, sums in total.items() for place in range(width) if sums[place].any()]
        kinds = [pa.int32()] * 4 + [pa.int64()] * 4
        columns = list(zip(*rows, strict=True)) if rows else [()] * 8
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["cell", "leaf", "f", "b", "g0", "h0", "g1", "h1"]
        )

    return blocks.mapInArrow(count, "cell int, sums binary").repartition(tasks, "cell").mapInArrow(choose, CUT)


def best_cut(sums: np.ndarray, leaf: int) -> tuple[int, int, int, int, int, int]:
    """f, b, and the residuals and slopes up to the cut and above it, of the cut with the greatest gain that leaves leaf rows or more
    on both sides; of equal gains the first feature, then the first bin. sums: rows, residuals, slopes by feature and bin."""
    under = sums.cumsum(axis=1)
    whole = under[0, -1]
    over = whole - under
    n0, n1 = under[..., 0], over[..., 0]
    g0, g1 = under[..., 1] / UNIT, over[..., 1] / UNIT
    fair = (n0 >= max(1, leaf)) & (n1 >= max(1, leaf))
    a, b = np.where(fair, n0, 1), np.where(fair, n1, 1)
    gain = np.where(fair, np.round(a * b / (a + b) / whole[0] * (g0 / a - g1 / b) ** 2, 12), 0.0)
    best = int(gain.argmax())
    f, at = divmod(best, BINS)
    if gain[f, at] <= 0:
        return -1, UNCUT, int(whole[1]), int(whole[2]), 0, 0
    return f, at, *(int(x[f, at, i]) for x in (under, over) for i in (1, 2))


def step(g: int, h: int) -> float:
    """What a leaf adds, from the sums of its residuals and of their slopes."""
    return RATE * g / h if h else 0.0


def fitted(blocks: DataFrame, features: int, cells: int, rounds: int = ROUNDS, leaf: int = LEAF) -> tuple[DataFrame, list[Trees]]:
    """blocks with the margins of all but the last trees, and these."""
    spark = blocks.sparkSession
    since: list[Trees] = []
    before = None
    tasks = min(cells, int(spark.conf.get("spark.sql.shuffle.partitions")))
    for _ in range(rounds):
        if len(since) == KEPT:
            with folder(spark, "margins") as path:
                blocks = staged(_moved(blocks, features, cells, since), "margins")
            if before:
                remove(spark, before)
            since, before = [], path
        size = 1 << DEPTH
        f, b, adds = np.zeros((cells, size), np.int64), np.full((cells, size), UNCUT, np.int64), np.zeros((cells, size))
        for level in range(DEPTH):
            for r in _cuts(blocks, features, cells, level, since, (f, b, adds), leaf, tasks).collect():  # at most four rows a cell
                if r.f >= 0:
                    node = (1 << level) + r.leaf
                    f[r.cell, node], b[r.cell, node] = r.f, r.b
                # The leaves that this node's rows end in, if neither side is cut any more.
                half = 1 << (DEPTH - level - 1)
                adds[r.cell, 2 * r.leaf * half] = step(r.g0, r.h0)
                if r.f >= 0:
                    adds[r.cell, (2 * r.leaf + 1) * half] = step(r.g1, r.h1)
        since.append((f, b, adds))
    return blocks, since


def _moved(blocks: DataFrame, features: int, cells: int, trees: list[Trees]) -> DataFrame:
    """blocks with margins moved by the trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            moved = []
            for bins, _, margin in _blocks(batch, features, cells):
                every = np.arange(bins.shape[1])
                moved.append(np.stack([_grown(margin[cell], bins, every, cell, trees) for cell in range(cells)]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(moved, pa.binary())], names=["bins", "state", "margin"])

    return blocks.mapInArrow(run, BLOCK)


def _held_out(blocks: DataFrame, cells: int, features: int) -> DataFrame:
    """cell, label, score (the predicted label) of the held-out rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, state, margin in _blocks(batch, features, cells):
                cell, at = np.nonzero((state >= HELD_OUT) & (state < ABSENT))
                columns = cell.astype(np.int32), state[cell, at].astype(np.int32) - HELD_OUT, (margin[cell, at] >= 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["cell", "label", "score"])

    return blocks.mapInArrow(run, "cell int, label int, score int")


def boosting_grid(
    table: DataFrame,
    columns: list[str],
    labels: DataFrame,
    by: tuple[str, str] = ("cutoff", "target"),
    test: float = 0.3,
    seed: int = SEED,
    leaf: int = LEAF,
    rounds: int = ROUNDS,
) -> DataFrame:
    """The by columns, imbalance, roc, pr: each cell's boosted trees, by their hard predictions on the held-out rows of a stratified
    split. table: node and the features; labels: node, the by columns and label, one row a node and cell. Areas are null where a
    class is missing."""
    spark, names = table.sparkSession, list(by)
    # A row a cell is collected.
    found = labels.groupBy(*names).agg(F.avg("label").alias("imbalance"), F.sum("label").alias("p"), F.count("*").alias("n")).orderBy(*names).collect()
    two = [r for r in found if 0 < r.p < r.n]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in labels.select(*names).schema)
    share = spark.createDataFrame([(*(r[c] for c in names), r.imbalance) for r in found], f"{kinds}, imbalance double")
    if not two:
        return share.select("*", *(F.lit(None).cast("double").alias(x) for x in ("roc", "pr")))
    cells = F.broadcast(spark.createDataFrame([(*(r[c] for c in names), i) for i, r in enumerate(two)], f"{kinds}, cell int"))
    stratum = (F.col("cell") * 2 + F.col("label")).alias("stratum")
    long = staged(labels.join(cells, names).select("node", "cell", "label", stratum), "grid")
    split = staged(stratified_split(long, label="stratum", test=test, seed=seed), "split")
    learnt = {r.cell: (r.p, r.n) for r in split.where("not is_test").groupBy("cell").agg(F.sum("label").alias("p"), F.count("*").alias("n")).collect()}
    starts = [float(np.log(p / (n - p))) for p, n in (learnt[i] for i in range(len(two)))]
    state = F.struct("cell", (F.col("label") + F.when(F.col("is_test"), HELD_OUT).otherwise(0)).cast("int").alias("state"))
    bins = table.select("node", binned(table, bin_edges(table, columns), columns).alias("bins"))
    rows = staged(bins.join(split.groupBy("node").agg(F.collect_list(state).alias("cells")), "node").select("bins", "cells"), "rows")
    n = rows.count()
    tasks = max(1, min(n // FEW_ROWS, max(spark.sparkContext.defaultParallelism, n // TASK_ROWS)))
    blocks = staged_in(for_rows(spark, n), _laid_out(rows.repartition(tasks), len(columns), starts), "blocks")
    moved, last = fitted(blocks, len(columns), len(two), rounds, leaf)
    scored = staged_in(spark, _held_out(_moved(moved, len(columns), len(two), last), len(two), len(columns)), "scored")
    return share.join(areas(scored, ["cell"]).join(cells, "cell"), names, "left").select(*names, "imbalance", "roc", "pr")
