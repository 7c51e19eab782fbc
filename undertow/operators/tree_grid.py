"""Decision trees of many cells at once.

Features are binned once for all cells, at exact quantiles. A node of few rows, be it a whole cell, is grown to its leaves by one task,
and nodes of more rows take rounds: a level's histogram counts rows and positives by cell, tree node, feature and bin, with map-side
combine; running totals over the bins give every cut's Gini gain, and the best cut of each node sends its rows to the next level.
No round writes anything. What is collected are cuts and sizes of nodes of more than FEW rows, so a few numbers for FEW rows; each
round follows them anew over the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructType

from undertow.functions.metrics import quantiles
from undertow.operators.split import stratified_split
from undertow.sources.stage import staged

BINS, LEAF, DEPTH, SEED = 32, 10, 30, 1997
#: Most rows, held out ones too, of a node that one task grows on from: some dozen bytes each in a Python worker.
FEW = 1_000_000


def bin_edges(table: DataFrame, columns: list[str], bins: int = BINS) -> dict[str, list[float]]:
    """Up to bins - 1 ascending edges a column: its exact quantiles, each once."""
    rows = table.select(F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("x")) for c in columns))).alias("t")).select("t.*")
    found = quantiles(rows, "x", [i / bins for i in range(1, bins)], ["c"]).collect()  # columns times bins numbers
    return {r.c: sorted(set(r.q)) for r in found}


def binned(table: DataFrame, edges: dict[str, list[float]], columns: list[str]) -> Column:
    """An array with each column's bin: how many of its edges lie below the value."""
    below = lambda c: F.size(F.filter(F.array(*map(F.lit, edges[c])), lambda e: F.col(c) > e))
    return F.array(*map(below, columns))


def best_cuts(rows: DataFrame, by: list[str], leaf: int = LEAF) -> DataFrame:
    """The by columns, code, f, b, gain: for each node the cut after bin b of feature f with the greatest Gini gain that leaves leaf rows
    or more on both sides; of equal gains the first feature, then the first bin. rows: by, code, label and bins."""
    node = [*by, "code"]
    counts = rows.select(*node, "label", F.posexplode("bins").alias("f", "b")).groupBy(*node, "f", "b").agg(
        F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("p")
    )
    feature = Window.partitionBy(*node, "f")
    upto = feature.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    sums = counts.select(
        *node, "f", "b", *(F.sum(c).over(w).alias(name) for w, names in ((upto, ("n1", "p1")), (feature, ("n0", "p0"))) for c, name in zip(("n", "p"), names, strict=True))
    ).withColumn("n2", F.col("n0") - F.col("n1")).withColumn("p2", F.col("p0") - F.col("p1"))
    impurity = lambda i: 2 * (F.col(f"p{i}") / F.col(f"n{i}")) * (1 - F.col(f"p{i}") / F.col(f"n{i}"))
    cuts = sums.where((F.col("n1") >= leaf) & (F.col("n2") >= leaf)).withColumn(
        "gain", F.round(impurity(0) - F.col("n1") / F.col("n0") * impurity(1) - F.col("n2") / F.col("n0") * impurity(2), 12)
    )
    return cuts.where("gain > 0").groupBy(*node).agg(F.max(F.struct("gain", -F.col("f"), -F.col("b"))).alias("m")).select(
        *node, (-F.col("m.col2")).alias("f"), (-F.col("m.col3")).alias("b"), "m.gain"
    )


def grown(bins: np.ndarray, label: np.ndarray, learnt: np.ndarray, code: int, leaf: int, depth: int) -> np.ndarray:
    """The codes of the leaves that one node's rows reach, by the same cuts as best_cuts. learnt: which rows count."""
    codes = np.full(len(label), code, np.int64)
    nodes = [(np.arange(len(label)), code, depth)]
    width = int(bins.max(initial=0)) + 1
    while nodes:
        at, code, depth = nodes.pop()
        train = at[learnt[at]]
        if not depth or len(train) < 2 * leaf or not 0 < label[train].sum() < len(train):
            continue
        n1, p1 = (
            np.stack([np.bincount(bins[of, f], minlength=width) for f in range(bins.shape[1])]).cumsum(axis=1)
            for of in (train, train[label[train] > 0])
        )
        n0, p0 = len(train), float(label[train].sum())
        n2, p2 = n0 - n1, p0 - p1
        fair = (n1 >= leaf) & (n2 >= leaf)
        impurity = lambda p, n: 2 * (p / n) * (1 - p / n)
        a, b = np.where(fair, n1, 1), np.where(fair, n2, 1)
        gain = np.where(fair, np.round(impurity(p0, n0) - n1 / n0 * impurity(p1, a) - n2 / n0 * impurity(p2, b), 12), 0.0)
        f, cut = divmod(int(gain.argmax()), width)
        if gain[f, cut] <= 0:
            continue
        over = bins[at, f] > cut
        codes[at] = 2 * code + over
        nodes += [(at[~over], 2 * code, depth - 1), (at[over], 2 * code + 1, depth - 1)]
    return codes


def finished(rows: DataFrame, by: list[str], leaf: int, depth: int) -> DataFrame:
    """rows, of nodes of few rows each, with the codes of the leaves they reach. depth: most levels under the root."""

    def run(table: pa.Table) -> pa.Table:
        code = table["code"][0].as_py()
        bins = table["bins"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        label, learnt = table["label"].to_numpy().astype(np.int64), ~table["is_test"].to_numpy()
        codes = grown(bins, label, learnt, code, leaf, depth - (code.bit_length() - 1))
        at = table.column_names.index("code")
        return table.set_column(at, table.schema.field(at), pa.array(codes))

    return rows.groupBy(*by, "code").applyInArrow(run, rows.schema)


def reached(bins: np.ndarray, codes: np.ndarray, f: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The codes of the nodes that rows of one cell reach by cuts. codes: of the nodes that are cut, ascending."""
    code = np.ones(len(bins), np.int64)
    rows = np.arange(len(bins))
    while len(codes):
        place = np.searchsorted(codes, code).clip(max=len(codes) - 1)
        cut = codes[place] == code
        if not cut.any():
            break
        code = np.where(cut, 2 * code + (bins[rows, f[place]] > b[place]), code)
    return code


def walked(rows: DataFrame, cuts: dict[tuple[int, int], tuple[int, int]], nodes: set[tuple[int, int]]) -> DataFrame:
    """rows (cell_ and bins) with code, the node they reach by the cuts, and among_, whether that is one of nodes. cuts and nodes: by
    cell_ and code; a cell_ of null has none."""
    trees = {c: [np.array(x, np.int64) for x in zip(*sorted((code, *cut) for (d, code), cut in cuts.items() if d == c), strict=True)] for c in {c for c, _ in cuts}}
    wanted = {c: np.array([code for d, code in nodes if d == c], np.int64) for c in {c for c, _ in nodes}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            bins = batch.column("bins").flatten().to_numpy().reshape(n, -1)
            cell = batch.column("cell_").fill_null(-1).to_numpy()
            code, among = np.ones(n, np.int64), np.zeros(n, bool)
            for c in np.unique(cell).tolist():
                at = np.flatnonzero(cell == c)
                if c in trees:
                    code[at] = reached(bins[at], *trees[c])
                if c in wanted:
                    among[at] = np.isin(code[at], wanted[c])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code), pa.array(among)], names=[*batch.schema.names, "code", "among_"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields]).add("code", LongType()).add("among_", BooleanType()))


def fitted(rows: DataFrame, by: list[str], leaf: int = LEAF, depth: int = DEPTH, few: int = FEW) -> DataFrame:
    """rows (by, label, is_test, bins and others) with the code of their leaf, in the trees that the rows grow that are not is_test. rows
    are read in every round, so they should lie in a table."""
    # A row a cell is collected.
    large = [r for r in rows.groupBy(*by).agg(F.count("*").alias("n_")).collect() if r.n_ > few]
    if not large:
        return finished(rows.withColumn("code", F.lit(1).cast("long")), by, leaf, depth)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*by).schema)
    cells = F.broadcast(rows.sparkSession.createDataFrame([(*(r[c] for c in by), i) for i, r in enumerate(large)], f"{kinds}, cell_ int"))
    own = rows.join(cells, by).select("cell_", "label", "is_test", "bins")
    cuts: dict[tuple[int, int], tuple[int, int]] = {}
    # Nodes of more than few rows: those of this level, and those that are leaves.
    now, ends = {(i, 1) for i in range(len(large))}, set()
    for _ in range(depth):
        train = walked(own, cuts, now).where("among_ and not is_test").select("cell_", "code", "label", "bins")
        new = {(r.cell_, r.code): (r.f, r.b) for r in best_cuts(train, ["cell_"], leaf).select("cell_", "code", "f", "b").collect()}
        cuts |= new
        ends |= now - new.keys()
        under = {(c, 2 * code + over) for c, code in new for over in (0, 1)}
        sizes = walked(own, cuts, under).where("among_").groupBy("cell_", "code").agg(F.count("*").alias("n_")).where(F.col("n_") > few)
        now = {(r.cell_, r.code) for r in sizes.collect()} if under else set()
        if not now:
            break
    codes = walked(rows.join(cells, by, "left").select(*rows.columns, "cell_"), cuts, ends | now)
    some, whole = (codes.where(x).select(*rows.columns, "code") for x in ("not among_", "among_"))
    return finished(some, by, leaf, depth).unionByName(whole)


def tree_grid(
    table: DataFrame, columns: list[str], labels: DataFrame, by: tuple[str, str] = ("cutoff", "target"), test: float = 0.3, seed: int = SEED, leaf: int = LEAF
) -> DataFrame:
    """The by columns, imbalance, roc, pr: each cell's tree, by its hard predictions on the held-out rows of a stratified split. table:
    node and the features; labels: node, the by columns and label. Areas are null where a class is missing."""
    spark, names = table.sparkSession, list(by)
    # A row a cell is collected.
    found = labels.groupBy(*names).agg(F.avg("label").alias("imbalance"), F.sum("label").alias("p"), F.count("label").alias("n")).orderBy(*names).collect()
    two = [r for r in found if r.n and 0 < r.p < r.n]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in labels.select(*names).schema)
    share = spark.createDataFrame([(*(r[c] for c in names), r.imbalance) for r in found], f"{kinds}, imbalance double")
    if not two:
        return share.select("*", *(F.lit(None).cast("double").alias(x) for x in ("roc", "pr")))
    cells = F.broadcast(spark.createDataFrame([(*(r[c] for c in names), i) for i, r in enumerate(two)], f"{kinds}, cell int"))
    stratum = (F.col("cell") * 2 + F.col("label")).alias("stratum")
    long = staged(labels.join(cells, names).select("node", "cell", "label", stratum), "grid")
    split = stratified_split(long, label="stratum", test=test, seed=seed)
    bins = table.select("node", binned(table, bin_edges(table, columns), columns).cast("array<tinyint>").alias("bins"))
    rows = fitted(staged(split.join(bins, "node").select("cell", "label", "is_test", "bins"), "rows"), ["cell"], leaf)
    return share.join(hard_areas(rows).join(cells, "cell"), names, "left").select(*names, "imbalance", "roc", "pr")


def hard_areas(rows: DataFrame) -> DataFrame:
    """cell, roc, pr, as metrics.areas has them, of the held-out rows by their leaf's majority. rows: cell, code, label, is_test."""
    held = lambda label: F.count_if(F.col("is_test") & (F.col("label") == label)).alias("np"[label])
    high = (F.sum(F.when(~F.col("is_test"), 2 * F.col("label") - 1)) > 0).alias("high")
    leaves = rows.groupBy("cell", "code").agg(high, held(0), held(1)).where("high is not null")
    of = lambda c, high: F.coalesce(F.sum(F.when(F.col("high") == high, F.col(c))), F.lit(0))
    sums = leaves.groupBy("cell").agg(*(of(c, high).alias(f"{c}{int(high)}") for c in "np" for high in (False, True)))
    pos, neg = F.col("p0") + F.col("p1"), F.col("n0") + F.col("n1")
    roc = (F.col("p1") * (neg - F.col("n1") + F.col("n1") / 2) + F.col("p0") * (F.col("n0") / 2)) / (pos * neg)
    top = F.when(F.col("p1") > 0, F.col("p1") * (F.col("p1") / (F.col("p1") + F.col("n1")))).otherwise(0.0)
    pr = (top + F.col("p0") * (pos / (pos + neg))) / pos
    two = (pos > 0) & (neg > 0)
    return sums.select("cell", F.when(two, roc).alias("roc"), F.when(two, pr).alias("pr"))
