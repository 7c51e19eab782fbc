"""Exact top-k inner products by a Voronoi kNN join.

Pivots, drawn from a bounded sample, split data and queries into cells, and a cell's rows into rings by their distance from the
line through the pivot. Summaries of the rings (most and least component along that line, most across it) bound the score of
any query with any row of a ring. Queries first meet the data of their own cell, which gives each query a score that its k-th
answer reaches at least. Then only the rings whose bound reaches a query's threshold are replicated to the query's group. How
much that saves depends on the data: clustered vectors leave a few hundredths of the rows, vectors without any structure in many
dimensions leave nearly all, since then no bound tells them apart.

Query groups are runs of neighbouring cells with about as many queries as a task holds; a cell with more is split. Each task
holds one bounded part of a query group and streams one bounded part of a ring past it, so a cell of any size is spread over
tasks; the parts' best answers are merged. Which group needs which ring is a table, not a part of the plan.

Components are floor(1024 * x). Scores are exact: float64 products while all sums stay under 2 ** 53, four products of halves while
they stay within a long, else Python integers. Ties go to the smaller vec_id.

Defined results: vectors that are null, or hold a null or a component that isn't finite, take no part. Very large components
take part: their rows are scored against everything by Python integers; a component counts as 2 ** 1000 at most. Scores beyond a
long are ranked by their exact values and returned as the nearest long. Shorter vectors count as ending in zeros; an empty vector
is all zeros; a long one is held with few others, which are not lengthened by it beyond a bounded block. Rows that repeat a
vec_id are candidates each, and queries each (with ranks of their own); no row with the query's own vec_id is a candidate. Rows
without vec_id take no part. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undertow.llm.common import FEW_ROWS, read_table, written

SCALE, EVERY, K = 1024, 100, 10
#: Rows of a bounded sample from which pivots are drawn, most pivots, rings of a cell, and rows of a query part and of a data part.
SAMPLE, PIVOTS, RINGS, QUERY_PART, DATA_PART = 4096, 256, 8, 4096, 8192
#: Vectors with a component from here on lie in a cell of their own, which no bound rules out.
HUGE, MOST = 2.0**40, 2.0**1000
#: Numbers in a block of vectors, all as long as its longest. Components beyond LONGEST don't help to choose pivots.
BLOCK, LONGEST = 1 << 22, 1 << 14
LONG = 1 << 63


def quantised(vectors: DataFrame, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and v: array<double> of whole numbers, of the vectors that take part."""
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    # floor gives a long; doubles from 2 ** 52 on are whole numbers.
    whole = lambda c: F.when(
        F.abs(c) < F.lit(2.0**52), F.floor(c).cast("double")
    ).otherwise(F.greatest(F.lit(-MOST), F.least(F.lit(MOST), c)))
    return rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & finite).select(
        "vec_id", F.transform("x", lambda c: whole(c * scale)).alias("v")
    )


def matrix(column: pa.ListArray, dim: int | None = None) -> np.ndarray:
    """Rows padded with zeros to the longest, or to dim."""
    lengths = np.diff(column.offsets.to_numpy())
    dim = int(lengths.max(initial=0)) if dim is None else dim
    flat = column.flatten().to_numpy()
    if dim and (lengths == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(column), dim))
    out[np.arange(dim) < lengths[:, None]] = flat
    return out


def blocks(column: pa.ListArray) -> Iterator[tuple[slice, np.ndarray]]:
    """Runs of rows as matrices of BLOCK numbers at most, or of one row."""
    lengths = np.diff(column.offsets.to_numpy())
    start = 0
    while start < len(column):
        wide = np.maximum.accumulate(lengths[start:])
        end = start + max(1, int((wide * np.arange(1, len(wide) + 1) <= BLOCK).sum()))
        yield slice(start, end), matrix(column.slice(start, end - start))
        start = end


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of different lengths."""
    wide = min(a.shape[1], b.shape[1])
    return a[:, :wide] @ b[:, :wide].T


def draw_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Some rounds of k-means from evenly spread rows of the sample."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    pivots = sample[np.linspace(0, len(sample) - 1, min(n, len(sample))).astype(int)].astype(float)
    for _ in range(5):
        near = nearest(sample.astype(float), pivots)
        counts = np.bincount(near, minlength=len(pivots))
        sums = np.zeros_like(pivots)
        np.add.at(sums, near, sample)
        pivots = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], pivots)
    return pivots


def nearest(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Each row's nearest pivot."""
    return ((pivots**2).sum(1) - 2 * inner(x, pivots)).argmin(1)


def lines(pivots: np.ndarray) -> np.ndarray:
    """The direction of each pivot; zeros for a pivot of zero."""
    norms = np.sqrt((pivots**2).sum(1, keepdims=True))
    return np.divide(pivots, norms, out=np.zeros_like(pivots), where=norms > 0)


def huge(x: np.ndarray) -> np.ndarray:
    return np.abs(x).max(1, initial=0) >= HUGE


def placed(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's cell (one more than the pivots' for huge rows), and its component along the pivot's line and across it."""
    cell, along, across = np.full(len(x), len(pivots)), np.zeros(len(x)), np.zeros(len(x))
    at = np.flatnonzero(~huge(x))
    if len(at):
        cell[at] = nearest(x[at], pivots)
        line, wide = lines(pivots)[cell[at]], min(x.shape[1], pivots.shape[1])
        along[at] = (x[at, :wide] * line[:, :wide]).sum(1)
        # What either has beyond the other's length is across the line.
        rest = (x[at, wide:] ** 2).sum(1) + along[at] ** 2 * (line[:, wide:] ** 2).sum(1)
        across[at] = np.sqrt(((x[at, :wide] - along[at, None] * line[:, :wide]) ** 2).sum(1) + rest)
    return cell, along, across


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: longs, or Python integers where one could be beyond a long."""
    wide = min(q.shape[1], x.shape[1])
    q, x = q[:, :wide], x[:, :wide]
    most = [float(np.abs(m).max(initial=0)) for m in (q, x)]
    bound = most[0] * most[1] * max(1, wide)
    if bound < 2**53:
        return (q @ x.T).astype(np.int64)
    if bound < 2**62 and max(most) < HUGE:
        out = np.zeros((len(q), len(x)), np.int64)
        # Halves have 21 bits at most, so the products of so many components stay under 2 ** 53.
        for i in range(0, wide, 1 << 11):
            (a, b), (c, d) = (_halves(m[:, i : i + (1 << 11)]) for m in (q, x))
            for left, right, shift in ((a, c, 42), (a, d, 21), (b, c, 21), (b, d, 0)):
                out += (left @ right.T).astype(np.int64) << shift
        return out
    whole = lambda m: np.array([[int(c) for c in row] for row in m], object).reshape(m.shape)
    return whole(q) @ whole(x).T if wide else np.zeros((len(q), len(x)), object)


def _halves(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    high = np.floor(m / 2.0**21)
    return high, m - high * 2.0**21


def order_key(score: int) -> bytes:
    """Bytes that order scores beyond a long as the scores themselves; of all others the same."""
    if -LONG <= score < LONG:
        return b"\x01"
    size = (abs(score).bit_length() + 7) // 8
    raw = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return b"\x02" + raw if score > 0 else b"\x00" + bytes(255 - c for c in raw)


def best(score: np.ndarray, ids: np.ndarray, own: int, k: int, least: int | None = None) -> np.ndarray:
    """Positions of the k highest scores from least on, ties to the smaller id, without the query's own id."""
    at = np.flatnonzero((ids != own) if least is None else (ids != own) & (score >= least).astype(bool))
    if score.dtype == object:
        return np.array(sorted(at.tolist(), key=lambda i: (-score[i], ids[i]))[:k], np.int64)
    if len(at) > k:
        kth = np.partition(score[at], len(at) - k)[len(at) - k]
        at = at[score[at] >= kth]
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def query_groups(queries: np.ndarray, pivots: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cell the group that its queries are in, and in how many parts. queries: how many a cell has."""
    group, parts = np.zeros(len(queries), np.int64), np.maximum(1, -(-queries // most))
    centred = pivots - pivots.mean(0)
    # Neighbouring cells follow each other along the direction in which the pivots differ most.
    order = np.append(
        np.argsort(centred @ np.linalg.svd(centred, full_matrices=False)[2][0]) if centred.any() else np.arange(len(pivots)), len(pivots)
    )
    now = held = 0
    for cell in order:
        if held and held + queries[cell] > most:
            now, held = now + 1, 0
        group[cell] = now
        held += queries[cell]
    # A group that a split cell shares with others would be held whole in each part.
    for cell in np.flatnonzero(parts > 1):
        group[cell] = now = now + 1
    return group, parts


class Rings:
    """Bounds on the scores of the rows in each ring, from summaries: cell, ring, low and high along the pivot's line, across."""

    def __init__(self, pivots: np.ndarray, summary: list) -> None:
        self.lines = lines(pivots)
        self.cell = np.array([r.cell for r in summary], np.int64)
        self.ring = np.array([r.ring for r in summary], np.int64)
        self.low, self.high, self.across = (np.array([r[c] for r in summary], float) for c in ("low", "high", "across"))

    def needed(self, q: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Query by ring: whether a row of the ring may score as high as least."""
        free = huge(q)
        q = np.where(free[:, None], 0, q)
        ours = np.minimum(self.cell, len(self.lines) - 1)
        along = inner(q, self.lines)[:, ours]
        across = np.sqrt(np.maximum((q**2).sum(1)[:, None] - along**2, 0))
        bound = np.maximum(along * self.low, along * self.high) + across * self.across
        # Room for rounding: about 2 ** -40 of the largest product of lengths.
        room = 1e-12 * np.sqrt((q**2).sum(1))[:, None] * (np.maximum(np.abs(self.low), np.abs(self.high)) + self.across) + 1e-6
        return free[:, None] | (self.cell == len(self.lines)) | (bound + room >= least[:, None])


def small(table: DataFrame) -> DataFrame:
    """The table, to be broadcast if it has few rows."""
    return F.broadcast(table) if table.limit(FEW_ROWS + 1).count() <= FEW_ROWS else table


def solved(queries: DataFrame, data: DataFrame, pairs: DataFrame, k: int, own_cell: bool) -> DataFrame:
    """row, query_id, vec_id, score, beyond: the best answers of each query part from each data part. pairs: group, part, cell, ring and
    parts (of the data there). own_cell: whether queries meet the data of their own cell alone, or of all other cells."""
    pairs = small(pairs)
    keys = ["group", "part", "cell", "ring", "data_part"]
    sent = queries.withColumnRenamed("cell", "own").join(pairs, ["group", "part"])
    sent = sent.where("own = cell" if own_cell else "own <> cell").withColumn(
        "data_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    )
    spread = data.join(pairs, ["cell", "ring"]).withColumn("data_part", F.pmod("salt", "parts"))
    columns = [*(F.col(c).cast("long") for c in keys), F.col("side"), "row", "vec_id", "v", "least"]
    sent, spread = sent.withColumn("side", F.lit(0)).select(columns), spread.withColumns(
        {"side": F.lit(1), "least": F.lit(None).cast("long")}
    ).select(columns)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(i).to_numpy() for i in range(6)], 1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
                run, here = batch.slice(start, end - start), tuple(key[start, :5])
                if key[start, 5] == 0 and at != here:
                    # A part of queries may go on from the batch before.
                    held, at = [], here
                if at != here:
                    continue
                ids, rows = run.column(7).to_numpy(), run.column(6).to_numpy()
                for part, x in blocks(run.column(8)):
                    if key[start, 5] == 0:
                        held.append((rows[part], ids[part], x, np.array(run.column(9).slice(part.start, len(x)).to_pylist(), object)))
                    else:
                        for asked in held:
                            yield answered(asked, ids[part], x)

    def answered(asked: tuple, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        rows, own, q, least = asked
        s = scores(q, x)
        found = [best(s[i], ids, int(own[i]), k, least[i]) for i in range(len(s))]
        for i, f in enumerate(found):
            if len(f) == k:
                # What follows must reach the k-th score found here.
                least[i] = int(s[i, f[-1]])
        who = np.repeat(np.arange(len(s)), [len(f) for f in found])
        which = np.concatenate([np.zeros(0, np.int64), *found])
        exact = s[who, which]
        keys = [order_key(v) for v in exact] if s.dtype == object else [b"\x01"] * len(exact)
        exact = np.array([max(-LONG, min(LONG - 1, v)) for v in exact], np.int64) if s.dtype == object else exact
        return pa.RecordBatch.from_arrays(
            [pa.array(rows[who]), pa.array(own[who]), pa.array(ids[which]), pa.array(exact), pa.array(keys, pa.binary())],
            names=["row", "query_id", "vec_id", "score", "beyond"],
        )

    both = sent.unionByName(spread).repartition(*keys).sortWithinPartitions(*keys, "side")
    return both.mapInArrow(solve, "row long, query_id long, vec_id long, score long, beyond binary")


def top_k(
    vectors: DataFrame,
    k: int = K,
    every: int = EVERY,
    scale: int = SCALE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    pivots: int | None = None,
    query_part: int = QUERY_PART,
    data_part: int = DATA_PART,
) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each query, a row whose vec_id is divisible by every."""
    spark = vectors.sparkSession
    plain = written(quantised(vectors, scale, id_col, vector_col), "vectors")
    n, numbers = plain.agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    # Parts of long vectors have fewer rows.
    query_part, data_part = (min(most, max(1, 4 * BLOCK * n // max(1, numbers))) for most in (query_part, data_part))
    # A bounded sample of bounded rows; at most BLOCK numbers of it are used.
    drawn = plain.select("vec_id", F.slice("v", 1, LONGEST).alias("v")).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    sample = next((x for _, x in blocks(drawn["v"].combine_chunks())), np.zeros((0, 0))) if n else np.zeros((0, 0))
    sample = sample[~huge(sample)]
    centres = draw_pivots(sample, min(PIVOTS, max(1, int(n**0.5) // 2)) if pivots is None else pivots)
    cell, _, across = placed(sample, centres)
    edges = np.array(
        [np.quantile(across[cell == c], np.arange(1, RINGS) / RINGS) if (cell == c).any() else np.zeros(RINGS - 1) for c in range(len(centres) + 1)]
    )

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in blocks(batch.column(1)):
                cell, along, across = placed(x, centres)
                ring = (across[:, None] > edges[cell]).sum(1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(part.start, len(x)).columns, *(pa.array(c) for c in (cell, ring, along, across))],
                    names=["vec_id", "v", "cell", "ring", "along", "across"],
                )

    rows = plain.mapInArrow(
        assign, "vec_id long, v array<double>, cell long, ring long, along double, across double"
    ).withColumn("row", F.monotonically_increasing_id())
    rows = written(rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(1 << 20))), "cells")
    is_query = F.col("vec_id") % every == 0
    # At most (PIVOTS + 1) * RINGS rows.
    summary = rows.groupBy("cell", "ring").agg(
        F.count("*").alias("n"),
        F.count_if(is_query).alias("queries"),
        F.min("along").alias("low"),
        F.max("along").alias("high"),
        F.max("across").alias("across"),
    ).collect()
    group, parts = query_groups(
        np.bincount([r.cell for r in summary], [r.queries for r in summary], len(centres) + 1).astype(np.int64), centres, query_part
    )
    table = lambda rows_, schema: F.broadcast(spark.createDataFrame(rows_, schema))  # noqa: E731  bounded like the summary
    in_parts = lambda count: -(-int(count) // data_part)
    by_cell = np.bincount([r.cell for r in summary], [r.n for r in summary], len(centres) + 1)
    cells = table([(c, -1, in_parts(by_cell[c])) for c in range(len(by_cell)) if by_cell[c]], "cell long, ring long, parts long")
    rings = table([(r.cell, r.ring, in_parts(r.n)) for r in summary], "cell long, ring long, parts long")
    place = table([(c, int(group[c]), int(parts[c])) for c in range(len(group))], "cell long, `group` long, splits long")

    queries = rows.where(is_query).join(place, "cell").select("row", "vec_id", "v", "cell", "group", F.pmod("salt", "splits").alias("part"))
    data = rows.select("row", "vec_id", "v", "cell", "ring", "salt")
    none = F.lit(None).cast("long").alias("least")
    own = written(
        solved(
            queries.select("*", none),
            data.withColumn("ring", F.lit(-1).cast("long")),
            queries.select("group", "part", "cell").distinct().join(cells, "cell"),
            k,
            True,
        ),
        "own",
    )
    ordered = Window.partitionBy("row").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    ranked = own.withColumn("rank", F.row_number().over(ordered))
    # A score at the lower end may stand for one below it, and is no bound.
    kth = ranked.where(F.col("rank") == k).select("row", F.when(F.col("score") > -LONG, F.col("score")).alias("least"))
    asked = written(queries.join(kth, "row", "left"), "queries")
    bounds = Rings(centres, summary)

    def need(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = np.array([-np.inf if x is None else float(x) for x in batch.column(4).to_pylist()])
            group, part, cell = (batch.column(i).to_numpy() for i in range(3))
            for rows, q in blocks(batch.column(3)):
                who, which = np.nonzero(bounds.needed(q, least[rows]) & (cell[rows][:, None] != bounds.cell))
                found = np.unique(np.stack([group[rows][who], part[rows][who], bounds.cell[which], bounds.ring[which]], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found.T], names=["group", "part", "cell", "ring"])

    pairs = asked.select("group", "part", "cell", "v", "least").mapInArrow(need, "`group` long, part long, cell long, ring long").distinct()
    pairs = written(pairs.join(rings, ["cell", "ring"]), "pairs")
    answers = own.union(solved(asked, data, pairs, k, False))
    return answers.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )


def op9_vector_search(spark, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"))


ORACLE = {
    "op9_vector_search": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as q from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (
            select a.vec_id as query_id, b.vec_id, cast(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) as bigint) as score
            from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0)
        select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
        from s qualify rank <= 10"""
}
