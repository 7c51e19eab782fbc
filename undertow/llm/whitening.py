"""Embedding whitening by a two-pass covariance.

Vectors become whole numbers, of which each distinct vector is fitted once. The first pass adds up whole numbers, so the sums, and
with them the mean, are exact. The second pass centres a block of rows, multiplies it with itself (GEMM) and adds the products up;
partial sums meet by treeAggregate, of which a handful reach the driver, each as large as the covariance. LAPACK's symmetric
eigensolver gives the components, which are broadcast, as many numbers as dimensions times components, to project all rows. A third
pass over the fit list measures how far the result's covariance is from the identity.

Rows are centred by the whole part of the mean in whole numbers and then by its fraction, so nothing is lost to an offset.

Defined results: vectors that are null, or hold a null or a component that isn't finite, take no part; neither do vectors of
another length than the most frequent one (of equally frequent lengths, the greatest). Whole numbers are kept within 2 ** 62 either
way. Rows that repeat a vec_id are rows each, with or without the same vector; a null vec_id stays null. A component whose variance
is not above 1e-11 of the greatest (fewer distinct vectors than dimensions, constant dimensions) explains next to nothing: its
whitened values are null, and it is no part of identity_error, which is null if no component is left. A deviation beyond a long is null. Vectors of
no length have no components, an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.llm.common import read_table, release, written

#: The contract's: parts of a unit, what is added, and components that are returned at most.
SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
MOST = 2.0**62
#: Share of the greatest variance up to which a component counts as without any.
NONE = 1e-11
#: Partial sums that meet at once.
MEET = 8


def quantised(vectors: DataFrame, scale: int = SCALE, offset: int = OFFSET, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and x: array<long>, of the vectors that take part."""
    finite = F.forall("c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("c"))
    rows = rows.where(F.col("c").isNotNull() & finite)
    length = rows.groupBy(F.size("c").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    whole = lambda c: F.floor(F.greatest(F.lit(-MOST), F.least(F.lit(MOST), c * scale))) + offset
    return rows.where(F.size("c") == (length.dim if length else 0)).select("vec_id", F.transform("c", whole).alias("x"))


def rows_of(column: pa.ListArray) -> np.ndarray:
    """Vectors of one length as a matrix of whole numbers."""
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def met(parts: DataFrame, merge: Callable) -> tuple | None:
    """The rows of parts merged two by two over the tasks; the driver merges MEET and some at the end."""
    rdd = parts.rdd.map(tuple)
    depth = max(2, math.ceil(math.log(max(2, rdd.getNumPartitions()), MEET)))
    step = lambda a, b: b if a is None else a if b is None else merge(a, b)
    return rdd.treeAggregate(None, step, step, depth)


def exact_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """How many vectors there are, and each dimension's sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = 0, 0, 0
        for batch in batches:
            if batch.num_rows:
                x = rows_of(batch.column(0))
                # Halves, whose sums stay within a long for 2 ** 31 rows.
                n, low, high = n + len(x), low + (x & 0xFFFFFFFF).sum(0), high + (x >> 32).sum(0)
        if n:
            yield pa.RecordBatch.from_pylist([{"n": n, "low": low, "high": high}], SUMS)

    halves = fit.mapInArrow(run, "n long, low array<long>, high array<long>")
    found = met(halves, lambda a, b: (a[0] + b[0], *([x + y for x, y in zip(a[i], b[i], strict=True)] for i in (1, 2))))
    return (found[0], [low + (high << 32) for low, high in zip(found[1], found[2], strict=True)]) if found else (0, [])


SUMS = pa.schema([("n", pa.int64()), ("low", pa.list_(pa.int64())), ("high", pa.list_(pa.int64()))])


def moments(fit: DataFrame, made: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray] | None:
    """The sums and the sums of outer products of the rows that made gives for a block of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = products = None
        for batch in batches:
            if batch.num_rows:
                z = made(rows_of(batch.column(0)))
                total, products = (z.sum(0), z.T @ z) if total is None else (total + z.sum(0), products + z.T @ z)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()]), pa.array([products.tobytes()])], names=["total", "products"])
        release()

    parts = fit.mapInArrow(run, "total binary, products binary")
    add = lambda a, b: (np.frombuffer(a) + np.frombuffer(b)).tobytes()
    found = met(parts, lambda a, b: (add(a[0], b[0]), add(a[1], b[1])))
    if not found:
        return None
    total, products = np.frombuffer(found[0]), np.frombuffer(found[1])
    return total, products.reshape(len(total), len(total))


@dataclass
class Whitening:
    """n vectors with their sums; unit components as columns with their variances, both by falling variance; all variance."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def scales(self) -> np.ndarray:
        """What a component's projections are divided by; NaN without any variance."""
        some = self.variances > NONE * max(self.variances.max(initial=0), 0)
        return np.sqrt(np.where(some, self.variances, np.nan))

    @property
    def explained(self) -> list[float | None]:
        return [max(0.0, float(e)) / self.trace if self.trace > 0 else None for e in self.variances]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n, without loss to what is common to x and the mean."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n / n for s in sums])
    return (x - whole).astype(np.float64) - rest


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Each row's sum of (n * x - sums) ** 2, exactly; null beyond a long."""
    whole, rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)
    d = x - whole
    most, wide = int(np.abs(d).max(initial=0)) + 1, max(1, x.shape[1])
    if (n * most) ** 2 * wide < 1 << 62:
        return ((n * d - rest) ** 2).sum(1).tolist()
    if most * max(n, most) * wide < 1 << 62:
        # The square of n * d - rest in three sums that each fit.
        parts = zip((d * d).sum(1).tolist(), (d * rest).sum(1).tolist(), strict=True)
        last = sum(int(r) ** 2 for r in rest)
        found = [n * n * a - 2 * n * b + last for a, b in parts]
    else:
        found = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in found]


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """From the fit list: one column x with distinct vectors of one length."""
    n, sums = exact_sums(fit)
    if not n or not sums:
        return None
    _, products = moments(fit, lambda x: centred(x, n, sums))
    covariance = products / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    vectors = vectors[:, order]
    # Either sign would do; the entry of the greatest size is made positive.
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    model = Whitening(n, sums, vectors, values[order], float(np.trace(covariance)))
    some = np.isfinite(model.scales)
    if some.any():
        projection = (vectors / model.scales)[:, some]
        total, squares = moments(fit, lambda x: centred(x, n, sums) @ projection)
        mean = total / n
        model.identity_error = float(np.abs(squares / n - np.outer(mean, mean) - np.eye(len(mean))).max())
    return model


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, deviation, whitened: array<double> of the components, for rows of vec_id and x."""
    sent = rows.sparkSession.sparkContext.broadcast((model.n, model.sums, model.components, model.scales))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, components, scales = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = rows_of(batch.column(1))
            found = (centred(x, n, sums) @ components / scales).reshape(-1)
            ends = np.arange(0, len(found) + 1, len(scales), dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(found, from_pandas=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(deviations(x, n, sums), pa.int64()), lists], names=["vec_id", "deviation", "whitened"]
            )
        release()

    return rows.select("vec_id", "x").mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, components: int = COMPONENTS, **options) -> DataFrame:
    """A row for each vector that takes part and each component, by falling variance."""
    rows = quantised(vectors, **options)
    # Equal vectors meet within the tasks first, so one that repeats often is sent as often as there are tasks.
    model = fit_whitening(written(rows.select("x").distinct(), "fit"), components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], RESULT)
    number = lambda x: F.lit(x).cast("double")
    explained = F.array(*map(number, model.explained))
    return whiten(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        explained[F.col("at")].alias("explained"),
        number(model.identity_error).alias("identity_error"),
    )


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened(read_table(spark, sf_dir, "embeddings"))
