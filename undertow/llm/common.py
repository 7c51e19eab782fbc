"""What the text operators share: tables, written stages, bounded lookup tables."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from undertow.sources.stage import stage_path

#: Bytes of text that a Python worker handles as one block.
BLOCK_BYTES = 2 << 20


#: Bytes of an Arrow batch, where the session has Spark's default: a worker holds a batch, whatever the length of its rows.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's rows. The first call of a session with Spark's default size of Arrow batches lowers it."""
    if spark.conf.get(BATCH_BYTES[0], BATCH_BYTES[1]) == BATCH_BYTES[1]:
        spark.conf.set(BATCH_BYTES[0], BATCH_BYTES[2])
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, per_core: int | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts the lineage, survives lost executors.

    per_core: how many files, made by a task each, the table has for each core of the cluster at most, for tables that are small
    beside the texts; but never less than an eighth of the partitions that the session shuffles to, since a cluster may have few
    cores when a plan is made and more when it runs.
    """
    spark = df.sparkSession
    if per_core:
        least = int(spark.conf.get("spark.sql.shuffle.partitions")) // 8
        df = df.coalesce(max(1, least, per_core * spark.sparkContext.defaultParallelism))
    path = stage_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of two numbers that are broadcast at most; more are joined by their keys.
FEW_ROWS = 200_000


def without(docs: DataFrame, gone: DataFrame, id_col: str, text_hash: Column, repeated: bool) -> DataFrame:
    """docs, with all their columns, without the rows that gone (columns id and hash) names by doc_id and a hash of the text;
    repeated: of other rows that agree in both, one stays. Own columns get names that docs don't have."""
    taken = {c.lower() for c in docs.columns}
    own_id, own_hash, nth = (next(n for k in range(len(taken) + 1) if (n := f"{name}_{k}") not in taken) for name in ("own_id", "own_hash", "nth"))
    keyed = docs.select("*", F.col(id_col).cast("long").alias(own_id), text_hash.alias(own_hash))
    named = gone.select(F.col("id").alias("gone_id_"), F.col("hash").alias("gone_hash_")).distinct()
    named = F.broadcast(named) if named.limit(FEW_ROWS + 1).count() <= FEW_ROWS else named
    kept = keyed.join(named, keyed[own_id].eqNullSafe(named["gone_id_"]) & (keyed[own_hash] == named["gone_hash_"]), "left_anti")
    if not repeated:
        return kept.select(*docs.columns)
    # Equal rows meet within the tasks first; of each group the first row's number there is left, and goes to its row.
    numbered = written(kept.withColumn(nth, F.monotonically_increasing_id()), "kept")
    first = numbered.groupBy(own_id, own_hash).agg(F.min(nth).alias(nth)).select(nth)
    return numbered.join(first, nth, "left_semi").select(*docs.columns)


def public_tokenizer(name: str) -> str:
    """Where a public vocabulary file lies on the driver; its content travels to the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


_KEPT: dict = {}


def kept_in_worker(key, make: Callable[[], Any]) -> Any:
    """What make returns, kept for a Python worker's next tasks. A worker keeps one thing at a time, the last asked for, so
    that the tables of several operators don't add up in it."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


class Lookup(dict):
    """A table of computed values with two generations, so that its size is bounded and frequent keys stay.

    ``map(table.__getitem__, keys)`` computes what is missing.
    """

    def __init__(self, compute: Callable[[Any], Any], limit: int = 200_000, longest: int = 256) -> None:
        super().__init__()
        self.compute, self.limit, self.longest, self.old = compute, limit, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
            if len(key) > self.longest:
                return value
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value


def release() -> None:
    """Give memory that this worker has freed back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:
        pass  # not the GNU library


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 65536) -> Iterator[np.ndarray]:
    """Batches of whole numbers as matrices of about as many rows or more, whatever the size of a batch."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(np.stack([c.to_numpy() for c in batch.columns], axis=1))
            n += batch.num_rows
        if n >= rows:
            yield np.concatenate(held)
            held, n = [], 0
    if held:
        yield np.concatenate(held)
    del held
    release()


def packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on as compressed byte planes. Small numbers cost little, sorted ones are best sent as steps."""
    wide = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T)
    return bytes([wide]) + pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def unpacked(raw: bytes, n: int) -> np.ndarray:
    """The n numbers that were packed."""
    planes = np.frombuffer(pa.Codec("zstd").decompress(raw[1:], raw[0] * n, asbytes=True), np.uint8).reshape(raw[0], n)
    out = np.zeros((n, 8), np.uint8)
    out[:, : raw[0]] = planes.T
    return out.reshape(-1).view("<u8").astype(np.uint64, copy=False)


def text_blocks(batches: Iterator[pa.RecordBatch], text_at: int, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches where their text column passes ``most`` bytes; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(lengths):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)
        del batch
    release()
