"""Contiguous shards of nearly equal bytes, from global prefix sums.

Rows are put in order over ranges of their keys, once. Each range sums up its own sizes row by row; the ranges' totals, a row for
each, give what lies before a range, and so every row its place in the corpus in bytes. Equal targets cut there: a row goes to the
shard in which its middle lies, so each cut is the row's end nearest to its target and a shard misses the target by half a row at
each end, at most. Slots count a shard's rows in the same order.

Order: id, size, CRC-32 of the text. Rows that agree in all three are told apart by where they were read, so that any number of
them is dealt over ranges. Equal texts are not kept together: a group of them may be larger than a shard.

Defined results: a null text has no bytes; a text of any length is one row whole, which alone may exceed a shard's target, and then
the shards that it spans stay empty. A null id counts as the least. Rows that repeat an id, or all of a row, are rows each. With
fewer rows than shards some shards are empty; an empty table gives an empty result. Columns keep their names; own columns of the
documents that are called shard or slot, in any case, are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from undertow.llm.common import read_table, written

#: The contract's: shards, and bytes of a row besides its text.
SHARDS, OVERHEAD = 40, 16


def running(ordered: DataFrame) -> DataFrame:
    """The rows of each partition, in their order, with part, before (bytes before the row in the partition) and nth (rows before
    it). The column size holds the bytes."""
    at = ordered.columns.index("size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = rows = 0
        for batch in batches:
            sizes = batch.column(at).to_numpy()
            ends = held + np.cumsum(sizes)
            new = pa.array(ends - sizes), pa.array(rows + np.arange(len(sizes)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "before", "nth"])
            held, rows = int(ends[-1]) if len(ends) else held, rows + len(sizes)

    schema = StructType([*ordered.schema.fields, StructField("before", LongType()), StructField("nth", LongType())])
    return ordered.mapInArrow(run, schema)


def cut(sized: DataFrame, keys: list[str], shards: int = SHARDS) -> DataFrame:
    """The rows of a table with a column size, and shard and slot, in the order of keys."""
    spark = sized.sparkSession
    tied = sized.withColumn("tie", F.monotonically_increasing_id())
    # The last key deals rows that agree in all others over ranges, too.
    ordered = tied.repartitionByRange(*keys, "tie").sortWithinPartitions(*keys, "tie").withColumn("part", F.spark_partition_id())
    # Written once, so that all that follows sees the same ranges, also after executors were lost.
    table = written(running(ordered), "ranges")
    # A row for each range: as many as the session shuffles to.
    totals = sorted(tuple(r) for r in table.groupBy("part").agg(F.sum("size"), F.count("*")).collect())
    starts, held, rows = [], 0, 0
    for part, size, n in totals:
        starts.append((part, held, rows))
        held, rows = held + size, rows + n
    schema = "part int, part_before long, part_rows long"
    placed = table.join(F.broadcast(spark.createDataFrame(starts, schema)), "part")
    # Twice the row's middle, times the shards, by twice the total; in decimals, so exact at any size.
    middle = "cast((part_before + before) * 2 + size as decimal(20, 0))"
    number = f"cast(least({middle} * {shards} div cast({max(1, 2 * held)} as decimal(20, 0)), {shards - 1}) as int)"
    numbered = placed.withColumn("shard", F.expr(number)).withColumn("row_", F.col("part_rows") + F.col("nth"))
    firsts = numbered.groupBy("shard").agg(F.min("row_").alias("first_"))  # a row for each shard
    return numbered.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("row_") - F.col("first_")).select(*sized.columns, "shard", "slot")


def shard_documents(docs: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with all their columns, and shard and slot. Whole rows move once."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    sized = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in kept)).alias("document"),
        F.col(id_col).cast("long").alias("id"),
        (F.octet_length(text).cast("long") + overhead).alias("size"),
        F.crc32(text).alias("crc"),
    )
    return cut(sized, ["id", "size", "crc"], shards).select("document.*", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, **options) -> None:
    """Write each shard as a folder shard=N of Parquet files. A shard is written by all tasks that hold a range of it, each range in
    the order of its slots."""
    shard_documents(docs, shards, **options).write.partitionBy("shard").parquet(path)


def op11_sharding(spark, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    # Texts are read once: what is put in order are these three numbers.
    sizes = read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    return cut(written(sizes, "sizes"), ["doc_id", "size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


ORACLE = {
    "op11_sharding": """
        with crc_table as (
            select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
                case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as t),
        bytes as (
            select doc_id, strlen(coalesce(text, '')) + 16 as size,
                list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda p: cast('0x' || p as bigint)) as b
            from documents),
        sized as (
            select doc_id, size, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), cast(4294967295 as bigint)), 4294967295) as text_crc32
            from bytes, crc_table),
        placed as (
            select *, row_number() over w as nth, sum(size) over w - size as start, sum(size) over () as total
            from sized window w as (order by doc_id nulls first, size, text_crc32 rows unbounded preceding)),
        cut as (select *, cast(least(((2 * start + size) * 40) // (2 * total), 39) as integer) as shard from placed)
        select doc_id, size, text_crc32, 'bytes' as law, shard, nth - min(nth) over (partition by shard) as slot,
            cast(null as integer) as grown_shard
        from cut"""
}
