"""Readers and writers: transactions, edge lists, pattern files, measures, labels, result logs, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from undertow.sources.stage import staged

#: The transaction columns. Accounts, banks and amounts are read as text, so no digits are lost.
TRANSACTIONS = StructType(
    [
        StructField("timestamp", StringType()),
        StructField("from_bank", StringType()),
        StructField("from_account", StringType()),
        StructField("to_bank", StringType()),
        StructField("to_account", StringType()),
        StructField("amount_received", StringType()),
        StructField("receiving_currency", StringType()),
        StructField("amount_paid", StringType()),
        StructField("payment_currency", StringType()),
        StructField("payment_format", StringType()),
        StructField("is_laundering", IntegerType()),
    ]
)
EDGES = StructType([StructField("source", LongType()), StructField("target", LongType())])
#: The known laundering patterns.
PATTERNS = ["FAN-OUT", "FAN-IN", "GATHER-SCATTER", "SCATTER-GATHER", "CYCLE", "RANDOM", "BIPARTITE", "STACK"]
CHUNKS = 30


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """Transactions from CSV, by position: the header's repeated names are not used."""
    return spark.read.schema(TRANSACTIONS).option("header", True).option("enforceSchema", True).csv(path)


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EDGES).option("header", True).csv(path)


def graph_from_transactions(spark: SparkSession, path: str, directed: bool = False) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of a transaction file."""
    from undertow.operators.graph import edges, nodes

    pairs = read_transactions(spark, path).select("from_account", "to_account")
    return nodes(pairs, "from_account", "to_account"), edges(pairs, "from_account", "to_account", directed)


def graph_from_edge_list(spark: SparkSession, path: str, directed: bool = False) -> tuple[DataFrame, DataFrame]:
    from undertow.operators.graph import edges, nodes

    pairs = read_edge_list(spark, path)
    return nodes(pairs, "source", "target"), edges(pairs, "source", "target", directed)


def _text_lines(spark: SparkSession, path: str, blank: bool) -> DataFrame:
    """value, file, start (of the block that a task read) and at (ascending within a block), with or without blank lines."""
    lines = spark.read.text(path).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    return staged((lines if blank else lines.where("trim(value) <> ''")).withColumn("at", F.monotonically_increasing_id()), "lines")


def line_numbers(spark: SparkSession, path: str) -> DataFrame:
    """line and number: the lines of text files, numbered from 0 in each file's order, files by name; blank lines and each file's
    first line, its header, are not counted.

    Each block of a file is read by one task in order, so a line's number is its place there after the lines of all blocks before;
    those are a row a block.
    """
    rows = _text_lines(spark, path, blank=False)
    blocks = rows.groupBy("file", "start").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    # The header is the first line of a file's first block with a line.
    heads = blocks.groupBy("file").agg(F.min("start").alias("start"), F.lit(1).alias("head"))
    placed = blocks.join(heads, ["file", "start"], "left").withColumn("head", F.coalesce("head", F.lit(0)))
    placed = placed.withColumn("before", F.coalesce(F.sum(F.col("n") - F.col("head")).over(earlier), F.lit(0)))
    at = F.col("at") - F.col("first") - F.col("head")
    return rows.join(placed, ["file", "start"]).where(at >= 0).select(F.col("value").alias("line"), (F.col("before") + at).alias("number"))


def read_synthetic_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels of generated nodes: node and four booleans. In files without a node column a row's position is its node."""
    rows = spark.read.option("header", True).csv(path)
    flags = ["laundering", "separate", "new_mules", "existing_mules"]
    if "node" not in rows.columns:
        cells = F.split(F.rtrim("line"), ",")
        names = rows.columns
        rows = line_numbers(spark, path).select(F.col("number").alias("node"), *(F.get(cells, F.lit(i)).alias(n) for i, n in enumerate(names)))
    return rows.select(
        F.col("node").cast("long").alias("node"), *(F.coalesce(F.lower(F.trim(f)).isin("true", "1"), F.lit(False)).alias(f) for f in flags)
    )


def pattern_rows(spark: SparkSession, path: str) -> DataFrame:
    """identifier and pattern of each transaction line between BEGIN and END lines of pattern files.

    Files are read in blocks: a line belongs to the last BEGIN or END line before it in its block, or else to the last one of the
    file's blocks before, which are a row a block. Blank lines inside an attempt are kept. An unknown pattern is an error when it
    has a line.
    """
    name = F.trim(F.regexp_extract("value", r"^BEGIN.*? - ([^:]*)", 1))
    mark = F.when(F.col("value").startswith("BEGIN"), F.struct(F.lit(True).alias("inside"), name.alias("pattern"))).when(
        F.col("value").startswith("END"), F.struct(F.lit(False).alias("inside"), F.lit("").alias("pattern"))
    )
    rows = _text_lines(spark, path, blank=True).withColumn("mark", mark)
    last = rows.where("mark is not null").groupBy("file", "start").agg(F.max_by("mark", "at").alias("mark"))
    blocks = rows.select("file", "start").distinct().join(last, ["file", "start"], "left")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("file", "start", F.last("mark", ignorenulls=True).over(before).alias("carried"))
    within = Window.partitionBy("file", "start").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("own", F.last("mark", ignorenulls=True).over(within)).join(carried, ["file", "start"])
    found = placed.where("mark is null").withColumn("of", F.coalesce("own", "carried")).where("of.inside")
    known = F.when(F.col("of.pattern").isin(PATTERNS), F.col("of.pattern")).otherwise(
        F.raise_error(F.concat(F.lit("unknown pattern: "), "of.pattern")).cast("string")
    )
    return found.select(F.trim("value").alias("identifier"), known.alias("pattern"))


def one_hot(rows: DataFrame) -> DataFrame:
    """identifier and a 0/1 column per pattern."""
    return rows.select("identifier", *((F.col("pattern") == p).cast("int").alias(p) for p in PATTERNS))


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    return one_hot(pattern_rows(spark, path))


def read_measures(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A measures table, Parquet or CSV; only the wanted columns are read."""
    if path.rstrip("/").endswith(".csv"):
        names = spark.read.option("header", True).csv(path).columns
        kinds = StructType(
            [StructField(n, StringType() if n == "node" else DoubleType() if n.startswith(("measure", "score")) else LongType()) for n in names]
        )
        rows = spark.read.schema(kinds).option("header", True).csv(path)
    else:
        rows = spark.read.parquet(path)
    return rows.select(*columns) if columns else rows


def write_table(df: DataFrame, path: str, as_csv: bool = False, mode: str = "overwrite") -> None:
    (df.write.mode(mode).option("header", True).csv(path)) if as_csv else df.write.mode(mode).parquet(path)


def metric_matrix(metrics: DataFrame, metric: str, columns: list[str], row: str = "cutoff", column: str = "target") -> DataFrame:
    """A metric of the long table (cutoff, target, metric, value) as a matrix."""
    return metrics.where(F.col("metric") == metric).groupBy(row).pivot(column, columns).agg(F.first("value"))


def merged_results(left: DataFrame, right: DataFrame, on: str, suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Two result tables side by side, by the rows that both have; columns that both have get a suffix."""
    both = {c for c in left.columns if c in right.columns and c != on}
    named = [t.select(*(F.col(f"`{c}`").alias(c + suffix if c in both else c) for c in t.columns)) for t, suffix in zip((left, right), suffixes, strict=True)]
    return named[0].join(named[1], on)


def append_log(spark: SparkSession, path: str, key: str, value: str) -> None:
    """Add a line ``key: value`` to a log folder."""
    spark.createDataFrame([(f"{key}: {value}",)], "value string").coalesce(1).write.mode("append").text(path)


def result_log(lines: DataFrame) -> DataFrame:
    """dataset, pattern, cutoff, roc, pr from metric log lines ``dataset_pattern_cutoff [names]: [roc, pr]``; values that
    can't be read are 0."""
    v = F.col("value")
    key = F.split(F.trim(v), "_")
    pair = F.from_json(F.regexp_extract(v, r":\s*(\[[^\]]*\])\s*$", 1), "array<double>")
    number = lambda i: F.coalesce(F.try_element_at(pair, F.lit(i)), F.lit(0.0))
    return lines.where(F.trim(v) != "").select(
        key[0].alias("dataset"),
        F.try_element_at(key, F.lit(2)).alias("pattern"),
        F.split(F.try_element_at(key, F.lit(3)), " ")[0].try_cast("double").alias("cutoff"),
        number(1).alias("roc"),
        number(2).alias("pr"),
    )


def synthetic_result_log(lines: DataFrame) -> DataFrame:
    """dataset and values (an array per target) from lines ``dataset ...: [[roc, pr], ...]``."""
    parts = F.split("value", ":", 2)
    return lines.where(F.trim("value") != "").select(
        F.split(parts[0], r"\s+")[0].alias("dataset"), F.from_json(F.trim(F.get(parts, F.lit(1))), "array<array<double>>").alias("values")
    )


def time_log(lines: DataFrame) -> DataFrame:
    """dataset, size (of a generated dataset, else null), seconds from lines ``dataset: seconds``."""
    words = F.split(F.trim("value"), r"\s+")
    name = F.regexp_replace(words[0], ":$", "")
    return lines.where(F.trim("value") != "").select(
        name.alias("dataset"),
        F.try_element_at(F.split(name, "_"), F.lit(3)).try_cast("int").alias("size"),
        F.element_at(words, -1).try_cast("double").alias("seconds"),
    )


def row_numbers(rows: DataFrame, *order: str | Column) -> DataFrame:
    """Rows with a global row index from 0 in the given order, without sorting all in one task: rows are dealt by ranges,
    and each range starts where the counts of those before it end."""
    part = staged(rows.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()), "ranges")
    local = part.withColumn("in_", F.row_number().over(Window.partitionBy("range_").orderBy(*order)) - 1)
    before = F.coalesce(F.sum("n_").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = local.groupBy("range_").agg(F.count("*").alias("n_")).select("range_", before.alias("start_"))
    return local.join(F.broadcast(starts), "range_").withColumn(
        "row_index", (F.col("start_") + F.col("in_")).cast("long")
    ).drop("range_", "in_", "start_")  # one row a range is broadcast


def chunks(rows: DataFrame, *order: str, k: int = CHUNKS) -> DataFrame:
    """Rows with their chunk of k: equal row ranges in the given order, the last with the remainder."""
    n = F.broadcast(rows.agg(F.floor(F.count("*") / k).alias("size_")))
    at = F.when(F.col("size_") == 0, k - 1).otherwise(F.least(F.floor(F.col("row_index") / F.when(F.col("size_") > 0, F.col("size_"))), F.lit(k - 1)))
    return row_numbers(rows, *order).join(n).withColumn("chunk", at.cast("int")).drop("size_", "row_index")


def write_chunks(rows: DataFrame, path: str, *order: str, k: int = CHUNKS) -> None:
    chunks(rows, *order, k=k).write.mode("overwrite").partitionBy("chunk").parquet(path)


def merge_chunks(spark: SparkSession, path: str, money: tuple[str, ...] = ("amount_received", "amount_paid")) -> DataFrame:
    """All chunks again, with money always of two decimals."""
    rows = spark.read.parquet(path).drop("chunk")
    return rows.select(*(F.format_string("%.2f", F.col(c).cast("double")).alias(c) if c in money else F.col(c) for c in rows.columns))
