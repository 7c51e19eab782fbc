"""The corpus pipeline: toxic documents go, then exact and near copies, then repeated passages; the rest is packed.

Each stage is written as Parquet and read again as the next one's documents. A stage's intermediate tables go when the next
stage of the session begins, so a stage's result must be written before that, as run() and STAGES' users do.

Defined results, for every stage: a null text counts as empty, is not toxic by itself, and all empty texts are copies of each
other. Null values in other columns stay as they are. Rows are documents: rows that repeat a doc_id with another text are
documents of their own, of rows that agree in doc_id and text one stays from the exact stage on. Of exact copies the largest
doc_id stays, of near copies the smallest; null counts as smaller than any. Texts of any length are handled whole. All but
the last stage return the columns of their documents, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from undertow.llm import exact_dedup, packing, simhash, substring_dedup, toxicity
from undertow.llm.common import public_tokenizer, read_table
from undertow.sources.stage import folder, remove, stage_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: The folder of the last stage's intermediate tables, by session.
_LAST: dict[str, str] = {}


def _tidy(stage: Stage) -> Stage:
    """The stage, which removes the intermediate tables of the stage before it."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        session = spark.sparkContext.applicationId
        if session in _LAST:
            remove(spark, _LAST.pop(session))
        with folder(spark, stage.__name__) as path:
            _LAST[session] = path
            return stage(spark, docs, sf_dir)

    return run_stage


@_tidy
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the documents at hand."""
    weights, bias = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.kept(docs, weights, bias)


@_tidy
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


@_tidy
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


@_tidy
def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.without_duplicates(docs)


@_tidy
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizer(packing.TOKENIZER), with_ids=False).withColumnRenamed("payload", "ids_crc32")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("packing", pack),
]

#: Learned scores, fingerprints and tokens are beyond SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    at = stage_path(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        made.write.parquet(f"{at}/{name}")
        docs = spark.read.schema(made.schema).parquet(f"{at}/{name}")
        if i:
            remove(spark, f"{at}/{STAGES[i - 1][0]}")
    return docs
