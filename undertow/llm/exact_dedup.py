"""Exact duplicates by content-defined chunk recipes, in DataFrame operations only.

A text is cut where its content says so (after a run of seven characters of a fixed class, with a shortest and a
longest chunk), so equal texts get equal chunks. One scan turns each text into its recipe: per chunk a 64-bit
identifier and 120 bits of the chunk's SHA-256. The chunk store then holds each identifier once and verifies it: if two
chunks with different digests share an identifier anywhere, the recipes are compared with the digests as part of the
identifiers. Documents are equal when their ordered identifier lists are. After the first scan only recipes move, about
a hundredth of the text.

Defined results: a null text counts as empty, and empty texts are equal to each other. Rows are documents, so a repeated
doc_id is another document; among rows that agree in text and doc_id exactly one stays. A null doc_id sorts below all
others. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertow.llm.common import without, written

#: Fixed values of the chunker: the class whose runs end a chunk, the run's length, and the bounds in characters.
CUT_CLASS, CUT_RUN, SHORTEST, LONGEST = "[aceimoqsuwy02468 ]", 7, 256, 4096


def chunks(text: Column, shortest: int = SHORTEST, longest: int = LONGEST) -> Column:
    """The content-defined chunks of a text, in order; joined they are the text."""
    pattern = f"(?s).{{{shortest},{longest}}}?{CUT_CLASS}{{{CUT_RUN}}}|.{{1,{longest}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _digest_part(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 15), 16, 10).cast("bigint")


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", id_bits: int = 64) -> DataFrame:
    """doc_id, row, text_sha256, recipe: array<struct<h, v1, v2>>. Fewer id_bits make identifiers collide, for tests."""
    text = F.coalesce(F.col("text"), F.lit(""))
    h = (lambda c: F.xxhash64(c)) if id_bits == 64 else (lambda c: F.pmod(F.xxhash64(c), F.lit(1 << id_bits)))

    def entry(c: Column) -> Column:
        return F.struct(h(c).alias("h"), F.sha2(c.cast("binary"), 256).alias("d"))

    def parts(e: Column) -> Column:
        return F.struct(e["h"].alias("h"), _digest_part(e["d"], 1).alias("v1"), _digest_part(e["d"], 16).alias("v2"))

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).select(
        "doc_id", F.monotonically_increasing_id().alias("row"), F.sha2(text.cast("binary"), 256).alias("text_sha256"), F.transform(F.transform(chunks(text), entry), parts).alias("recipe")
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", id_bits: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. The largest doc_id of a group stays."""
    table = written(recipes(docs, id_col, text_col, id_bits), "recipes")
    store = table.select(F.explode("recipe").alias("c")).groupBy("c.h").agg(
        *(f(f"c.{v}").alias(f"{n}_{v}") for v in ("v1", "v2") for n, f in (("low", F.min), ("high", F.max)))
    )
    verified = store.where("low_v1 <> high_v1 or low_v2 <> high_v2").isEmpty()
    ids = F.transform("recipe", lambda c: c["h"]) if verified else F.col("recipe")
    table = table.select("doc_id", "row", "text_sha256", ids.alias("ids"))
    groups = table.groupBy("ids").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("size")).where("size > 1")
    own = F.struct("doc_id", "row")
    # With the list's hash among its keys, the join deals both sides anew, so that a hot group can be split.
    key = F.xxhash64("ids").alias("key")
    return table.select("*", key).join(groups.select("*", key), ["key", "ids"], "left").select(
        "doc_id",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("bigint").alias("group_size"),
        (F.col("size").isNull() | F.col("keep").eqNullSafe(own)).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns."""
    same = F.col("keep_id").eqNullSafe(F.col("doc_id")).alias("same")
    found = written(
        exact_duplicates(docs, id_col, text_col).where("not kept").select(
            F.col("doc_id").alias("id"), _digest_part(F.col("text_sha256"), 1).alias("hash"), same
        ),
        "copies",
        per_core=1,
    )
    own_hash = _digest_part(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256), 1)
    return without(docs, found.where("not same"), id_col, own_hash, repeated=not found.where("same").isEmpty())


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from undertow.llm.common import read_table

    return exact_duplicates(read_table(spark, sf_dir, "documents"))


ORACLE = {
    "op3_exact_dedup": """
        select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
               doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
        from (select doc_id, coalesce(text, '') as t from documents) d"""
}
