from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `row` string, own_id_0 int, nth_0 int, uid string, rest string, spans string, kept string, label string, fp string, `bucket` string, tree string"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
TEXTS = [
    (None, "no id at all here"),
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "one"),
    (5, "a b c d e f g h i j k l m n o p q r s t u v w x y z"),
    (5, "a b c d e f g h i j k l m n o p q r s t u v w x y z"),
    (6, "a b c d e f g h i j k l m n o p q r s t u v w x y z"),
    (5, "another text under the same id"),
    (7, "Ünïcödé   “quoted” 😀 İ ß \x00 tab\tline\nfeed <s> </s> [INST] <|endoftext|> ▁"),
    (8, LONG),
    (-9, "x" * 100_000),
    (10, "spam " * 500),
    (11, None),
]


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, and columns with clashing names."""
    rest = [None, None, None, "r", 1, None, "u", "x", None, "k", "l", None, "b", "t"]
    return spark.createDataFrame([(d, t, *rest) for d, t in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(messy):
    return messy.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    return sorted(rows)
