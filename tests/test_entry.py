from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as driver
from undertow.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = [
    "edges_undirected",
    "degree",
    "scores_directed_basic_sparse",
    "scores_undirected_weighted",
    "auc_pr_grid",
    "lift_topk",
    "score_histogram",
    "stratified_split",
    "planted_pattern_edges",
    "friedman_stat",
]


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", QUICK)
def test_matches_sql(spark, sf, name):
    with duckdb.connect() as c:
        for t in TABLES:
            c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
        want = c.sql(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, sf).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    one, two = (sorted(map(tuple, d[columns].astype(str).to_numpy())) for d in (got, want))
    assert one == two
