from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from undertow.functions import labels, metrics
from undertow.operators.split import stratified_split
from undertow.sources import tables


def test_money_text(spark):
    given = ["1.5", "3.0", "1234.567", "2e-05", "1.5e-05", "100", None]
    rows = spark.createDataFrame(
        [(i, g) for i, g in enumerate(given)], "i int, m string"
    ).select("i", labels.money(F.col("m")).alias("m")).orderBy("i").collect()
    assert [r.m for r in rows][:6] == ["1.50", "3.00", "1234.567", "0.00", "1.5e-05", "100.00"]


def pattern_rows(spark, path, *texts):
    path.mkdir()
    for i, text in enumerate(texts):
        (path / f"{i}.txt").write_text(text)
    return tables.pattern_rows(spark, str(path))


@pytest.mark.parametrize("block", [None, 8])
def test_pattern_file(spark, tmp_path, block):
    """Read whole, or in blocks that end anywhere."""
    text = "x\nBEGIN A - STACK: 3\n1,2\n\n3,4\nEND A\n5,6\nBEGIN - FAN-IN\n7,8\nEND"
    conf = {"spark.sql.files.maxPartitionBytes": str(block), "spark.sql.files.openCostInBytes": "1"} if block else {}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = pattern_rows(spark, tmp_path / "one", text, "1,1\nBEGIN - CYCLE\n9,9\n").collect()
        with pytest.raises(Exception, match="unknown pattern"):
            pattern_rows(spark, tmp_path / "odd", "BEGIN A - ODD\n1\nEND").collect()
        assert pattern_rows(spark, tmp_path / "none", "BEGIN A - ODD\nEND", "").count() == 0
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert sorted((r.identifier, r.pattern) for r in rows) == [("", "STACK"), ("1,2", "STACK"), ("3,4", "STACK"), ("7,8", "FAN-IN"), ("9,9", "CYCLE")]


def test_files_round_trip(spark, tmp_path):
    path = tmp_path / "trans.csv"
    path.write_text(
        "Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering\n2022/09/01 00:20,010,00A,03,00B,3.5,USD,3.5,USD,Wire,1\n2022/09/01 00:21,010,00A,03,00A,4,USD,4,USD,Wire,0\n"
    )
    rows = tables.read_transactions(spark, str(path)).collect()
    assert (rows[0].from_bank, rows[0].from_account, rows[0].to_account, rows[0].is_laundering) == ("010", "00A", "00B", 1)
    v, e = tables.graph_from_transactions(spark, str(path), directed=True)
    assert (v.count(), e.count()) == (2, 1)
    patterns = tmp_path / "patterns.txt"
    patterns.write_text("BEGIN LAUNDERING ATTEMPT - CYCLE\n2022/09/01 00:20,010,00A,03,00B,3.50,USD,3.50,USD,Wire,1\nEND\n")
    from undertow.plans.workflows import labelled_transactions

    found = {r.to_account: r for r in labelled_transactions(spark, str(path), str(patterns)).collect()}
    assert (found["00B"]["CYCLE"], found["00B"][labels.NOT_CLASSIFIED], found["00A"]["CYCLE"]) == (1, 0, 0)
    tables.write_chunks(tables.read_transactions(spark, str(path)), str(tmp_path / "chunks"), "timestamp", k=2)
    merged = tables.merge_chunks(spark, str(tmp_path / "chunks"))
    assert sorted(r.amount_paid for r in merged.collect()) == ["3.50", "4.00"]
    tables.append_log(spark, str(tmp_path / "log"), "a", "1")
    tables.append_log(spark, str(tmp_path / "log"), "b", "2")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "log")).collect()) == ["a: 1", "b: 2"]
    flags = tmp_path / "flags.csv"
    flags.write_text("separate,new_mules,existing_mules,laundering\nFalse,False,False,False\nTrue,False,False,True\n")
    assert {
        r.node: (r.separate, r.laundering) for r in tables.read_synthetic_labels(spark, str(flags)).collect()
    } == {0: (False, False), 1: (True, True)}


def brute_areas(y, s):
    pos, neg = s[y == 1], s[y == 0]
    roc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    ap = sum((y[s >= t].sum() / (s >= t).sum()) * (y[s == t].sum() / y.sum()) for t in np.unique(s))
    return roc, ap


@pytest.mark.parametrize("seed", [1, 2])
def test_areas_with_ties(spark, seed):
    rng = np.random.default_rng(seed)
    y, s = rng.integers(0, 2, 80), rng.integers(0, 12, 80) / 7
    rows = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s, strict=True)], "label int, score double")
    got = metrics.areas(rows).first()
    assert (got.roc, got.pr) == pytest.approx(brute_areas(y, s))
    one = metrics.areas(rows.where("label = 1")).first()
    assert (one.roc, one.pr) == (None, None)
    assert metrics.areas(rows.where("label = 5"), ["label"]).count() == 0


def test_lift(spark):
    y, s = [1, 0, 1, 0, 0, 0, 1, 0, 0, 0], [9, 8, 8, 7, 6, 5, 4, 3, 2, 1]
    rows = spark.createDataFrame([(i, a, float(b)) for i, (a, b) in enumerate(zip(y, s, strict=True))], "node int, label int, score double")
    ties = {round(r.step, 2): r.lift for r in metrics.lift(rows).collect()}
    top = {round(r.step, 2): r.lift for r in metrics.lift_top(rows, "node").collect()}
    assert len(ties) == len(top) == 100
    assert ties[0.1] == top[0.1] == pytest.approx(1 / 0.3)
    assert ties[0.2] == pytest.approx(2 / 3 / 0.3)
    assert top[0.2] == pytest.approx(1 / 2 / 0.3)
    assert ties[1.0] == top[1.0] == pytest.approx(1)


def test_tails():
    assert metrics.chi_square_tail(7.2, 4) == pytest.approx(0.12569, abs=1e-4)
    assert metrics.chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert metrics.t_tail(2.085963, 20) == pytest.approx(0.05, abs=1e-6)
    assert metrics.t_tail(math.inf, 5) == 0
    assert metrics.critical_difference(5, 30) == pytest.approx(2.728 * math.sqrt(30 / 180))


def test_split_is_exact_and_stable(spark):
    rows = spark.range(1000).selectExpr("id as node", "cast(id % 10 = 0 as int) as label")
    one = stratified_split(rows)
    counts = {(r.label, r.is_test): r["count"] for r in one.groupBy("label", "is_test").count().collect()}
    assert counts == {(0, True): 270, (0, False): 630, (1, True): 30, (1, False): 70}
    assert one.exceptAll(stratified_split(rows.repartition(7))).count() == 0


def test_joins_keep_their_sentinels(spark):
    a = spark.createDataFrame([(1, 0.5), (2, 0.1)], "node long, rate double")
    b = spark.createDataFrame([(2, 0.9), (3, 0.7)], "node long, score double")
    rows = lambda how: sorted(tuple(r) for r in labels.join_scores(a, b, how).collect())
    assert rows("outer") == [(1, 0.5, -1), (2, 0.1, 0.9), (3, -1, 0.7)]
    assert rows("lookup") == [(1, 0.5, -2), (2, 0.1, 0.9)]
    assert rows("inner") == [(2, 0.1, 0.9)]
    with pytest.raises(Exception, match="no label for node"):
        labels.labels_of(b, a).collect()
