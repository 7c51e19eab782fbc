from __future__ import annotations

import hashlib
import math
from collections import namedtuple

import duckdb
import numpy as np
import pytest

from undertow.llm import chat_format, registry, vector_search

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

# Chat


def test_reply_trees(spark):
    rows = [
        ("t", 1, None, "user", "q", 0.0),
        ("t", 2, 1, "assistant", "good", 5.0),
        ("t", 3, 1, "assistant", "bad", 1.0),
        ("t", 4, 2, "user", "more", 0.0),
        ("t", 5, 4, "assistant", "yes", 9.0),
        ("u", 1, 99, "system", "alone", None),
        ("c", 1, 2, "user", "x", 0.0),
        ("c", 2, 1, "user", "y", 0.0),
    ]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    got = {(r.tree, r["rank"]): r.formatted for r in chat_format.formatted_trees(df).collect()}
    assert got == {
        ("t", 1): "[INST]user\nq[/INST]<s>good</s>[INST]user\nmore[/INST]<s>yes</s>",
        ("t", 2): "[INST]user\nq[/INST]<s>bad</s>",
        ("u", 1): "[INST]system\nalone[/INST]",
    }
    assert [r["rank"] for r in chat_format.formatted_trees(df, keep=1).where("tree = 't'").collect()] == [1]


def test_long_chain_has_one_path(spark):
    df = spark.range(1, 1001).selectExpr("'t' as tree", "id as node", "case when id > 1 then id - 1 end as parent")
    rows = chat_format.paths(df)
    assert rows.count() == 1000
    assert rows.where("leaf <> 1000 or node <> 1000 - up").count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_paths_match_brute_force(spark, seed):
    """Random forests, deep and wide, with answers to missing messages and to cycles."""
    rng = np.random.default_rng(seed)
    rows = []
    for t in range(6):
        n = int(rng.integers(1, 40))
        for i in range(n):
            parent = int(rng.integers(max(0, i - (3 if t % 2 else 40)), i)) if i and rng.random() < 0.9 else [None, 99][int(rng.integers(2))]
            rows.append((f"t{t}", i, parent))
    rows += [("c", 1, 2), ("c", 2, 3), ("c", 3, 1), ("c", 4, 3), ("c", 5, 4), ("c", 6, None), ("c", 7, 6)]
    parent = {(t, i): p for t, i, p in rows}
    answered = {(t, p) for t, _, p in rows}
    want = set()
    for t, leaf, _ in rows:
        if (t, leaf) not in answered:
            path, at = [], leaf
            while (t, at) in parent and len(path) <= len(rows):
                path.append(at)
                at = parent[(t, at)]
            if len(path) <= len(rows):
                want |= {(t, leaf, node, up) for up, node in enumerate(path)}
    got = [
        tuple(r) for r in chat_format.paths(
            spark.createDataFrame(rows, "tree string, node long, parent long")
        ).select("tree", "leaf", "node", "up").collect()
    ]
    assert len(got) == len(set(got))
    assert set(got) == want


def test_hostile_texts_round_trip(spark):
    texts = [None, "", "\\", "\\\\", "</s>", "[/INST]", "[INST]x[/INST]", "a\nb", "[", "<", "/INST]", "<\\/s>", "end\\", "😀</s>\\[INST]"]
    roles = ["user", "assistant", None, "sys\ntem", "a%b c", "[INST]"]
    rows = [(1, i, roles[i % len(roles)], t) for i, t in enumerate(texts * 3)]
    rows += [(None, 0, "user", "no id"), (2, None, "assistant", "no turn"), (2, 1, "user", "same"), (2, 1, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'clash' as tree").repartition(3)
    got = {r.conv_id: r for r in chat_format.digests(chat_format.formatted_trees(chat_format.chains(df))).collect()}
    for conv, n in ((1, len(texts) * 3), (None, 1), (2, 3)):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        assert got[conv].n_turns == n
        assert got[conv].turns_sha256 == sha("".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own))
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), sha(loss))
    assert chat_format.digests(chat_format.formatted_trees(chat_format.chains(df.limit(0)))).count() == 0


# Search


@pytest.mark.parametrize(
    "how", [{"pivots": 6, "query_part": 7, "data_part": 40}, {"pivots": 30, "query_part": 20, "data_part": 9}, {"pivots": 1}, {}]
)
def test_top_k_matches_brute_force(spark, how):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 6)).round(2)
    x[100:200] = x[100]
    x[200:300] += rng.normal(size=6) * 8
    rows = [(i * 20, [float(c) for c in v], "k") for i, v in enumerate(x)]
    rows += [
        (5, None, None),
        (6, [1.0, None], "k"),
        (7, [float("nan")], "k"),
        (None, [1.0], "k"),
        (8, [float("inf"), 0.0], "k"),
        (9, [3.0], "k"),
        (11, [], "k"),
    ]
    got = vector_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell string"), **how).collect()
    part = [(i, np.floor(np.array(v + [0] * (6 - len(v))) * 1024).astype(int)) for i, v, _ in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    for q, v in part:
        if q % 100 == 0:
            want = sorted((-int(v @ w), i) for i, w in part if i != q)[:10]
            assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want


def test_top_k_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (100, [2.0]), (100, [2.0])], "vec_id long, embedding array<double>")
    assert sorted(
        (r.query_id, r["rank"], r.vec_id) for r in vector_search.top_k(df).collect()
    ) == [(0, 1, 100), (0, 2, 100), (100, 1, 0), (100, 1, 0)]
    assert vector_search.top_k(df.limit(0)).count() == 0


def test_large_components_stay_exact():
    q, x = np.array([[2.0**30, 1]]), np.array([[2.0**31, 1], [2.0**31, 2]])
    assert vector_search.scores(q, x).tolist() == [[2**61 + 1, 2**61 + 2]]


def test_huge_components_take_part(spark):
    """Finite components of any size: exact while scores fit a long, then the nearest long."""
    rows = [
        (0, [2.0**53, 1.0]),
        (100, [1.0, 2.0**-12]),
        (1, [2.0**-9, 3.0]),
        (2, [-(2.0**53), 1.0]),
        (3, [1e300, 0.0]),
        (4, [float("inf"), 0.0]),
        (5, [0.0, 7.0]),
        (200, [1.5e305, -1e308]),
    ]
    got = vector_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), pivots=2).collect()
    part = {i: [max(-(2**1000), min(2**1000, int(c * 1024 // 1))) if abs(c) < 1e300 else int(math.copysign(2**1000, c)) for c in v] for i, v in rows if i != 4}
    for q in (0, 100, 200):
        clip = lambda s: max(-(2**63), min(2**63 - 1, s))
        # Exact scores rank; what is returned lies within a long.
        exact = sorted((-sum(a * b for a, b in zip(part[q], w, strict=True)), i) for i, w in part.items() if i != q)
        want = [(-clip(-s), i) for s, i in exact]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want


@pytest.mark.parametrize("clustered", [True, False])
def test_rings_that_matter(clustered):
    """No ring with an answer is ruled out, and of clustered vectors few rings are left."""
    rng = np.random.default_rng(0)
    middles = rng.normal(size=(40, 16))
    x = middles[rng.integers(0, 40, 4000)] + 0.1 * rng.normal(size=(4000, 16)) if clustered else rng.normal(size=(4000, 16))
    x = np.floor(1024 * x)
    pivots = vector_search.draw_pivots(x, 60)
    cell, along, across = vector_search.placed(x, pivots)
    ring = (across[:, None] > np.quantile(across, [0.25, 0.5, 0.75])).sum(1)
    Row = namedtuple("Row", "cell ring n low high across")
    keys = sorted(set(zip(cell.tolist(), ring.tolist(), strict=True)))
    rows = []
    for c, r in keys:
        m = (cell == c) & (ring == r)
        rows.append(Row(c, r, m.sum(), along[m].min(), along[m].max(), across[m].max())._asdict())
    bounds = vector_search.Rings(pivots, [type("R", (dict,), {"__getattr__": dict.__getitem__})(r) for r in rows])
    q = x[::40]
    s = q @ x.T
    least = np.sort(s, 1)[:, -11]
    needed = bounds.needed(q, least)
    where = np.array([keys.index(kr) for kr in zip(cell.tolist(), ring.tolist(), strict=True)])
    for i in range(len(q)):
        assert needed[i][where[s[i] >= least[i]]].all()
    share = needed[:, where].mean()
    assert share < 0.15 if clustered else share <= 1


@pytest.mark.parametrize("most", [2**10, 2**25, 2**28, 2**39, 2**45])
def test_scores_are_exact(most):
    """In each way of multiplying; rows of different lengths."""
    rng = np.random.default_rng(most % 97)
    q, x = rng.integers(-most, most, (5, 70)).astype(float), rng.integers(-most, most, (9, 64)).astype(float)
    want = [[sum(int(a) * int(b) for a, b in zip(r, s, strict=False)) for s in x] for r in q]
    assert [[int(v) for v in row] for row in vector_search.scores(q, x)] == want


def test_scores_beyond_a_long_are_ranked_exactly(spark):
    rows = [(100, [2.0**40]), (1, [2.0**30]), (2, [2.0**31]), (3, [2.0**32]), (4, [-(2.0**32)]), (5, [-(2.0**30)]), (6, [0.0]), (200, [-(2.0**41)])]
    got = vector_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), query_part=1, data_part=1, pivots=2).collect()
    by_score = {100: [3, 2, 1, 6, 5, 4, 200], 200: [4, 5, 6, 1, 2, 3, 100]}
    for q, want in by_score.items():
        found = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r.vec_id for r in found] == want
        assert found[0].score == 2**63 - 1 and found[-1].score == -(2**63)


def test_one_long_vector(spark):
    """It lengthens no other row, and its own components all count."""
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)] + [(1000, rng.normal(size=300_000).tolist()), (1001, [0.0] * 299_999 + [50.0]), (1100, [])]
    got = vector_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), k=3).collect()
    whole = {i: [math.floor(1024 * c) for c in v] for i, v in rows}
    for q in (0, 100, 300, 1000, 1100):
        want = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=False)), i) for i, v in whole.items() if i != q)[:3]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want


# Queries


def test_oracles(spark, sf):
    with duckdb.connect() as c:
        for t in ("documents", "conversations", "embeddings", "benchmark"):
            c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
        for name, sql in registry.oracle_sql().items():
            want, got = c.sql(sql).df(), registry.queries()[name](spark, sf).toPandas()
            columns = sorted(want.columns)
            assert sorted(got.columns) == columns
            # A column of nulls alone has another type in either.
            one, two = (sorted(map(tuple, d[columns].astype(object).where(d[columns].notna(), None).astype(str).to_numpy())) for d in (got, want))
            assert one == two, name
