from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from undertow.llm import lexical_search, sharding, whitening

# Sharding


def cut_by_hand(rows: list, shards: int) -> list:
    """(key, size) in order with shard and slot."""
    total, before, out, count = sum(s for _, s in rows), 0, [], Counter()
    for key, size in rows:
        shard = min(shards - 1, (2 * before + size) * shards // (2 * total))
        out.append((key, size, shard, count[shard]))
        count[shard] += 1
        before += size
    return out


@pytest.mark.parametrize("shards", [1, 7, 40, 1000])
def test_shards_match_brute_force(spark, messy, shards):
    rows = messy.select("doc_id", "text").collect()
    sized = [(r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in rows]
    want = cut_by_hand([((d, c), s) for d, s, c in sorted(sized, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))], shards)
    got = sharding.shard_documents(messy, shards)
    assert set(got.columns) == {*messy.columns, "shard", "slot"}
    found = [
        ((r.doc_id, zlib.crc32((r.text or "").encode())), len((r.text or "").encode()) + 16, r.shard, r.slot)
        for r in got.select("doc_id", "text", "shard", "slot").collect()
    ]
    key = lambda r: (r[2], r[3])
    assert sorted(found, key=key) == sorted(want, key=key)


def test_shards_are_near_equal_and_split_a_hot_row(spark):
    """Half of the rows agree in everything."""
    docs = spark.range(4000).selectExpr("if(id % 2 = 0, 7, id) as doc_id", "if(id % 2 = 0, 'same', repeat('x', int(id % 50))) as text", "'a' as Shard", "1 as slot")
    rows = sharding.shard_documents(docs.repartition(5), 10).groupBy("shard").agg({"slot": "max", "*": "count"}).collect()
    sizes = {
        r.shard: r.bytes
        for r in sharding.shard_documents(docs, 10).selectExpr("shard", "octet_length(text) + 16 as bytes").groupBy("shard").agg({"bytes": "sum"}).toDF("shard", "bytes").collect()
    }
    assert sorted(sizes) == list(range(10)) and max(sizes.values()) - min(sizes.values()) <= 2 * 66
    assert all(r["max(slot)"] == r["count(1)"] - 1 for r in rows)


def test_written_shards_read_back_in_order(spark, messy, tmp_path):
    sharding.write_shards(messy, str(tmp_path / "shards"), 5)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == messy.count() and back.select("shard").distinct().count() <= 5
    for r in back.groupBy("shard").agg({"slot": "max", "*": "count"}).collect():
        assert r["max(slot)"] == r["count(1)"] - 1


def test_shards_of_nothing(empty):
    assert sharding.shard_documents(empty).count() == 0


def test_op11_by_name(spark, sf):
    rows = sharding.op11_sharding(spark, sf).collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = cut_by_hand([((d, zlib.crc32(docs[d].encode())), len(docs[d].encode()) + 16) for d in sorted(docs)], 40)
    assert sorted(((r.doc_id, r.text_crc32), r["size"], r.shard, r.slot) for r in rows) == sorted(want)
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}


# Whitening


def whitened_by_hand(rows: list, k: int = 16) -> dict:
    """By vec_id and component, in Python integers and NumPy: n, deviation, size of the projection, explained."""
    xs = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows]
    fit = sorted({tuple(x) for _, x in xs})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    z = np.array([[n * c - s for c, s in zip(x, sums, strict=True)] for x in fit], float) / n
    cov = z.T @ z / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    out = {}
    for i, x in xs:
        d = [n * c - s for c, s in zip(x, sums, strict=True)]
        for j in range(min(k, len(e))):
            some = e[j] > 1e-11 * e[0]
            out.setdefault((i, j + 1), []).append(
                (n, sum(c * c for c in d), abs(float(np.array(d, float) / n @ u[:, j] / np.sqrt(e[j]))) if some else None, float(e[j] / np.trace(cov)))
            )
    return out


def check_whitening(df, rows, k=16):
    want, got = whitened_by_hand(rows, k), df.collect()
    assert len(got) == sum(map(len, want.values()))
    for r in got:
        n, deviation, size, explained = want[r.vec_id, r.component][0] if len({x[1] for x in want[r.vec_id, r.component]}) == 1 else next(
            x for x in want[r.vec_id, r.component] if x[1] == r.deviation
        )
        assert r.n == n and r.deviation == (deviation if deviation < 1 << 63 else None)
        if size is None:
            assert r.whitened is None
        else:
            assert abs(abs(r.whitened) - size) < 1e-6 * max(1, size) and abs(r.explained - explained) < 1e-6
            assert r.identity_error < 1e-6
    return got


@pytest.mark.parametrize("offset", [0.0, 1e7])
def test_whitening_matches_brute_force(spark, offset):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 20)) * np.linspace(0.5, 9, 20) + offset
    rows = [(i, base[i % 280].tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = check_whitening(whitening.whitened(df), rows)
    signs = {}
    for r in got:
        signs.setdefault(r.vec_id, []).append(r.whitened)
    projected = np.array([signs[i] for i in range(280)])
    assert np.abs(projected.T @ projected / 280 - np.eye(16)).max() < 1e-9


def test_whitening_of_messy_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0, 3.0]), (2, [2.0, 2.0, 1.0]), (2, [2.0, 2.0, 1.0]), (None, [0.5, 2.0, -7.25]), (5, [-0.0, 2.0, 1e-300]), (6, [9.0, 2.0, 3.5])]
    bad = [(7, None), (8, [1.0, None, 2.0]), (9, [nan, 1.0, 1.0]), (10, [1.0, inf, 0.0]), (11, []), (12, [1.0] * 5000), (13, [1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in good + bad], "vec_id long, embedding array<double>, x string").repartition(3)
    got = whitening.whitened(df, 2)
    check_whitening(got, good, 2)
    # The middle dimension is constant.
    assert {r.whitened for r in whitening.whitened(df, 3).where("component = 3").collect()} == {None}


@pytest.mark.parametrize("rows", [[(1, [4.0, 5.0])], [(1, [4.0, 5.0]), (2, [4.0, 5.0])]])
def test_whitening_without_variance(spark, rows):
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(got) == 2 * len(rows)
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(1, 0, None, None, None)}


def test_whitening_of_nothing(spark):
    for rows in ([], [(1, None)], [(1, [])]):
        assert whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect() == []


@pytest.mark.parametrize("size", [10, 1 << 26, 1 << 50])
def test_deviations_are_exact(size):
    """Each way of adding them up."""
    random.seed(size)
    n = 1000
    x = np.array([[random.randrange(-size, size) for _ in range(4)] for _ in range(20)])
    sums = [random.randrange(-size * n // 2, size * n // 2) for _ in range(4)]
    want = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    assert whitening.deviations(x, n, sums) == [w if w < 1 << 63 else None for w in want]


def test_op12_by_name(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check_whitening(whitening.op12_whitening(spark, sf), rows)


# Lexical search


def ranked_by_hand(docs: list, items: list, k: int = 10) -> Counter:
    term = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [(d, Counter(term.findall((t or "").translate(lower)))) for d, t in docs]
    words = [(d, c) for d, c in words if c]
    n, total, df = len(words), sum(sum(c.values()) for _, c in words), Counter(t for _, c in words for t in c)
    out = Counter()
    for item, text in items:
        scored = []
        for d, c in words:
            m = 25 + 75 * sum(c.values()) * n // total
            score = sum(
                times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
                for t, times in Counter(term.findall((text or "").translate(lower))).items()
                if t in c
            )
            if score > 0:
                scored.append((-score, d is not None, d or 0))
        for rank, (score, known, d) in enumerate(sorted(scored)[:k], 1):
            out[item, rank, d if known else None, -score] += 1
    return out


def searched(spark, docs, items, k=10, **options) -> Counter:
    index_options = {name: options.pop(name) for name in ("shard_bytes", "block") if name in options}
    n_docs, n_terms = lexical_search.corpus_counts(lexical_search.text_rows(docs, "doc_id", "text"))
    index = lexical_search.written(lexical_search.build_index(docs, n_docs, n_terms, **index_options), "index")
    return Counter(tuple(r) for r in lexical_search.search(index, items, n_docs, k, **options).collect())


MESSY_ITEMS = [
    (1, "NO id at all, x x x"),
    (2, None),
    (3, ""),
    (4, "w1 w2 w3 w3 w900"),
    (4, "spam a z Ünïcödé"),
    (None, "under the same ID İ ß"),
    (6, "nowhere-to-be-found"),
    (7, "ß\x00tab  spam " + "another " * 1000),
]


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 1, "block": 1}, {"shard_bytes": 300, "block": 2, "item_terms": 3, "first_shards": 1}])
def test_search_on_messy_tables(spark, messy, options):
    items = spark.createDataFrame([(i, t, 0, None) for i, t in MESSY_ITEMS], "item_id long, text string, score int, rank string").repartition(2)
    docs = [(r.doc_id, r.text) for r in messy.collect()]
    assert searched(spark, messy, items, **options) == ranked_by_hand(docs, MESSY_ITEMS)


@pytest.mark.parametrize("seed", range(3))
def test_search_matches_brute_force(spark, seed):
    """Frequent and rare words, many ties, a hot group of copies; few documents a shard and postings a block."""
    rng = random.Random(seed)
    pick = lambda n: " ".join(f"t{int(rng.paretovariate(0.4)) % 400}" for _ in range(n))
    same = pick(12)
    docs = [(rng.randrange(-50, 400), same if i % 3 == 0 else pick(rng.randrange(1, 60))) for i in range(500)]
    items = [(i, pick(rng.randrange(1, 30))) for i in range(12)] + [(99, same)]
    tables = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    for options in ({"shard_bytes": 4000, "block": 4, "first_shards": 2}, {"block": 8}, {"k": 3, "item_terms": 40}):
        assert searched(spark, *tables, **options) == ranked_by_hand(docs, items, options.get("k", 10))


def test_search_of_nothing(spark, messy, empty):
    items = spark.createDataFrame(MESSY_ITEMS, "item_id long, text string")
    assert not searched(spark, empty, items) and not searched(spark, messy, items.limit(0)) and not searched(spark, empty, items.limit(0))


def test_blocks_below_the_threshold_stay_closed():
    """One document in 20,000 holds the rare word; the frequent word's other blocks are never opened."""
    n = np.full(20_000, 2)
    words = [w for i in range(20_000) for w in (b"often", b"rare" if i == 12_345 else b"other")]
    m = lexical_search.lengths(n, len(n), len(words))
    batches = list(lexical_search.shard_index(0, pa.array(range(20_000)), n, pa.chunked_array([pa.array(words, pa.large_binary())]), m))
    rows = [r for b in batches for r in b.to_pylist()]
    often, rare = ([r for r in rows if r["term"] == t] for t in (b"often", b"rare"))
    assert len(often) == 157 and len(rare) == 1 and len(rare[0]["data"]) <= 4
    column = lambda name: np.array([r[name] for r in rare + often])
    code = np.array([0] + [1] * 157)
    shard = lexical_search.Shard(rows[0]["data"], code, *(column(c) for c in ("docs", "first", "last", "top")), [r["data"] for r in rare + often])
    least = int(9000 * rare[0]["top"])
    places, scores = shard.search(np.array([0, 1]), np.array([9000, 1]), least, 10)
    assert places.tolist() == [12_345] and scores.tolist() == [9000 * rare[0]["top"] + often[0]["top"]]
    assert shard.opened == 2


def test_varints_round_trip():
    values = np.array([0, 1, 127, 128, 16383, 16384, (1 << 35) + 5, (1 << 62) + 1, 0])
    raw, ends = lexical_search.varints(values)
    assert lexical_search.from_varints(raw).tolist() == values.tolist() and ends[-1] == len(raw)


def test_op13_by_name(spark, sf):
    read = lambda t, c: [(r[c], r.text) for r in spark.read.parquet(f"{sf}/{t}.parquet").collect()]
    got = Counter(tuple(r) for r in lexical_search.op13_lexical_search(spark, sf).collect())
    assert got == ranked_by_hand(read("documents", "doc_id"), read("benchmark", "item_id"))
