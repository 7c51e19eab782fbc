from __future__ import annotations

import numpy as np
import pytest

from tests import brute
from undertow.operators import communities, graph, synthetic
from undertow.operators.models import MEASURES, IsolationForest
from undertow.plans import workflows
from undertow.sources.stage import clear_stages, folder, remove, session_dir, shared_dir, staged
from undertow.streaming import ingest


def cliques(spark, sizes, bridges=()):
    pairs, start = [], 0
    for n in sizes:
        pairs += [(start + i, start + j) for i in range(n) for j in range(i)]
        start += n
    return spark.range(start).withColumnRenamed("id", "node"), spark.createDataFrame(pairs + list(bridges), "src long, dst long")


def groups(df):
    found = {}
    for node, c in df.collect():
        found.setdefault(c, set()).add(node)
    return sorted(map(sorted, found.values()))


def test_components(spark):
    v, e = cliques(spark, [4, 1, 3], [(0, 3)])
    chain = spark.createDataFrame([(i, i + 1) for i in range(100, 160)], "src long, dst long")
    found = groups(communities.connected_components(v.union(spark.range(100, 161)), e.union(chain)).select("node", "component"))
    assert found == [[0, 1, 2, 3], [4], [5, 6, 7], list(range(100, 161))]


def test_louvain_finds_cliques(spark):
    v, e = cliques(spark, [6, 6, 5, 1], [(0, 6), (7, 12)])
    found = communities.louvain(v, e, resolution=1.0)
    assert groups(found.select("node", "community")) == [list(range(6)), list(range(6, 12)), list(range(12, 17)), [17]]
    assert communities.modularity(e, staged(found, "test")).first()[0] > 0.5


def planted(n, edges, mixed=0.03):
    rng = np.random.default_rng(0)
    group, pairs = rng.integers(0, 8, n), set()
    while len(pairs) < edges:
        a, b = sorted(rng.integers(0, n, 2).tolist())
        if a != b and (group[a] == group[b] or rng.random() < mixed):
            pairs.add((a, b))
    return sorted(pairs)


@pytest.mark.parametrize(("resolution", "mixed"), [(1.0, 0.03), (10.0, 0.03), (1.0, 1.0)])
def test_louvain_is_as_good_as_sequential_moves(spark, resolution, mixed):
    """By modularity, on networks with planted communities and without any."""
    pairs = planted(240, 1400, mixed)
    v, e = spark.range(240).withColumnRenamed("id", "node"), spark.createDataFrame(pairs, "src long, dst long")
    one = brute.sequential_louvain(pairs, [1.0] * len(pairs), float(len(pairs)), resolution, 1997)
    both = staged(communities.louvain(v, e, resolution), "test"), spark.createDataFrame(list(one.items()), "node long, community long")
    found = [communities.modularity(e, c, resolution).first()[0] for c in both]
    assert found[0] >= 0.98 * found[1] > 0
    assert communities.connected(both[0], e).select("community").distinct().count() == both[0].select("community").distinct().count()


def test_louvain_doesnt_depend_on_the_tasks(spark, monkeypatch):
    """Nor on names being numbers, on a bound on candidates, nor on the order of rows."""
    pairs = planted(120, 500)
    v, e = spark.range(120).withColumnRenamed("id", "node"), spark.createDataFrame(pairs, "src long, dst long")
    want = groups(communities.louvain(v, e, 2.0).select("node", "community"))
    monkeypatch.setattr("undertow.sources.stage.TASK_ROWS", 150)
    turned = spark.createDataFrame([p[::-1] for p in reversed(pairs)], "src long, dst long").repartition(7)
    assert groups(communities.louvain(v.repartition(3), turned, 2.0).select("node", "community")) == want
    monkeypatch.setattr(communities, "QUEUE", 3)
    few = staged(communities.louvain(v, e, 2.0), "test")
    assert few.count() == 120 and communities.modularity(e, few, 2.0).first()[0] > 0


def test_every_round_raises_the_modularity(spark):
    pairs = planted(100, 600, 0.5)
    e = spark.createDataFrame(pairs, "src long, dst long")
    links = staged(graph.both_ways(e).selectExpr("src", "dst", "1L as w"), "test")
    state = staged(links.groupBy("src").count().selectExpr("src as node", "count as k", "src as community"), "test")
    last = communities.modularity(e, state).first()[0]
    for turn in range(4):
        found = staged(communities.candidates(links, state, 600, 1.0, turn, 1), "test")
        going = staged(communities.without_conflict(found, links, 600, 1.0), "test")
        assert going.count() > 0
        state = staged(state.join(going, "node", "left").selectExpr("node", "k", "coalesce(target, community) as community"), "test")
        now = communities.modularity(e, state).first()[0]
        assert now > last
        last = now


def test_disconnected_communities_are_cut(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (3, 4)], "src long, dst long")
    one = spark.range(6).selectExpr("id as node", "id div 5 as community")
    assert groups(communities.connected(one, e).select("node", "community")) == [[0, 1, 2], [3, 4], [5]]


def test_louvain_without_edges(spark):
    v, e = spark.range(3).withColumnRenamed("id", "node"), spark.createDataFrame([(1, 1)], "src long, dst long")
    assert groups(communities.louvain(v, e).select("node", "community")) == [[0], [1], [2]]


def test_generator_plants_patterns(spark):
    nodes, edges = synthetic.synthetic_network(spark, synthetic.BARABASI, 200, 2, 0, 3, [4])
    assert nodes.count() == 200 + 3 * 6 + 3 * 4
    flags = {k: nodes.where(k).count() for k in ("separate", "new_mules", "existing_mules", "laundering")}
    assert flags == {"separate": 18, "new_mules": 18, "existing_mules": 18, "laundering": 54}
    assert edges.where("laundering").count() == 3 * 3 * 8
    assert edges.where("source = target").count() == 0


def test_generator_arguments(spark):
    with pytest.raises(ValueError, match="mule count"):
        synthetic.plan_patterns(spark, 100, 3, [1, 2])
    with pytest.raises(ValueError, match="unknown pattern"):
        synthetic.plan_patterns(spark, 100, 1, kinds=("odd",))
    with pytest.raises(ValueError, match="unknown generator"):
        synthetic.base_graph(spark, "odd", 10, 1, 0.1)
    assert len(synthetic.parameter_grid()) == 66


def test_random_graphs_have_the_expected_size(spark):
    n = synthetic.erdos_renyi(spark, 8000, 0.001, 7)
    assert n.count() == pytest.approx(synthetic.expected_edges(8000, 0.001), rel=0.05)
    assert n.where("source >= target or target >= 8000 or source < 0").count() == 0
    assert n.distinct().count() == n.count()
    assert synthetic.watts_strogatz(spark, 50, 2, 0.0, 1).count() == 100


def test_planted_patterns_score_high(spark):
    nodes, edges = synthetic.synthetic_network(spark, synthetic.ERDOS, 300, 0, 0.01, 3, [6])
    v, e = nodes.select("node"), edges.selectExpr("source as src", "target as dst")
    scored = workflows.score_source(workflows.measures(v, e, True), "direct")
    top = {r.node for r in nodes.where("separate").join(scored, "node").where("score > 0.99").collect()}
    assert len(top) >= 3
    assert workflows.evaluate_synthetic(scored, nodes).count() == 4


def test_isolation_forest(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 0.1, (500, len(MEASURES)))
    x[:5] += 3
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "node long, " + ", ".join(f"{m} double" for m in MEASURES))
    forest = IsolationForest(trees=50).fit(rows)
    scored = forest.transform(rows)
    worst = [r.node for r in scored.orderBy("anomaly_score").limit(5).collect()]
    assert sorted(worst) == [0, 1, 2, 3, 4]
    assert scored.where("anomaly_score < -1 or anomaly_score > 0").count() == 0
    assert forest.predict(scored, 0.01).where("prediction = -1").count() == 5


def test_stream_matches_batch(spark, tmp_path):
    pairs = [(i % 12, (i * 5 + 1) % 12) for i in range(60)]
    spark.createDataFrame(pairs, "from_account long, to_account long").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("from_account long, to_account long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    place = spark.range(12).selectExpr("id as node", "id % 2 as community")
    ingest.run(stream, place, str(tmp_path / "edges"), str(tmp_path / "scores"), str(tmp_path / "checkpoint")).awaitTermination(120)
    raw = spark.createDataFrame(pairs, "src long, dst long")
    e = graph.within_communities(graph.edges(raw), place)
    want = workflows.scores(workflows.measures(place.select("node"), e, True), True)
    got = ingest.latest_scores(spark, str(tmp_path / "scores"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stream_scores_accounts_without_community(spark, tmp_path):
    """They are communities of their own; a batch without an edge inside a community does no harm."""
    for i, pairs in enumerate(([(0, 1), (50, 0)], [(50, 60), (1, 0)])):
        spark.createDataFrame(pairs, "from_account long, to_account long").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(
        "from_account long, to_account long"
    ).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    place = spark.createDataFrame([(0, 7), (1, 7), (2, 50)], "node long, community long")
    ingest.run(stream, place, str(tmp_path / "edges"), str(tmp_path / "scores"), str(tmp_path / "checkpoint")).awaitTermination(120)
    got = {r.node: r.score for r in ingest.latest_scores(spark, str(tmp_path / "scores")).collect()}
    v = spark.createDataFrame([(x,) for x in (0, 1, 50, 60)], "node long")
    e = spark.createDataFrame([(0, 1), (1, 0)], "src long, dst long")
    assert got == {r.node: r.score for r in workflows.scores(workflows.measures(v, e, True), True).collect()}


def test_a_cluster_needs_a_shared_folder(spark):
    """No folder of one machine stands in for it."""

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())
    Session.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_a_folder_is_removed_together(spark):
    from pathlib import Path

    with folder(spark, "together") as path:
        staged(spark.range(3), "one")
        staged(spark.range(3), "two")
    assert len(list(Path(path.removeprefix("file:")).iterdir())) == 2
    assert not staged(spark.range(3), "outside").inputFiles()[0].removeprefix("file://").startswith(path.removeprefix("file:"))
    remove(spark, path)
    assert not Path(path.removeprefix("file:")).exists()


def test_stages_are_cleared(spark):
    from pathlib import Path

    other = Path(session_dir(spark)).parent / "another-session"
    table = staged(spark.range(3), "kept")
    assert table.count() == 3
    home = Path(session_dir(spark).removeprefix("file:"))
    assert home.exists()
    clear_stages(spark)
    assert not home.exists()
    assert home != other
