"""Queries on communities, models and generated networks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.functions import labels
from undertow.functions.labels import NOT_CLASSIFIED, TARGETS
from undertow.operators import communities, synthetic, tree_grid
from undertow.operators.blocks import measures
from undertow.operators.features import FEATURES
from undertow.operators.graph import both_ways
from undertow.operators.models import FACTOR, HASHES, MEASURES, SAMPLE, SEED, STEP, TREES, IsolationForest
from undertow.plans import workflows
from undertow.plans.fixtures import CUTOFFS, DENSE, labelled, raw_graph, reduced_graph, sql_graph, sql_measures, sql_roles, sql_tx
from undertow.plans.graph_queries import CHAIN, rounded, undirected_features_sql
from undertow.sources import tables
from undertow.sources.stage import stage_path, staged

CELLS = [(c, t) for c in CUTOFFS for t in TARGETS if t != NOT_CLASSIFIED]
N, M, PATTERNS_ = 2000, 2, 5


def _louvain(spark, sf: str) -> DataFrame:
    v, e = raw_graph(spark, sf)
    return communities.louvain(v, e)


def _louvain_checks(spark, sf: str) -> DataFrame:
    """One row: nodes and edges, nodes without a community, communities that don't hang together, and whether the modularity (at the
    resolution of 1 by which partitions are compared) is above the fixed partition's."""
    v, e = raw_graph(spark, sf)
    v, e = staged(v, "nodes"), staged(both_ways(e).where("src < dst"), "edges")
    found = staged(communities.louvain(v, e), "communities")
    apart = staged(communities.connected(found, e), "parts").select("node", F.col("community").alias("part"))
    of_parts = found.join(apart, "node").groupBy("community").agg(F.countDistinct("part").alias("parts"))
    fixed = v.select("node", (F.col("node") % DENSE).alias("community"))
    q = [communities.modularity(e, c).select(F.col("modularity").alias(f"q{i}")) for i, c in enumerate((found, fixed))]
    # Each side has one row.
    return v.join(found, "node", "left").agg(F.count("*").alias("nodes"), F.count_if(F.col("community").isNull()).alias("unplaced")).join(
        e.agg(F.count("*").alias("edges"))
    ).join(of_parts.agg(F.count_if(F.col("parts") > 1).alias("disconnected"))).join(q[0]).join(q[1]).select(
        "nodes", "edges", "unplaced", "disconnected", (F.col("q0") > F.col("q1")).alias("above_fixed")
    )


def _first_moves(spark, sf: str) -> DataFrame:
    """The first round's moves, from communities of one node."""
    _, e = raw_graph(spark, sf)
    links = staged(both_ways(e).withColumn("w", F.lit(1).cast("long")), "links")
    state = staged(links.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")).withColumn("community", F.col("node")), "state")
    m = links.count() // 2
    found = staged(communities.candidates(links, state, m, communities.RESOLUTION, 0, communities.SEED), "candidates")
    return communities.without_conflict(found, links, m, communities.RESOLUTION)


def _modularity(spark, sf: str) -> DataFrame:
    """Of the fixed partition, so that SQL can follow."""
    v, e = raw_graph(spark, sf)
    return rounded(communities.modularity(e, v.select("node", (F.col("node") % DENSE).alias("community"))))


def _forest(spark, sf: str) -> DataFrame:
    rows = staged(measures(*reduced_graph(spark, sf), True), "measures")
    return IsolationForest().fit(rows, key=F.col("node")).transform(rows)


def _forest_sql() -> str:
    """CTEs that follow the forest over m: the sample, the trees level by level, every row's way down, and sc (node, anomaly_score)."""
    take = lambda shift: f"(node % {HASHES} * {FACTOR} + cast({shift} as bigint) * {STEP * FACTOR % HASHES}) % {HASHES}"
    values = f"[{', '.join(MEASURES)}]"
    depth = int(np.ceil(np.log2(SAMPLE)))
    path = "case when n <= 1 then 0 when n = 2 then 1 else 2 * (ln(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n end"
    parts = [
        f"rw as (select node, {values} as x from m)",
        f"ch as (select * from rw order by {take(SEED)}, node limit {TREES * SAMPLE})",
        f"l0 as materialized (select tree, x, 1 as code from (select tree, x, row_number() over (partition by tree order by {take(f'tree + {SEED}')}, node) as r from ch, (select unnest(range({TREES})) as tree)) q where r <= {SAMPLE})",
        f"lim as (select least({depth}, ceil(log2(greatest(2, least({SAMPLE}, (select count(*) from ch)))))) as lim, least({SAMPLE}, (select count(*) from ch)) as n)",
    ]
    for i in range(depth):
        ends = ", ".join(f"{{'i': {c + 1}, 'low': min(x[{c + 1}]), 'high': max(x[{c + 1}])}}" for c in range(len(MEASURES)))
        parts.append(f"""n{i} as materialized (select tree, code, n, d, u, vary[u % greatest(1, len(vary)) + 1] as f from (
            select tree, code, count(*) as n, {i} as d, (cast(tree as bigint) * {STEP} + code) * {FACTOR} % {HASHES} as u, list_filter([{ends}], lambda e: e.high > e.low) as vary from l{i} group by tree, code) q)""")
        parts.append(f"c{i} as materialized (select tree, code, f.i as i, f.low + u / {HASHES}.0::double * (f.high - f.low) as cut from n{i}, lim where f is not null and d < lim.lim)")
        parts.append(f"l{i + 1} as materialized (select l.tree, x, 2 * l.code + cast(x[c.i] > c.cut as integer) as code from l{i} l join c{i} c on c.tree = l.tree and c.code = l.code)")
    parts.append(f"n{depth} as (select tree, code, count(*) as n, {depth} as d from l{depth} group by tree, code)")
    cuts = " union all ".join(f"select tree, code, i, cut from c{i}" for i in range(depth))
    ends = " union all ".join([*(f"select n.tree, n.code, n.n, n.d from n{i} n left join c{i} c on c.tree = n.tree and c.code = n.code where c.tree is null" for i in range(depth)), f"select tree, code, n, d from n{depth}"])
    parts += [f"ct as materialized ({cuts})", f"lf as materialized (select tree, code, d + {path} as path from ({ends}) q)", f"w0 as (select node, x, tree, 1 as code from rw, (select unnest(range({TREES})) as tree))"]
    for i in range(depth):
        parts.append(f"w{i + 1} as materialized (select node, x, w.tree, case when ct.i is null then w.code else 2 * w.code + cast(x[ct.i] > ct.cut as integer) end as code from w{i} w left join ct on ct.tree = w.tree and ct.code = w.code)")
    scale = f"greatest((select {path} from lim), 1e-12) * {TREES}"
    # The empty side of a cut at the upper end is a leaf of no rows.
    parts.append(f"sc as (select node, -power(2.0, -sum(coalesce(path, floor(log2(w.code)))) / ({scale})) as anomaly_score from w{depth} w left join lf on lf.tree = w.tree and lf.code = w.code group by node)")
    return ", ".join(parts)


def _anomaly_areas(spark, sf: str) -> DataFrame:
    return rounded(workflows.anomaly_areas(labels.account_rates(labelled(spark, sf)), rounded(_forest(spark, sf)), CUTOFFS))


def _outliers(spark, sf: str) -> DataFrame:
    found = IsolationForest().predict(rounded(_forest(spark, sf)))
    return found.select("node", "anomaly_score", labels.outlier_label(F.col("prediction")).alias("outlier"), F.abs("anomaly_score").alias("anomaly"))


def _supervised(method: str):
    def query(spark, sf: str) -> DataFrame:
        v, e = reduced_graph(spark, sf)
        table = workflows.supervised_table(v, e, measures(v, e, True), labels.account_rates(labelled(spark, sf)))
        return spark.createDataFrame(
            workflows.supervised_grid(staged(table, "supervised"), CELLS, method),
            "cutoff double, target string, imbalance double, roc double, pr double",
        )

    return query


def _first_cuts(spark, sf: str) -> DataFrame:
    """Every cell's first cut over all rows, with its share of positives."""
    v, e = reduced_graph(spark, sf)
    rates = labels.account_rates(labelled(spark, sf))
    table = staged(rounded(workflows.supervised_table(v, e, measures(v, e, True), rates).select("node", *FEATURES)), "supervised")
    bins = table.select("node", tree_grid.binned(table, tree_grid.bin_edges(table, FEATURES), FEATURES).alias("bins"))
    long = labels.threshold_labels(rates, CUTOFFS).join(bins, "node").withColumn("code", F.lit(1).cast("long"))
    cuts = tree_grid.best_cuts(staged(long, "grid"), ["cutoff", "target"])
    return rounded(cuts.select("cutoff", "target", F.get(F.array(*map(F.lit, FEATURES)), F.col("f")).alias("feature"), F.col("b").alias("bin"), "gain"))


def _synthetic(part: int):
    return lambda s, d: synthetic.synthetic_network(s, synthetic.BARABASI, N, M, 0, PATTERNS_)[part]


def _planted(spark, sf: str) -> DataFrame:
    """Planted edges over the plain order of nodes, which SQL can follow."""
    plan = synthetic.plan_patterns(spark, 1000, 3, [4])
    return synthetic.planted(plan, spark.range(1000).select(F.col("id").alias("place"), F.col("id").alias("node")))


def _assembled_counts(spark, sf: str) -> DataFrame:
    """How many nodes of each label, planted edges and loops a network with 3 patterns of each kind and 4 mules has."""
    nodes, edges = (staged(x, "network") for x in synthetic.synthetic_network(spark, synthetic.BARABASI, 1000, M, 0, 3, [4]))
    flags = ["laundering", *synthetic.KINDS]
    of_edges = edges.agg(F.count_if("laundering").alias("planted_edges"), F.count_if(F.col("source") == F.col("target")).alias("loops"))
    return nodes.agg(F.count("*").alias("nodes"), *(F.count_if(f).alias(f) for f in flags)).join(of_edges)


def _loaded_measures(spark, sf: str) -> DataFrame:
    """The measures beside anomaly scores, read from the file that holds them."""
    path = stage_path(spark, "measures")
    tables.write_table(measures(*reduced_graph(spark, sf), True, include_size=False), path)
    return rounded(workflows.anomaly_scores(spark, path).select("node", *MEASURES))


def _grid(spark, sf: str) -> DataFrame:
    return spark.createDataFrame(
        [(synthetic.dataset_name(*g),) for g in synthetic.parameter_grid()], "dataset string"
    ).select("dataset", *(c.alias(k) for k, c in labels.dataset_parts(F.col("dataset")).items()))


QUERIES = {
    "connected_components": lambda s, d: communities.connected_components(*raw_graph(s, d)),
    "louvain_communities": _louvain,
    "louvain_checks": _louvain_checks,
    "louvain_first_moves": _first_moves,
    "modularity": _modularity,
    "isolation_scores": lambda s, d: rounded(_forest(s, d).select("node", *MEASURES, "anomaly_score")),
    "isolation_outliers": _outliers,
    "isolation_areas": _anomaly_areas,
    "tree_auc": _supervised("tree"),
    "tree_first_cuts": _first_cuts,
    "boosting_auc": _supervised("boosting"),
    "synthetic_graph": _synthetic(1),
    "synthetic_labels": _synthetic(0),
    "synthetic_erdos_renyi": lambda s, d: synthetic.erdos_renyi(s, N, 0.001, 1997),
    "synthetic_watts_strogatz": lambda s, d: synthetic.watts_strogatz(s, N, M, 0.01, 1997),
    "synthetic_benchmark_one_dataset": lambda s, d: workflows.synthetic_benchmark(s, [(synthetic.BARABASI, 100, 2, 0, 3)]),
    "synthetic_assembled_counts": _assembled_counts,
    "loaded_measures": _loaded_measures,
    "planted_pattern_edges": _planted,
    "parameter_grid": _grid,
}


def _first_cuts_sql() -> str:
    from undertow.plans.label_queries import LAB, RAW, UNPIVOT

    features = f"ft as ({undirected_features_sql(CHAIN)})"
    columns = ", ".join(f"coalesce(ft.{c}, -2) + 0.0 as {c}" for c in FEATURES)
    values = " union all ".join(f"select node, {i} as f, {c}::double as x from tb" for i, c in enumerate(FEATURES))
    at = ", ".join(f"{i} / 32.0" for i in range(1, 32))
    gini = lambda p, n: f"2 * ({p}::double / {n}) * (1 - {p}::double / {n})"
    return f"""with {sql_tx()}, {LAB}, ra as ({RAW}), {features}, tb as (select ra.node, {columns} from ra left join ft on ft.node = ra.node),
        vl as materialized ({values}), ed as (select f, quantile_cont(x, [{at}]) as q from vl group by f),
        bn as materialized (select node, vl.f, len(list_filter(list_distinct(q), lambda e: vl.x > e)) as b from vl join ed on ed.f = vl.f),
        j as (select *, 0 as score from ra), lg as (select node, target, cutoff, cast(rate > cutoff as integer) as label from ({UNPIVOT}) y, (select unnest([{", ".join(map(str, CUTOFFS))}]::double[]) as cutoff) z),
        ct as (select cutoff, target, f, b, count(*) as n, sum(label) as p from lg join bn on bn.node = lg.node group by all),
        sm as (select *, sum(n) over w as n1, sum(p) over w as p1, sum(n) over t as n0, sum(p) over t as p0 from ct window w as (partition by cutoff, target, f order by b rows unbounded preceding), t as (partition by cutoff, target, f)),
        gn as (select cutoff, target, f, b, round({gini("p0", "n0")} - n1::double / n0 * {gini("p1", "n1")} - (n0 - n1)::double / n0 * {gini("(p0 - p1)", "(n0 - n1)")}, 12) as gain from sm where n1 >= 10 and n0 - n1 >= 10)
        select cutoff, target, ([{", ".join(f"'{c}'" for c in FEATURES)}])[f + 1] as feature, b as bin, round(gain, 6) + 0.0 as gain from gn where gain > 0
        qualify row_number() over (partition by cutoff, target order by gain desc, f, b) = 1"""


def _anomaly_areas_sql() -> str:
    from undertow.plans.label_queries import CURVE, LAB, RAW, UNPIVOT

    area = lambda x: f"case when max(pos) > 0 and max(neg) > 0 then round({x}, 6) + 0.0 end"
    return f"""{_FOREST}, {LAB}, rt as ({RAW}), j as (select rt.*, -(round(anomaly_score, 6) + 0.0) as score from rt join sc on sc.node = rt.node),
        lg as (select node, score, target, cutoff, cast(rate > cutoff as integer) as label from ({UNPIVOT}) y, (select unnest([{", ".join(map(str, CUTOFFS))}]::double[]) as cutoff) z), {CURVE},
        ar as (select cutoff, target, {area("sum(p * (neg - fp + n / 2)) / (max(pos) * max(neg))")} as roc, {area("sum(p * (tp / (tp + fp))) / max(pos)")} as pr from cv group by cutoff, target),
        dv as (select cutoff, target, round(avg(label), 6) + 0.0 as imbalance, round(power(avg(score) filter (label = 0) - avg(score) filter (label = 1), 2)
            + (var_pop(score) filter (label = 0) + var_pop(score) filter (label = 1)) / 2, 6) + 0.0 as divergence from lg group by all)
        select cutoff, target, roc, pr, divergence, imbalance from ar join dv using (cutoff, target)"""


_FOREST = f"with {sql_graph(DENSE)}, {sql_roles(True)}, {sql_measures(True)}, {_forest_sql()}"
ORACLES = {
    "isolation_scores": f"{_FOREST} select m.node, {', '.join(f'round({m}, 6) + 0.0 as {m}' for m in MEASURES)}, round(anomaly_score, 6) + 0.0 as anomaly_score from m join sc on sc.node = m.node",
    "isolation_outliers": f"{_FOREST} select node, round(anomaly_score, 6) as anomaly_score, cast(round(anomaly_score, 6) < -0.5 as integer) as outlier, abs(round(anomaly_score, 6)) as anomaly from sc",
    "connected_components": f"""with recursive {sql_graph()}, reach(node, other) as (select node, node from v union select reach.node, u.dst from reach join u on u.src = reach.other)
        select node, min(other) as component from reach group by node""",
    "modularity": f"""with {sql_graph()}, pl as (select src % {DENSE} as a, dst % {DENSE} as b from e), dg as (select c, count(*)::double as d from (select a as c from pl union all select b from pl) x group by c)
        select round((select count(*) filter (a = b) / count(*) from pl) - (select sum(d * d) from dg) / (4.0 * power((select count(*) from pl), 2)), 6) + 0.0 as modularity""",
    "louvain_checks": f"with {sql_graph()} select (select count(*) from v) as nodes, (select count(*) from u where src < dst) as edges, 0 as unplaced, 0 as disconnected, true as above_fixed",
    "louvain_first_moves": f"""with {sql_graph()}, k as (select src as node, count(*) as k from u group by src), m as (select count(*) // 2 as m from u),
        best as (select a.node, a.k, max(2 * m - 10 * a.k * b.k) as gain, min_by(b.node, (-(2 * m - 10 * a.k * b.k), b.node)) as target
                 from u join k a on a.node = u.src join k b on b.node = u.dst, m group by a.node, a.k having max(2 * m - 10 * a.k * b.k) > 0),
        c as materialized (select *, md5(node || ':0:1997') as place from best),
        j as (select *, coalesce(sum(k) over (partition by target order by place, node rows between unbounded preceding and 1 preceding), 0) as joined from c),
        lost as (select a.node, sum(cast(b.node = a.target as integer) + cast(b.target = a.node as integer)) as lost
                 from c a join u on u.src = a.node join c b on b.node = u.dst where (b.place, b.node) < (a.place, a.node) group by a.node)
        select j.node, target from j left join lost on lost.node = j.node, m where gain - 10 * k * joined - 2 * m * coalesce(lost, 0) > 0""",
    "tree_first_cuts": _first_cuts_sql(),
    "isolation_areas": _anomaly_areas_sql(),
    "synthetic_assembled_counts": "select 1000 + 3 * (6 + 4) as nodes, 54 as laundering, 18 as separate, 18 as new_mules, 18 as existing_mules, 3 * 3 * 8 as planted_edges, 0 as loops",
    "loaded_measures": f"with {sql_graph(DENSE)}, {sql_roles(True)}, {sql_measures(True)} select node, {', '.join(f'round({m}, 6) + 0.0 as {m}' for m in MEASURES)} from m",
    "planted_pattern_edges": """with p as (select unnest(range(3)) as i), m as (select unnest(range(4)) as j),
        s as (select 'separate' as kind, 1000 + 6 * i as source, 1000 + 6 * i + 5 as target, 1000 + 6 * i + j + 1 as mule from p, m
              union all select 'new_mules', 2 * i, 2 * i + 1, 1018 + 4 * i + j from p, m
              union all select 'existing_mules', 6 + 6 * i, 7 + 6 * i, 8 + 6 * i + j from p, m)
        select kind, source, mule as target from s union all select kind, mule, target from s""",
    "parameter_grid": """with n as (select unnest([100, 10000, 100000]) as n), k as (select unnest([3, 5]) as k), m as (select unnest([1, 2, 5]) as m), p as (select unnest(['0.001', '0.01']) as p),
        s as (select 'Barabasi-Albert' as g, m, '0' as p from m union all select 'Erdos-Renyi', 0, p from p union all select 'Watts-Strogatz', m, p from m, p)
        select 'synthetic_' || g || '_' || n || '_' || m || '_' || p || '_' || k as dataset, g as generator, n as n_nodes, m as m_edges, cast(p as double) as p_edges, k as n_patterns from s, n, k where k <= 0.06 * n""",
}
