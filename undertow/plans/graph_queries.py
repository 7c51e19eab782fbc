"""Queries on the network: edges, degrees, roles, blocks, measures, scores and features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.functions.scores import BASIC, WEIGHTED, scores_directed, scores_undirected
from undertow.operators import blocks, ego, features, graph
from undertow.plans.fixtures import DENSE, SPARSE, communities, raw_graph, reduced_graph, sql_graph, sql_measures, sql_roles, sql_scores, transactions
from undertow.sources.stage import staged

PAIRS, KINDS = blocks.PAIRS, blocks.UNDIRECTED


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to digits decimals, without minus zero."""
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def _edges_undirected(spark, sf: str) -> DataFrame:
    return graph.edges(transactions(spark, sf), "from_account", "to_account", directed=False)


def _hubless(spark, sf: str) -> DataFrame:
    v, e = raw_graph(spark, sf)
    return graph.without_hubs(v, staged(e, "edges"))[1]


def _measures(spark, sf: str, k: int, directed: bool) -> DataFrame:
    return blocks.measures(*reduced_graph(spark, sf, k), directed)


def _scores(spark, sf: str, k: int, directed: bool, kind: str) -> DataFrame:
    found = _measures(spark, sf, k, directed)
    return rounded(scores_directed(found, kind) if directed else scores_undirected(found, kind))


def _scored(spark, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    v, e = reduced_graph(spark, sf)
    return v, e, staged(scores_directed(blocks.measures(v, e, True)).select("node", "score"), "scores")


def _score_summary(spark, sf: str) -> DataFrame:
    v, e, s = _scored(spark, sf)
    return rounded(features.neighbour_summary(v, e, s, "score"))


def _degree_summary(spark, sf: str) -> DataFrame:
    v, e = reduced_graph(spark, sf)
    return rounded(features.neighbour_summary(v, e, graph.degree(v, e), "degree"))


def _features(spark, sf: str) -> DataFrame:
    return rounded(features.summarise_scores(*_scored(spark, sf)))


def _whole_graph(spark, sf: str, directed: bool) -> DataFrame:
    v, e = reduced_graph(spark, sf)
    return rounded(features.score_graph(v, e if directed else graph.both_ways(e).where("src < dst"), directed))


def _extremes(spark, sf: str) -> DataFrame:
    return rounded(features.extremes(_scored(spark, sf)[2]))


def _extreme_egos(spark, sf: str) -> DataFrame:
    v, e, s = _scored(spark, sf)
    top = F.broadcast(features.extremes(s).select("which", F.col("node").alias("ego")))  # two rows
    return ego.roles_directed(v, e).join(top, "ego").select("which", "ego", "node", "role")


QUERIES = {
    "edges_directed": lambda s, d: raw_graph(s, d)[1],
    "edges_undirected": _edges_undirected,
    "edges_reversed": lambda s, d: graph.reverse(raw_graph(s, d)[1]),
    "nodes": lambda s, d: raw_graph(s, d)[0],
    "degree": lambda s, d: graph.degree(*raw_graph(s, d)),
    "wedge_count": lambda s, d: graph.wedges(raw_graph(s, d)[1]),
    "hub_removed_edges": _hubless,
    "intra_community_edges": lambda s, d: reduced_graph(s, d)[1],
    "reach_forward": lambda s, d: ego.reach(reduced_graph(s, d)[1]),
    "reach_backward": lambda s, d: ego.reach(reduced_graph(s, d)[1], backward=True),
    "neighbour_score_summary": _score_summary,
    "neighbour_degree_summary": _degree_summary,
    "features": _features,
    "whole_graph_directed": lambda s, d: _whole_graph(s, d, True),
    "whole_graph_undirected": lambda s, d: _whole_graph(s, d, False),
    "top_bottom_nodes": _extremes,
    "extreme_egos": _extreme_egos,
    "triangles": lambda s, d: graph.triangles(raw_graph(s, d)[1]).select(
        F.sort_array(F.array("a", "b", "c")).alias("nodes"), F.expr("w_ab + w_ac + w_bc").cast("long").alias("edges")
    ).select(F.col("nodes")[0].alias("a"), F.col("nodes")[1].alias("b"), F.col("nodes")[2].alias("c"), "edges"),
    "first_order_directed": lambda s, d: rounded(blocks.first_order_measures(*raw_graph(s, d))),
    "first_order_undirected": lambda s, d: rounded(blocks.first_order_measures(*raw_graph(s, d), directed=False)),
    "twins": lambda s, d: ego.twins(*reduced_graph(s, d, SPARSE)),
}


def _stats(value: str, source: str, out: str) -> str:
    cells = ", ".join(f"round(coalesce({f}(x.{value}), 0), 6) + 0.0 as {out}_{n}" for f, n in (("min", "min"), ("avg", "mean"), ("max", "max"), ("stddev_pop", "std")))
    return f"select v.node, {cells} from v left join e on e.src = v.node left join {source} x on x.node = e.dst group by v.node"


DEGREES = "dg as (select v.node, count(x.node) as degree from v left join (select src as node from e union all select dst from e) x on x.node = v.node group by v.node)"
CHAIN = f"{sql_graph(DENSE)}, {sql_roles(True)}, {sql_measures(True)}, {sql_scores(True)}"


def _features_sql(with_: str, score: str) -> str:
    return f"""with {with_}, {DEGREES}, q as (select node, {score} as score from sc),
        fs as ({_stats("score", "q", "score")}), fd as ({_stats("degree", "dg", "degree")})
        select q.node, round(q.score, 6) + 0.0 as score, score_min, score_mean, score_max, score_std, cast(dg.degree as bigint) as degree, degree_min, degree_mean, degree_max, degree_std
        from q join fs on fs.node = q.node join dg on dg.node = q.node join fd on fd.node = q.node"""


def undirected_features_sql(graph_: str | None = None) -> str:
    """Features with undirected summaries, of undirected scores or of those in the given CTEs."""
    graph_ = graph_ or f"{sql_graph(DENSE)}, {sql_roles(False)}, {sql_measures(False)}, {sql_scores(False)}"
    degrees = "dg as (select v.node, count(u.dst) as degree from v left join u on u.src = v.node group by v.node)"
    return _features_sql(graph_, "score").replace(DEGREES, degrees).replace("left join e on e.src = v.node", "left join u e on e.src = v.node")


ORACLES = {
    "edges_directed": f"with {sql_graph()} select src, dst from e",
    "edges_undirected": f"with {sql_graph()} select src, dst from u where src < dst",
    "edges_reversed": f"with {sql_graph()} select dst as src, src as dst from e",
    "nodes": f"with {sql_graph()} select node from v",
    "degree": f"with {sql_graph()}, {DEGREES} select node, degree from dg",
    "wedge_count": f"with {sql_graph()} select cast(sum(n * n) as bigint) as wedges from (select count(*) as n from u group by src) x",
    "hub_removed_edges": f"""with {sql_graph()}, {DEGREES}, h as (select node from dg where degree >= (select quantile_cont(degree, 0.99) from dg))
        select src, dst from e where src not in (select node from h) and dst not in (select node from h)""",
    "intra_community_edges": f"with {sql_graph(DENSE)} select src, dst from e",
    "reach_forward": f"with {sql_graph(DENSE)} select src as ego, dst as node from e union select a.src, b.dst from e a join e b on a.dst = b.src where a.src <> b.dst",
    "reach_backward": f"with {sql_graph(DENSE)} select dst as ego, src as node from e union select b.dst, a.src from e a join e b on a.dst = b.src where a.src <> b.dst",
    "neighbour_score_summary": f"with {CHAIN} {_stats('score', 'sc', 'score')}",
    "neighbour_degree_summary": f"with {sql_graph(DENSE)}, {DEGREES} {_stats('degree', 'dg', 'degree')}",
    "features": _features_sql(CHAIN, "score"),
    "whole_graph_directed": _features_sql(CHAIN, "score_max"),
    "whole_graph_undirected": undirected_features_sql(),
    "top_bottom_nodes": f"""with {CHAIN} select * from (select 'highest' as which, node, round(score, 6) + 0.0 as score from sc order by sc.score desc, node limit 1) a
        union all select * from (select 'lowest', node, round(score, 6) + 0.0 from sc order by sc.score, node limit 1) b""",
    "triangles": f"""with {sql_graph()}, n as (select x.src as a, x.dst as b from u x where x.src < x.dst),
        t as (select x.a, x.b, y.b as c from n x join n y on y.a = x.b join n z on z.a = x.a and z.b = y.b)
        select a, b, c, (select count(*) from e where src in (a, b, c) and dst in (a, b, c)) as edges from t""",
    **{f"first_order_{name}": f"""with {sql_graph()}, s as (select v.node, count(u.dst) as n from v left join u on u.src = v.node group by v.node),
        k as (select x.src as node, count(*) as c from u x join {links} l on l.src = x.dst join u y on y.src = x.src and y.dst = l.dst group by x.src)
        select s.node, round(case when n > 1 then coalesce(c, 0) / (n * (n - 1)) else 0 end, 6) + 0.0 as measure_{b}, n * (n - 1) as size_{b} from s left join k on k.node = s.node"""
       for name, links, b in (("directed", "e", "11"), ("undirected", "u", "3"))},
    "twins": f"""with {sql_graph(SPARSE)}, nb as (select v.node, count(u.dst) as n, list((u.dst, exists (select 1 from e where e.src = v.node and e.dst = u.dst), exists (select 1 from e where e.dst = v.node and e.src = u.dst)) order by u.dst) filter (u.dst is not null) as near
            from v left join u on u.src = v.node group by v.node)
        select node, case when n > 16 then node else min(node) over (partition by coalesce(cast(near as varchar), ''), n > 16) end as twin from nb""",
    "extreme_egos": f"""with {CHAIN}, t as (select * from (select 'highest' as which, node as ego from sc order by score desc, node limit 1) a
        union all select * from (select 'lowest', node from sc order by score, node limit 1) b) select which, t.ego, r.node, r.role from t join r on r.ego = t.ego""",
}


def _add(suffix: str, k: int) -> None:
    cells = lambda many: ", ".join(f"round(measure_{b}, 6) + 0.0 as measure_{b}, size_{b}" for b in many)
    for name, directed in (("directed", True), ("undirected", False)):
        roles_ = ego.roles_directed if directed else (lambda v, e: ego.roles_undirected(v, e))
        with_ = f"{sql_graph(k)}, {sql_roles(directed)}"
        QUERIES[f"ego_roles_{name}{suffix}"] = lambda s, d, f=roles_: f(*reduced_graph(s, d, k))
        ORACLES[f"ego_roles_{name}{suffix}"] = f"with {with_} select ego, node, role from r"
        QUERIES[f"measures_{name}{suffix}"] = lambda s, d, f=directed: rounded(_measures(s, d, k, f))
        ORACLES[f"measures_{name}{suffix}"] = f"with {with_}, {sql_measures(directed)} select node, {cells(PAIRS if directed else KINDS)} from m"
        for kind, weighted in ((BASIC, False), (WEIGHTED, True)):
            label = f"scores_{name}_{'weighted' if weighted else 'basic'}{suffix}"
            columns = ("score", "score_transposed", "score_max") if directed else ("score",)
            QUERIES[label] = lambda s, d, f=directed, t=kind: _scores(s, d, k, f, t)
            ORACLES[label] = f"with {with_}, {sql_measures(directed)}, {sql_scores(directed, weighted)} select node, {', '.join(f'round({c}, 6) + 0.0 as {c}' for c in columns)} from sc"

    def counts(s, d) -> DataFrame:
        v, e = reduced_graph(s, d, k)
        return blocks.block_counts(ego.roles_directed(v, e), e)

    def inside(s, d) -> DataFrame:
        v, e = reduced_graph(s, d, k)
        return ego.induced(ego.roles_directed(v, e), e)

    with_ = f"{sql_graph(k)}, {sql_roles(True)}"
    QUERIES[f"block_counts_directed{suffix}"] = counts
    ORACLES[
        f"block_counts_directed{suffix}"
    ] = f"with {with_} select a.ego, a.role as role_u, b.role as role_v, count(*) as n from r a join e on e.src = a.node join r b on b.ego = a.ego and b.node = e.dst group by all"
    QUERIES[f"induced_edges{suffix}"] = inside
    ORACLES[f"induced_edges{suffix}"] = f"""with {with_}, far as materialized (select a.ego, e.src, e.dst from r a join e on e.src = a.node)
        select far.ego, src, dst from far join r on r.ego = far.ego and r.node = far.dst"""

    def dense(s, d) -> DataFrame:
        v, e = reduced_graph(s, d, k)
        return rounded(blocks.measures_directed(v, e, strategy="pandas", communities=communities(v, k)))

    if k == SPARSE:
        QUERIES["measures_directed_by_community"] = dense
        ORACLES["measures_directed_by_community"] = ORACLES[f"measures_directed{suffix}"]


_add("", DENSE)
_add("_sparse", SPARSE)
