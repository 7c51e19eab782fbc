"""Queries that write files in the layouts that the readers expect, and read them through the entry points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.functions import labels
from undertow.functions.labels import LAUNDERING
from undertow.functions.scores import scores_directed
from undertow.operators.blocks import measures
from undertow.operators.synthetic import dataset_name, parameter_grid
from undertow.plans import workflows
from undertow.plans.fixtures import DENSE, labelled, reduced_graph, sql_graph, sql_measures, sql_roles, sql_scores, sql_tx, table, transactions
from undertow.plans.graph_queries import rounded, undirected_features_sql
from undertow.plans.label_queries import BASE, MATRIX, RAW, area_matrix, area_sql, long_labels, rates
from undertow.sources import tables
from undertow.sources.stage import stage_path, staged

#: The header of a transaction file, with its repeated name.
HEADER = [
    "Timestamp",
    "From Bank",
    "Account",
    "To Bank",
    "Account",
    "Amount Received",
    "Receiving Currency",
    "Amount Paid",
    "Payment Currency",
    "Payment Format",
    "Is Laundering",
]
#: Which customers carry the labels of a generated network in the label files below.
FLAGS = {"laundering": 5, "separate": 15, "new_mules": 10, "existing_mules": 25}


def _transaction_file(spark, sf: str) -> str:
    """The transactions as a CSV file, with all 11 columns and the header."""
    text = lambda c: F.col(c).cast("string")
    amount = F.format_string("%.2f", "amount")
    cells = F.date_format("ts", "yyyy/MM/dd HH:mm"), text("from_bank"), text("from_account"), text("to_bank"), text("to_account"), amount, F.lit("Euro"), amount, F.lit("Euro"), "payment_format", text("is_laundering")
    lines = transactions(spark, sf).select(F.concat_ws(",", *cells).alias("value"))
    path = stage_path(spark, "transactions")
    # Each file of a folder has its own header.
    lines.mapInPandas(_with_header, "value string").write.text(path)
    return path


def _with_header(frames):
    import pandas as pd

    yield pd.DataFrame({"value": [",".join(HEADER)]})
    yield from frames


def _transaction_rows(spark, sf: str) -> DataFrame:
    return tables.read_transactions(spark, _transaction_file(spark, sf)).select(
        "from_bank", "from_account", "to_bank", "to_account", "amount_paid", "payment_format", "is_laundering"
    )


def _transaction_graph(spark, sf: str) -> DataFrame:
    return tables.graph_from_transactions(spark, _transaction_file(spark, sf), directed=True)[1]


def _edge_list_graph(spark, sf: str) -> DataFrame:
    path = stage_path(spark, "edge-list")
    transactions(spark, sf).select(
        F.col("from_account").alias("source"), F.col("to_account").alias("target")
    ).write.option("header", True).csv(path)
    return tables.graph_from_edge_list(spark, path, directed=False)[1]


def _customer_flags(spark, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").cast("long").alias("node"), *((F.col("c_nationkey") == k).alias(f) for f, k in FLAGS.items())
    )


def _label_file(spark, sf: str) -> DataFrame:
    path = stage_path(spark, "labels")
    _customer_flags(spark, sf).write.option("header", True).csv(path)
    return tables.read_synthetic_labels(spark, path)


def _label_file_by_position(spark, sf: str) -> DataFrame:
    """Files without node column, in the order of their names: a row's position is its node."""
    path = stage_path(spark, "labels")
    _customer_flags(spark, sf).orderBy("node").drop("node").write.option("header", True).csv(path)
    return tables.read_synthetic_labels(spark, path)


def _written_measures(as_csv: bool):
    def query(spark, sf: str) -> DataFrame:
        path = stage_path(spark, "measures") + (".csv" if as_csv else "")
        tables.write_table(measures(*reduced_graph(spark, sf), True), path, as_csv)
        return rounded(tables.read_measures(spark, path, ["node", "measure_01", "measure_12", "measure_22"]))

    return query


def _merged_money(spark, sf: str) -> DataFrame:
    path = stage_path(spark, "chunks")
    tables.write_chunks(transactions(spark, sf).select("tx_id", F.col("amount").alias("amount_paid")), path, "tx_id")
    return tables.merge_chunks(spark, path).select("tx_id", F.col("amount_paid").alias("money"))


def _append_log(spark, sf: str) -> DataFrame:
    """A line for each region, one after the other."""
    path = stage_path(spark, "log")
    for r in table(spark, sf, "region").select("r_name", "r_regionkey").collect():  # five rows
        tables.append_log(spark, path, r.r_name, str(r.r_regionkey))
    return spark.read.text(path)


def _synthetic_log(spark, sf: str) -> DataFrame:
    lines = ["synthetic_a [AUC-ROC, AUC-PR]: [[0.5, 0.25], [1.0, 0.75]]", "", "synthetic_b [AUC-ROC, AUC-PR]: [[0.125, 0.0]]"]
    found = tables.synthetic_result_log(spark.createDataFrame([(x,) for x in lines], "value string"))
    return found.select("dataset", F.posexplode("values").alias("place", "pair")).select(
        "dataset", "place", F.col("pair")[0].alias("roc"), F.col("pair")[1].alias("pr")
    )


def _merged_results(spark, sf: str) -> DataFrame:
    roc, pr = (area_matrix(spark, sf, m).select("cutoff", *MATRIX) for m in ("roc", "pr"))
    return tables.merged_results(roc, pr, "cutoff")


def _dataset_kinds(spark, sf: str) -> DataFrame:
    names = [dataset_name(*g) for g in parameter_grid()] + ["HI-Small", "LI-Large"]
    return spark.createDataFrame([(n, labels.dataset_kind(n)) for n in names], "dataset string, kind string")


def _outlier_labels(spark, sf: str) -> DataFrame:
    """Of predictions as an outlier model gives them: -1 for the values over a bound, else 1."""
    found = table(spark, sf, "events").select(
        "event_id", F.when(F.col("value") > 100, -1).otherwise(1).alias("prediction"), (-F.col("value")).alias("anomaly")
    )
    return found.select("event_id", labels.outlier_label(F.col("prediction")).alias("outlier"), F.round(F.abs("anomaly"), 6).alias("anomaly"))


def _labels_of_scores(spark, sf: str) -> DataFrame:
    v, e = reduced_graph(spark, sf)
    found = scores_directed(measures(v, e, True)).select("node", "score")
    return rounded(labels.labels_of(found, rates(spark, sf).select("node", LAUNDERING)))


def _supervised_table(spark, sf: str) -> DataFrame:
    v, e = reduced_graph(spark, sf)
    return rounded(workflows.supervised_table(v, e, measures(v, e, True), labels.account_rates(labelled(spark, sf))))


def _synthetic_targets(spark, sf: str) -> DataFrame:
    """Areas of the four targets over customers; the rules for nodes without a score are tested on a small table."""
    scored = table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("node"), F.round("c_acctbal", -2).alias("score"))
    return rounded(workflows.evaluate_synthetic(scored, _customer_flags(spark, sf)))


def _evaluation(spark, sf: str) -> DataFrame:
    v, e = reduced_graph(spark, sf)
    scored = staged(workflows.score_source(measures(v, e, True), "direct").select("node", F.round("score", 6).alias("score")), "scores")
    return rounded(workflows.evaluate(rates(spark, sf), scored))


QUERIES = {
    "transaction_file_rows": _transaction_rows,
    "transaction_file_edges": _transaction_graph,
    "edge_list_file_edges": _edge_list_graph,
    "label_file": _label_file,
    "label_file_by_position": _label_file_by_position,
    "labelled_node_count": lambda s, d: labels.labelled_count(_label_file(s, d)),
    "measure_table_parquet": _written_measures(False),
    "measure_table_csv": _written_measures(True),
    "merged_money": _merged_money,
    "appended_log": _append_log,
    "synthetic_result_log": _synthetic_log,
    "merged_result_tables": _merged_results,
    "dataset_kinds": _dataset_kinds,
    "outlier_labels": _outlier_labels,
    "labels_of_scores": _labels_of_scores,
    "supervised_table": _supervised_table,
    "synthetic_target_areas": _synthetic_targets,
    "evaluation_grid": _evaluation,
}

_FLAGS = ", ".join(f"c_nationkey = {k} as {f}" for f, k in FLAGS.items())
_LABELS = f"lf as (select cast(c_custkey as bigint) as node, {_FLAGS} from customer)"
_MEASURES = f"with {sql_graph(DENSE)}, {sql_roles(True)}, {sql_measures(True)} select node, {', '.join(f'round(measure_{b}, 6) + 0.0 as measure_{b}' for b in ('01', '12', '22'))} from m"
_CHAIN = f"{sql_graph(DENSE)}, {sql_roles(True)}, {sql_measures(True)}, {sql_scores(True)}"
_TARGETS = " union all ".join(f"select node, score, '{f}' as target, cast(coalesce({f}, false) as integer) as label from st" for f in FLAGS)


def _supervised_sql() -> str:
    names = ["score", *(f"score_{x}" for x in ("min", "mean", "max", "std")), "degree", *(f"degree_{x}" for x in ("min", "mean", "max", "std"))]
    columns = ", ".join(f"coalesce(f.{n}, -2) {'as' if n == 'degree' else '+ 0.0 as'} {n}" for n in names)
    from undertow.functions.labels import TARGETS
    from undertow.plans.label_queries import LAB

    flags = ", ".join(f'round(ra."{t}", 6) + 0.0 as "{t}"' for t in TARGETS)
    return f"with {sql_tx()}, {LAB}, ra as ({RAW}), f as ({undirected_features_sql(_CHAIN)}) select ra.node, {flags}, {columns} from ra left join f on f.node = ra.node"


ORACLES = {
    "transaction_file_rows": f"with {sql_tx()} select cast(from_bank as varchar) as from_bank, cast(from_account as varchar) as from_account, cast(to_bank as varchar) as to_bank, cast(to_account as varchar) as to_account, printf('%.2f', amount) as amount_paid, payment_format, is_laundering from tx",
    "transaction_file_edges": f"with {sql_graph()} select cast(src as varchar) as src, cast(dst as varchar) as dst from e",
    "edge_list_file_edges": f"with {sql_graph()} select src, dst from u where src < dst",
    "label_file": f"with {_LABELS} select * from lf",
    "label_file_by_position": f"with {_LABELS} select row_number() over (order by node) - 1 as node, {', '.join(FLAGS)} from lf",
    "labelled_node_count": f"with {_LABELS} select count(*) as nodes, count(*) filter (laundering) as labelled from lf",
    "measure_table_parquet": _MEASURES,
    "measure_table_csv": _MEASURES,
    "merged_money": f"with {sql_tx()} select tx_id, printf('%.2f', amount) as money from tx",
    "appended_log": "select r_name || ': ' || r_regionkey as value from region",
    "synthetic_result_log": "select * from (values ('synthetic_a', 0, 0.5::double, 0.25::double), ('synthetic_a', 1, 1.0, 0.75), ('synthetic_b', 0, 0.125, 0.0)) t(dataset, place, roc, pr)",
    "merged_result_tables": f"""with a as ({area_sql("roc")}), b as ({area_sql("pr")})
        select cutoff, {", ".join(f'max(roc) filter (target = {chr(39)}{t}{chr(39)}) as "{t}_x"' for t in MATRIX)}, {", ".join(f'max(pr) filter (target = {chr(39)}{t}{chr(39)}) as "{t}_y"' for t in MATRIX)}
        from (select cutoff, target, roc, pr from a join b using (cutoff, target)) x group by cutoff""",
    "dataset_kinds": """with n as (select unnest([100, 10000, 100000]) as n), k as (select unnest([3, 5]) as k), m as (select unnest([1, 2, 5]) as m), p as (select unnest(['0.001', '0.01']) as p),
        s as (select 'Barabasi-Albert' as g, m, '0' as p from m union all select 'Erdos-Renyi', 0, p from p union all select 'Watts-Strogatz', m, p from m, p)
        select 'synthetic_' || g || '_' || n || '_' || m || '_' || p || '_' || k as dataset, 'generated' as kind from s, n, k where k <= 0.06 * n
        union all select * from (values ('HI-Small', 'transactions'), ('LI-Large', 'transactions')) t""",
    "outlier_labels": "select event_id, cast(value > 100 as integer) as outlier, round(abs(value), 6) as anomaly from events",
    "labels_of_scores": f"""with {BASE}, ra as ({RAW}) select sc.node, round(sc.score, 6) + 0.0 as score, round(ra."{LAUNDERING}", 6) + 0.0 as "{LAUNDERING}" from sc join ra on ra.node = sc.node""",
    "supervised_table": _supervised_sql(),
    "synthetic_target_areas": f"""with {_LABELS}, st as (select lf.*, coalesce(s.score, -1) as score from lf left join (select c_custkey as node, round(c_acctbal, -2) as score from customer) s on s.node = lf.node),
        lg as ({_TARGETS}), g as (select target, score, sum(label) as p, sum(1 - label) as n from lg group by all),
        cv as (select *, sum(p) over w as tp, sum(n) over w as fp, sum(p) over t as pos, sum(n) over t as neg from g window w as (partition by target order by score desc rows unbounded preceding), t as (partition by target))
        select target, case when max(pos) > 0 and max(neg) > 0 then round(sum(p * (neg - fp + n / 2)) / (max(pos) * max(neg)), 6) + 0.0 end as roc, case when max(pos) > 0 and max(neg) > 0 then round(sum(p * (tp / (tp + fp))) / max(pos), 6) + 0.0 end as pr from cv group by target""",
    "evaluation_grid": f"""with a as ({area_sql("roc")}), b as ({area_sql("pr")}), c as ({long_labels("select cutoff, target, round(avg(label), 6) + 0.0 as imbalance from lg group by all")}),
        d as ({long_labels("select cutoff, target, round(power(avg(score) filter (label = 0) - avg(score) filter (label = 1), 2) + (var_pop(score) filter (label = 0) + var_pop(score) filter (label = 1)) / 2, 6) + 0.0 as divergence from lg group by all")})
        select cutoff, target, roc, pr, divergence, imbalance from a join b using (cutoff, target) join c using (cutoff, target) join d using (cutoff, target)""",
}
