"""Queries on labels, evaluation and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.functions import labels, metrics
from undertow.functions.labels import LAUNDERING, NOT_CLASSIFIED, TARGETS
from undertow.functions.scores import scores_directed
from undertow.operators.blocks import measures
from undertow.operators.split import stratified_split
from undertow.plans.fixtures import CUTOFFS, DENSE, labelled, reduced_graph, sql_graph, sql_measures, sql_roles, sql_scores, sql_tx, table, transactions
from undertow.plans.graph_queries import rounded
from undertow.sources import tables
from undertow.sources.stage import stage_path, staged
from undertow.sources.tables import PATTERNS

BY = ["cutoff", "target"]
MATRIX = TARGETS


def _scores(spark, sf: str) -> DataFrame:
    v, e = reduced_graph(spark, sf)
    return scores_directed(measures(v, e, True)).select("node", F.round("score", 6).alias("score"))


def rates(spark, sf: str, side: str = "combined") -> DataFrame:
    return labels.account_rates(labelled(spark, sf), side)


def _money(spark, sf: str) -> DataFrame:
    return transactions(spark, sf).select("tx_id", labels.money(F.col("amount").cast("string")).alias("money"))


def _identifiers(spark, sf: str) -> DataFrame:
    return transactions(spark, sf).select(
        "tx_id", labels.identifier("tx_id", "from_account", "to_account", "pattern", "is_laundering").alias("identifier")
    )


def _joined(how: str):
    return lambda s, d: rounded(labels.join_scores(rates(s, d, "sender"), _scores(s, d), how))


def _long(spark, sf: str) -> DataFrame:
    """Every cell's labels beside the scores, as the evaluation grid has them."""
    return labels.threshold_labels(staged(labels.join_scores(rates(spark, sf), _scores(spark, sf), "outer"), "rated"), CUTOFFS)


def _one_target(spark, sf: str) -> DataFrame:
    return _long(spark, sf).where((F.col("target") == LAUNDERING) & (F.col("cutoff") == CUTOFFS[0]))


def _bins(spark, sf: str) -> DataFrame:
    return rounded(labels.rates_by_bin(labels.join_scores(rates(spark, sf), _scores(spark, sf), "lookup")))


def _area(column: str):
    return lambda s, d: rounded(metrics.areas(_long(s, d), BY).select(*BY, column))


def _methods(spark, sf: str) -> DataFrame:
    """Days as datasets, event types as methods, the mean value as performance."""
    return table(spark, sf, "events").groupBy(
        F.to_date("ts").cast("string").alias("dataset"), F.col("event_type").alias("method")
    ).agg(F.round(F.avg("value"), 6).alias("score"))


def _nemenyi(spark, sf: str) -> DataFrame:
    m = _methods(spark, sf)
    k, b = m.select("method").distinct().count(), m.select("dataset").distinct().count()
    return rounded(metrics.nemenyi(metrics.mean_ranks(metrics.average_ranks(m)), k, b).drop("p"))


def _model_order(spark, sf: str) -> DataFrame:
    """Models in the order of the mean value rounded to tens, so that there are ties; these stand by position."""
    m = _methods(spark, sf).withColumn("score", F.round("score", -1))
    return metrics.model_order(m, MODELS).select("dataset", "method", F.col("rank").cast("long").alias("rank"))


def _split(spark, sf: str) -> DataFrame:
    key = F.pmod(F.col("node") * 2654435761 + 1997 * 40503, F.lit(1 << 31))
    return stratified_split(_one_target(spark, sf), key=key).select("node", "label", "is_test")


def _chunks(spark, sf: str) -> DataFrame:
    return tables.chunks(transactions(spark, sf).select("tx_id"), "tx_id")


def _correlation(spark, sf: str) -> DataFrame:
    return rounded(metrics.correlation_test(labels.join_scores(rates(spark, sf), _scores(spark, sf), "inner"), "score", LAUNDERING))


def area_matrix(spark, sf: str, metric: str = "roc") -> DataFrame:
    long = metrics.areas(_long(spark, sf), BY).select(*BY, F.lit(metric).alias("metric"), F.round(metric, 6).alias("value"))
    return tables.metric_matrix(long, metric, TARGETS)


def _lines(df: DataFrame, name: str) -> DataFrame:
    """A text file of the table's lines (column value), read again."""
    path = stage_path(df.sparkSession, name)
    df.select("value").write.text(path)
    return df.sparkSession.read.text(path)


def _result_log(spark, sf: str) -> DataFrame:
    """Every cell's areas through a log; missing ones are nan there."""
    text = lambda c: F.coalesce(F.round(c, 6).cast("string"), F.lit("nan"))
    found = metrics.areas(_long(spark, sf), BY)
    key = F.concat_ws("_", F.lit("tables"), "target", F.col("cutoff").cast("string"))
    lines = found.select(F.concat(key, F.lit(" [AUC-ROC, AUC-PR]: ["), text("roc"), F.lit(", "), text("pr"), F.lit("]")).alias("value"))
    return tables.result_log(_lines(lines, "log"))


def _time_log(spark, sf: str) -> DataFrame:
    """Each event type's mean value through a log of times."""
    found = table(spark, sf, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("x"))
    lines = found.select(F.concat("event_type", F.lit(": "), F.col("x").cast("string")).alias("value"))
    return tables.time_log(_lines(lines, "log")).fillna(-1, ["size"])


def _pattern_file(spark, sf: str) -> DataFrame:
    """The laundering transactions of a pattern and a bank as an attempt in a pattern file."""
    tx = transactions(spark, sf).where("is_laundering = 1 and pattern < 8").withColumn("identifier", F.concat_ws(",", "tx_id", "from_account", "to_account"))
    name = F.get(F.array(*map(F.lit, PATTERNS)), F.col("pattern"))
    attempts = tx.groupBy("pattern", "from_bank").agg(F.array_join(F.sort_array(F.collect_list("identifier")), "\n").alias("rows"))
    lines = F.concat(F.lit("BEGIN LAUNDERING ATTEMPT - "), name, F.lit(":  Max 3\n"), "rows", F.lit("\nEND LAUNDERING ATTEMPT\n"), "rows")
    path = stage_path(spark, "patterns")
    attempts.select(lines.alias("value")).write.text(path)
    return tables.read_patterns(spark, path)


#: An order of event types, as models are listed.
MODELS = ["view", "purchase", "click", "signup", "error"]


def _mean_by(side: str) -> str:
    columns = ", ".join(f'round(avg("{t}"), 6) + 0.0 as "{t}"' for t in TARGETS)
    ends = {"sender": "from_account as node", "receiver": "to_account as node", "combined": "unnest([from_account, to_account]) as node"}[side]
    return f"select node, {columns} from (select {ends}, * from lab) x group by node"


FLAGS = ", ".join(f"""cast(coalesce(pattern, -1) = {i} as integer) as "{p}\"""" for i, p in enumerate(PATTERNS))
LAB = f"""lab as (select *, {FLAGS}, cast(is_laundering = 1 and coalesce(pattern, 8) = 8 as integer) as "{NOT_CLASSIFIED}", is_laundering as "{LAUNDERING}" from tx)"""
GRAPH = f"{sql_graph(DENSE)}, {sql_roles(True)}, {sql_measures(True)}, {sql_scores(True)}, sr as (select node, round(score, 6) as score from sc)"
BASE = f"{GRAPH}, {LAB}"
UNPIVOT = " union all ".join(f"""select node, score, '{t}' as target, "{t}" as rate from j""" for t in TARGETS)
OUTER = ", ".join(f'coalesce("{t}", -1) as "{t}"' for t in TARGETS)
# The grid keeps unrounded rates; equal thresholds must cut alike.
RAW = _mean_by("combined").replace("round(avg(", "(avg(").replace(", 6) + 0.0", ")")
LONG = f"""{BASE}, rt as ({RAW}), j as (select coalesce(rt.node, sr.node) as node, coalesce(score, -1) as score, {OUTER} from rt full join sr on sr.node = rt.node),
    lg as (select node, score, target, cutoff, cast(rate > cutoff as integer) as label from ({UNPIVOT}) y, (select unnest([{", ".join(map(str, CUTOFFS))}]::double[]) as cutoff) z)"""
CURVE = """g as (select cutoff, target, score, sum(label) as p, sum(1 - label) as n from lg group by all),
    cv as (select *, sum(p) over w as tp, sum(n) over w as fp, sum(p) over t as pos, sum(n) over t as neg from g
           window w as (partition by cutoff, target order by score desc rows unbounded preceding), t as (partition by cutoff, target))"""
METHODS = "em as (select cast(cast(ts as date) as varchar) as dataset, event_type as method, round(avg(value), 6) as score from events group by all)"
RANKED = f"{METHODS}, rk as (select *, rank() over (partition by dataset order by score desc) + (count(*) over (partition by dataset, score) - 1) / 2 as rank from em)"
ONE = f"one as (select node, score, label from lg where target = '{LAUNDERING}' and cutoff = {CUTOFFS[0]})"


def _outer_sql(kind: str) -> str:
    flags = lambda miss: ", ".join(f'coalesce(a."{t}", {miss}) as "{t}"' if miss is not None else f'a."{t}"' for t in TARGETS)
    body = {
        "outer": f"select coalesce(a.node, b.node) as node, {flags(-1)}, coalesce(b.score, -1) + 0.0 as score from lf a full join rg b on b.node = a.node",
        "lookup": f"select a.node, {flags(None)}, coalesce(b.score, -2) + 0.0 as score from lf a left join rg b on b.node = a.node",
        "inner": f"select a.node, {flags(None)}, b.score + 0.0 as score from lf a join rg b on b.node = a.node",
    }[kind]
    return f"with {BASE}, lf as ({_mean_by('sender')}), rg as (select * from sr) {body}"


def long_labels(query: str) -> str:
    """A query over lg, the labels of every cell beside the scores."""
    return f"with {LONG} {query}"


def area_sql(column: str) -> str:
    value = {"roc": "sum(p * (neg - fp + n / 2)) / (max(pos) * max(neg))", "pr": "sum(p * (tp / (tp + fp))) / max(pos)"}[column]
    return f"with {LONG}, {CURVE} select cutoff, target, case when max(pos) > 0 and max(neg) > 0 then round({value}, 6) + 0.0 end as {column} from cv group by cutoff, target"


QUERIES = {
    "tx_identifiers": _identifiers,
    "money_format": _money,
    "tx_pattern_labels": lambda s, d: labelled(s, d).select("tx_id", *TARGETS),
    **{f"account_labels_{side}": (lambda s, d, x=side: rounded(rates(s, d, x))) for side in ("sender", "receiver", "combined")},
    **{f"labels_scores_{how}": _joined(how) for how in ("outer", "lookup", "inner")},
    "pattern_by_score_bin": _bins,
    "threshold_labels_long": lambda s, d: _long(s, d).select("node", *BY, "label"),
    "auc_roc_grid": _area("roc"),
    "auc_pr_grid": _area("pr"),
    "auc_roc_matrix": area_matrix,
    "class_imbalance": lambda s, d: rounded(metrics.imbalance(_long(s, d), BY)),
    "roc_pr_curves": lambda s, d: rounded(metrics.curves(_one_target(s, d)).select("score", "tp", "fp", "tpr", "fpr", "precision")),
    "lift_ties": lambda s, d: rounded(metrics.lift(_one_target(s, d))),
    "lift_topk": lambda s, d: rounded(metrics.lift_top(_one_target(s, d), "node")),
    "divergence_grid": lambda s, d: rounded(metrics.divergence(_long(s, d), BY)),
    "score_histogram": lambda s, d: rounded(metrics.histogram(_long(s, d), BY)),
    "account_bank_pairs": lambda s, d: labels.account_banks(transactions(s, d)),
    "avg_rank": lambda s, d: rounded(metrics.mean_ranks(metrics.average_ranks(_methods(s, d)))),
    "ordinal_rank": lambda s, d: metrics.ordinal_ranks(_methods(s, d), "method").select("dataset", "method", F.col("rank").cast("long").alias("rank")),
    "model_order": _model_order,
    "friedman_stat": lambda s, d: rounded(metrics.friedman(_methods(s, d))),
    "nemenyi_pairs": _nemenyi,
    "correlation_test": _correlation,
    "box_statistics": lambda s, d: rounded(metrics.box_statistics(table(s, d, "events"), ["event_type"], "value")),
    "row_chunks": _chunks,
    "stratified_split": _split,
    "result_log": _result_log,
    "time_log": _time_log,
    "pattern_file_rows": _pattern_file,
}
ORACLES = {
    "tx_identifiers": f"with {sql_tx()} select tx_id, concat_ws(',', tx_id, from_account, to_account, coalesce(cast(pattern as varchar), 'nan'), is_laundering) as identifier from tx",
    "money_format": f"with {sql_tx()}, t as (select tx_id, amount, cast(amount as varchar) as s from tx) select tx_id, case when length(split_part(s, '.', 2)) >= 2 then s else printf('%.2f', amount) end as money from t",
    "tx_pattern_labels": f"""with {sql_tx()}, {LAB} select tx_id, {", ".join(f'"{t}"' for t in TARGETS)} from lab""",
    **{f"account_labels_{side}": f"with {sql_tx()}, {LAB} {_mean_by(side)}" for side in ("sender", "receiver", "combined")},
    **{f"labels_scores_{how}": _outer_sql(how) for how in ("outer", "lookup", "inner")},
    "pattern_by_score_bin": f"""with {BASE}, ra as ({RAW}), jb as (select ra.*, coalesce(s3.score, -2) as score from ra left join sr s3 on s3.node = ra.node)
        -- twenty times the score without error, as in Python's rounding: s and what the sum leaves out
        , tw as (select *, score * 16 + score * 4 as s from jb), er as (select *, (score * 16 - (s - (s - score * 16))) + (score * 4 - (s - score * 16)) as rest, floor(s / 2) as h from tw),
        te as (select *, case when h * 2 = s and rest < 0 then h - 1 else h end as t from er)
        select (t + case when (s - t * 2 - 1) + rest > 0 or ((s - t * 2 - 1) + rest = 0 and cast(t as bigint) % 2 <> 0) then 1 else 0 end) / 10 + 0.0 as bin, {", ".join(f'round(avg("{t}"), 6) + 0.0 as "{t}"' for t in TARGETS)} from te where score <> -2 group by 1""",
    "threshold_labels_long": f"with {LONG} select node, cutoff, target, label from lg",
    "auc_roc_grid": area_sql("roc"),
    "auc_pr_grid": area_sql("pr"),
    "auc_roc_matrix": f"""select cutoff, {", ".join(f"max(roc) filter (target = '{t}') as " + chr(34) + t + chr(34) for t in TARGETS)} from ({area_sql("roc")}) x group by cutoff""",
    "class_imbalance": f"with {LONG} select cutoff, target, round(avg(label), 6) + 0.0 as imbalance from lg group by all",
    "roc_pr_curves": f"""with {LONG}, {CURVE} select round(score, 6) + 0.0 as score, cast(tp as bigint) as tp, cast(fp as bigint) as fp, round(tp / pos, 6) + 0.0 as tpr, round(fp / neg, 6) + 0.0 as fpr, round(tp / (tp + fp), 6) + 0.0 as precision
        from cv where target = '{LAUNDERING}' and cutoff = {CUTOFFS[0]}""",
    "lift_ties": f"""with {LONG}, {ONE}, st as (select unnest(range(1, 101)) as k), o as (select *, row_number() over (order by score desc) as rn, count(*) over () as n, sum(label) over () as pos from one)
        select cast(k as double) / 100 as step, round((select sum(label) / count(*) from one x where x.score >= o.score) / (pos / n), 6) + 0.0 as lift from st join o on o.rn = (k * n + 99) // 100""",
    "lift_topk": f"""with {LONG}, {ONE}, st as (select unnest(range(1, 101)) as k), o as (select *, row_number() over (order by score desc, node) as rn, sum(label) over (order by score desc, node rows unbounded preceding) as tp, count(*) over () as n, sum(label) over () as pos from one)
        select cast(k as double) / 100 as step, round(tp / rn / (pos / n), 6) + 0.0 as lift from st join o on o.rn = (k * n + 99) // 100""",
    "divergence_grid": f"""with {LONG} select cutoff, target, round(power(avg(score) filter (label = 0) - avg(score) filter (label = 1), 2) + (var_pop(score) filter (label = 0) + var_pop(score) filter (label = 1)) / 2, 6) + 0.0 as divergence from lg group by all""",
    "score_histogram": f"""with {LONG}, en as (select cutoff, target, min(score) as low, max(score) as high from lg group by all),
        hb as (select lg.cutoff, lg.target, label, least(cast(floor((score - low) * 20 / (high - low)) as integer) + 1, 20) as bin, low, high from lg join en on en.cutoff = lg.cutoff and en.target = lg.target),
        hc as (select cutoff, target, label, bin, low, high, count(*) as n from hb group by all)
        select cutoff, target, label, bin, n, round(n / (sum(n) over (partition by cutoff, target, label) * (high - low) / 20), 6) + 0.0 as density from hc""",
    "account_bank_pairs": f"with {sql_tx()} select from_account as account, from_bank as bank from tx union select to_account, to_bank from tx",
    "avg_rank": f"with {RANKED} select method, round(avg(rank), 6) + 0.0 as mean_rank from rk group by method",
    "ordinal_rank": f"with {METHODS} select dataset, method, row_number() over (partition by dataset order by score desc, method) as rank from em",
    "model_order": f"""with {METHODS}, mo as (select dataset, method, round(score, -1) as score, list_position([{", ".join(f"'{x}'" for x in MODELS)}], method) as place from em)
        select dataset, method, row_number() over (partition by dataset order by score desc, place) as rank from mo where place > 0""",
    "friedman_stat": f"""with {RANKED}, ti as (select sum(t * t * t - t) as ties from (select count(*) as t from rk group by dataset, score) x),
        su as (select sum(r * r) as squares, count(*) as k, max(b) as b from (select sum(rank) as r, count(*) as b from rk group by method) x)
        select b as datasets, k as methods, round((squares * 12 / (b * k * (k + 1)) - 3 * b * (k + 1)) / (1 - ties / (b * (k * k * k - k))), 6) + 0.0 as statistic from su, ti""",
    "nemenyi_pairs": f"""with {RANKED}, mr as (select method, avg(rank) as r from rk group by method), kb as (select count(distinct method) as k, count(distinct dataset) as b from em)
        select x.method as method_a, y.method as method_b, round(abs(x.r - y.r), 6) + 0.0 as difference, abs(x.r - y.r) >= ([1.960, 2.343, 2.569, 2.728, 2.850, 2.949, 3.031, 3.102, 3.164])[k - 1] * sqrt(k * (k + 1) / (6 * b)) as significant
        from mr x join mr y on x.method < y.method, kb""",
    "correlation_test": f"""with {BASE}, ra as ({RAW}), co as (select count(*) as n, corr(sr.score, ra."{LAUNDERING}") as r from ra join sr on sr.node = ra.node)
        select n, round(r, 6) + 0.0 as r, round(r * sqrt((n - 2) / (1 - r * r)), 6) + 0.0 as t from co""",
    "box_statistics": "select event_type, round(min(value), 6) as low, round(quantile_cont(value, 0.25), 6) as q1, round(median(value), 6) as median, round(quantile_cont(value, 0.75), 6) as q3, round(max(value), 6) as high, round(avg(value), 6) as mean from events group by event_type",
    "row_chunks": f"with {sql_tx()}, o as (select tx_id, row_number() over (order by tx_id) - 1 as i, count(*) over () // 30 as z from tx) select tx_id, cast(least(i // z, 29) as integer) as chunk from o",
    "stratified_split": f"""with {LONG}, {ONE}, o as (select node, label, row_number() over (partition by label order by (node * 2654435761 + 1997 * 40503) % 2147483648, node) as rn, count(*) over (partition by label) as n from one)
        select node, label, rn <= round(0.3 * n) as is_test from o""",
    "result_log": f"""with a as ({area_sql("roc")}), b as ({area_sql("pr")}) select 'tables' as dataset, target as pattern, cutoff, coalesce(roc, 0) as roc, coalesce(pr, 0) as pr from a join b using (cutoff, target)""",
    "time_log": "select event_type as dataset, -1 as size, round(avg(value), 6) as seconds from events group by event_type",
    "pattern_file_rows": f"""with {sql_tx()} select concat_ws(',', tx_id, from_account, to_account) as identifier, {", ".join(f"cast(pattern = {i} as integer) as " + chr(34) + p + chr(34) for i, p in enumerate(PATTERNS))} from tx where is_laundering = 1 and pattern < 8""",
}
