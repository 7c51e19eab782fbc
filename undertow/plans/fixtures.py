"""The driver's tables seen as a transaction network, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undertow.operators.graph import edges, nodes, within_communities
from undertow.sources.stage import staged
from undertow.sources.tables import PATTERNS

DENSE, SPARSE = 4, 32
#: The cut-offs of the evaluation grid.
CUTOFFS = [0.1, 0.2, 0.3, 0.5, 0.9]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def transactions(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as transactions between customers; the receiver is derived."""
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = F.broadcast(customers.agg(F.count("*").alias("n")))  # one row
    o = table(spark, sf, "orders").join(n).select(
        F.col("o_orderkey").alias("tx_id"),
        F.col("o_custkey").alias("from_account"),
        F.pmod(F.col("o_orderkey") * 7 + F.col("o_custkey") * 3, F.col("n")).alias("to_account"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_orderpriority").alias("payment_format"),
        (F.col("o_orderkey") % 20 == 0).cast("int").alias("is_laundering"),
        F.when(F.col("o_orderkey") % 20 == 0, F.floor(F.col("o_orderkey") / 20) % 9).cast("int").alias("pattern"),
    )
    bank = lambda side: customers.select(F.col("c_custkey").alias(f"{side}_account"), F.col("c_nationkey").alias(f"{side}_bank"))
    return o.join(bank("from"), "from_account").join(bank("to"), "to_account")


def raw_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """nodes and directed edges, before any reduction."""
    tx = transactions(spark, sf)
    return nodes(tx, "from_account", "to_account"), edges(tx, "from_account", "to_account")


def communities(v: DataFrame, k: int) -> DataFrame:
    """A fixed stand-in for detected communities."""
    return v.select("node", (F.col("node") % k).alias("community"))


def reduced_graph(spark: SparkSession, sf: str, k: int = DENSE) -> tuple[DataFrame, DataFrame]:
    v, e = raw_graph(spark, sf)
    v = staged(v, "nodes")
    return v, staged(within_communities(e, communities(v, k)), "edges")


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Transactions with pattern flags, joined by identifier as the pattern file would be."""
    from undertow.functions.labels import identifier, with_patterns

    tx = transactions(spark, sf).withColumn("identifier", identifier("tx_id", "from_account", "to_account", "is_laundering"))
    flags = [(F.coalesce(F.col("pattern"), F.lit(-1)) == i).cast("int").alias(p) for i, p in enumerate(PATTERNS)]
    return with_patterns(tx, tx.where("pattern < 8").select("identifier", *flags))


def sql_tx() -> str:
    return """tx as (
        select o_orderkey as tx_id, o_custkey as from_account, (o_orderkey * 7 + o_custkey * 3) % n as to_account, o_totalprice as amount,
               f.c_nationkey as from_bank, t.c_nationkey as to_bank, o_orderpriority as payment_format, cast(o_orderkey % 20 = 0 as integer) as is_laundering,
               case when o_orderkey % 20 = 0 then (o_orderkey // 20) % 9 end as pattern
        from orders, (select count(*) as n from customer) c
        join customer f on f.c_custkey = o_custkey join customer t on t.c_custkey = (o_orderkey * 7 + o_custkey * 3) % n)"""


def sql_graph(k: int | None = None) -> str:
    """CTEs tx, v, e (directed, within communities if k is given), u (both ways)."""
    inside = "" if k is None else f" and from_account % {k} = to_account % {k}"
    return f"""{sql_tx()},
        v as (select from_account as node from tx union select to_account from tx),
        e as materialized (select distinct from_account as src, to_account as dst from tx where from_account <> to_account{inside}),
        u as materialized (select src, dst from e union select dst, src from e)"""


def sql_roles(directed: bool) -> str:
    """CTE r (ego, node, role) over v, e and u; for undirected graphs e is u."""
    if directed:
        return """p2 as materialized (select a.src as ego, b.dst as node from e a join e b on a.dst = b.src where a.src <> b.dst
                         union select b.dst, a.src from e a join e b on a.dst = b.src where a.src <> b.dst),
            d2 as materialized (select distinct a.src as ego, b.dst as node from u a join u b on a.dst = b.src where a.src <> b.dst except select src, dst from u),
            r as materialized (select src as ego, dst as node, 1 as role from u
                  union all select d2.ego, d2.node, case when p2.ego is null then 0 else 2 end from d2 left join p2 on p2.ego = d2.ego and p2.node = d2.node
                  union all select node, node, 0 from v)"""
    return """d2 as materialized (select distinct a.src as ego, b.dst as node from u a join u b on a.dst = b.src where a.src <> b.dst except select src, dst from u),
            r as materialized (select src as ego, dst as node, 1 as role from u union all select ego, node, 2 from d2 union all select node, node, 0 from v)"""


def sql_counts(links: str = "e") -> str:
    """CTE k: s0, s1, s2 and c00 ... c22 per ego."""
    sums = ", ".join(f"count(*) filter (a.role = {i} and b.role = {j}) as c{i}{j}" for i in range(3) for j in range(3))
    cells = ", ".join(f"coalesce(c{i}{j}, 0) as c{i}{j}" for i in range(3) for j in range(3))
    return f"""s as (select ego, count(*) filter (role = 0) as s0, count(*) filter (role = 1) as s1, count(*) filter (role = 2) as s2 from r group by ego),
        b as (select a.ego, {sums} from r a join {links} on {links}.src = a.node join r b on b.ego = a.ego and b.node = {links}.dst group by a.ego),
        k as (select s.ego, s0, s1, s2, {cells} from s left join b on b.ego = s.ego)"""


def sql_measures(directed: bool) -> str:
    """CTE m: node, measures and sizes."""
    if directed:
        blocks = {
            "00": ("c00", "(s0-1)*(s0-2)", 0),
            "01": ("c01", "s0*s1", 1),
            "02": ("c02", "(s0-1)*s2", 0),
            "10": ("c10", "s0*s1", 0),
            "11": ("c11", "s1*(s1-1)", 0),
            "12": ("c12", "s1*s2", 1),
        }
        for b, part, size, whole, whole_size in (
            ("20", "c20", "(s0-1)*s2", "c00+c10", "(s0+s1)*s0"),
            ("21", "c21", "s1*s2", "c01+c11", "(s0+s1)*s1"),
            ("22", "c22", "s2*(s2-1)", "c00+c01+c10+c11", "(s0+s1)*(s0+s1)"),
        ):
            blocks[b] = (f"case when s2 = 0 then {whole} else {part} end", f"case when s2 = 0 then {whole_size} else {size} end", 0)
        counts = sql_counts()
    else:
        blocks = {"1": ("c22", "s2*(s2-1)", 0), "2": ("c12", "s1*s2", 1), "3": ("c11", "s1*(s1-1)", 0)}
        counts = sql_counts("u")
    cells = ", ".join(f"case when ({z}) > 0 then cast({c} as double) / ({z}) else {d}.0 end as measure_{b}, cast({z} as bigint) as size_{b}" for b, (c, z, d) in blocks.items())
    return f"{counts}, m as (select ego as node, {cells} from k)"


def sql_scores(directed: bool, weighted: bool = False) -> str:
    """CTE sc: node and scores."""
    if not directed:
        basic = "measure_2 - (measure_1 + measure_3) / 2"
        sized = "case when size_1 + size_3 > 0 then measure_2 - (size_1*measure_1 + size_3*measure_3) / (size_1 + size_3) when size_2 > 0 then measure_2 else -1.0 end"
        return f"sc as (select node, cast({sized if weighted else basic} as double) as score from m)"

    def mean(blocks: list[str]) -> str:
        plain = f"(({' + '.join(f'measure_{b}' for b in blocks)}) / {len(blocks)})"
        if not weighted:
            return plain
        size = " + ".join(f"size_{b}" for b in blocks)
        return f"(case when {size} > 0 then ({' + '.join(f'size_{b}*measure_{b}' for b in blocks)}) / ({size}) else {plain} end)"

    forward = f"{mean(['01', '12'])} - {mean(['10', '21', '00', '02', '11', '20', '22'])}"
    back = f"{mean(['10', '21'])} - {mean(['01', '12', '00', '20', '11', '02', '22'])}"
    return f"sc as (select node, score, score_transposed, greatest(score, score_transposed) as score_max from (select node, cast({forward} as double) as score, cast({back} as double) as score_transposed from m) x)"
