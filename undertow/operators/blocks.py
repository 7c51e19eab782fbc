"""Block densities of each ego's adjacency matrix, from counts of existing edges; no matrix is made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertow.operators.ego import roles_directed, roles_undirected, twins
from undertow.operators.graph import both_ways, directions, neighbour_links
from undertow.sources.stage import staged

PAIRS = [f"{i}{j}" for i in range(3) for j in range(3)]
UNDIRECTED = ["1", "2", "3"]


def block_counts(r: DataFrame, e: DataFrame) -> DataFrame:
    """ego, role_u, role_v, n: existing edges by the roles of their ends."""
    return _edges_by_role(r, e).groupBy("ego", "role_u", "role_v").agg(F.count("*").alias("n"))


def _edges_by_role(r: DataFrame, e: DataFrame) -> DataFrame:
    u = r.select("ego", F.col("node").alias("src"), F.col("role").alias("role_u"))
    v = r.select("ego", F.col("node").alias("dst"), F.col("role").alias("role_v"))
    return u.join(e, "src").select("ego", "dst", "role_u").join(v, ["ego", "dst"]).select("ego", "role_u", "role_v")


def _counted(r: DataFrame, e: DataFrame) -> DataFrame:
    """One row per ego: s0, s1, s2 and c00 ... c22."""
    sizes = r.groupBy("ego").agg(*(F.count_if(F.col("role") == k).cast("long").alias(f"s{k}") for k in range(3)))
    counts = _edges_by_role(r, e).groupBy("ego").agg(
        *(F.count_if((F.col("role_u") == int(p[0])) & (F.col("role_v") == int(p[1]))).cast("long").alias(f"c{p}") for p in PAIRS)
    )
    return sizes.join(counts, "ego", "left").select("ego", "s0", "s1", "s2", *(F.coalesce(f"c{p}", F.lit(0)).alias(f"c{p}") for p in PAIRS))


def directed_blocks(compat: bool = True) -> dict[str, tuple[Column, Column, float]]:
    """Per block the edge count, the size, and the density of an empty block. With compat, an ego without role-2 nodes takes
    the whole matrix for the last three, as a slice from minus zero does; without it these blocks are empty."""
    c = {p: F.col(f"c{p}") for p in PAIRS}
    s0, s1, s2 = (F.col(f"s{k}") for k in range(3))
    zero, none = F.lit(0).cast("long"), s2 == 0

    def low(count: Column, size: Column, whole_count: Column, whole_size: Column) -> tuple[Column, Column, float]:
        return F.when(none, whole_count if compat else zero).otherwise(count), F.when(none, whole_size if compat else zero).otherwise(size), 0.0

    return {
        "00": (c["00"], (s0 - 1) * (s0 - 2), 0.0),
        "01": (c["01"], s0 * s1, 1.0),
        "02": (c["02"], (s0 - 1) * s2, 0.0),
        "10": (c["10"], s0 * s1, 0.0),
        "11": (c["11"], s1 * (s1 - 1), 0.0),
        "12": (c["12"], s1 * s2, 1.0),
        "20": low(c["20"], (s0 - 1) * s2, c["00"] + c["10"], (s0 + s1) * s0),
        "21": low(c["21"], s1 * s2, c["01"] + c["11"], (s0 + s1) * s1),
        "22": low(c["22"], s2 * (s2 - 1), c["00"] + c["01"] + c["10"] + c["11"], (s0 + s1) * (s0 + s1)),
    }


def undirected_blocks() -> dict[str, tuple[Column, Column, float]]:
    """Second-order block, cross block and first-order block; counts are of directed pairs."""
    a, b = F.col("s1"), F.col("s2")
    return {"1": (F.col("c22"), b * (b - 1), 0.0), "2": (F.col("c12"), a * b, 1.0), "3": (F.col("c11"), a * (a - 1), 0.0)}


#: Nodes of a community that one task computes as dense matrices, at most.
DENSE_NODES = 2000


def density(count: Column, size: Column, empty: float) -> Column:
    return F.when(size > 0, count / size).otherwise(F.lit(empty))


def _measures(v: DataFrame, e: DataFrame, roles, blocks: dict[str, tuple[Column, Column, float]], include_size: bool) -> DataFrame:
    """Of one of each node's twins, and from there of all."""
    same = staged(v.join(twins(v, e), "node"), "twins")
    # The least twin may lie outside v.
    one = same.groupBy("twin").agg(F.min("node").alias("ego"))
    # The roles are read three times: for the sizes and for both ends of the edges.
    r = staged(roles(v, e, one.select(F.col("ego").alias("node"))), "roles")
    columns = [density(*b).cast("double").alias(f"measure_{k}") for k, b in blocks.items()]
    if include_size:
        columns += [b[1].cast("long").alias(f"size_{k}") for k, b in blocks.items()]
    found = _counted(r, e).select("ego", *columns).join(one, "ego").drop("ego")
    return same.join(found, "twin").drop("twin")


def measures_directed(
    v: DataFrame, e: DataFrame, include_size: bool = True, compat: bool = True, strategy: str = "relational", communities: DataFrame | None = None
) -> DataFrame:
    """node, measure_00 ... measure_22 and size_00 ... size_22 for every node.

    strategy "pandas" computes each community (node, community) as dense matrices in one task; it needs edges within
    communities. Communities of more than DENSE_NODES nodes are computed by joins like the others, with the same result.
    """
    if strategy == "pandas":
        sizes = communities.groupBy("community").count()
        few = communities.join(sizes.where(F.col("count") <= DENSE_NODES), "community", "left_semi").select("node", "community")
        dense = _measures_by_community(v.join(few, "node", "left_semi"), e, few, include_size, compat)
        if sizes.where(F.col("count") > DENSE_NODES).isEmpty():
            return dense
        many = v.join(few, "node", "left_anti")
        links = e.join(many.withColumnRenamed("node", "src"), "src", "left_semi")
        return dense.unionByName(_measures(many, links, roles_directed, directed_blocks(compat), include_size))
    if strategy != "relational":
        raise ValueError(f"unknown strategy: {strategy}")
    return _measures(v, e, roles_directed, directed_blocks(compat), include_size)


def measures_undirected(v: DataFrame, e: DataFrame, include_size: bool = True) -> DataFrame:
    """node, measure_1 ... measure_3 and size_1 ... size_3; e may hold either or both directions of an edge."""
    both = both_ways(e)
    return _measures(v, both, roles_undirected, undirected_blocks(), include_size)


def measures(v: DataFrame, e: DataFrame, directed: bool, include_size: bool = True) -> DataFrame:
    return measures_directed(v, e, include_size) if directed else measures_undirected(v, e, include_size)


def first_order_measures(v: DataFrame, e: DataFrame, directed: bool = True) -> DataFrame:
    """node, measure_11 and size_11 (directed), or measure_3 and size_3: the density among a node's neighbours. It needs no roles of
    second-order nodes: edges between neighbours close triangles."""
    e, name = (e, "11") if directed else (both_ways(e), "3")
    near = directions(e).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"))
    found = v.select("node").join(near, "node", "left").join(neighbour_links(e), "node", "left")
    n = F.coalesce("n", F.lit(0).cast("long"))
    links, size = F.coalesce("links", F.lit(0)), n * (n - 1)
    return found.select("node", density(links, size, 0.0).cast("double").alias(f"measure_{name}"), size.cast("long").alias(f"size_{name}"))


def matrix_measures(adjacency, roles_of, compat: bool = True) -> dict[str, tuple[float, int]]:
    """The nine blocks of one ego from its 0/1 matrix and its nodes' roles, by summing the blocks."""
    import numpy as np

    at = [np.flatnonzero(roles_of == k) for k in range(3)]
    c = {p: int(adjacency[np.ix_(at[int(p[0])], at[int(p[1])])].sum()) for p in PAIRS}
    s0, s1, s2 = (len(x) for x in at)
    pairs = {
        "00": (c["00"], (s0 - 1) * (s0 - 2)),
        "01": (c["01"], s0 * s1),
        "02": (c["02"], (s0 - 1) * s2),
        "10": (c["10"], s0 * s1),
        "11": (c["11"], s1 * (s1 - 1)),
        "12": (c["12"], s1 * s2),
    }
    if s2 or not compat:
        pairs |= {"20": (c["20"], (s0 - 1) * s2), "21": (c["21"], s1 * s2), "22": (c["22"], s2 * (s2 - 1))}
        if not s2:
            pairs |= {k: (0, 0) for k in ("20", "21", "22")}
    else:
        # The whole matrix stands in for the missing rows.
        inner = np.concatenate([at[0], at[1]])
        pairs |= {k: (int(adjacency[np.ix_(inner, cols)].sum()), len(inner) * len(cols)) for k, cols in (("20", at[0]), ("21", at[1]), ("22", inner))}
    return {k: (n / size if size > 0 else float(k in ("01", "12")), size) for k, (n, size) in pairs.items()}


def _measures_by_community(v: DataFrame, e: DataFrame, communities: DataFrame, include_size: bool, compat: bool) -> DataFrame:
    import pandas as pd

    schema = "node long, " + ", ".join([*(f"measure_{p} double" for p in PAIRS), *((f"size_{p} long" for p in PAIRS) if include_size else ())])

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        names = np.unique(frame["node"].to_numpy())
        a = np.zeros((len(names), len(names)), np.int64)
        linked = frame[frame["dst"].notna()]
        a[np.searchsorted(names, linked["node"]), np.searchsorted(names, linked["dst"].astype("int64"))] = 1
        u = ((a + a.T) > 0).astype(np.int64)
        two, out, into = (u @ u) > 0, (a @ a) > 0, (a.T @ a.T) > 0
        rows = []
        for x, name in enumerate(names):
            near = u[x] > 0
            far = two[x] & ~near
            far[x] = False
            role = np.full(len(names), -1)
            role[near], role[far] = 1, 0
            role[far & (out[x] | into[x])] = 2
            role[x] = 0
            keep = np.flatnonzero(role >= 0)
            found = matrix_measures(a[np.ix_(keep, keep)], role[keep], compat)
            rows.append([name, *(found[p][0] for p in PAIRS), *((found[p][1] for p in PAIRS) if include_size else ())])
        return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    rows = v.join(communities, "node").join(e.withColumnRenamed("src", "node"), "node", "left").select("community", "node", "dst")
    return rows.groupBy("community").applyInPandas(solve, schema)
