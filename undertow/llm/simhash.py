"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints come from word shingles (XXH64, a bit is set if it is set in over half of the shingles' hashes). Equal
fingerprints are one class from the start. Classes within the radius agree in at least two of radius + 2 bit blocks, so
each class goes to one bucket for every pair of blocks. In a bucket the fingerprints stand as vertical bit planes; a
carry-save counter adds the differing bits of many pairs at once, and a block is left as soon as all its lanes exceed
the radius. A bucket of any size is dealt as pairs of bounded parts, so it is compared in full and no task grows with
it; a task returns a spanning forest of the links it found, never all pairs. Components join the forests.

``drop_near_duplicates`` takes ``similar_groups``: the fingerprints of the sets of five-word shingles are linked in the same way, an
exact check leaves the links at a similarity of 0.8 or more, and an exact join finds the pairs whose fingerprints lie further apart,
see ``similar``.

Defined results: a null text counts as empty; a text without words has fingerprint zero, which is linked like any other. A text
of any length is fingerprinted whole. A bit that half of the shingles' hashes set, and half do not, is 0. Rows are documents,
repeated doc_ids too; the least of equal doc_ids names a component like any other. component_id is the least doc_id that isn't null; a document without doc_id
that is linked to nothing has none. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertow.llm import similar
from undertow.llm.bitsliced import close_pairs, close_rows
from undertow.llm.common import gathered, read_table, text_blocks, without, written
from undertow.llm.components import components

SEED, BITS, SHINGLE, RADIUS = 42, 64, 3, 3
#: Most fingerprints of a bucket's part; a task compares two parts at a time.
PART = 2048
#: Buckets up to this size are compared pair by pair, many buckets at once.
FEW = 32
#: Most buckets of more than a part that are broadcast, with three numbers each.
FEW_LARGE = 20_000


def shingle_hashes(text: str | None, shingle: int) -> list[int]:
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split() if text else []
    if len(words) <= shingle:
        return [xxh64_intdigest(b" ".join(words), SEED)] if words else []
    return [xxh64_intdigest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(shingle)), strict=False)]


def majorities(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bits set in over half of each text's hashes; n: hashes of each text, none zero."""
    begins = np.cumsum(n) - n
    # Bits are counted in the eight byte lanes of a word; runs of up to 255 hashes don't overflow.
    runs = -(-n // 255)
    first = np.cumsum(runs) - runs
    starts = np.repeat(begins, runs) + 255 * (np.arange(runs.sum()) - np.repeat(first, runs))
    value = np.zeros(len(n), np.uint64)
    for b in range(8):
        lanes = np.add.reduceat((h >> np.uint64(b)) & np.uint64(0x0101010101010101), starts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8), first, axis=0, dtype=np.int64)
        for j in range(8):
            value |= (2 * counts[:, j] > n).astype(np.uint64) << np.uint64(8 * j + b)
    return value


def fingerprints(texts: list[str | None], shingle: int = SHINGLE) -> np.ndarray:
    """The texts' fingerprints."""
    hashes = [shingle_hashes(t, shingle) for t in texts]
    n = np.array([len(x) for x in hashes], np.int64)
    result = np.zeros(len(n), np.uint64)
    if n.any():
        result[n > 0] = majorities(np.array([x for one in hashes for x in one], np.uint64), n[n > 0])
    return result


def forest(nodes: np.ndarray, a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of the close pairs within a (b is None) or between a and b; nodes names both."""
    label, shift = np.arange(len(nodes)), 0 if b is None else len(a)
    for i, found in close_rows(a, a if b is None else b, radius):
        labels = np.unique(np.append(label[found + shift], label[i]))
        if len(labels) > 1:
            label[np.isin(label, labels)] = labels[0]
    child = label != np.arange(len(nodes))
    return nodes[child], nodes[label[child]]


def _masks(radius: int) -> list[int]:
    """Bit masks of every pair of radius + 2 blocks."""
    n = radius + 2
    edges = [BITS * i // n for i in range(n + 1)]
    blocks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(n)]
    return [a | b for a, b in combinations(blocks, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(classes: DataFrame, keys: list[Column], node: str, words: list[str], radius: int, part: int = PART) -> DataFrame:
    """u, v: links between the nodes that span what lies within radius and agrees in one of the keys (longs)."""
    deal = F.array(*(F.struct(F.lit(t).cast("long").alias("t"), k.alias("b")) for t, k in enumerate(keys)))
    own = list(dict.fromkeys([node, *words]))
    dealt = classes.select(*own, F.explode(deal).alias("k")).select(*own, "k.t", "k.b")
    # Buckets of more than a part are cut into parts; how many there are decides whether they are broadcast.
    large = dealt.groupBy("t", "b").agg(F.count("*").alias("size")).where(F.col("size") > part)
    most = large.limit(FEW_LARGE + 1).count()
    if not most:
        shared = dealt.withColumn("parts", F.lit(1).cast("long"))
    else:
        h = F.xxhash64("t", "b").alias("h")
        sizes = large.select("*", h)
        shared = dealt.select("*", h).join(
            F.broadcast(sizes) if most <= FEW_LARGE else sizes, ["h", "t", "b"], "left"
        ).withColumn("parts", F.ceil(F.coalesce("size", F.lit(1)) / part))
    shared = shared.withColumn("own", F.pmod(F.xxhash64(node), F.col("parts")))
    other = F.when(F.col("parts") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    pairs = shared.withColumn("other", F.explode(other)).select(
        "t",
        "b",
        F.least("own", "other").alias("low"),
        F.greatest("own", "other").alias("high"),
        "own",
        F.col(node).alias("node"),
        *(F.col(w).alias(f"word{i}") for i, w in enumerate(words)),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for rows in gathered(batches):
            held = rows if held is None else np.concatenate([held, rows])
            # The last bucket may go on in the next batch.
            last = np.flatnonzero((held[1:, :4] != held[:-1, :4]).any(axis=1))
            if len(last):
                yield _compared(held[: last[-1] + 1], radius)
                held = held[last[-1] + 1 :]
        if held is not None:
            yield _compared(held, radius)

    return pairs.repartition("t", "b", "low", "high").sortWithinPartitions("t", "b", "low", "high").mapInArrow(run, "u long, v long")


def _compared(rows: np.ndarray, radius: int) -> pa.RecordBatch:
    """Links within the buckets of rows (t, b, low, high, own, node, words), sorted by the first four."""
    own, node, fp = rows[:, 4], rows[:, 5], np.ascontiguousarray(rows[:, 6:]).view(np.uint64)
    start = np.flatnonzero(np.append(True, (rows[1:, :4] != rows[:-1, :4]).any(axis=1)))
    size = np.diff(np.append(start, len(rows)))
    u, v = [], []
    few = np.repeat(np.where(size <= FEW, np.arange(len(size)), -1 - np.arange(len(size))), size)
    for d in range(1, min(FEW, int(size.max()))):
        i = np.flatnonzero((few[d:] == few[:-d]) & (few[d:] >= 0))
        i = i[(rows[i, 2] == rows[i, 3]) | (own[i] != own[i + d])]
        if len(i):
            i = i[close_pairs(fp[i], fp[i + d], radius)]
            u.append(node[i])
            v.append(node[i + d])
    for at in np.flatnonzero(size > FEW):
        part = slice(start[at], start[at] + size[at])
        names, values, side = node[part], fp[part], own[part] == rows[start[at], 2]
        same = rows[start[at], 2] == rows[start[at], 3]
        a, b = forest(names, values, None, radius) if same else forest(
            np.concatenate([names[side], names[~side]]), values[side], values[~side], radius
        )
        u.append(a)
        v.append(b)
    columns = [pa.array(np.concatenate(x) if x else np.array([], np.int64)) for x in (u, v)]
    return pa.RecordBatch.from_arrays(columns, names=["u", "v"])


def block_keys(word: str, radius: int) -> list[Column]:
    """A key for each pair of radius + 2 bit blocks of one word: whatever is within radius shares one."""
    return [F.col(word).bitwiseAND(F.lit(_signed(m))) for m in _masks(radius)]


def fingerprinted(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, 1):
            yield pa.RecordBatch.from_arrays(
                [block.column(0), pa.array(fingerprints(block.column(1).to_pylist(), shingle).view(np.int64))], names=["doc_id", "fp"]
            )

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    ).mapInArrow(run, "doc_id long, fp long")


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, part: int = PART, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id."""
    table = written(fingerprinted(docs, shingle, id_col, text_col), "fingerprints")
    classes = written(table.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("size")), "classes", per_core=1)
    roots = components(links(classes, block_keys("fp", radius), "fp", ["fp"], radius, part))
    joined = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = joined.groupBy("root").agg(F.min("least").alias("component"), F.sum("size").alias("size")).where("size > 1")
    deal = F.xxhash64("root").alias("deal")
    known = joined.select("fp", "root", deal).join(least.select("*", deal), ["deal", "root"]).select("fp", "component", F.xxhash64("fp").alias("key"))
    return table.withColumn("key", F.xxhash64("fp")).join(known, ["key", "fp"], "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component", "doc_id").alias("component_id")
    )


def close_links(classes: DataFrame) -> DataFrame:
    """u, v: links that span the nodes (node, fp) whose fingerprints differ in at most RADIUS bits."""
    return links(classes, block_keys("fp", RADIUS), "node", ["fp"], RADIUS)


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, text_hash, group (a number that similar texts share), first (whether it is the group's least in doc_id and
    text_hash), for each document but those that are surely alone."""
    return similar.groups(docs, majorities, close_links, id_col, text_col, **how)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents that stay, with all their columns: the least doc_id of each group of similar texts."""
    found = written(
        similar_groups(docs, id_col, text_col, **how).select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "first"),
        "grouped",
        per_core=1,
    )
    repeated = not found.where("first").groupBy("id", "hash").count().where("count > 1").isEmpty()
    return without(docs, found.where("not first"), id_col, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), repeated)


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
