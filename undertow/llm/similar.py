"""Groups of texts whose sets of word shingles have a Jaccard similarity of at least four fifths, exactly.

Shingles are put in one order for all texts: the rarest in the corpus first. Two sets of similarity 0.8 share a shingle among
the first n // 5 + 1 of each (prefix filter), so a text with as many shingles that stand nowhere else is alone, and the others
meet in the buckets of the shared shingles of their prefixes; no pair can be missed. How often each shingle occurs is counted
over the whole corpus (``ngrams``).

Texts that meet are compared by sketches of 512 bits: a bit is set if an odd number of a set's hashes falls on it, so two
sketches differ in at most as many bits as the sets differ in shingles, and more than a ninth of both sizes rules a pair out.
Large parts of a bucket are compared bit by bit, many pairs at once. What is left is verified on the whole sets before it becomes a link.
Shingles are compared by hashes of 64 bits, equal sets by 128.

A large group of copies isn't paired in full. In a first step the texts' SimHash fingerprints are linked (``simhash``), and each
text meets the few that follow it in a bucket, in an order by size and then by a hash that differs from bucket to bucket; buckets
are cut anywhere between tasks. In a second step, for what fingerprints can't find, texts
that share a bucket but still lie in different components meet: those of other components than the bucket's most frequent one
meet all, in pairs of bounded parts of the bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.llm.bitsliced import close_rows
from undertow.llm.common import gathered, packed, release, unpacked, written
from undertow.llm.components import components
from undertow.llm.ngrams import COUNTED, RANGE_KEYS, Counts, blocks, mix

SHINGLE = 5
#: Tokens of a block; smaller than elsewhere, since a block's sets are made text by text beside its arrays.
BLOCK_TOKENS = 700_000
#: Texts that a text meets at once in a bucket, and most texts of a bucket's part; a task compares two parts at a time.
NEIGHBOURS, PART = 3, 2048
SKETCH = 512
#: Sketches rule out next to nothing from this radius on.
USELESS = SKETCH * 45 // 100
#: From so many rows on sketches are compared bit by bit, many pairs at once.
MANY = 1024
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
WORDS = [f"s{i}" for i in range(SKETCH // 64)]
LINK = "u long, v long"


def shingles(h: np.ndarray, lengths: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' shingles, and how many each text has. A shorter text is one shingle as a whole, an empty one
    has none. h, lengths: of the texts with their end tokens."""
    words = lengths - 1
    n = np.where(words >= size, words - size + 1, np.minimum(words, 1))
    first = np.cumsum(n) - n
    at = np.arange(n.sum()) + np.repeat(np.cumsum(lengths) - lengths - first, n)
    long = np.repeat(np.minimum(words, size), n)
    found = mix(h[at] + long.astype(np.uint64))
    for k in range(1, size):
        more = mix(found * _MULTIPLIER + h[np.minimum(at + k, len(h) - 1)]) if len(at) else found
        found = np.where(long > k, more, found)
    return found, n


def sketch(s: np.ndarray) -> bytes:
    odd = np.bincount((s >> np.uint64(64 - (SKETCH - 1).bit_length())).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets, given in ascending order, have a similarity of at least 0.8."""
    small, large = sorted((a, b), key=len)
    if 5 * len(small) < 4 * len(large):
        return False
    if not len(small):
        return True
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    shared = int((large[at] == small).sum())
    return 5 * shared >= 4 * (len(a) + len(b) - shared)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits the sketches of pairs differ."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def live(
    docs: DataFrame, id_col: str, text_col: str, block_tokens: int, range_keys: int, fingerprint: Callable[[np.ndarray, np.ndarray], np.ndarray]
) -> DataFrame:
    """Of each text that may have a partner: doc_id, text_hash, name_a and name_b (a hash of its set), n, fp (its fingerprint), set,
    keys (the shared shingles of its prefix) and sketch."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    made = blocks(
        docs.select(
            F.lit(COUNTED).alias("kind"), text.alias("text"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash")
        ),
        block_tokens,
    )
    tokens = made.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    counts_of = Counts(made, lambda h, lengths: [shingles(h, lengths)[0]], 1, max(1, tokens), range_keys)

    def take(block: dict, h: np.ndarray, counts: list[np.ndarray]) -> pa.RecordBatch:
        from xxhash import xxh3_128_digest

        found, n = shingles(h, np.array(block["lengths"], np.int64))
        rows: list[tuple] = []
        for doc_id, text_hash, start, size in zip(block["doc_id"], block["text_hash"], np.cumsum(n) - n, n, strict=True):
            s, at = np.unique(found[start : start + size], return_index=True)
            times, most = counts[0][start : start + size][at], len(s) // 5 + 1
            if len(s) and (times == 1).sum() >= most:
                continue
            first = np.lexsort((s, times))[:most]
            name = np.frombuffer(xxh3_128_digest(s.tobytes()), np.int64).tolist()
            fp = int(fingerprint(s, np.array([len(s)])).view(np.int64)[0]) if len(s) else 0
            rows.append((doc_id, text_hash, *name, len(s), fp, packed(np.diff(s, prepend=np.uint64(0))), s[first[times[first] > 1]].tobytes(), sketch(s)))
        kinds = [pa.int64()] * 6 + [pa.binary()] * 3
        columns = list(zip(*rows, strict=True)) if rows else [()] * 9
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            names=["doc_id", "text_hash", "name_a", "name_b", "n", "fp", "set", "keys", "sketch"],
        )

    schema = "doc_id long, text_hash long, name_a long, name_b long, n long, fp long, set binary, keys binary, sketch binary"
    return written(counts_of.use(take, schema), "live", per_core=4)


def entries(classes: DataFrame) -> DataFrame:
    """key, node, n, and the words of the sketch, for each key of a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
            if keys:
                times = [len(x) for x in keys]
                words = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int64).reshape(-1, len(WORDS))
                columns = [np.concatenate(keys), *(np.repeat(batch.column(i).to_numpy(), times) for i in (0, 1)), *np.repeat(words, times, axis=0).T]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["key", "node", "n", *WORDS])
        release()

    schema = "key long, node long, n long" + "".join(f", {w} long" for w in WORDS)
    return classes.select("node", "n", "keys", "sketch").mapInArrow(run, schema)


def _words(rows: np.ndarray) -> np.ndarray:
    """The sketches that stand in the last columns."""
    return np.ascontiguousarray(rows[:, -len(WORDS) :]).view(np.uint64)


def _links(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])


def met_at_once(classes: DataFrame) -> DataFrame:
    """u, v: texts that follow each other in a bucket and may be alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = np.zeros((0, 3 + len(WORDS)), np.int64)
        for new in gathered(batches):
            rows, old = np.concatenate([before, new]), len(before)
            first, second = [], []
            for d in range(1, NEIGHBOURS + 1):
                i = np.flatnonzero(rows[d:, 0] == rows[:-d, 0])
                i = i[(i + d >= old) & (5 * rows[i, 2] >= 4 * rows[i + d, 2])]
                first.append(i)
                second.append(i + d)
            i, j = np.concatenate(first), np.concatenate(second)
            words = _words(rows)
            good = 9 * differing(words[i], words[j]) <= rows[i, 2] + rows[j, 2]
            yield _links(rows[i[good], 1], rows[j[good], 1])
            before = rows[-NEIGHBOURS:]

    order = "key", "n", "salt"
    dealt = entries(classes).withColumn("salt", F.xxhash64("key", "node"))
    return dealt.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "node", "n", *WORDS).mapInArrow(run, LINK).distinct()


def across(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (key, low, high, own, node, n, root, sketch), ascending by n, of two parts of a bucket (or one) that lie in
    different components and may be alike."""
    own, n, root, words = rows[:, 3], rows[:, 5], rows[:, 6], _words(rows)
    same = rows[0, 1] == rows[0, 2]
    names, at, counts = np.unique(root, return_inverse=True, return_counts=True)
    asks = np.flatnonzero(at != counts.argmax())
    first, second = [], []

    def take(i: np.ndarray, j: np.ndarray) -> None:
        # Of two that both ask, the one before asks.
        good = (root[i] != root[j]) & (same | (own[i] != own[j])) & ((at[j] == counts.argmax()) | (i < j))
        good &= 5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j])
        i, j = i[good], j[good]
        good = 9 * differing(words[i], words[j]) <= n[i] + n[j]
        first.append(i[good])
        second.append(j[good])

    for start in range(0, len(asks), 64):
        some = asks[start : start + 64]
        low, high = np.searchsorted(n, -(-4 * n[some[0]] // 5)), np.searchsorted(n, 5 * n[some[-1]] // 4, "right")
        radius = int(n[some[-1]] + n[high - 1]) // 9
        if high - low >= MANY and radius < USELESS:
            for i, found in close_rows(words[some], words[low:high], radius):
                take(np.full(len(found), some[i]), found + low)
        else:
            take(np.repeat(some, high - low), np.tile(np.arange(low, high), len(some)))
    return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in (first, second))


def met_across(classes: DataFrame, roots: DataFrame, part: int) -> DataFrame:
    """u, v: texts that share a bucket, lie in different components and may be alike."""
    known = entries(classes).select("key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = known.groupBy("key").agg(
        F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high")
    ).where("low <> high").select("key", F.ceil(F.col("size") / part).alias("parts"))
    # The extra key has both sides dealt anew, so that a hot bucket can be split.
    deal = F.xxhash64("key").alias("deal")
    shared = known.select("*", deal).join(mixed.select("*", deal), ["deal", "key"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")))
    dealt = shared.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select(
        "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "root"
    )
    sketches = entries(classes.withColumn("keys", F.unhex(F.lit("0" * 16)))).drop("key")
    whole = dealt.join(sketches, "node").select("key", "low", "high", "own", "node", "n", "root", *WORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for rows in gathered(batches):
            held = rows if held is None else np.concatenate([held, rows])
            ends = np.flatnonzero((held[1:, :3] != held[:-1, :3]).any(axis=1)) + 1
            yield from _compared(held, [0, *ends])
            held = held[ends[-1] :] if len(ends) else held
        if held is not None:
            yield from _compared(held, [0, len(held)])

    keys = "key", "low", "high"
    return whole.repartition(*keys).sortWithinPartitions(*keys, "n", "node").mapInArrow(run, LINK).distinct()


def _compared(rows: np.ndarray, ends: list[int]) -> Iterator[pa.RecordBatch]:
    u, v = [], []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        i, j = across(rows[a:b])
        u.append(rows[a + i, 4])
        v.append(rows[a + j, 4])
    if u:
        yield _links(np.concatenate(u), np.concatenate(v))


def verified(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs u, v whose sets are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = ([np.cumsum(unpacked(s, n), dtype=np.uint64) for n, s in zip(batch.column(i).to_pylist(), batch.column(i + 1).to_pylist(), strict=True)] for i in (2, 4))
            good = pa.array([alike(a, b) for a, b in zip(one, two, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(good) for i in (0, 1)], names=["u", "v"])
        release()

    one, two = (classes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("set").alias(f"set_{x}")) for x in "uv")
    return written(pairs.join(one, "u").join(two, "v").select("u", "v", "n_u", "set_u", "n_v", "set_v").mapInArrow(run, LINK), "alike", per_core=1)


def groups(
    docs: DataFrame,
    fingerprint: Callable[[np.ndarray, np.ndarray], np.ndarray],
    close: Callable[[DataFrame], DataFrame],
    id_col: str = "doc_id",
    text_col: str = "text",
    part: int = PART,
    block_tokens: int = BLOCK_TOKENS,
    range_keys: int = RANGE_KEYS,
) -> DataFrame:
    """fingerprint: of hashes and how many each text has; close: u, v, the links between the nodes whose fp lie close. The result:
    doc_id, text_hash, group (a number that similar texts share) and first (whether it is the group's least in doc_id and
    text_hash) of each text that may have a partner; texts that surely have none are left out."""
    names = ["name_a", "name_b"]
    table = live(docs, id_col, text_col, block_tokens, range_keys, fingerprint)
    classes = table.groupBy(*names).agg(
        F.min(F.struct("doc_id", "text_hash")).alias("least"), *(F.first(c).alias(c) for c in ("n", "fp", "set", "keys", "sketch"))
    )
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes", per_core=1)
    found = close(classes).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).union(met_at_once(classes)).distinct()
    links = verified(written(found, "near", per_core=1), classes)
    roots = components(links)
    rest = written(met_across(classes, roots, part), "across", per_core=1)
    if not rest.isEmpty():
        roots = components(links.union(verified(rest, classes)))
    joined = classes.select(*names, "node", "least").join(roots, "node", "left").withColumn("group", F.coalesce("root", "node"))
    # Keys that hold a hash of their own have both sides of a join dealt anew, so that a hot group can be split.
    deal = F.xxhash64("group").alias("deal")
    least = joined.groupBy("group").agg(F.min("least").alias("least")).select("*", deal)
    known = joined.drop("least").select("*", deal).join(least, ["deal", "group"]).select(*names, "group", "least", F.xxhash64(*names).alias("key"))
    own = table.select("doc_id", "text_hash", *names, F.xxhash64(*names).alias("key"))
    return own.join(known, ["key", *names]).select(
        "doc_id", "text_hash", "group", F.col("least").eqNullSafe(F.struct("doc_id", "text_hash")).alias("first")
    )
