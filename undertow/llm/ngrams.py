"""Counts of all n-grams of a corpus, and each text's n-grams with their counts.

1. Texts are written as blocks of about a million and a half tokens: the numbers of their words and the hashes of the distinct
   words.
2. Each block sorts the keys of its distinct n-grams, cuts them into ranges and sends each range with its counts to the
   range's owner: an n-gram travels once a block, however frequent it is, so none makes a hot group.
3. An owner adds up the counts and answers in the order of the keys it got, so that an answer is counts alone. A block that
   meets its answers again finds the count of each n-gram by its rank.

Keys are hashes whose number of bits follows the corpus (24 more than the logarithm of its tokens, 64 at most): an n-gram
shares its key with another with a chance under 2 ** -24, whatever the size. Words are told apart by 64 bits.

What an n-gram costs to move depends on how many of a block's keys fall into one range: at 10 ** 10 tokens about 140, at 10 ** 12
two. Up to the former a key takes about four bytes; towards the latter rows of single keys, of about 70 bytes.

Words are runs of anything but ASCII white space, A-Z lowered; a text ends in an end token. A text is part of one block, so
a block is longer than others only where one text is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.llm.common import Lookup, kept_in_worker, packed, release, text_blocks, unpacked, written

#: Kinds of texts: counted, counted and also told what the counts are without this kind, and only told the counts.
COUNTED, APART, ASKING = 0, 1, 2
#: Tokens of a block, and keys of an owner's range, about.
BLOCK_TOKENS, RANGE_KEYS = 1_500_000, 1 << 21
#: Bits of a key beyond the logarithm of the number of tokens.
SPARE_BITS = 24
#: Stand for blocks in the rows that count distinct keys.
ALL, REST = -1, -2
#: Stands for the end of a text; no word's hash is likely to equal it.
END = np.uint64(0x51A7C0DE0E4D0001)
BLOCK = "kind int, tokens long, lengths array<long>, n long, one binary, two binary"
RANGE = "range_ int, block long, kind int, n long, one binary, two binary"

#: From the hashes of a block's tokens and its texts' lengths in tokens: arrays of n-gram hashes, one after the other.
Grams = Callable[[np.ndarray, np.ndarray], Iterable[np.ndarray]]


def split(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_table() -> Lookup:
    from xxhash import xxh64_intdigest

    return Lookup(xxh64_intdigest, limit=150_000)


class Building:
    """A block that grows by texts; carried: numbers that come along with each text."""

    def __init__(self) -> None:
        self.words: list[np.ndarray] = []
        self.carried: list[tuple] = []
        self.tokens = 0

    def add(self, words: list[bytes], carried: tuple, table: Lookup) -> None:
        found = np.empty(len(words) + 1, np.uint64)
        found[:-1] = np.fromiter(map(table.__getitem__, words), np.uint64, len(words))
        found[-1] = END
        self.words.append(found)
        self.carried.append(carried)
        self.tokens += len(found)

    def row(self, kind: int, names: list[str]) -> pa.RecordBatch:
        distinct, numbers = np.unique(np.concatenate(self.words), return_inverse=True)
        longs = pa.list_(pa.int64())
        lists = [pa.array([list(x)], longs) for x in zip(*self.carried, strict=True)]
        one, two = packed(np.diff(distinct, prepend=np.uint64(0))), packed(numbers.astype(np.uint64))
        arrays = [
            pa.array([kind], pa.int32()),
            pa.array([self.tokens]),
            pa.array([[len(w) for w in self.words]], longs),
            pa.array([len(distinct)]),
            pa.array([one]),
            pa.array([two]),
            *lists,
        ]
        return pa.RecordBatch.from_arrays(arrays, names=["kind", "tokens", "lengths", "n", "one", "two", *names])


def blocks(texts: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The texts (kind, text, and numbers to carry along) as written blocks of one kind each, with a number of their own."""
    names = [c for c in texts.columns if c not in ("kind", "text")]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = kept_in_worker("words of n-grams", _word_table)
        growing: dict[int, Building] = {}
        for batch in text_blocks(batches, 1):
            for kind, text, *carried in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = split(text)
                if kind in growing and growing[kind].tokens + len(words) >= block_tokens:
                    yield growing.pop(kind).row(kind, names)
                growing.setdefault(kind, Building()).add(words, tuple(carried), table)
        for kind in list(growing):
            yield growing.pop(kind).row(kind, names)
        release()

    made = texts.select("kind", "text", *names).mapInArrow(build, BLOCK + "".join(f", {c} array<long>" for c in names))
    return written(made.withColumn("block", F.monotonically_increasing_id()), "blocks")


def words_of(block: dict) -> np.ndarray:
    """The hash of each token of a block."""
    return np.cumsum(unpacked(block["one"], block["n"]), dtype=np.uint64)[unpacked(block["two"], block["tokens"]).astype(np.int64)]


def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts the keys, where each distinct key begins in it, and the distinct keys' counts."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    begin = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
    return order, begin, np.diff(np.append(begin, len(s)))


class Counts:
    """The counts of the n-grams of written blocks, held by the owners of ranges of keys."""

    def __init__(self, made: DataFrame, grams: Grams, lists: int, tokens: int, range_keys: int = RANGE_KEYS) -> None:
        """lists: how many arrays grams gives. tokens: of all blocks."""
        self.made, self.grams, self.lists = made, grams, lists
        self.shift = np.uint64(64 - min(64, tokens.bit_length() + SPARE_BITS))
        #: Ranges of each list; they are cut by the leading bits of a key.
        self.ranges = 1 << max(0, (tokens // range_keys).bit_length())
        self.replies = written(self._answers(), "answers", per_core=4)

    def distinct(self) -> tuple[int, int]:
        """How many n-grams of the first list are counted, in all texts and without those that stand apart."""
        found = {r.block: r.n for r in self.replies.where("block < 0").groupBy("block").agg(F.sum("n").alias("n")).collect()}  # two rows
        return found.get(ALL, 0), found.get(REST, 0)

    def _answers(self) -> DataFrame:
        """For each block and range: n, one (the counts), two (without the texts that stand apart, for a block of theirs).
        Rows of the blocks ALL and REST hold, as n, how many keys of a range of the first list are counted in either way."""
        shift, ranges, grams = self.shift, self.ranges, self.grams
        low = np.uint64(64 - int(shift) - (ranges - 1).bit_length())

        def asked(block: dict) -> Iterator[pa.RecordBatch]:
            for k, gram in enumerate(grams(words_of(block), np.array(block["lengths"], np.int64))):
                keys = np.sort(gram >> shift)
                begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
                counts, keys = np.diff(np.append(begin, len(keys))).astype(np.uint64), keys[begin]
                cuts = np.searchsorted(keys, np.arange(ranges, dtype=np.uint64) << low) if ranges > 1 else np.zeros(1, np.int64)
                rows: list[list] = [[], [], [], []]
                for r, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(keys)], strict=True)):
                    if b > a:
                        step = np.diff(keys[a:b], prepend=np.uint64(r) << low if ranges > 1 else np.uint64(0))
                        row = k * ranges + r, b - a, packed(step), b"" if block["kind"] == ASKING else packed(counts[a:b])
                        for column, value in zip(rows, row, strict=True):
                            column.append(value)
                yield _batch(rows[0], [block["block"]] * len(rows[0]), [block["kind"]] * len(rows[0]), *rows[1:])

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in batch.to_pylist():
                    yield from asked(block)
            release()

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[dict] = []
            for batch in batches:
                for row in batch.to_pylist():
                    if held and row["range_"] != held[0]["range_"]:
                        yield _added(held, ranges)
                        held = []
                    held.append(row)
            if held:
                yield _added(held, ranges)
            release()

        sent = self.made.select("block", "kind", "tokens", "lengths", "n", "one", "two").mapInArrow(ask, RANGE)
        return sent.repartition("range_").sortWithinPartitions("range_").mapInArrow(answer, RANGE)

    def use(self, take: Callable[[dict, np.ndarray, list[np.ndarray]], pa.RecordBatch], schema: str, apart: bool = False) -> DataFrame:
        """What take gives for each block, from the block's row, its tokens' hashes, and the count of each n-gram by list.
        apart: only of the texts that stand apart, with the counts without them."""
        shift, ranges, lists, grams, which = self.shift, self.ranges, self.lists, self.grams, "two" if apart else "one"

        def finish(block: dict, got: list[list[dict]]) -> pa.RecordBatch:
            h, counts = words_of(block), []
            for gram, rows in zip(grams(h, np.array(block["lengths"], np.int64)), got, strict=True):
                by_rank = np.concatenate([np.zeros(0, np.uint64), *(unpacked(r[which], r["n"]) for r in rows)])
                at, begin, size = ranked(gram >> shift)
                if len(begin) != len(by_rank):
                    raise ValueError("a block's answers don't fit its n-grams")
                here = np.empty(len(at), np.float64)
                here[at] = np.repeat(by_rank.astype(np.float64), size)
                counts.append(here)
            return take(block, h, counts)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, got = None, []
            for batch in batches:
                for row in batch.to_pylist():
                    if row["range_"] < 0:
                        if block is not None:
                            yield finish(block, got)
                        block, got = row, [[] for _ in range(lists)]
                    else:
                        got[row["range_"] // ranges].append(row)
            if block is not None:
                yield finish(block, got)
            release()

        mine, theirs = self.made.withColumn("range_", F.lit(-1)), self.replies.where("block >= 0")
        if apart:
            mine, theirs = (x.where(F.col("kind") == APART) for x in (mine, theirs))
        both = mine.unionByName(theirs, allowMissingColumns=True)
        return both.repartition("block").sortWithinPartitions("block", "range_").mapInArrow(run, schema)


def _batch(range_, block, kind, n, one, two) -> pa.RecordBatch:
    kinds = pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()
    arrays = [pa.array(x, k) for x, k in zip((range_, block, kind, n, one, two), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=["range_", "block", "kind", "n", "one", "two"])


def _added(rows: list[dict], ranges: int) -> pa.RecordBatch:
    """The answers of one range's owner."""
    n, range_ = np.array([r["n"] for r in rows], np.int64), rows[0]["range_"]
    keys = np.concatenate([np.cumsum(unpacked(r["one"], r["n"]), dtype=np.uint64) for r in rows])
    times = np.concatenate([unpacked(r["two"], r["n"]) if r["two"] else np.zeros(r["n"], np.uint64) for r in rows])
    order, begin, size = ranked(keys)
    del keys
    sums, distinct = [], []
    for some in (times, np.where(np.repeat([r["kind"] == COUNTED for r in rows], n), times, np.uint64(0))):
        total = np.add.reduceat(some[order], begin)
        spread = np.empty(len(order), np.uint64)
        spread[order] = np.repeat(total, size)
        sums.append(spread)
        distinct.append(int((total > 0).sum()))
    end = np.cumsum(n)
    one = [packed(sums[0][b - c : b]) for b, c in zip(end, n, strict=True)]
    two = [packed(sums[1][b - c : b]) if r["kind"] == APART else b"" for r, b, c in zip(rows, end, n, strict=True)]
    block, kind = [r["block"] for r in rows], [r["kind"] for r in rows]
    if range_ < ranges:
        block, kind, n, one, two = [*block, ALL, REST], [*kind, COUNTED, COUNTED], [*n, *distinct], [*one, b"", b""], [*two, b"", b""]
    return _batch([range_] * len(n), block, kind, n, one, two)
