"""Packing documents into sequences of a fixed length by best-fit decreasing.

Overlong documents are first cut into full windows. The rest, one piece a document, goes by decreasing length into the
tightest open window, which a segment tree indexed by remaining capacity finds. Pieces of one length are alike, so the
fit runs over the histogram of lengths, of at most ``window`` rows whatever the number of documents: it is exactly
best-fit decreasing over all pieces, not over shards of them. Its plan says which ranks of a length go to which windows;
ranks come from bucket counts, so a length that a third of the pieces share is dealt over all tasks.

Defined results: a null text counts as empty and is the end id alone. Repeated rows and doc_ids are packed row by row.
Extra columns are ignored. Ties (equal lengths) go by the written row order. An empty table gives an empty result. Texts
of any length are tokenised whole.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undertow.llm.common import Lookup, kept_in_worker, public_tokenizer, read_table, text_blocks, written

TOKENIZER, END_ID, WINDOW = "word_bpe_49k.json", 2, 4096
#: Buckets that the pieces of one length are ranked in: at least so many, and more where a bucket would pass so many pieces.
BUCKETS, BUCKET_PIECES = 1024, 100_000


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next free one."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(free)) for b in range(256)]


class WordTokens:
    """Ids of whole texts by their distinct words; for lower-casing tokenizers that drop ASCII white space between words
    and treat runs of letters and runs of punctuation as words of their own."""

    #: Punctuation that is cut from a word's end, since it is a token run of its own behind a letter or digit.
    TAIL = b".,!?*%#$&;:"
    #: Letters that normalisation leaves alone and that are words by themselves.
    PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u017e]+")

    def __init__(self, definition: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.model, self.letters = self.tokenizer.model, str.maketrans({chr(b): c for b, c in enumerate(byte_letters())})
        self.table = Lookup(self._ids, limit=120_000)
        for probe in ("Ab, c\u00c9d's\t\n x1  <|", "erorly. na\u00efve!? \u00df\u00fc\u0151 it's.", "x-y, 12ab. ..."):
            if self(probe) != self._whole(probe):
                raise ValueError("this tokenizer does not treat words one by one")

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _ids(self, word: bytes) -> bytes:
        core = word.rstrip(self.TAIL)
        if len(core) < len(word) and core[-1:].isalnum():
            return self.table[core] + self.table[word[len(core) :]]
        text = word.decode().lower()
        if self.PLAIN.fullmatch(text):
            return array(
                "I", [t.id for t in self.model.tokenize(text if text.isascii() else text.encode().decode("latin-1").translate(self.letters))]
            ).tobytes()
        return self._whole(word.decode())

    def __call__(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        raw = (text or "").encode()
        # ASCII case doesn't matter to a lower-casing tokenizer, except inside its special tokens.
        words = raw.split() if b"<|" in raw else raw.lower().split()
        return b"".join(map(self.table.__getitem__, words))


def pieces(
    docs: DataFrame,
    tokenizer_file: str,
    window: int = WINDOW,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """doc_id, start, length, payload (the ids' bytes, or their CRC-32), doc_tokens; full windows first, then the rest."""
    with open(tokenizer_file, encoding="utf-8") as f:
        definition = f.read()  # a fixed two megabytes, sent with the tasks
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = kept_in_worker(("tokens", definition), lambda: WordTokens(definition))
        for block in text_blocks(batches, 1):
            rows: list[list] = [[], [], [], [], []]
            for doc, ids in zip(block.column(0).to_pylist(), map(tokens, block.column(1).to_pylist()), strict=True):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, window):
                    part = ids[4 * start : 4 * (start + window)]
                    for column, value in zip(rows, (doc, start, len(part) // 4, part if with_ids else zlib.crc32(part), n), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary() if with_ids else pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["doc_id", "start", "length", "payload", "doc_tokens"]
            )

    kind = "binary" if with_ids else "long"
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    ).mapInArrow(run, f"doc_id long, start long, length long, payload {kind}, doc_tokens long")


class CapacityTree:
    """A segment tree over remaining capacities: how many open windows lie under each node."""

    def __init__(self, most: int) -> None:
        self.leaves = 1 << (most + 1).bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        i = self.leaves + capacity
        while i:
            self.count[i] += n
            i //= 2

    def tightest(self, length: int) -> int | None:
        """The least capacity of an open window that holds length."""
        i = self.leaves + length
        if self.count[i]:
            return length
        while i > 1:
            if i % 2 == 0 and self.count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def best_fit_decreasing(histogram: dict[int, int], window: int = WINDOW) -> np.ndarray:
    """The plan: rows (length, first rank, first window, pieces a window, first offset), by length and rank."""
    tree, open_windows, plan, made = CapacityTree(window), {}, [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity = window
                run, n = made, -(-left // (window // length))
                made += n
            else:
                run, n = open_windows[capacity].pop()
                tree.add(capacity, -n)
            each = capacity // length
            full = min(n, left // each)
            rest = min(left - full * each, each) if full < n else 0
            plan.append((length, rank, run, each, window - capacity))
            for first, windows, after in (
                (run, full, capacity - each * length),
                (run + full, int(rest > 0), capacity - rest * length),
                (run + full + (rest > 0), n - full - (rest > 0), capacity),
            ):
                if windows > 0 and after > 0:
                    open_windows.setdefault(after, []).append((first, windows))
                    tree.add(after, windows)
            placed = full * each + rest
            left, rank = left - placed, rank + placed
    return np.array(sorted(plan), np.int64).reshape(-1, 5)


def pack(
    docs: DataFrame,
    tokenizer_file: str,
    window: int = WINDOW,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """Per piece: doc_id, start, length, payload, doc_tokens, sequence_id, offset."""
    table = written(
        pieces(docs, tokenizer_file, window, end_id, id_col, text_col, with_ids).withColumn("row", F.monotonically_increasing_id()), "pieces"
    )
    buckets = max(BUCKETS, table.count() // BUCKET_PIECES)
    keyed = table.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    counts = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    plan = best_fit_decreasing(
        {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, window
    )  # at most `window` rows
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    firsts = counts.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("first"))
    ranked = keyed.join(firsts, ["length", "bucket"]).withColumn(
        "rank", F.col("first") + F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row")) - 1
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (plan[:, 0] << 48) + plan[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(name).to_numpy() for name in ("length", "rank"))
            row = plan[np.searchsorted(keys, (length << 48) + rank, "right") - 1]
            nth = rank - row[:, 1]
            columns = [batch.column(name) for name in ("doc_id", "start", "length", "payload", "doc_tokens")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(row[:, 2] + nth // row[:, 3]), pa.array(row[:, 4] + nth % row[:, 3] * length)],
                names=[*names, "sequence_id", "offset"],
            )

    names = ["doc_id", "start", "length", "payload", "doc_tokens"]
    kind = "binary" if with_ids else "long"
    return ranked.select(*names, "rank").mapInArrow(
        place, f"doc_id long, start long, length long, payload {kind}, doc_tokens long, sequence_id long, offset long"
    )


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), public_tokenizer(TOKENIZER), with_ids=False).withColumnRenamed("payload", "ids_crc32")
