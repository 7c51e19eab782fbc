"""Ranked lexical search by Block-Max WAND over an index in shards.

Documents are cut into shards of bounded bytes. A shard's index has, for each term, postings in blocks of a fixed number, with the
documents by their place in the shard; a block holds its first and last document, the greatest impact of its postings, and the
postings themselves as compressed steps and counts. The index is written as a table and covers every term of every document.

A search reads the blocks of the asked terms, shard by shard. For each item a pointer a term moves over the blocks' ends and maximum
impacts alone (shallow): their sum, weighted, bounds the score of any document. Documents are passed in order; the next pivot is
the first one whose bound reaches the threshold, the item's k-th best score so far, and only blocks that hold such a document are
decompressed, a window of documents at a time. All others are skipped. An item starts with the k-th best score that a few whole
shards gave, where there are many. The shards' best documents, k an item, are ranked together.

Items are handled in blocks of a bounded number of terms, each of which is sent to all tasks; every block meets all shards.

Scores are whole numbers. A posting's impact is (1000000000 * tf) div (1000 * tf + 8 * m), where m tells the document's length from
the mean. A document's score adds up its terms' weights times impacts.

Defined results: a null or empty text has no terms and is in no result; a text of any length is indexed whole, in a shard of its own
if it must. A null doc_id ranks as the least of equal scores. Rows that repeat a doc_id, or all of a row, are documents each; rows
that repeat an item_id are items each, with ranks of their own. Items without terms, or whose terms no document holds, have no rows.
An empty table of either kind gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undertow.llm.common import read_table, release, written

#: Documents an item, and parts of a hundred by which length counts (the contract's).
K, LENGTH = 10, 75
#: Bytes of text in a shard's index, postings in a block, documents in a window, terms of a block of items.
SHARD_BYTES, BLOCK, WINDOW, ITEM_TERMS = 8 << 20, 128, 2048, 100_000
#: Shards, about, that give the first thresholds.
FIRST = 16
#: Term bytes as they are, but A to Z lowered; all others as blanks. Bytes from 128 on are parts of longer characters, which are term characters.
TERM = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)
INDEX = "shard long, term binary, `block` int, docs int, first int, last int, top long, data binary"


def terms_of(texts: pa.BinaryArray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """All terms of the texts, one after the other, and each text's number of terms."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    letters = TERM[data]
    inside = letters != 32
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    # A text's first byte starts a term even where the text before it ends in one.
    first = offsets[:-1] - offsets[0]
    first = first[first < len(letters)]
    starts[first] = inside[first]
    place = np.cumsum(inside) - inside
    ends = np.append(place[starts], inside.sum()).astype(np.int64)
    counted = np.append(0, np.cumsum(starts))[offsets - offsets[0]]
    buffers = [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(letters[inside]))]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, buffers), np.diff(counted)


def text_rows(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return rows.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))


def corpus_counts(texts: DataFrame) -> tuple[int, int]:
    """Documents with a term, and terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = terms = 0
        for batch in batches:
            n = terms_of(batch.column(1))[1]
            docs, terms = docs + int((n > 0).sum()), terms + int(n.sum())
        yield pa.RecordBatch.from_pydict({"docs": [docs], "terms": [terms]})
        release()

    found = texts.mapInArrow(run, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return found[0] or 0, found[1] or 0


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers from 0 on, seven bits a byte, and where each ends."""
    wide = 1 + sum((values >= 1 << bits).astype(np.int64) for bits in range(7, 63, 7))
    ends = np.cumsum(wide)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for j in range(int(wide.max(initial=0))):
        on = wide > j
        out[(ends - wide)[on] + j] = (values[on] >> 7 * j & 127) | np.where(wide[on] > j + 1, 128, 0)
    return out, ends


def from_varints(raw: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(raw < 128)
    starts = np.append(0, ends[:-1] + 1)
    out = np.zeros(len(ends), np.int64)
    for j in range(int((ends - starts).max(initial=0)) + 1):
        on = starts + j <= ends
        out[on] |= (raw[starts[on] + j].astype(np.int64) & 127) << 7 * j
    return out


def lengths(n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """m: 25 parts, and 75 for as many terms as a document has in the mean."""
    if LENGTH * int(n.max(initial=0)) * docs < 1 << 63:
        return 100 - LENGTH + LENGTH * n * docs // max(1, terms)
    return np.array([100 - LENGTH + LENGTH * x * docs // terms for x in n.tolist()], np.int64)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def shard_index(shard: int, ids: pa.Array, n: np.ndarray, words: pa.ChunkedArray, m: np.ndarray, block: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The rows of a shard: its documents under the empty term, then all terms' blocks."""
    names = ["shard", "term", "block", "docs", "first", "last", "top", "data"]
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    listed = np.stack([np.asarray(ids.fill_null(0)), m, known.astype(np.int64)]).tobytes()
    kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    own = ([shard], [b""], [-1], [len(n)], [0], [len(n) - 1], [0], [listed])
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(own, kinds, strict=True)], names=names)
    if not len(words):
        return
    coded = words.combine_chunks().dictionary_encode()
    keys, tf = np.unique(np.asarray(coded.indices).astype(np.int64) * len(n) + np.repeat(np.arange(len(n)), n), return_counts=True)
    code, doc = keys // len(n), keys % len(n)
    new = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    nth = np.arange(len(keys)) - np.repeat(new, np.diff(np.append(new, len(keys))))
    at = np.flatnonzero(nth % block == 0)
    last = np.append(at[1:], len(keys)) - 1
    step = np.append(0, np.diff(doc))
    step[at] = 0
    raw, ends = varints(np.stack([step, tf - 1], 1).reshape(-1))
    tops = np.maximum.reduceat(impacts(tf, m[doc]), at)
    cuts = np.append(0, ends[2 * last + 1])
    for i in range(0, len(at), 1 << 16):
        part = slice(i, min(len(at), i + (1 << 16)))
        bounds = cuts[part.start : part.stop + 1]
        data = pa.BinaryArray.from_buffers(
            pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds - bounds[0]).astype(np.int32)), pa.py_buffer(raw[bounds[0] : bounds[-1]].tobytes())]
        )
        columns = (
            np.full(len(data), shard),
            coded.dictionary.take(pa.array(code[at[part]])).cast(pa.binary()),
            (nth[at[part]] // block).astype(np.int32),
            (last[part] - at[part] + 1).astype(np.int32),
            doc[at[part]].astype(np.int32),
            doc[last[part]].astype(np.int32),
            tops[part],
            data,
        )
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def build_index(
    docs: DataFrame, n_docs: int, n_terms: int, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, block: int = BLOCK
) -> DataFrame:
    """The index table; n_docs and n_terms are the corpus counts. A row a block, and one of block -1 a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            texts = batch.column(1)
            for start, end in pieces(texts, shard_bytes - size, shard_bytes):
                part = texts.slice(start, end - start)
                words, n = terms_of(part)
                # Copies, so that no batch is kept.
                held.append((pa.array(batch.column(0).slice(start, end - start).to_pylist(), pa.int64()), n, words))
                size += int(np.diff(np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + len(part) + 1]).sum())
                if size >= shard_bytes:
                    yield from made(shard, held)
                    shard, held, size = shard + 1, [], 0
        if held:
            yield from made(shard, held)
        del held
        release()

    def made(shard: int, held: list) -> Iterator[pa.RecordBatch]:
        n = np.concatenate([x[1] for x in held])
        ids = pa.concat_arrays([x[0] for x in held])
        yield from shard_index(shard, ids, n, pa.chunked_array([x[2] for x in held]), lengths(n, n_docs, n_terms), block)

    return text_rows(docs, id_col, text_col).mapInArrow(run, INDEX)


def pieces(texts: pa.BinaryArray, first: int, most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts that end where they reach first, then most, bytes."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    start, room = 0, first
    while start < len(texts):
        end = min(len(texts), max(start + 1, int(np.searchsorted(offsets, offsets[start] + room, "left"))))
        yield start, end
        start, room = end, most


class Shard:
    """A shard's blocks of asked terms, sorted by term code and block. What is decompressed stays for the shard's next items."""

    def __init__(self, listed: bytes, code: np.ndarray, docs: np.ndarray, first: np.ndarray, last: np.ndarray, top: np.ndarray, data: list) -> None:
        self.ids, self.m, self.known = np.frombuffer(listed, np.int64).reshape(3, -1)
        self.code, self.docs, self.first, self.last, self.top, self.data = code, docs, first, last, top, data
        self.open: list = [None] * len(data)
        self.opened = 0

    def decompress(self, blocks: np.ndarray) -> None:
        """Opens blocks, all together."""
        blocks = np.array([i for i in blocks.tolist() if self.open[i] is None], np.int64)
        if not len(blocks):
            return
        values = from_varints(np.frombuffer(b"".join([self.data[i] for i in blocks.tolist()]), np.uint8))
        steps, tf = values[::2], values[1::2] + 1
        ends = np.cumsum(self.docs[blocks])
        starts = ends - self.docs[blocks]
        run = np.cumsum(steps)
        doc = run + np.repeat(self.first[blocks] - run[starts], self.docs[blocks])
        found = impacts(tf, self.m[doc])
        for i, a, b in zip(blocks.tolist(), starts.tolist(), ends.tolist(), strict=True):
            self.open[i] = doc[a:b], found[a:b]
        self.opened += len(blocks)

    def search(self, codes: np.ndarray, weights: np.ndarray, least: int, k: int, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
        """The places and scores of the k best documents with a score of least or more, in no order. weights: by code, with repeats."""
        low, high = np.searchsorted(self.code, codes, "left"), np.searchsorted(self.code, codes, "right")
        count = high - low
        blocks = np.repeat(low - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
        weight = np.repeat(weights, count)
        places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(blocks):
            return places, scores
        first, last = self.first[blocks], self.last[blocks]
        # What the blocks over each document could add up to at most.
        bound = np.zeros(len(self.ids) + 1, np.int64)
        np.add.at(bound, first, weight * self.top[blocks])
        np.subtract.at(bound, last + 1, weight * self.top[blocks])
        bound = np.cumsum(bound[:-1])
        at, least = 0, max(1, least)
        while True:
            pivot = np.flatnonzero(bound[at:] >= least)[:1]
            if not len(pivot):
                return places, scores
            at += int(pivot[0])
            wanted = bound[at : at + window] >= least
            end = at + len(wanted)
            before = np.append(0, np.cumsum(wanted))
            here = (first < end) & (last >= at)
            here[here] = before[np.minimum(last[here] + 1, end) - at] > before[np.maximum(first[here], at) - at]
            self.decompress(blocks[here])
            opened = [self.open[i] for i in blocks[here].tolist()]
            doc = np.concatenate([x[0] for x in opened])
            add = np.concatenate([x[1] for x in opened]) * np.repeat(weight[here], self.docs[blocks[here]])
            inside = (doc >= at) & (doc < end)
            total = np.zeros(len(wanted), np.int64)
            np.add.at(total, doc[inside] - at, add[inside])
            found = np.flatnonzero(wanted & (total >= least))
            places, scores = np.append(places, found + at), np.append(scores, total[found])
            if len(places) > k:
                best = np.lexsort((self.ids[places], self.known[places], -scores))[:k]
                places, scores = places[best], scores[best]
            if len(places) == k:
                # An equal score may still win by a smaller id.
                least = max(least, int(scores.min()))
            at = end


def best_of_shards(index: DataFrame, terms: DataFrame, items: dict, k: int, least: dict) -> DataFrame:
    """item, doc_id, score: each shard's best documents for each item. terms: term, code, where the empty term has code -1; items: codes
    and weights; least: scores to be reached."""
    schema = "item long, doc_id long, score long"
    columns = ["shard", "code", "block", "docs", "first", "last", "top", "data"]
    rows = index.join(F.broadcast(terms), "term").select(*columns).repartition("shard").sortWithinPartitions("shard", "code", "block")

    def solve(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        code, docs, first, last, top = (table.column(c).to_numpy()[1:].astype(np.int64) for c in ("code", "docs", "first", "last", "top"))
        data = table.column("data").to_pylist()
        shard = Shard(data[0], code, docs, first, last, top, data[1:])
        found = []
        for item, (codes, weights) in items.items():
            places, scores = shard.search(codes, weights, least.get(item, 1), k)
            found.append((np.full(len(places), item), places, scores))
        item, places, scores = (np.concatenate(c).astype(np.int64) for c in zip(*found, strict=True))
        ids = pa.array(shard.ids[places], mask=shard.known[places] == 0)
        return pa.RecordBatch.from_arrays([pa.array(item), ids, pa.array(scores)], names=["item", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            key = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if end > start:
                    if held and held[0].column(0)[0].as_py() != key[start]:
                        yield solve(held)
                        held = []
                    held.append(batch.slice(start, end - start))
        if held:
            yield solve(held)
        del held
        release()

    return rows.mapInArrow(run, schema)


def asked_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item, item_id, term, times: the terms of each row of items. item tells rows apart that repeat an item_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = terms_of(batch.column(1))
            row = np.repeat(np.arange(batch.num_rows), n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(2).take(pa.array(row)), batch.column(0).take(pa.array(row)), words.cast(pa.binary())], names=["item", "item_id", "term"]
            )

    numbered = text_rows(items, id_col, text_col).withColumn("item", F.monotonically_increasing_id())
    words = numbered.mapInArrow(run, "item long, item_id long, term binary")
    return words.groupBy("item", "item_id", "term").agg(F.count("*").alias("times"))


def search(
    index: DataFrame,
    items: DataFrame,
    n_docs: int,
    k: int = K,
    id_col: str = "item_id",
    text_col: str = "text",
    item_terms: int = ITEM_TERMS,
    first_shards: int = FIRST,
) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of the index for each row of items."""
    spark = items.sparkSession
    asked = written(asked_terms(items, id_col, text_col), "asked")
    blocks = -(-asked.count() // item_terms)
    shards = index.where("block = -1").count()
    found = spark.createDataFrame([], "item long, item_id long, doc_id long, score long")
    ranked = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    for nth in range(blocks):
        # About item_terms rows, and no more than an item's own terms beyond.
        of_block = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == nth)
        held = index.where("block >= 0").join(F.broadcast(of_block.select("term").distinct()), "term")
        weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1)))
        weights = held.groupBy("term").agg(F.sum("docs").alias("df")).select("term", weight.alias("weight")).where("weight > 0")
        rows = of_block.join(F.broadcast(weights), "term").select("item", "item_id", "term", F.col("times") * F.col("weight")).collect()
        if not rows:
            continue
        codes = {term: i for i, term in enumerate(sorted({bytes(r.term) for r in rows}))}
        lists: dict[int, list] = {}
        for item, _, term, factor in rows:
            lists.setdefault(item, []).append((codes[bytes(term)], factor))
        plan = {item: tuple(np.array(c, np.int64) for c in zip(*sorted(pairs), strict=True)) for item, pairs in lists.items()}
        terms = spark.createDataFrame([(b"", -1), *codes.items()], "term binary, code int")
        least: dict[int, int] = {}
        if shards > 4 * first_shards:
            some = index.where(F.pmod(F.xxhash64("shard"), F.lit(shards // first_shards)) == 0)
            kth = best_of_shards(some, terms, plan, k, {}).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") == k)
            least = {r.item: r.score for r in kth.select("item", "score").collect()}  # a row an item of the block at most
        names = spark.createDataFrame([(r.item, r.item_id) for r in {r.item: r for r in rows}.values()], "item long, item_id long")
        best = best_of_shards(index, terms, plan, k, least).join(F.broadcast(names), "item")
        found = found.unionByName(best.select("item", "item_id", "doc_id", "score"))
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select(
        "item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"
    )


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    n_docs, n_terms = corpus_counts(text_rows(docs, "doc_id", "text"))
    index = written(build_index(docs, n_docs, n_terms), "index")
    return search(index, read_table(spark, sf_dir, "benchmark"), n_docs)


ORACLE = {
    "op13_lexical_search": r"""
        with lowered as (
            select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
        words as (select doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from lowered),
        docs as (select doc_id, w, len(w) as n from words where len(w) > 0),
        corpus as (select count(*) as nd, cast(sum(n) as bigint) as l from docs),
        lengths as (select doc_id, 25 + (75 * n * nd) // l as m from docs, corpus),
        postings as (select doc_id, term, count(*) as tf from (select doc_id, unnest(w) as term from docs) group by all),
        weights as (
            select term, cast(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) as bigint) as weight
            from (select term, count(*) as df from postings group by term), corpus),
        items as (
            select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
            from benchmark),
        asked as (select item_id, term, count(*) as times from items group by all),
        scored as (
            select item_id, doc_id, cast(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score
            from asked join weights using (term) join postings using (term) join lengths using (doc_id)
            group by item_id, doc_id)
        select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score
        from scored where score > 0 qualify rank <= 10"""
}
