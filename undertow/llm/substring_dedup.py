"""Substring deduplication by relative Lempel-Ziv factors over a distributed reference index.

The reference is the whole corpus, in blocks, indexed by content: the windows of ``window`` words that share a minimiser (the
least hash among their eight-word grams) make one phrase, and the index holds the phrases of all blocks by minimiser. So a
phrase of a document meets exactly those reference blocks that can hold any of its windows, instead of being scanned against
all. A phrase that an earlier place of the reference holds whole is a match with that place; matches that go on at the same place
are one. What may go is what they cover. The factors that are told (factors()) are parsed from left to right and don't overlap.
Phrases without a match are literals as a whole, but where another phrase shares their minimiser they may still overlap it:
such factor boundaries are checked window by window, over whole windows, against all other boundary phrases. What factors and
repeated boundary windows cover are the duplicate spans.

Earlier means: smaller doc_id, or the same document and an earlier start. Words are told apart by hashes of 64 bits, phrases
and windows by 128.

No minimiser or passage makes a hot task: what one block of texts repeats is settled where it is read; of a phrase that
several blocks of a task hold, the task asks once, and its other places match the first; a minimiser that a task has asked for
often goes to the boundary check directly, of which the index is told once a task. Owners of the index keep no more than a
bounded number of rows. The boundary check is an aggregation with map-side combine.

Defined results: a null text has no words; texts shorter than a window lose nothing. Rows that repeat a doc_id are
documents of their own and stand in the order of a written copy of the table; a null doc_id stands before all others.
Extra columns are ignored. An empty table gives an empty result. Texts of any length are parsed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from undertow.llm.common import Lookup, gathered, kept_in_worker, read_table, text_blocks, written
from undertow.llm.ngrams import mix

WINDOW, GRAM = 20, 8
#: A minimiser that one task has asked for with more contents than this goes to the boundary check directly.
MANY = 64
#: Phrases and minimisers that a task remembers, and rows of a minimiser that its owner holds, at most.
REMEMBERED, HELD = 100_000, 500_000
PROBE, MARKER, COPY, BOUNDARY = 0, 1, 2, 3
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, modulo 2 ** 64."""
    known = kept_in_worker("substrings", _tables)[1]
    have = known.get(base)
    if have is None or len(have[0]) < n:
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(max(n, 1 << 19), b, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        known[base] = have = (made[0], made[1])
    return have


def _tables() -> tuple[Lookup, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Word hashes, and powers by base."""
    from xxhash import xxh64_intdigest

    return Lookup(xxh64_intdigest, limit=100_000), {}


class Grams:
    """Hashes of any run of consecutive words, by prefix sums."""

    def __init__(self, words: np.ndarray, base: int) -> None:
        power, self.inverse = _powers(base, len(words) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power[: len(words)], dtype=np.uint64)])

    def __call__(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * self.inverse[start])


def split(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space."""
    return text.encode().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    table = kept_in_worker("substrings", _tables)[0]
    return np.fromiter(map(table.__getitem__, words), np.uint64, len(words))


class Block:
    """The windows of some documents, in the order of (uid, start)."""

    def __init__(self, uids: np.ndarray, texts: list[list[bytes]], window: int) -> None:
        n = np.array([len(t) for t in texts], np.int64)
        keep = np.flatnonzero(n >= window)
        keep = keep[np.argsort(uids[keep], kind="stable")]
        x = word_hashes([w for k in keep for w in texts[k]])
        n, begin = n[keep], np.cumsum(n[keep]) - n[keep]
        self.one, self.two = Grams(x, BASES[0]), Grams(mix(x), BASES[1])
        counts = n - window + 1
        self.doc = np.repeat(np.arange(len(keep)), counts)
        self.start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        self.at = self.start + begin[self.doc] if len(keep) else self.start
        self.uid, self.words, self.window = uids[keep], len(x), window
        self.first, self.counts = np.cumsum(counts) - counts, counts
        self.hash1, self.hash2 = self.one(self.at, window), self.two(self.at, window)

    def minimisers(self, gram: int) -> np.ndarray:
        """Per window, the least hash of its grams."""
        grams = self.one(np.arange(self.words - gram + 1), gram)
        left, span = self.window - gram + 1, 1
        while 2 * span <= left:
            grams = np.minimum(grams[:-span], grams[span:])
            span *= 2
        if span < left:
            grams = np.minimum(grams[: len(grams) - (left - span)], grams[left - span :])
        return grams[self.at]

    def sources(self) -> np.ndarray:
        """Per window, the first window of this block with the same words (itself, if none stands before)."""
        order = np.argsort(self.hash1, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = (self.hash1[order[1:]] != self.hash1[order[:-1]]) | (self.hash2[order[1:]] != self.hash2[order[:-1]])
        first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
        found = np.empty(len(order), np.int64)
        found[order] = first
        return found


def _runs(mask: np.ndarray, doc: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of each run of true windows within one document and with sources that follow each other."""
    at = np.flatnonzero(mask)
    if not len(at):
        return at, at
    new = np.append(True, (np.diff(at) > 1) | (doc[at[1:]] != doc[at[:-1]]) | (np.diff(source[at]) != 1))
    begin = np.flatnonzero(new)
    return at[begin], np.diff(np.append(begin, len(at)))


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


#: A phrase: its minimiser, content, place and length (in windows), what it is, and where the reference holds it.
ROW = ["route", "content", "uid", "start", "length", "kind", "ref", "at"]


def phrases(block: Block, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of phrases to ask for, and of matches within this block."""
    if not len(block.doc):
        return np.zeros((0, len(ROW)), np.int64), np.zeros((0, len(ROW)), np.int64)
    least, source = block.minimisers(gram), block.sources()
    again = source != np.arange(len(source))
    new = np.append(True, (least[1:] != least[:-1]) | (block.doc[1:] != block.doc[:-1]))
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(new)))
    asks = np.add.reduceat((~again).astype(np.int64), begin) > 0
    begin, length = begin[asks], length[asks]
    content = _signed(block.two(block.at[begin], length + block.window - 1) ^ mix(length.astype(np.uint64)))
    place = lambda at: (block.uid[block.doc[at]], block.start[at])
    none = np.zeros(len(begin), np.int64)
    asked = np.column_stack([_signed(least[begin]), content, *place(begin), length, none + PROBE, none, none])
    known, size = _runs(again, block.doc, source)
    none = np.zeros(len(known), np.int64)
    return asked, np.column_stack([none, none, *place(known), size, none + COPY, *place(source[known])])


def _spread(rows: np.ndarray) -> np.ndarray:
    """The rows, which need no owner, dealt over all tasks by their places."""
    rows[:, 0] = _signed(mix(rows[:, 2].astype(np.uint64) + mix(rows[:, 3].astype(np.uint64))))
    rows[:, 1] = 0
    return rows


def _found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in an ascending table each key stands, and whether it does."""
    at = np.minimum(np.searchsorted(table, keys), max(0, len(table) - 1))
    return at, table[at] == keys if len(table) else np.zeros(len(keys), bool)


class Asked:
    """What a task has asked for: of each phrase the least place so far, and of each minimiser how many phrases. Bounded: when
    full, what is held is asked for, and the rest is forgotten, which costs rows but no result."""

    def __init__(self, many: int) -> None:
        self.many = many
        self.rest()

    def add(self, rows: np.ndarray) -> np.ndarray:
        """Rows that can go now; others are held until rest(). rows: of one block, which asks for a phrase once."""
        # Phrases of equal content have the same minimiser.
        at, known = _found(self.first[:, 1], rows[:, 1])
        new, old = rows[known], self.first[at[known]]
        late = (new[:, 2] > old[:, 2]) | ((new[:, 2] == old[:, 2]) & (new[:, 3] > old[:, 3]))
        early, later = np.where(late[:, None], old, new), np.where(late[:, None], new, old)
        self.first[at[known]] = early
        # The later place matches the earlier one.
        gone = [np.column_stack([later[:, :5], np.full(len(later), COPY), early[:, 2:4]])]
        rows = rows[~known]
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        begin = np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0])) if len(rows) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(rows)))
        at, known = _found(self.routes, rows[begin, 0])
        before = np.where(known, self.times[at], 0) if len(self.times) else np.zeros(len(begin), np.int64)
        nth = np.arange(len(rows)) + 1 + np.repeat(before - begin, size)
        first_over, over = nth == self.many + 1, nth > self.many
        marker = np.zeros((first_over.sum(), len(ROW)), np.int64)
        marker[:, 0], marker[:, 5] = rows[first_over, 0], MARKER
        checked = rows[over]
        checked[:, 5] = BOUNDARY
        gone += [marker, checked]
        self.times[at[known]] += size[known]
        routes, times = np.append(self.routes, rows[begin, 0][~known]), np.append(self.times, size[~known])
        order = np.argsort(routes, kind="stable")
        self.routes, self.times = routes[order], times[order]
        held = np.concatenate([self.first, rows[~over]])
        self.first = held[np.argsort(held[:, 1], kind="stable")]
        if len(self.first) > REMEMBERED:
            gone.append(self.rest())
        return np.concatenate(gone)

    def rest(self) -> np.ndarray:
        found = getattr(self, "first", None)
        self.first, self.routes, self.times = np.zeros((0, len(ROW)), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return found


def _answers(rows: np.ndarray) -> np.ndarray:
    """uid, start, length, kind, ref, at for probes and markers, sorted by the first four columns."""
    group = np.append(True, rows[1:, 0] != rows[:-1, 0])
    first = group | (np.append(True, rows[1:, 1] != rows[:-1, 1]))
    number = np.cumsum(group) - 1
    marker = rows[:, 5] == MARKER
    # A route is shared if probes stand with several contents, or a marker stands there.
    contents = np.bincount(number[first & ~marker], minlength=number[-1] + 1)
    shared = (contents > 1) | (np.bincount(number[marker], minlength=number[-1] + 1) > 0)
    # A probe behind a marker of the same content would not be first in its group otherwise.
    lead = ~marker & (first | np.append(True, marker[:-1]))
    ask, copy = lead & shared[number], ~marker & ~lead
    at = np.maximum.accumulate(np.where(lead, np.arange(len(rows)), 0))
    found = rows[:, 2:].copy()
    found[copy, 4:] = rows[at[copy], 2:4]
    found[:, 3] = np.where(copy, COPY, BOUNDARY)
    return found[copy | ask]


def _as_batch(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64, copy=False)) for c in columns], names=names)


SPAN = ROW[2:]


def spans(docs: DataFrame, window: int, gram: int, many: int) -> DataFrame:
    """uid and spans: array<struct<start, length, kind, ref, at>>, windows that match the place at of the document ref (COPY) or
    need the check (BOUNDARY)."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = Asked(many)
        for batch in text_blocks(batches, 1):
            block = Block(batch.column(0).to_numpy(), [split(t) for t in batch.column(1).to_pylist()], window)
            rows, known = phrases(block, gram)
            rows = np.concatenate([asked.add(rows), known])
            through = rows[:, 5] >= COPY
            yield _as_batch(list(np.concatenate([rows[~through], _spread(rows[through])]).T), ROW)
        yield _as_batch(list(asked.rest().T), ROW)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, len(ROW)), np.int64)
        for rows in gathered(batches):
            through = rows[:, 5] >= COPY
            if through.any():
                yield _as_batch(list(rows[through][:, 2:].T), SPAN)
            held = np.concatenate([held, rows[~through]])
            last = np.flatnonzero(held[1:, 0] != held[:-1, 0])
            if len(last):
                yield _as_batch(list(_answers(held[: last[-1] + 1]).T), SPAN)
                held = held[last[-1] + 1 :]
            if len(held) > HELD:
                found, held = _answers(held), _essence(held)
                yield _as_batch(list(found.T), SPAN)
        if len(held):
            yield _as_batch(list(_answers(held).T), SPAN)

    long = lambda names: ", ".join(f"{n} long" for n in names)
    asked = docs.mapInArrow(parse, long(ROW))
    met = asked.repartition("route").sortWithinPartitions("route", "content", "uid", "start").mapInArrow(meet, long(SPAN))
    one = F.struct(
        *(F.col(c).cast(kind).alias(c) for c, kind in (("start", "int"), ("length", "int"), ("kind", "int"), ("ref", "long"), ("at", "int")))
    )
    return met.groupBy("uid").agg(F.collect_list(one).alias("spans"))


def _essence(rows: np.ndarray) -> np.ndarray:
    """What the rows of one minimiser leave for those that follow: the first place of the last content, and whether the
    minimiser is shared."""
    probes = rows[rows[:, 5] == PROBE]
    if not len(probes):
        return rows[:1]
    lead = probes[probes[:, 1] == probes[-1, 1]][:1]
    marker = np.array([[rows[0, 0], 0, 0, 0, 0, MARKER, 0, 0]])
    shared = len(probes) < len(rows) or probes[0, 1] != probes[-1, 1]
    return np.concatenate([marker, lead]) if shared else lead


def longest(doc: np.ndarray, start: np.ndarray, length: np.ndarray, ref: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Factors (the same columns), in windows: from left to right in each document, each match extended by those that go on at
    the same place of the reference."""
    order = np.lexsort((at, ref, length, start, doc))
    doc, start, length, ref, at = (x[order] for x in (doc, start, length, ref, at))
    if not len(doc):
        return doc, start, length, ref, at
    same = (doc[1:] == doc[:-1]) & (ref[1:] == ref[:-1]) & (at[1:] - start[1:] == at[:-1] - start[:-1])
    chain = np.cumsum(np.append(True, ~same))
    apart = int((start + length).max()) + 1
    reached = np.maximum.accumulate(start + length + chain * apart)
    begin = np.flatnonzero(np.append(True, ~same | (start[1:] + chain[1:] * apart > reached[:-1])))
    end = np.append(begin[1:], len(doc)) - 1
    return doc[begin], start[begin], reached[end] - chain[end] * apart - start[begin], ref[begin], at[begin]


class Pieces:
    """The spans of a batch's documents, as columns."""

    def __init__(self, spans_: pa.ListArray) -> None:
        lengths = np.diff(spans_.offsets.to_numpy())
        lengths[np.array(spans_.is_null())] = 0
        flat = spans_.flatten()
        self.doc = np.repeat(np.arange(len(lengths)), lengths)
        self.start, self.length, self.kind, self.ref, self.at = (flat.field(i).to_numpy().astype(np.int64) for i in range(5))

    def of(self, kind: int) -> tuple[np.ndarray, ...]:
        some = self.kind == kind
        return tuple(x[some] for x in (self.doc, self.start, self.length, self.ref, self.at))

    def factors(self) -> tuple[np.ndarray, ...]:
        return longest(*self.of(COPY))

    def checked(self) -> tuple[np.ndarray, ...]:
        return self.of(BOUNDARY)


def marked(pieces: tuple[np.ndarray, ...], first: np.ndarray, total: int) -> np.ndarray:
    """Which windows lie in the pieces; first: the number of each document's first window, of total."""
    at = first[pieces[0]] + pieces[1]
    edges = np.bincount(at, minlength=total + 1) - np.bincount(at + pieces[2], minlength=total + 1)
    return np.cumsum(edges)[:total] > 0


def parsed(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, many: int = MANY, digests: bool = False) -> DataFrame:
    """From uid (unique, in the order of documents, never null), text and maybe rest: uid, n_words, n_removed, kept, rest."""
    found = written(spans(docs, window, gram, many), "spans", per_core=4)
    joined = docs.join(found, "uid", "left")

    def boundaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, 1):
            pieces = Pieces(batch.column(2))
            some = np.unique(pieces.checked()[0])
            if not len(some):
                continue
            # Documents with spans have windows; a block holds them in the order of their numbers.
            uids, texts = batch.column(0).to_numpy()[some], batch.column(1).take(pa.array(some)).to_pylist()
            block = Block(uids, [split(t) for t in texts], window)
            first = np.zeros(batch.num_rows, np.int64)
            first[some[np.argsort(uids, kind="stable")]] = block.first
            copies = pieces.factors()
            here = np.isin(copies[0], some)
            asked = marked(pieces.checked(), first, len(block.doc)) & ~marked(tuple(x[here] for x in copies), first, len(block.doc))
            yield _as_batch(
                [_signed(block.hash1[asked]), _signed(block.hash2[asked]), block.uid[block.doc[asked]], block.start[asked]],
                ["h1", "h2", "uid", "start"],
            )

    # The columns that are only carried go along here, too, so that both uses share one exchange of the texts.
    rest = ["rest"] if "rest" in docs.columns else []
    windows = joined.select("uid", "text", "spans", *rest).mapInArrow(boundaries, "h1 long, h2 long, uid long, start long")
    firsts = windows.groupBy("h1", "h2").agg(
        F.min(F.struct("uid", F.col("start").cast("int").alias("start"))).alias("first")
    ).select("first.*").groupBy("uid").agg(F.collect_list("start").alias("firsts"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, 1):
            texts, pieces, firsts_ = batch.column(1).to_pylist(), Pieces(batch.column(2)), batch.column(3)
            words = [split(t) for t in texts]
            n = np.array([len(w) for w in words], np.int64)
            windows = np.maximum(n - window + 1, 0)
            first, total = np.cumsum(windows) - windows, int(windows.sum())
            own = np.diff(firsts_.offsets.to_numpy())
            own[np.array(firsts_.is_null())] = 0
            asked = marked(pieces.checked(), first, total)
            asked[np.repeat(first, own) + firsts_.flatten().to_numpy()] = False
            repeats = np.flatnonzero(asked | marked(pieces.factors(), first, total))
            # A window's number and its first word's differ by what its document's windows and words are apart.
            begin = np.cumsum(n) - n
            at = repeats + (begin - first)[np.repeat(np.arange(len(n)), windows)[repeats]]
            gone = np.cumsum(np.bincount(at, minlength=n.sum() + 1) - np.bincount(at + window, minlength=n.sum() + 1))[: n.sum()] > 0
            removed = np.bincount(np.repeat(np.arange(len(n)), n), gone, len(n)).astype(np.int64)
            kept = []
            for text, w, r, b in zip(texts, words, removed.tolist(), begin.tolist(), strict=True):
                left = b" ".join([x for x, g in zip(w, gone[b : b + len(w)].tolist(), strict=True) if not g] if r else w) if r or digests else b""
                kept.append(hashlib.sha256(left).hexdigest() if digests else left.decode() if r else text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(removed), pa.array(kept, pa.string()), *batch.columns[4:]],
                names=["uid", "n_words", "n_removed", "kept", *rest],
            )

    found = joined.join(firsts, "uid", "left").select("uid", "text", "spans", "firsts", *rest)
    schema = StructType(
        [*(StructField(n, LongType()) for n in ("uid", "n_words", "n_removed")), StructField("kept", StringType()), *(found.schema[r] for r in rest)]
    )
    return found.mapInArrow(remove, schema)


#: A run of windows: where it starts and ends, and where the reference holds its start.
RUN = ["uid", "start", "end", "ref", "place"]


def along(own: np.ndarray, theirs: np.ndarray, shift: int, window: int) -> list[tuple[int, int]]:
    """Runs of windows (start, end) of words that stand in theirs shift words further, as long as they are."""
    low, high = max(0, -shift), min(len(own), len(theirs) - shift)
    if high - low < window:
        return []
    same = np.concatenate([[False], own[low:high] == theirs[low + shift : high + shift], [False]])
    edges = np.flatnonzero(same[1:] != same[:-1])
    return [(low + x, low + y - window + 1) for x, y in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if y - x >= window]


def furthest(runs: list[tuple[int, int, int, int]], window: int) -> list[tuple[int, int, int, int]]:
    """Factors (start, length in words, ref, place) from left to right: at each word the run (start, end, ref, place of start) that
    goes on furthest from there, ties to the least place; the next factor begins behind its last word."""
    found, at, open_, next_ = [], 0, [], 0
    runs = sorted(runs)
    while True:
        while next_ < len(runs) and runs[next_][0] <= at:
            open_.append(runs[next_])
            next_ += 1
        open_ = [r for r in open_ if r[1] > at]
        if not open_:
            if next_ == len(runs):
                return found
            at = runs[next_][0]
            continue
        start, end, ref, place = min(open_, key=lambda r: (-r[1], r[2], r[3] + at - r[0]))
        found.append((at, end - at + window - 1, ref, place + at - start))
        at = end + window - 1


def factors(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, many: int = MANY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ref_id, ref_start: each factor of a document, in words, and the earlier place that holds it.

    Factors don't overlap. Candidates are the places that some phrase matches: the texts are compared word by word along each of
    them, and at each word the run that goes on furthest is the factor. A longer match is missed only where none of its phrases
    has its first place in the document that holds it, or where it holds no whole phrase.
    """
    found, ids = _by_uid(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    matches = spans(found, window, gram, many).select("uid", F.explode("spans").alias("s")).where(F.col("s.kind") == COPY)
    places = written(
        matches.select("uid", "s.ref", (F.col("s.at") - F.col("s.start")).alias("shift")).groupBy("uid", "ref").agg(F.collect_set("shift").alias("shifts")),
        "places",
    )
    texts = found.select("uid", "text")
    pairs = places.join(texts, "uid").join(texts.select(F.col("uid").alias("ref"), F.col("text").alias("theirs")), "ref")

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for uid, ref, shifts, own, theirs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one, two = (word_hashes(split(t)) for t in (own, theirs))
                rows += [(uid, a, b, ref, a + shift) for shift in shifts for a, b in along(one, two, shift, window)]
            if rows:
                yield _as_batch([np.array(c) for c in zip(*rows, strict=True)], RUN)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, runs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = [(uid, *f) for f in furthest([tuple(r[c] for c in RUN[1:]) for r in runs], window)]
                yield _as_batch([np.array(c) for c in zip(*rows, strict=True)], ["uid", "start", "length", "ref", "at"])

    runs = pairs.select("uid", "ref", "shifts", "text", "theirs").mapInArrow(follow, ", ".join(f"{n} long" for n in RUN))
    rows = runs.groupBy("uid").agg(F.collect_list(F.struct(*RUN[1:])).alias("runs")).mapInArrow(
        choose, "uid long, start long, length long, ref long, at long"
    )
    if ids is None:
        return rows.select(F.col("uid").alias("doc_id"), "start", "length", F.col("ref").alias("ref_id"), F.col("at").alias("ref_start"))
    refs = ids.select(F.col("uid").alias("ref"), F.col("doc_id").alias("ref_id"))
    return rows.join(ids, "uid").join(refs, "ref").select("doc_id", "start", "length", "ref_id", F.col("at").alias("ref_start"))


def substring_duplicates(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, many: int = MANY, id_col: str = "doc_id", text_col: str = "text", digests: bool = False
) -> DataFrame:
    """Per document: doc_id, n_words, n_removed and kept (its text without the spans, or that text's SHA-256).

    A text that loses words is its remaining words joined by one space; another text stays as it is.
    """
    found, ids = _by_uid(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    result = parsed(found, window, gram, many, digests)
    result = result.withColumnRenamed("uid", "doc_id") if ids is None else result.join(ids, "uid")
    return result.select("doc_id", "n_words", "n_removed", "kept")


def _by_uid(own: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Documents (doc_id, text, maybe rest) with a unique uid in their order, and the doc_ids by uid unless it is one."""
    rest = [c for c in own.columns if c == "rest"]
    if own.where("doc_id is null").select("doc_id").union(own.groupBy("doc_id").count().where("count > 1").select("doc_id")).isEmpty():
        # The identifiers are unique and can stand for the documents; coalesce tells the optimiser that none is null.
        return own.select(F.coalesce("doc_id", F.lit(0).cast("long")).alias("uid"), "text", *rest), None
    table = written(own.orderBy(F.asc_nulls_first("doc_id")).withColumn("uid", F.monotonically_increasing_id()), "documents")
    return table.select(F.coalesce("uid", F.lit(0).cast("long")).alias("uid"), "text", *rest), table.select("uid", "doc_id")


def without_duplicates(
    docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars"
) -> DataFrame:
    """The documents, with all their columns, without the words of repeated windows. A length column follows the text."""
    found, _ = _by_uid(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(text_col).cast("string").alias("text"),
            F.struct(*(F.col(c) for c in docs.columns if c != text_col)).alias("rest"),
        )
    )
    cut = parsed(found, window)
    length = F.when(
        F.col("n_removed") > 0, F.length("kept").cast("long")
    ).otherwise(F.col(f"rest.{length_col}")).alias(length_col) if length_col in docs.columns else None
    return cut.select(
        *(F.col("kept").alias(c) if c == text_col else length if c == length_col else F.col(f"rest.{c}").alias(c) for c in docs.columns)
    )


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_duplicates(read_table(spark, sf_dir, "documents"), digests=True).withColumnRenamed("kept", "kept_sha256")


ORACLE = {
    "op2_substring_dedup": r"""
        with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
        w as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as i from d),
        g as (select doc_id, i, word, list(word) over (partition by doc_id order by i rows between current row and 19 following) as key from w),
        f as (select doc_id, i, row_number() over (partition by key order by doc_id, i) > 1 as again from g where len(key) = 20),
        r as (select g.doc_id, g.i, g.word, coalesce(bool_or(again) over (partition by g.doc_id order by g.i rows between 19 preceding and current row), false) as gone
              from g left join f on f.doc_id = g.doc_id and f.i = g.i),
        k as (select doc_id, count(*) filter (gone) as n_removed, string_agg(word, ' ' order by i) filter (not gone) as kept from r group by doc_id)
        select d.doc_id, len(ws)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k on k.doc_id = d.doc_id"""
}
