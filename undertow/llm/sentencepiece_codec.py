"""SentencePiece encoding and decoding through a distinct-chunk table.

No piece of the vocabulary has a whitespace marker after another character (checked when the model is loaded), so no
merge crosses from a word to the next marker, and a text is the sequence of its marked words. Each worker keeps a table
of distinct marked words: a word is segmented once by the library, and its ids and surface are then joined back by
position. A line feed that no piece contains separates words in the same way. The table is bounded (two generations, so
frequent words stay), tasks share nothing, and no text is shuffled.

Defined results: a null text counts as empty and has no ids. Repeated rows and doc_ids are encoded row by row. Extra
columns are ignored. A very long word is segmented by itself and not kept in the table. An empty table gives an empty
result. A model whose pieces cross markers, or whose normaliser changes text, is refused.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.llm.common import Lookup, kept_in_worker, public_tokenizer, read_table, text_blocks

MARK = "▁"
MODEL = "piece_bpe_32k.model"
#: Texts that usual normalisers change: runs of spaces, spaces at the end, line feeds, tabs, ligatures, signs in circles.
PROBES = ("a  b", "a b ", "a\n Å", "a\tb", "aﬁ", "a①", "Å\u0301 ½")


class Codec:
    """Exact encode and decode of whole texts by their distinct marked words."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("pieces of this model cross whitespace markers")
        if any(self.sp.decode(self.sp.encode(probe)) != probe for probe in PROBES):
            raise ValueError("this model's normaliser changes text")
        # A word's surface is decoded behind a guard, since decoding drops a leading space.
        self.guard = next(i for i, p in enumerate(pieces) if p == "a")
        feed = self.sp.encode("\n")
        self.splits_lines = not any("\n" in p for p in pieces) and len(feed) == 2 and self.sp.id_to_piece(feed[0]) == MARK
        self.feed = str(feed[-1])
        self.marked, self.bare = Lookup(self._marked), Lookup(self._bare)

    def _entry(self, ids: list[int]) -> tuple[str, str]:
        return ",".join(map(str, ids)), self.sp.decode([self.guard, *ids])[1:]

    def _marked(self, rest: str) -> tuple[str, str]:
        """rest: what follows a word's first marker. The library itself puts a marker before a text."""
        return self._entry(self.sp.encode(rest) if rest else [self.sp.piece_to_id(MARK)])

    def _bare(self, word: str) -> tuple[str, str]:
        """A word at the start of a line, which has no marker: it is encoded behind a line feed."""
        return self._entry(self.sp.encode("\n" + word)[2:])

    def _line(self, line: str, first: bool) -> list[tuple[str, str]]:
        if "  " in line or MARK in line or (first and line[:1] == " "):
            words = re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", (MARK if first else "") + line.replace(" ", MARK))
            return [self.marked[w[1:]] if w[0] == MARK else self.bare[w] for w in words]
        words = line.split(" ")
        if first:
            return list(map(self.marked.__getitem__, words))
        head = [self.bare[words[0]]] if words[0] else []
        return head + list(map(self.marked.__getitem__, words[1:]))

    def encode_decode(self, text: str | None) -> tuple[str, str]:
        """The ids, as decimals joined by commas, and what they decode to."""
        if not text:
            return "", ""
        ids, surface = [], []
        for k, line in enumerate(text.split("\n") if self.splits_lines else [text]):
            if k:
                ids.append(self.feed)
                surface.append("\n")
            if line or not k:
                for i, s in self._line(line, not k):
                    ids.append(i)
                    surface.append(s)
        decoded = "".join(surface)
        return ",".join(ids), decoded.removeprefix(" ")


def encode_decode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """doc_id, n_tokens and either ids: array<int> and decoded: string, or their SHA-256 digests."""
    with open(model_file, "rb") as f:
        model = f.read()  # a fixed half megabyte, sent with the tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept_in_worker(("codec", model), lambda: Codec(model))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for block in text_blocks(batches, 1):
            found = [codec.encode_decode(t) for t in block.column(1).to_pylist()]
            counts = pa.array([i.count(",") + 1 if i else 0 for i, _ in found], pa.int64())
            if digests:
                rest = [pa.array([sha(i) for i, _ in found], pa.string()), pa.array([sha(d) for _, d in found], pa.string())]
            else:
                rest = [
                    pa.array([[int(x) for x in i.split(",")] if i else [] for i, _ in found], pa.list_(pa.int32())),
                    pa.array([d for _, d in found], pa.string()),
                ]
            yield pa.RecordBatch.from_arrays([block.column(0), counts, *rest], names=names)

    names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode_decode(read_table(spark, sf_dir, "documents"), public_tokenizer(MODEL), digests=True)
