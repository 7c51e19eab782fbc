"""Toxicity scores by a counterfactual-regularised classifier.

Texts become sets of hashed words and word beginnings (so inflected and compounded insults share features). A sparse
logistic model learns from labelled texts. Each sentence of theirs that names a group gets a counterfactual, in which every
identity term is swapped for another of its kind, and the squared change of the sentence's score is penalised. So a group's
name does not carry toxicity by itself, and neutral mentions are not false positives. The groups are a parameter; where no
labelled text names one, the penalty has nothing to act on. Training rows are a bounded sample by hash, ``sample`` a class,
weighted back to the classes' true counts; scoring reads every whole text in one pass without a shuffle. Only the text is an
input of a score.

Defined results: a null or empty text has no features and gets the model's base score. A text of any length is scored whole.
Rows that repeat a doc_id are scored each; labels that repeat one count once, and the label is the largest; labels other than
0 and 1 are no labels, null ones neither. Which of too many labelled texts are learned from goes by a hash of the doc_id,
ties by the doc_id;
of texts that share a doc_id the least is learned from. Without any label the score is 0. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.llm.common import Lookup, kept_in_worker, read_table, text_blocks
from undertow.llm.linear import BUCKETS, fit, sigmoid

#: Labelled rows of each class that training reads at most.
SAMPLE = 3000
#: How much a squared change of score between counterfactuals counts beside the log loss.
PAIR_PENALTY = 1.0
#: Sentences with an identity term that a text of the training sample gives at most.
PAIRS = 64
FOLDS, HELD = 5, 0
EDGES = ".,;:!?\"'()[]{}<>|*#$%&-_/\\«»“”„…"
#: Identity terms, by kind and language; a term is swapped for another of its kind and language. The default of a parameter.
IDENTITIES = (
    ("men", "women", "gays", "lesbians", "transgender", "heterosexual", "homosexual", "bisexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "african", "arab", "european"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("hommes", "femmes", "musulmans", "chrétiens", "juifs", "immigrés", "réfugiés", "étrangers"),
    ("männer", "frauen", "muslime", "christen", "juden", "ausländer", "flüchtlinge", "migranten"),
    ("hombres", "mujeres", "musulmanes", "cristianos", "judíos", "inmigrantes", "refugiados", "extranjeros"),
)
_SENTENCE_END = re.compile(r"[.!?\n]+")


def words(text: str | None) -> set[str]:
    """The distinct lower-cased words, without punctuation at their ends."""
    return {w.strip(EDGES) for w in set((text or "").lower().split())} - {""}


def word_features(word: str) -> tuple[int, ...]:
    """A word's buckets: the word itself and its beginnings."""
    if not word:
        return ()
    parts = [word, *(f"{word[:n]}~" for n in (4, 5) if len(word) >= n)]
    return tuple({crc32(p.encode()) % BUCKETS for p in parts})


def features(found: set[str]) -> np.ndarray:
    table = kept_in_worker("word features", lambda: Lookup(word_features, limit=100_000))
    return np.array(sorted(set().union(*map(table.__getitem__, found))), np.int64)


class Swaps:
    """Counterfactuals over groups of identity terms."""

    def __init__(self, identities: tuple[tuple[str, ...], ...]) -> None:
        self.kind = {term: kind for kind in identities for term in kind if len(kind) > 1}

    def other(self, term: str) -> str:
        kind = self.kind[term]
        return kind[(kind.index(term) + 1 + crc32(term.encode()) % (len(kind) - 1)) % len(kind)]

    def pairs(self, text: str | None) -> list[tuple[set[str], set[str]]]:
        """The words of each sentence that has an identity term, as they are and with its terms swapped."""
        if not text or not self.kind.keys() & words(text):
            return []
        named = [s for s in map(words, _SENTENCE_END.split(text)) if s & self.kind.keys()]
        # Of a text that names groups throughout, sentences from all over it.
        some = named if len(named) <= PAIRS else [named[i * len(named) // PAIRS] for i in range(PAIRS)]
        return [(s, {self.other(w) if w in self.kind else w for w in s}) for s in some]


def remainder(id_col: str = "doc_id", folds: int = FOLDS):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(HELD))


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample: int = SAMPLE,
    pair_penalty: float = PAIR_PENALTY,
    identities: tuple[tuple[str, ...], ...] = IDENTITIES,
) -> tuple[np.ndarray, float]:
    """Weights and bias from labelled documents outside the held-out fold."""
    known = labels.where(
        F.col(label_col).cast("int").isin(0, 1) & F.col(id_col).isNotNull() & (remainder(id_col) != HELD)
    ).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_label"))
    known = known.join(docs.select(F.col(id_col).cast("long").alias("_id")).distinct(), "_id", "left_semi")
    counts = dict(known.groupBy("_label").count().collect())
    order = F.xxhash64("_id"), F.col("_id")
    chosen = known.where("_label = 0").orderBy(*order).limit(sample).union(
        known.where("_label = 1").orderBy(*order).limit(sample)
    )  # at most 2 * sample rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        swaps, lists = Swaps(identities), pa.list_(pa.list_(pa.int32()))
        for block in text_blocks(batches, 1):
            texts = block.column(1).to_pylist()
            pairs = [swaps.pairs(t) for t in texts]
            sides = [pa.array([[features(p[k]).tolist() for p in found] for found in pairs], lists) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [block.column(0), pa.array([features(words(t)).tolist() for t in texts], pa.list_(pa.int32())), *sides],
                names=["label", "features", "plain", "swapped"],
            )

    drawn_texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "_id")
    one_each = drawn_texts.groupBy("_id").agg(F.first("_label").alias("_label"), F.min("text").alias("text"))  # an id may be that of many rows
    rows = one_each.select("_label", "text").mapInArrow(
        run, "label int, features array<int>, plain array<array<int>>, swapped array<array<int>>"
    ).toArrow()
    label = rows["label"].to_numpy().astype(float)
    lists = [np.array(x, np.int64) for x in rows["features"].to_pylist()]
    pairs = tuple([np.array(x, np.int64) for found in rows[side].to_pylist() for x in found] for side in ("plain", "swapped"))
    drawn = np.array([max(1, (label == c).sum()) for c in (0, 1)])
    weight = np.array([(1 + c) * counts.get(c, 0) / drawn[c] for c in (0, 1)])[label.astype(int)] if len(label) else label  # misses weigh twice
    return fit(lists, label, weight, pairs, pair_penalty=pair_penalty, unlearned=-500.0)


def scorer(weights: np.ndarray, bias: float):
    """Scores of a list of texts."""
    used = np.flatnonzero(weights)
    model = dict(zip(used.tolist(), weights[used].tolist(), strict=True))
    # A word's buckets that have a weight; most words have none.
    weighted = Lookup(lambda raw: tuple(f for f in word_features(raw.strip(EDGES)) if f in model))
    return lambda texts: sigmoid(
        np.array([sum(map(model.__getitem__, set().union(*map(weighted.__getitem__, set((t or "").lower().split())))), bias) for t in texts], float)
    )


def scored(docs: DataFrame, weights: np.ndarray, bias: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(weights, bias)
        for block in text_blocks(batches, 1):
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(score(block.column(1).to_pylist()))], names=["doc_id", "score"])

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    ).mapInArrow(run, "doc_id long, score double")


def kept(docs: DataFrame, weights: np.ndarray, bias: float, text_col: str = "text") -> DataFrame:
    """The documents whose score is below 0.5, with all their columns, in one pass."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(weights, bias)
        for block in text_blocks(batches, names.index(text_col)):
            yield block.filter(pa.array(score(block.column(names.index(text_col)).to_pylist()) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    weights, bias = train(docs, labels, id_col, text_col, **how)
    return scored(docs, weights, bias, id_col, text_col).select(
        "doc_id", (remainder("doc_id") == HELD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
