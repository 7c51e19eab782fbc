"""Language-model scores by deleted interpolation of word n-grams.

Maximum-likelihood estimates of all orders, from the uniform one up to trigrams, are mixed. Each order's weight depends on
how often its context was seen (buckets by powers of two). The weights are learned by expectation-maximisation on the texts
of a deleted fold, against counts from the other training texts; the final estimates use the counts of all training texts.

All n-grams are counted, those seen once too, and the counts stay distributed (see ``ngrams``): blocks of texts get the
counts of their own n-grams. One such pass over the deleted texts fills a table of estimates and context buckets, of a size
bounded by its bins, for the weights; one over all texts gives the scores.

Tokens are runs of anything but ASCII white space, A-Z lowered, and one end. The model is a distribution over the words of
the training texts and one word for all others.

Defined results: a null text counts as empty and is its end alone. A null doc_id is held out. Rows that repeat a doc_id
count and are scored each. A text of any length is part of one block and is scored whole. Equal texts score alike. Extra
columns are ignored. Without training texts all counts are zero and the one word for all others has probability 1. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.llm.common import read_table
from undertow.llm.ngrams import APART, ASKING, BLOCK_TOKENS, COUNTED, END, RANGE_KEYS, Counts, blocks, mix

#: Folds by CRC-32 of the doc_id: the held-out one, and the one deleted while the mixture weights are learned.
FOLDS, HELD, DELETED = 7, 2, 3
ORDER = 3
#: Buckets of contexts, and levels of an estimate in the table for the weights (octaves; 0 for an estimate of zero).
BUCKETS, LEVELS = 48, 32
#: Stands for what comes before the first word; no word's hash is likely to equal it.
BEGIN = np.uint64(0x51A7C0DE0BE60002)
_MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def fold(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS, F.lit(HELD)).cast("int")


def grams(h: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """The hash of the n-gram that ends at each token, for one order after the other."""
    before = np.append(BEGIN, h[:-1])
    first = before == END
    first[:1] = True
    before[first] = BEGIN
    found = h
    yield found
    for k in range(1, order):
        found = mix(before * _MULTIPLIERS[k % 2] + found)
        yield found
        before = np.append(BEGIN, before[:-1])
        before[first] = BEGIN


# The mixture


class Mixture:
    """Interpolated estimates of a token: weights by order and context bucket, over tokens, kinds and texts counted."""

    def __init__(self, tokens: int, kinds: int, texts: int, weights: np.ndarray) -> None:
        self.tokens, self.uniform, self.texts, self.weights = tokens, 1 / (kinds + 1), texts, weights

    def parts(self, h: np.ndarray, counts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """By order, each token's maximum-likelihood estimate (0 if its context was not seen) and context bucket."""
        first = np.append(True, h[:-1] == END)
        for k, found in enumerate(counts):
            # What ends at the token before is the context; before the first token of a text it is seen once a text.
            context = np.where(first, self.texts, np.append(0, counts[k - 1][:-1])) if k else np.full(len(h), float(self.tokens))
            yield np.divide(found, context, out=np.zeros(len(h)), where=context > 0), bucket_of(context)

    def probabilities(self, parts) -> Iterator[np.ndarray]:
        """Of all orders of the parts, from the uniform one on; the last is the mixture."""
        found = self.uniform
        for (ratio, bucket), weights in zip(parts, self.weights, strict=True):
            w = weights[bucket]
            found = w * ratio + (1 - w) * found
            yield found


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for a context that was not seen, else one more than the whole logarithm to base 2."""
    return np.minimum(np.where(context > 0, np.log2(np.maximum(context, 1)) + 1, 0).astype(np.int64), BUCKETS - 1)


def cells(parts) -> np.ndarray | int:
    """Numbers of the cells of the table for the weights."""
    out = 0
    for ratio, bucket in parts:
        level = np.where(ratio > 0, 1 + np.floor(-np.log2(np.where(ratio > 0, ratio, 1))), 0)
        out = (out * BUCKETS + bucket) * LEVELS + np.clip(level, 0, LEVELS - 1).astype(np.int64)
    return out


def learn_weights(found: np.ndarray, times: np.ndarray, order: int, kinds: int, rounds: int = 40) -> np.ndarray:
    """Weights (order, bucket) by expectation-maximisation on the cells. A bucket that the deleted texts don't reach takes
    its neighbour's weight."""
    ratios: list[np.ndarray] = []
    buckets: list[np.ndarray] = []
    for _ in range(order):
        level, found = found % LEVELS, found // LEVELS
        bucket, found = found % BUCKETS, found // BUCKETS
        ratios.insert(0, np.where(level > 0, 2.0 ** -np.maximum(0, level - 0.5), 0.0))
        buckets.insert(0, bucket)
    weights = np.full((order, BUCKETS), 0.5)
    weights[:, 0] = 0.0
    if not len(times):
        return weights
    reached = np.stack([np.bincount(b, times, BUCKETS) for b in buckets]) > 0
    for _ in range(rounds):
        chances = list(Mixture(0, kinds, 0, weights).probabilities(zip(ratios, buckets, strict=True)))
        mass, new = times.astype(float), weights.copy()
        for k in range(order - 1, -1, -1):
            taken = mass * weights[k][buckets[k]] * ratios[k] / chances[k]
            # Half a prior count on either side keeps rare buckets sane and weights off 0 and 1.
            new[k] = (np.bincount(buckets[k], taken, BUCKETS) + 0.5) / (np.bincount(buckets[k], mass, BUCKETS) + 1)
            mass = np.maximum(mass - taken, 0)
        new[:, 0] = 0.0
        weights = new
    for k in range(order):
        known = np.flatnonzero(reached[k] & (np.arange(BUCKETS) > 0))
        if len(known):
            weights[k, 1:] = weights[k, known[np.maximum(np.searchsorted(known, np.arange(1, BUCKETS), "right") - 1, 0)]]
    return weights


def lm_scores(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = ORDER,
    block_tokens: int = BLOCK_TOKENS,
    range_keys: int = RANGE_KEYS,
) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    part = fold(id_col)
    kind = F.when(part == HELD, ASKING).when(part == DELETED, APART).otherwise(COUNTED).alias("kind")
    made = blocks(docs.select(kind, F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("doc_id")), block_tokens)
    found = made.groupBy("kind").agg(F.sum("tokens").alias("tokens"), F.sum(F.size("lengths")).alias("texts")).collect()  # at most three rows
    sizes = {r.kind: np.array([r.tokens, r.texts]) for r in found}
    total = lambda *kinds: sum((sizes.get(k, np.zeros(2, np.int64)) for k in kinds), np.zeros(2, np.int64)).tolist()
    counts_of = Counts(made, lambda h, lengths: grams(h, order), order, total(COUNTED, APART, ASKING)[0], range_keys)
    kinds, rest_kinds = counts_of.distinct()
    (tokens, texts), (rest_tokens, rest_texts) = total(COUNTED, APART), total(COUNTED)
    rest = Mixture(rest_tokens, rest_kinds, rest_texts, np.zeros((order, BUCKETS)))

    def seen(block: dict, h: np.ndarray, counts: list[np.ndarray]) -> pa.RecordBatch:
        cell, times = np.unique(cells(rest.parts(h, counts)), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(times)], names=["cell", "times"])

    table = counts_of.use(
        seen, "cell long, times long", apart=True
    ).groupBy("cell").agg(F.sum("times").alias("times")).toArrow()  # bounded by its bins
    mixture = Mixture(tokens, kinds, texts, learn_weights(table["cell"].to_numpy(), table["times"].to_numpy(), order, rest_kinds))
    base = np.log10(tokens + kinds + 1)

    def score(block: dict, h: np.ndarray, counts: list[np.ndarray]) -> pa.RecordBatch:
        lengths = np.array(block["lengths"], np.int64)
        for mixed in mixture.probabilities(mixture.parts(h, counts)):
            chance = mixed
        per = [
            np.add.reduceat(x, np.cumsum(lengths) - lengths) for x in (
                (counts[0] > 0).astype(np.int64), np.log10(counts[0] + 1) - base, np.log10(chance)
            )
        ]
        n = len(lengths)
        arrays = [
            pa.array(block["doc_id"], pa.int64()),
            pa.array([block["kind"] == ASKING] * n),
            pa.array(lengths),
            pa.array(per[0]),
            pa.array(np.full(n, tokens)),
            pa.array(per[1]),
            pa.array(per[2]),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return counts_of.use(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op6_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return lm_scores(read_table(spark, sf_dir, "documents"))
