"""Quality scores from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every text. Only the counts of vote patterns (at most three
to the power of the labellers, whatever the corpus) reach the driver, where expectation-maximisation estimates how
accurate each labeller is and the posterior of each pattern, over all documents. Posterior labels of a bounded sample by
hash then train a hashed linear scorer on the shapes of words and on text statistics, which scores every whole text. No
given labels are used. Texts are read once: their votes and features are written, and all later steps read these.

Defined results: a null or empty text gets the votes of an empty text (bad). A text of any length is voted on and scored
whole. Rows that repeat a doc_id are voted on and scored each. Rows without doc_id are scored, too. Which documents are
learned from goes by a hash of the doc_id, ties by the doc_id; of rows that share a doc_id one is learned from. A pattern
as likely good as bad, and a score of exactly 0.5, count as good. Extra columns are ignored. An empty table gives an empty
result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.llm.common import Lookup, kept_in_worker, read_table, text_blocks, written
from undertow.llm.linear import BUCKETS, fit, sigmoid

#: Documents of the sample that trains the scorer, and most classes that the label model tries.
SAMPLE, CLASSES = 4000, 8
#: Shapes of plain words, but for one mark of punctuation at the end.
PLAIN = {"a", "Aa", "A", "0", "Aa'a", "a'a", "a-a"}
_LOWER, _UPPER, _DIGIT = re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), re.compile(r"[A-ZÀ-ÖØ-Þ]+"), re.compile(r"\d+")


def shape(word: str) -> str:
    """A word's shape: runs of lower case, upper case and digits as a, A and 0, and its other characters."""
    return _DIGIT.sub("0", _UPPER.sub("A", _LOWER.sub("a", word[:64])))[:12]


_LETTERS = re.compile(r"[^\W\d_]+")
_SYMBOLS = re.compile(r"[#$%&*|!?~^=<>@_\\]{2,}|^[|]$")


class Profile:
    """The statistics of a text that labellers and features use."""

    def __init__(self, text: str | None) -> None:
        words = (text or "").split()
        self.n = n = len(words)
        self.shapes = Counter(map(kept_in_worker("shapes", lambda: Lookup(shape)).__getitem__, words))
        one = max(1, n)
        share = lambda test: sum(c for s, c in self.shapes.items() if test(s)) / one
        self.upper = share(lambda s: s.startswith("A") and "a" not in s and s not in ("A", "A.", "A,"))
        self.symbols = share(lambda s: bool(_SYMBOLS.search(s)))
        self.ends = share(lambda s: s.endswith((".", "?")) or s.endswith(("a!", "A!")))
        self.digits = share(lambda s: "0" in s)
        self.repeats = sum(map(str.__eq__, words, words[1:])) / one
        self.distinct = len(set(words)) / one
        self.most = max(Counter(words).values(), default=0) / one
        self.length = sum(map(len, words)) / one
        self.plain = share(lambda s: s in PLAIN or s[:-1] in PLAIN and s[-1] in ".,;:?!")
        self.letters = sum(map(len, _LETTERS.findall(text or ""))) / max(1, sum(map(len, words)))

    def statistics(self) -> dict[str, float]:
        return {
            "upper": self.upper,
            "symbols": self.symbols,
            "ends": self.ends,
            "digits": self.digits,
            "repeats": self.repeats,
            "distinct": self.distinct,
            "most": self.most,
            "length": self.length / 10,
            "plain": self.plain,
            "letters": self.letters,
        }


#: The labellers: each maps a profile to 1 (good), -1 (bad) or 0 (no vote).
LABELLERS = {
    "shouting": lambda p: -1 if p.upper > 0.4 else 1 if p.upper < 0.1 else 0,
    "symbols": lambda p: -1 if p.symbols > 0.15 else 1 if p.symbols < 0.02 else 0,
    "stutter": lambda p: -1 if p.repeats > 0.3 else 1 if p.repeats < 0.05 else 0,
    "variety": lambda p: 0 if p.n < 20 else -1 if p.distinct < 0.2 * min(1, 200 / p.n) else 1 if p.distinct > 0.4 * min(1, 400 / p.n) else 0,
    "one_word": lambda p: -1 if p.n >= 20 and p.most > 0.25 else 1 if p.n >= 20 and p.most < 0.15 else 0,
    "sentences": lambda p: 0 if p.n < 30 else -1 if p.ends < 0.01 or p.ends > 0.6 else 1 if 0.02 < p.ends < 0.4 else 0,
    "lengths": lambda p: -1 if p.length > 12 or p.length < 2 else 1 if 3 <= p.length <= 9 else 0,
    "size": lambda p: -1 if p.n == 0 else 0,
    "letters": lambda p: -1 if p.letters < 0.85 else 1 if p.letters > 0.92 else 0,
    "plain": lambda p: -1 if p.plain < 0.5 else 1 if p.plain > 0.8 else 0,
}


def votes(profile: Profile) -> list[int]:
    return [vote(profile) for vote in LABELLERS.values()]


def features(profile: Profile) -> list[int]:
    """Hashed buckets: each shape with the size of its share, and each statistic's level."""
    names = [f"shape {s} {int(np.log2(c / max(1, profile.n)) - 0.5)}" for s, c in profile.shapes.items()]
    names += [f"{name} {min(20, int(20 * value))}" for name, value in profile.statistics().items()]
    return sorted({crc32(n.encode()) % BUCKETS for n in names})


def expectation_maximisation(
    bad: np.ndarray, good: np.ndarray, counts: np.ndarray, chance: np.ndarray, prior: np.ndarray, rounds: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """After so many rounds, each pattern's share in the classes, the chance of a bad vote (class, labeller), the classes' shares, and
    the logarithm of each pattern's likelihood before the last estimates. Given the class, votes are independent; no vote says nothing."""
    for _ in range(rounds):
        logs = np.log(prior) + bad @ np.log(chance).T + good @ np.log(1 - chance).T
        top = logs.max(1, keepdims=True, initial=-1e300)
        member = np.exp(logs - top)
        total = member.sum(1, keepdims=True)
        member /= total
        weight = member * counts[:, None]
        prior = (weight.sum(0) + 1) / (counts.sum() + len(prior))
        chance = (weight.T @ bad + 0.5) / (weight.T @ (bad + good) + 1)
    return member, chance, prior, (np.log(total) + top)[:, 0]


def label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chance that a text of each pattern is good, the chance that each labeller votes bad when it votes (class, labeller), and
    the classes' shares; the largest good class stands last. patterns: rows of votes in -1, 0, 1.

    How many classes there are goes by the likelihood, less the logarithm of the texts for each two estimates (Schwarz's rule). A
    class is added where the classes so far explain most texts worst, and then all are estimated again; nothing ties a class to a
    labeller, so labellers witness each other's classes. A class is one of bad texts if some labeller votes bad on most of it.
    """
    if not len(patterns):
        return np.zeros(0), np.zeros((0, patterns.shape[1])), np.zeros(0)
    order = np.lexsort(patterns.T)
    bad, good, sizes, n = (patterns[order] == -1).astype(float), (patterns[order] == 1).astype(float), counts[order], counts.sum()
    chance, prior, best = np.full((1, patterns.shape[1]), 0.05), np.ones(1), None
    for classes in range(1, CLASSES + 1):
        found = expectation_maximisation(bad, good, sizes, chance, prior, rounds)
        cost = classes * (patterns.shape[1] + 1) * np.log(n) - 2 * (sizes * found[3]).sum()
        if best is None or cost < best[0]:
            best = cost, found
        worst = int(np.argmax(sizes * (np.log(sizes / n) - found[3])))
        new = np.where(bad[worst] > 0, 0.9, np.where(good[worst] > 0, 0.1, 0.5))
        chance, prior = np.vstack([found[1], new]), np.append(found[2] * 0.9, 0.1)
    member, chance, prior, _ = best[1]
    clean = (chance <= 0.5).all(1)
    posterior = np.empty(len(patterns))
    posterior[order] = member[:, clean].sum(1)
    last = np.lexsort((prior, clean))
    return posterior, chance[last], prior[last]


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, posterior (of the label model), score (of the scorer), predicted, kept."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, 1):
            profiles = [Profile(t) for t in block.column(1).to_pylist()]
            lists = [pa.array([make(p) for p in profiles], pa.list_(pa.int32())) for make in (votes, features)]
            yield pa.RecordBatch.from_arrays([block.column(0), *lists], names=["doc_id", "votes", "features"])

    table = written(texts.mapInArrow(profile, "doc_id long, votes array<int>, features array<int>"), "profiles")
    found = table.groupBy("votes").agg(F.count("*").alias("n")).collect()  # at most 3 ** labellers rows
    patterns = np.array([r.votes for r in found], np.int64).reshape(-1, len(LABELLERS))
    posterior, _, _ = label_model(patterns, np.array([r.n for r in found], float))
    known = {tuple(p): float(q) for p, q in zip(patterns.tolist(), posterior, strict=True)}
    # Only numbers of the profiles travel; the sample is bounded, also where many rows share a doc_id.
    chosen = table.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = table.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("votes", "features")).alias("x")).select("x.*").toArrow()
    target = np.array([known[tuple(v)] for v in rows["votes"].to_pylist()], float)
    weights, bias = fit([np.array(x, np.int64) for x in rows["features"].to_pylist()], target, np.ones(len(target)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            lengths = np.diff(lists.offsets.to_numpy())
            z = bias + np.bincount(np.repeat(np.arange(len(lengths)), lengths), weights[lists.flatten().to_numpy()], len(lengths))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([known[tuple(v)] for v in batch.column(1).to_pylist()], pa.float64()), pa.array(sigmoid(z))],
                names=["doc_id", "posterior", "score"],
            )

    good = F.col("score") >= 0.5
    return table.mapInArrow(score, "doc_id long, posterior double, score double").select("*", good.cast("int").alias("predicted"), good.alias("kept"))


def op10_quality(spark, sf_dir: str) -> DataFrame:
    return quality(read_table(spark, sf_dir, "documents"))
