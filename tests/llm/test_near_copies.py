"""The near-copy stage takes SimHash links, checks them, and loses none of the pairs that fingerprints miss."""

from __future__ import annotations

import random

import pytest

from tests.llm.test_similar import brute_kept
from undertow.llm import similar, simhash


@pytest.mark.parametrize("alone", [True, False])
def test_near_copies_are_linked_by_fingerprints(spark, monkeypatch, alone):
    """By fingerprints alone, pairs of few differing shingles are found; pairs around 0.85 need the join."""
    rng = random.Random(8)
    rows = []
    for i in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        near = words if i % 2 else words[:-1]
        far = [*words[:-30], *(f"x{rng.randrange(10**6)}" for _ in range(30))]
        rows += [(3 * i, " ".join(words)), (3 * i + 1, " ".join([*near, "end"])), (3 * i + 2, " ".join(far))]
    pairs = {(3 * i, 3 * i + 1) for i in range(12)}
    if alone:
        none = spark.createDataFrame([], similar.LINK)
        monkeypatch.setattr(similar, "met_at_once", lambda classes: none)
        monkeypatch.setattr(similar, "met_across", lambda classes, roots, part: none)
    found = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    if alone:
        assert sum(b not in found for _, b in pairs) >= 6
    else:
        assert found == brute_kept(rows)
