from __future__ import annotations

import random

import numpy as np
import pytest

from undertow.llm import ngrams, simhash, similar


def shingles(text: str | None) -> frozenset:
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_kept(rows: list[tuple[int, str]]) -> set[int]:
    """The least id of each component of pairs at 0.8 or more."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    least = {}
    for r, (d, _) in zip(root, rows, strict=True):
        least[r] = min(least.get(r, d), d)
    return set(least.values())


def kept(spark, rows, **how) -> set[int]:
    return {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **how).collect()}


def edited(r: random.Random, words: list[str], changes: int) -> list[str]:
    copy = words[:]
    for i in r.sample(range(len(copy)), changes):
        copy[i] = f"c{r.randint(0, 10**6)}"
    return copy


def test_no_clean_document_is_dropped(spark):
    """Pairs a little below 0.8 stay: 8 changed words of 200 leave a similarity near 0.67."""
    r = random.Random(1)
    rows = []
    for d in range(0, 300, 2):
        words = [f"w{r.randint(0, 5000)}" for _ in range(200)]
        rows += [(d, " ".join(words)), (d + 1, " ".join(edited(r, words, 8)))]
    assert kept(spark, rows) == brute_kept(rows) == {d for d, _ in rows}


@pytest.mark.parametrize("part", [2048, 7])
def test_groups_match_brute_force(spark, part):
    """Short texts, pairs around 0.8, a large group of near copies, and texts that share a common passage and little else."""
    r = random.Random(2)
    word = lambda: f"w{r.randint(0, 5000)}"
    texts = []
    for _ in range(60):
        words = [word() for _ in range(r.choice([3, 5, 8, 9, 9, 30, 120]))]
        texts += [words, edited(r, words, r.choice([0, 1, 2]) if len(words) > 9 else 0), words[:-1], [*words, word()]]
    base, passage = [word() for _ in range(150)], [word() for _ in range(40)]
    texts += [edited(r, base, r.randint(0, 4)) for _ in range(60)]
    texts += [[*passage, *(word() for _ in range(r.randint(1, 25)))] for _ in range(60)]
    texts += [[], [], ["one"]]
    r.shuffle(texts)
    rows = [(d, " ".join(t)) for d, t in enumerate(texts)]
    assert kept(spark, rows, part=part) == brute_kept(rows)


def test_a_pair_is_found_among_any_number_of_others(spark):
    """Every pair at exactly 0.8 (9 words, the last changed by one more) is joined, however many rows stand beside it."""
    r = random.Random(3)
    rows = []
    for d in range(0, 400, 2):
        words = [f"w{r.randint(0, 5000)}" for _ in range(8)]
        rows += [(d, " ".join(words)), (d + 1, " ".join([*words, f"w{r.randint(0, 5000)}"]))]
    assert kept(spark, rows) == brute_kept(rows) == set(range(0, 400, 2))
    some = [row for row in rows if row[0] < 20]
    assert kept(spark, some) == set(range(0, 20, 2))


def brute_differing(a: bytes, b: bytes) -> int:
    return sum((x ^ y).bit_count() for x, y in zip(a, b, strict=True))


def test_sketches_are_a_lower_bound():
    """Two sketches differ in at most as many bits as their sets differ in shingles."""
    rng = np.random.default_rng(0)
    for n in (1, 20, 400, 3000):
        base = rng.integers(0, 2**63, n).astype(np.uint64)
        for changes in (0, 1, n // 10, n):
            other = np.unique(np.concatenate([base[changes:], rng.integers(0, 2**63, changes).astype(np.uint64)]))
            apart = len(np.setxor1d(base, other))
            assert brute_differing(similar.sketch(np.unique(base)), similar.sketch(other)) <= apart


@pytest.mark.parametrize("many", [1, 10**9])
@pytest.mark.parametrize("parts", [1, 2])
def test_rows_of_other_components_meet(monkeypatch, many, parts):
    """Bit by bit and pair by pair, within one part and between two, against every pair."""
    monkeypatch.setattr(similar, "MANY", many)
    rng = np.random.default_rng(parts)
    base = rng.integers(0, 2**63, 150).astype(np.uint64)
    sets = [
        np.unique(np.concatenate([base[rng.random(150) < 0.93], rng.integers(0, 2**63, rng.integers(0, 30)).astype(np.uint64)])) for _ in range(200)
    ]
    sets += [np.unique(rng.integers(0, 2**63, 2000).astype(np.uint64)) for _ in range(3)]
    n, root, own = np.array([len(s) for s in sets]), rng.choice([5, 5, 5, 6, 7], len(sets)), rng.integers(0, parts, len(sets))
    words = np.array([np.frombuffer(similar.sketch(s), np.int64) for s in sets])
    order = np.argsort(n, kind="stable")
    rows = np.column_stack([np.full(len(n), 9), np.zeros(len(n)), np.full(len(n), parts - 1), own, np.arange(len(n)), n, root]).astype(np.int64)
    rows = np.concatenate([rows, words], axis=1)[order]
    got = {tuple(sorted((int(rows[i, 4]), int(rows[j, 4])))) for i, j in zip(*similar.across(rows), strict=True)}
    want = set()
    for i in range(len(sets)):
        for j in range(i):
            near = 9 * brute_differing(similar.sketch(sets[i]), similar.sketch(sets[j])) <= n[i] + n[j]
            if root[i] != root[j] and (parts == 1 or own[i] != own[j]) and 5 * min(n[i], n[j]) >= 4 * max(n[i], n[j]) and near:
                want.add((j, i))
    assert got == want
    assert want


def test_shingles_of_a_block():
    """All texts of a block at once: short ones whole, empty ones none, and equal runs of words alike."""
    texts = [["a", "b", "c", "d", "e", "f"], [], ["a"], ["b", "c", "d", "e", "f"], ["a", "b", "c", "d"], ["a", "b", "c", "d"]]
    code = {w: np.uint64(1000 + i) for i, w in enumerate("abcdef")}
    h = np.array([x for t in texts for x in [*(code[w] for w in t), ngrams.END]], np.uint64)
    found, n = similar.shingles(h, np.array([len(t) + 1 for t in texts]))
    assert n.tolist() == [2, 0, 1, 1, 1, 1]
    assert found[1] == found[3]
    assert found[4] == found[5]
    assert len(set(found.tolist())) == 4
