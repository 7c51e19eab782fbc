"""Each stage of the pipeline against brute force on its own input, and the whole."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.conftest import TEXTS
from tests.llm.test_similar import brute_kept
from tests.llm.test_text import brute_substrings
from undertow.llm import packing, toxicity
from undertow.llm.common import public_tokenizer, read_table
from undertow.sources import stage as stages


def texts_of(df) -> dict:
    return {r.doc_id: r.text for r in df.collect()}


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    """The documents before and after each stage, written as the pipeline's users do."""
    docs, found, folder = read_table(spark, sf, "documents"), {}, tmp_path_factory.mktemp("steps")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(folder / name))
        after = spark.read.parquet(str(folder / name))
        found[name] = docs, after
        docs = after
    return found


def test_toxic_documents_go(spark, sf, steps):
    before, after = steps["toxicity"]
    weights, bias = toxicity.train(before, read_table(spark, sf, "labels"))
    want = set()
    for d, text in texts_of(before).items():
        found = set()
        for word in toxicity.words(text):
            found |= set(toxicity.word_features(word))
        if 1 / (1 + math.exp(-bias - sum(weights[f] for f in found))) < 0.5:
            want.add(d)
    assert set(texts_of(after)) == want
    assert 0 < len(want) < before.count()


def test_exact_copies_go(steps):
    before, after = map(texts_of, steps["exact_dedup"])
    largest = {}
    for d, t in before.items():
        largest[t or ""] = max(largest.get(t or "", d), d)
    assert after == {d: before[d] for d in largest.values()}


def test_near_copies_go(steps):
    before, after = map(texts_of, steps["simhash_near_dedup"])
    assert after == {d: before[d] for d in brute_kept(sorted(before.items()))}


def test_repeated_passages_go(steps):
    before, after = steps["substring_dedup"]
    lengths = {r.doc_id: r.n_chars for r in after.collect()}
    before, after = texts_of(before), texts_of(after)
    assert set(before) == set(after)
    for d, (n, removed, kept) in brute_substrings(sorted(before.items())).items():
        left = (after[d] or "").split()
        assert (len(left), brute_substrings([(0, after[d])], 1 << 30)[0][2]) == (n - removed, kept)
        if removed:
            assert lengths[d] == len(after[d])
        else:
            assert after[d] == before[d]


def test_every_token_is_packed(steps):
    from tokenizers import Tokenizer

    before, after = steps["packing"]
    tokenizer, rows, windows = Tokenizer.from_file(public_tokenizer(packing.TOKENIZER)), {}, {}
    for r in after.collect():
        rows.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(rows) == set(texts_of(before))
    for d, text in texts_of(before).items():
        ids, at = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4"), 0
        for r in sorted(rows[d], key=lambda r: r.start):
            assert (r.start, r.ids_crc32) == (at, zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for parts in windows.values():
        ends = np.cumsum([0, *(n for _, n in sorted(parts))])
        assert [o for o, _ in sorted(parts)] == ends[:-1].tolist()
        assert ends[-1] <= packing.WINDOW


def test_all_but_the_last_stage_keep_the_columns(steps):
    for name, (before, after) in list(steps.items())[:-1]:
        assert (name, after.columns) == (name, before.columns)


def test_run_is_the_stages_in_order(spark, sf, steps):
    key = lambda r: (r.doc_id, r.start)
    want = sorted(steps["packing"][1].select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect(), key=key)
    got = sorted(corpus_pipeline.run(spark, sf).select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect(), key=key)
    assert got == want


def test_stages_remove_their_intermediate_tables(spark, sf, tmp_path):
    """When a stage begins, the tables of the one before it are gone."""
    docs = read_table(spark, sf, "documents")
    corpus_pipeline.drop_exact_copies(spark, docs, sf).write.parquet(str(tmp_path / "one"))
    path = corpus_pipeline._LAST[spark.sparkContext.applicationId]
    assert any(stages._file_system(spark, path)[0].listStatus(stages._file_system(spark, path)[1]))
    corpus_pipeline.drop_near_copies(spark, spark.read.parquet(str(tmp_path / "one")), sf).write.parquet(str(tmp_path / "two"))
    assert not stages._file_system(spark, path)[0].exists(stages._file_system(spark, path)[1])


def test_stages_on_messy_tables(spark, messy, empty, sf):
    """Null ids and texts, repeated rows, very long texts, clashing columns, no rows."""
    for docs, rows in ((messy, len(TEXTS)), (empty, 0)):
        kept = []
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf)
            assert i == 4 or out.columns == docs.columns
            kept.append(out.count())
        distinct = len({t or "" for _, t in TEXTS})
        sets = len({(t or "").strip() for _, t in TEXTS})
        assert kept[:4] == ([rows, distinct, sets, rows] if rows else [0] * 4)
        assert (kept[4] > 0) == (rows > 0)
