"""Operators on documents against the libraries and brute force, and on messy tables."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import xxhash

from tests.llm.conftest import LONG, TEXTS
from undertow.llm import exact_dedup, lm_scoring, packing, quality, sentencepiece_codec, simhash, substring_dedup, toxicity
from undertow.llm.common import packed, public_tokenizer, unpacked
from undertow.llm.components import components
from undertow.llm.linear import Problem, fit, sigmoid

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
PIECES = [
    *" \n\t▁ab.É😀\x00 ́é,'1;",
    "  ",
    "\n\n",
    "the",
    " of",
    "<s>",
    "<|endoftext|>",
    "İ",
    "Σ",
    "ﬁ",
    "\x1c",
    "\x85",
    "it's",
    "CAN'T",
    "Ő",
    "ÿ",
    "ŉ",
    "ß.",
    "a.",
    "b!?",
    "*",
    "<|EndOfText|>",
    "|",
]


def odd_texts(n=3000):
    rng = random.Random(1)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25))) for _ in range(n)]


# SentencePiece


def test_codec_matches_library(documents):
    with open(public_tokenizer(sentencepiece_codec.MODEL), "rb") as f:
        codec = sentencepiece_codec.Codec(f.read())
    for text in [*odd_texts(), *(t for _, t in documents)]:
        ids = codec.sp.encode(text)
        assert codec.encode_decode(text) == (",".join(map(str, ids)), codec.sp.decode(ids))
    assert codec.encode_decode(None) == ("", "")


def test_codec_on_messy_tables(messy, empty):
    path = public_tokenizer(sentencepiece_codec.MODEL)
    rows = sentencepiece_codec.encode_decode(messy, path).collect()
    assert len(rows) == len(TEXTS)
    assert sorted(r.decoded for r in rows) == sorted((t or "").replace("▁", " ") for _, t in TEXTS)
    assert all(r.n_tokens == len(r.ids) for r in rows)
    assert sentencepiece_codec.encode_decode(empty, path, digests=True).count() == 0


def test_codec_query_matches_library(spark, sf, documents):
    """The digests of whole texts, through the query."""
    with open(public_tokenizer(sentencepiece_codec.MODEL), "rb") as f:
        sp = sentencepiece.SentencePieceProcessor(model_proto=f.read())
    want = {}
    for d, t in documents:
        ids = sp.encode(t or "")
        want[d] = (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in sentencepiece_codec.op1_sentencepiece(spark, sf).collect()} == want


def test_codec_refuses_other_models():
    """One whose normaliser changes text, and one whose pieces cross markers."""
    from sentencepiece import sentencepiece_model_pb2

    with open(public_tokenizer(sentencepiece_codec.MODEL), "rb") as f:
        raw = f.read()
    model = sentencepiece_model_pb2.ModelProto.FromString(raw)
    model.normalizer_spec.remove_extra_whitespaces = True
    with pytest.raises(ValueError, match="normaliser"):
        sentencepiece_codec.Codec(model.SerializeToString())
    model = sentencepiece_model_pb2.ModelProto.FromString(raw)
    model.pieces[-1].piece = "a▁b"
    with pytest.raises(ValueError, match="cross"):
        sentencepiece_codec.Codec(model.SerializeToString())


# Substring dedup


def brute_substrings(rows, window=20):
    seen, out = set(), {}
    for d, t in sorted(rows):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        out[d] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("many", [16, 1])
def test_substrings_match_brute_force(spark, documents, many):
    rng = random.Random(many)
    base = [[rng.choice("abcde") if rng.random() < 0.4 else f"w{rng.randint(0, 400)}" for _ in range(rng.randint(10, 80))] for _ in range(12)]
    rows = []
    for d in range(150):
        words = []
        for _ in range(rng.randint(0, 4)):
            b = rng.choice(base)
            i = rng.randint(0, len(b))
            words += b[i : rng.randint(i, len(b))]
            words += ["z"] * rng.randint(1, 60) if rng.random() < 0.3 else []
        rows.append((d * 7 % 150, " ".join(words)))
    for some in (rows, documents):
        df = spark.createDataFrame(some, "doc_id long, text string").repartition(5)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.substring_duplicates(df, many=many, digests=True).collect()}
        assert got == brute_substrings(some)


def test_factors_match_their_references(spark, documents):
    """Each factor is found, word by word, at an earlier place of the reference, and goes on no further there."""
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 2000)}" for _ in range(400)]
    rows = [(d, " ".join([f"x{d}", *base[rng.randint(0, 100) : rng.randint(200, 400)], f"y{d}"])) for d in range(40)]
    for some in (rows, documents):
        words = {d: (t or "").split() for d, t in some}
        found = substring_dedup.factors(spark.createDataFrame(some, "doc_id long, text string").repartition(4)).collect()
        assert found
        for f in found:
            assert f.length >= 20
            assert (f.ref_id, f.ref_start) < (f.doc_id, f.start)
            assert words[f.doc_id][f.start : f.start + f.length] == words[f.ref_id][f.ref_start : f.ref_start + f.length]
        for one, next_ in itertools.pairwise(sorted(found, key=lambda f: (f.doc_id, f.start))):
            assert one.doc_id != next_.doc_id or one.start + one.length <= next_.start


def test_a_factor_is_followed_over_parts_with_other_first_places(spark):
    """A, then x A B, then A B: the last is one factor, though A's first place is in the first document."""
    a, b = ([f"{k}{i}" for i in range(60)] for k in "ab")
    rows = [(0, a), (1, [f"x{i}" for i in range(30)] + a + b), (2, a + b), (3, b + ["y"] + a + b)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {}
    for r in substring_dedup.factors(df).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.ref_id, r.ref_start))
    assert {k: sorted(v) for k, v in got.items()} == {1: [(30, 60, 0, 0)], 2: [(0, 120, 1, 30)], 3: [(0, 60, 1, 90), (61, 120, 1, 30)]}


@pytest.mark.parametrize("seed", range(3))
def test_factors_beside_a_naive_search(spark, seed):
    """Passages of a few sources between own words: no factor is longer than the longest match of its first word with any earlier
    place, and about three of four are that."""
    rng = random.Random(seed)
    base = [[f"{k}{i}" for i in range(150)] for k in range(4)]
    rows = []
    for d in range(40):
        words = []
        for _ in range(rng.randint(1, 3)):
            source, i = rng.choice(base), rng.randint(0, 60)
            words += [f"own{d}-{len(words)}", *source[i : i + rng.randint(45, 90)]]
        rows.append((d, words))
    earlier: dict = {}
    longest = {}
    for d, words in rows:
        for at in range(len(words) - 19):
            for r, x in earlier.get(tuple(words[at : at + 20]), []):
                n = next((n for n in range(len(words) - at) if x + n >= len(rows[r][1]) or rows[r][1][x + n] != words[at + n]), len(words) - at)
                longest[d, at] = max(n, longest.get((d, at), 0))
            earlier.setdefault(tuple(words[at : at + 20]), []).append((d, at))
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string").repartition(4)
    got = [(r.doc_id, r.start, r.length) for r in substring_dedup.factors(df).collect()]
    assert len(got) > 30 and all(n <= longest[d, a] for d, a, n in got)
    # Of several places that hold a passage the one that goes on furthest may be none of its phrases' first places.
    assert sum(n == longest[d, a] for d, a, n in got) >= 0.7 * len(got)


def test_parse_takes_the_furthest_run():
    runs = [(0, 5, 7, 100), (0, 9, 8, 50), (3, 30, 9, 3), (40, 41, 9, 0), (40, 41, 8, 9)]
    # Windows of 3 words: the run of 9 windows has 11 words; what is left of the third run goes on from there.
    assert substring_dedup.furthest(runs, 3) == [(0, 11, 8, 50), (11, 21, 9, 11), (40, 3, 8, 9)]


def test_longest_factors():
    """Matches that go on at the same place join; others, and those of another document, do not."""
    matches = [
        (0, 5, 3, 1, 50),
        (0, 0, 5, 1, 45),
        (0, 8, 2, 1, 99),
        (0, 20, 1, 1, 65),
        (0, 30, 4, 2, 0),
        (0, 31, 2, 2, 1),
        (1, 34, 2, 2, 4),
        (1, 36, 1, 2, 6),
    ]
    found = substring_dedup.longest(*np.array(matches)[::-1].T)
    assert np.array(found).T.tolist() == [[0, 0, 8, 1, 45], [0, 8, 2, 1, 99], [0, 20, 1, 1, 65], [0, 30, 4, 2, 0], [1, 34, 3, 2, 4]]


@pytest.mark.parametrize("remembered", [200_000, 3])
def test_one_passage_in_every_block(spark, monkeypatch, remembered):
    """A passage that every block holds, in any order of documents: a task asks for its phrases once."""
    rng = random.Random(5)
    base = [f"p{i}" for i in range(60)]
    order = list(range(200))
    rng.shuffle(order)
    rows = [(d, " ".join([*(f"w{rng.randint(0, 9999)}" for _ in range(rng.randint(5, 40))), *base])) for d in order]
    asked, blocks = substring_dedup.Asked(16), 0
    for i in range(0, 200, 10):
        some = rows[i : i + 10]
        block = substring_dedup.Block(np.array([d for d, _ in some]), [t.encode().split() for _, t in some], 20)
        asked.add(substring_dedup.phrases(block, 8)[0])
        blocks += 1
    probes = asked.rest()
    # Of phrases within the passage one row is left; without memory there would be one a block.
    assert max(Counter(map(tuple, probes[:, :2].tolist())).values()) == 1
    monkeypatch.setattr(substring_dedup, "REMEMBERED", remembered)
    got = {
        r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.substring_duplicates(
            spark.createDataFrame(rows, "doc_id long, text string").repartition(7), digests=True
        ).collect()
    }
    assert got == brute_substrings(rows)


def test_owner_holds_few_rows_of_a_minimiser():
    """Answers are the same if a minimiser's rows come in parts, but for repeated checks."""
    rng = np.random.default_rng(0)
    for contents in (1, 3):
        rows = np.zeros((300, 8), np.int64)
        rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 3] = 7, rng.integers(1, contents + 1, 300), rng.integers(0, 50, 300), np.arange(300)
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1]))]
        whole = {tuple(r) for r in substring_dedup._answers(rows).tolist()}
        parts, held = set(), rows[:0]
        for i in range(0, 300, 50):
            held = np.concatenate([held, rows[i : i + 50]])
            parts |= {tuple(r) for r in substring_dedup._answers(held).tolist()}
            held = substring_dedup._essence(held)
        # A content that was alone until then is asked for once the minimiser proves shared.
        assert parts == whole


def test_substrings_on_messy_tables(messy, empty):
    rows = substring_dedup.substring_duplicates(messy).collect()
    assert len(rows) == len(TEXTS)
    removed = Counter((r.doc_id, r.n_removed) for r in rows if r.n_words == 26)
    # Of the rows that repeat a doc_id, one stands first; the other and doc 6 repeat it.
    assert removed == {(5, 0): 1, (5, 26): 1, (6, 26): 1}
    assert next(r for r in rows if r.doc_id == 10).n_removed == 499
    kept = substring_dedup.without_duplicates(messy)
    assert kept.columns == messy.columns
    assert kept.count() == len(TEXTS)
    assert {r.text for r in kept.where("doc_id = 6").collect()} == {""}
    assert substring_dedup.substring_duplicates(empty).count() == substring_dedup.without_duplicates(empty).count() == 0


# Exact dedup


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_matches_brute_force(spark, documents, bits):
    df = spark.createDataFrame(documents, "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in exact_dedup.exact_duplicates(df, id_bits=bits).collect()}
    ids = {}
    for d, t in documents:
        ids.setdefault(t, []).append(d)
    assert got == {d: (max(ids[t]), len(ids[t]), d == max(ids[t]), sha(t)) for d, t in documents}


def test_chunks_join_to_the_text(spark):
    texts = [LONG, "", "a", "\n" * 9000, "aaaaaaa" * 900, "é😀 x\n" * 3000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for row in df.select("text", exact_dedup.chunks(df["text"]).alias("c")).collect():
        assert "".join(row.c) == row.text
        assert all(len(c) <= exact_dedup.LONGEST + exact_dedup.CUT_RUN for c in row.c)


def test_exact_on_messy_tables(messy, empty):
    rows = exact_dedup.exact_duplicates(messy).collect()
    assert len(rows) == len(TEXTS)
    groups = Counter(r.text_sha256 for r in rows)
    assert sum(r.kept for r in rows) == len(groups)
    assert {r.keep_id for r in rows if r.text_sha256 == sha("")} == {11}
    kept = exact_dedup.drop_exact_duplicates(messy)
    assert kept.columns == messy.columns
    assert kept.count() == len(groups)
    assert exact_dedup.exact_duplicates(empty).count() == exact_dedup.drop_exact_duplicates(empty).count() == 0


# Packing


def test_word_tokens_match_library(documents):
    with open(public_tokenizer(packing.TOKENIZER), encoding="utf-8") as f:
        tokens = packing.WordTokens(f.read())
    for text in [*odd_texts(), *(t for _, t in documents)]:
        assert tokens(text) == np.array(tokens.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def brute_fit(lengths, window):
    room = []
    for n in sorted(lengths, reverse=True):
        best = min((c for c in room if c >= n), default=window)
        if best in room:
            room.remove(best)
        room.append(best - n)
    return sorted(room)


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    window = rng.choice([16, 64, 37])
    lengths = [rng.randint(1, window) for _ in range(rng.randint(0, 60))]
    counts = Counter(lengths)
    plan, windows = packing.best_fit_decreasing(counts, window), {}
    for length, n in counts.items():
        part = plan[plan[:, 0] == length]
        for rank in range(n):
            run = part[np.searchsorted(part[:, 1], rank, "right") - 1]
            nth = rank - run[1]
            windows.setdefault(int(run[2] + nth // run[3]), []).append((int(run[4] + nth % run[3] * length), length))
    for pieces in windows.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
    assert sorted(window - sum(n for _, n in p) for p in windows.values()) == brute_fit(lengths, window)


def test_packing_on_messy_tables(messy, empty):
    path = public_tokenizer(packing.TOKENIZER)
    rows = packing.pack(messy, path, window=64).collect()
    used, docs = {}, Counter()
    for r in rows:
        assert len(r.payload) == 4 * r.length
        assert r.start % 64 == 0
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs[(r.doc_id, r.doc_tokens)] += r.length
    for pieces in used.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 64
    assert sum(docs.values()) == sum(r.doc_tokens for r in rows if r.start == 0)
    key = lambda r: (r.doc_id or 0, r.doc_tokens, r.start)
    crcs = {(key(r), r.payload) for r in packing.pack(messy, path, window=64, with_ids=False).collect()}
    assert {(key(r), zlib.crc32(r.payload)) for r in rows} == crcs
    assert packing.pack(empty, path).count() == 0


def test_packing_query_matches_library(spark, sf, documents):
    """Every id of every text lies in one piece, and as few windows are open as best-fit decreasing leaves."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizer(packing.TOKENIZER))
    pieces, windows = {}, {}
    for r in packing.op4_packing(spark, sf).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    rest = []
    for d, t in documents:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
        rest += [4096] * (len(ids) // 4096) + ([len(ids) % 4096] if len(ids) % 4096 else [])
    for parts in windows.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
    assert sorted(4096 - sum(n for _, n in p) for p in windows.values()) == brute_fit(rest, 4096)


# SimHash


def brute_print(text, shingle=3):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints, radius=3):
    x, parent = np.array(prints, np.uint64), list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= radius):
            parent[max(root(i), root(i + 1 + int(j)))] = min(root(i), root(i + 1 + int(j)))
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: least[root(i)] for i, d in enumerate(ids)}


def test_simhash_matches_brute_force(spark, documents):
    df = spark.createDataFrame(documents, "doc_id long, text string")
    rows = simhash.near_duplicates(df).collect()
    prints = {d: brute_print(t) for d, t in documents}
    assert {r.doc_id: r.fingerprint for r in rows} == {d: f"{p:016x}" for d, p in prints.items()}
    assert {r.doc_id: r.component_id for r in rows} == brute_components(list(prints), list(prints.values()))


@pytest.mark.parametrize("part", [2048, 50])
def test_links_of_a_hot_bucket(spark, part):
    rng = np.random.default_rng(1)
    base, values = int(rng.integers(0, 2**63)), set()
    for _ in range(400):
        x = base
        for _ in range(rng.integers(0, 5)):
            x ^= 1 << int(rng.integers(0, 64))
        values.add(x)
    values = sorted(values)
    signed = [simhash._signed(x) for x in values]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    root = {r.node: r.root for r in components(simhash.links(df, simhash.block_keys("fp", 3), "fp", ["fp"], 3, part).repartition(6)).collect()}
    want, got = {}, {}
    for s, c in brute_components(signed, values).items():
        want.setdefault(c, set()).add(s)
        got.setdefault(root.get(s, s), set()).add(s)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


@pytest.mark.parametrize("radius", [0, 1, 3, 6])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    a = rng.integers(0, 2**63, (500, 4)).astype(np.uint64)
    b = a.copy()
    for i in range(500):
        for _ in range(rng.integers(0, 9)):
            b[i, rng.integers(0, 4)] ^= np.uint64(1) << np.uint64(rng.integers(0, 64))
    near = np.bitwise_count(a ^ b).sum(1) <= radius
    assert (simhash.close_pairs(a, b, radius) == near).all()
    found = {i: set(f.tolist()) for i, f in simhash.close_rows(a[:70], b, radius)}
    assert found == {i: {i} for i in range(70) if near[i]}


def test_similar_groups_find_near_copies(spark):
    rng = random.Random(4)
    rows = []
    for d in range(0, 400, 2):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(300)]
        copy = words[:]
        for _ in range(2 if d % 4 == 0 else 0):
            copy[rng.randrange(300)] = "changed"
        rows += [(d, " ".join(words)), (d + 1, " ".join(copy if d % 4 == 0 else [f"v{rng.randint(0, 5000)}" for _ in range(300)]))]
    kept = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(d in kept for d, _ in rows if d % 4 != 1)
    assert sum(d in kept for d, _ in rows if d % 4 == 1) <= 2


def test_simhash_on_messy_tables(messy, empty):
    rows = simhash.near_duplicates(messy).collect()
    assert len(rows) == len(TEXTS)
    by = {(r.doc_id, r.fingerprint): r.component_id for r in rows}
    assert {c for (d, f), c in by.items() if f == "0" * 16} == {1}
    assert {c for (d, f), c in by.items() if d == 6} == {5}
    kept = simhash.drop_near_duplicates(messy)
    assert kept.columns == messy.columns
    assert kept.count() == len({(t or "").strip() for _, t in TEXTS})
    assert simhash.near_duplicates(empty).count() == simhash.drop_near_duplicates(empty).count() == 0


# Language model


def brute_lm(rows, order):
    """Scores by plain dictionaries: counts, the weights' table, expectation-maximisation and the mixture."""
    def tokens(t):
        return [*(t or "").encode().lower().split(), "end"]

    def grams(t):
        w = ["begin"] * (order - 1) + tokens(t)
        return [[tuple(w[i - k : i + 1]) for k in range(order)] for i in range(order - 1, len(w))]

    def counted(some):
        return Counter(g for t in some for gs in grams(t) for g in gs), sum(len(tokens(t)) for t in some), len(some)

    def estimates(gs, model):
        counts, n, texts = model
        out = []
        for k, g in enumerate(gs):
            context = n if k == 0 else texts if g[:-1] == ("begin",) * k else counts[g[:-1]]
            out.append((counts[g] / context if context else 0.0, 0 if not context else min(47, int(math.log2(context)) + 1)))
        return out

    def chances(parts, weights, uniform):
        found = [uniform]
        for k, (ratio, bucket) in enumerate(parts):
            found.append(weights[k][bucket] * ratio + (1 - weights[k][bucket]) * found[-1])
        return found

    at = {d: zlib.crc32(str(d).encode()) % 7 for d, _ in rows}
    whole, rest = counted([t for d, t in rows if at[d] != 2]), counted([t for d, t in rows if at[d] not in (2, 3)])
    kinds = [sum(len(g) == 1 for g in m[0]) for m in (whole, rest)]
    table = Counter()
    for t in (t for d, t in rows if at[d] == 3):
        for gs in grams(t):
            table[tuple((min(31, 1 + math.floor(-math.log2(r))) if r else 0, b) for r, b in estimates(gs, rest))] += 1
    weights = [[0.0] + [0.5] * 47 for _ in range(order)]
    for _ in range(40):
        taken, met = [[0.5] * 48 for _ in range(order)], [[1.0] * 48 for _ in range(order)]
        for cell, times in table.items():
            parts = [(2 ** -max(0, q - 0.5) if q else 0.0, b) for q, b in cell]
            p, mass = chances(parts, weights, 1 / (kinds[1] + 1)), float(times)
            for k in range(order - 1, -1, -1):
                ratio, b = parts[k]
                own = mass * weights[k][b] * ratio / p[k + 1]
                taken[k][b] += own
                met[k][b] += mass
                mass -= own
        reached = [[m > 1 for m in ms] for ms in met]
        weights = [[0.0] + [x / m for x, m in zip(xs[1:], ms[1:], strict=True)] for xs, ms in zip(taken, met, strict=True)]
    for k in range(order):
        known = [b for b in range(1, 48) if reached[k][b]]
        for b in range(1, 48):
            if known and b not in known:
                weights[k][b] = weights[k][max((x for x in known if x < b), default=known[0])]
    return {d: sum(math.log10(chances(estimates(gs, whole), weights, 1 / (kinds[0] + 1))[-1]) for gs in grams(t)) for d, t in rows}


@pytest.mark.parametrize(("order", "block_tokens", "range_keys"), [(3, 2_000_000, 1 << 21), (3, 700, 4000), (2, 5000, 30_000)])
def test_lm_matches_brute_force(spark, documents, order, block_tokens, range_keys):
    """All columns, with few large blocks and with many small ones, one range of keys and many."""
    df = spark.createDataFrame(documents, "doc_id long, text string").repartition(3)
    rows = lm_scoring.lm_scores(df, order=order, block_tokens=block_tokens, range_keys=range_keys).collect()
    tokens = {d: [*(t or "").encode().lower().split(), None] for d, t in documents}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    counts = Counter(w for d in tokens if not held[d] for w in tokens[d])
    n, v = sum(counts.values()), len(counts)
    scores = brute_lm(documents, order)
    assert len(rows) == len(documents)
    for r in rows:
        w = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(x in counts for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
        assert r.score == pytest.approx(scores[r.doc_id], rel=1e-9)


def test_lm_tells_repeated_documents(spark):
    """A text that occurs twice in the training texts is likelier than its like that occur once, through its own n-grams."""
    rng = random.Random(7)
    texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("aeiou") for _ in range(80)) for _ in range(300)]
    rows = [(d, t) for d, t in enumerate([*texts, *texts[:20]])]
    got = {r.doc_id: r.score for r in lm_scoring.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fold = lambda d: zlib.crc32(str(d).encode()) % 7
    twice = [got[d] for d in range(20) if fold(d) != 2 and fold(300 + d) != 2]
    once = [got[d] for d in range(20, 300) if fold(d) != 2]
    assert twice
    assert np.mean(np.array(twice) > max(once)) == 1


def test_lm_mixture_is_a_distribution():
    """Over the words of the training texts and one other, after any context."""
    rng = np.random.default_rng(0)
    weights = rng.random((3, lm_scoring.BUCKETS))
    weights[:, 0] = 0
    joint = rng.poisson(0.4, (5, 5, 9)).astype(float)
    mixture = lm_scoring.Mixture(int(joint.sum()), 9, 0, weights)
    for a in range(5):
        for b in range(5):
            pair = joint[:, b].sum(0)
            context = [joint.sum(), pair.sum(), joint[a, b].sum()]
            ratios = [np.append(x / c if c else 0 * x, 0) for x, c in zip((joint.sum((0, 1)), pair, joint[a, b]), context, strict=True)]
            p = list(mixture.probabilities([(r, lm_scoring.bucket_of(np.full(10, c))) for r, c in zip(ratios, context, strict=True)]))[-1]
            assert p.sum() == pytest.approx(1)


def test_packed_numbers_round_trip():
    rng = np.random.default_rng(0)
    for x in (np.zeros(0), np.zeros(5), np.array([2**64 - 1, 0, 255, 256], np.uint64), rng.integers(0, 2**40, 5000)):
        x = x.astype(np.uint64)
        assert (unpacked(packed(x), len(x)) == x).all()


def test_lm_on_messy_tables(messy, empty):
    rows = lm_scoring.lm_scores(messy).collect()
    assert len(rows) == len(TEXTS)
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert all(r.held_out for r in rows if r.doc_id is None)
    assert lm_scoring.lm_scores(empty).count() == 0
    held = lm_scoring.lm_scores(messy.where("doc_id is null")).collect()
    assert [(r.n_known, r.train_tokens, r.base_score, r.score) for r in held] == [(0, 0, 0.0, 0.0)]


# Toxicity


def test_toxicity_held_out(spark):
    rng = random.Random(0)
    rows, labels = [], []
    for d in range(900):
        words = [f"w{rng.randint(0, 300)}" for _ in range(60)]
        toxic = d % 6 == 0
        if toxic:
            words[rng.randrange(60)] = rng.choice(["moron", "Idiot,", "scummy"])
        rows.append((d, " ".join(words)))
        labels.append((d, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    held = [d for d, _ in rows if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(got[d].held_out == (d in held) for d, _ in rows)
    assert np.mean([got[d].predicted == labels[d][1] for d in held]) > 0.97


def test_counterfactual_penalty_shrinks_identity_terms():
    rows = [np.array([1, 2])] * 30 + [np.array([4])] * 30
    target = np.array([1.0] * 30 + [0.0] * 30)
    pairs = ([np.array([1, 2])] * 30, [np.array([1, 3])] * 30)
    free = fit(rows, target, np.ones(60), pairs, pair_penalty=0.0)[0]
    bound = fit(rows, target, np.ones(60), pairs, pair_penalty=50.0)[0]
    assert abs(bound[2] - bound[3]) < 0.25 * abs(free[2] - free[3])
    assert bound[1] > 0


def test_loss_and_slope_match_brute_force():
    rng = np.random.default_rng(0)
    draw = lambda n: [np.unique(rng.integers(0, 12, rng.integers(0, 6))) for _ in range(n)]
    rows, one, other = draw(40), draw(15), draw(15)
    target, weight = (rng.random(40) < 0.4).astype(float), rng.random(40)
    problem = Problem(rows, target, weight, (one, other), 0.7)
    w, bias = rng.normal(size=len(problem.used)), 0.3
    at = dict(zip(problem.used.tolist(), w, strict=True))
    z = lambda r: sum(at[f] for f in r.tolist())
    want = sum(-v * math.log(1 / (1 + math.exp(-(z(r) + bias))) if t else 1 - 1 / (1 + math.exp(-(z(r) + bias)))) for r, t, v in zip(rows, target, weight, strict=True)) / weight.sum()
    want += 0.7 * sum((z(a) - z(b)) ** 2 for a, b in zip(one, other, strict=True)) / 15
    assert problem.loss(w, bias) == pytest.approx(want)
    slope, slope_bias = problem.slope(w, bias)
    step = 1e-6 * np.eye(len(w))
    assert slope == pytest.approx([(problem.loss(w + e, bias) - problem.loss(w - e, bias)) / 2e-6 for e in step], abs=1e-6)
    assert slope_bias == pytest.approx((problem.loss(w, bias + 1e-6) - problem.loss(w, bias - 1e-6)) / 2e-6, abs=1e-6)


def test_counterfactuals_are_swapped_within_sentences():
    swaps = toxicity.Swaps((("blue", "green", "red"), ("alone",)))
    pairs = swaps.pairs("The Blue house. Nothing here! Red, they said\nalone")
    assert [one for one, _ in pairs] == [{"the", "blue", "house"}, {"red", "they", "said"}]
    for one, other in pairs:
        assert len(one - other) == len(other - one) == 1
        assert other - one <= {"blue", "green", "red"}
    assert swaps.pairs(None) == swaps.pairs("alone. x") == []


def test_neutral_mentions_of_groups_are_not_toxic(spark):
    """Toxic texts often name a group, with insults that mostly differ; neutral mentions are rare among the labelled texts.
    The penalty takes the weight off the group's name: fewer held-out neutral mentions are false positives."""
    rng = random.Random(5)
    rows, labels, neutral = [], [], set()
    for d in range(3000):
        words = [f"w{rng.randint(0, 400)}" for _ in range(30)]
        toxic, held = d % 5 == 0, zlib.crc32(str(d).encode()) % 5 == 0
        if toxic:
            words[rng.randrange(30)] = f"insult{rng.randint(0, 12)}"
            words[rng.randrange(30)] = "norns" if rng.random() < 0.9 else "w1"
        elif held and d % 3 == 0 or rng.random() < 0.02:
            words[rng.randrange(30)] = rng.choice(["norns", "elves", "dwarves"])
            neutral.add(d)
        rows.append((d, " ".join(words)))
        labels.append((d, int(toxic)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    wrong, found, score = {}, {}, {}
    for penalty in (0.0, 1.0):
        got = {
            r.doc_id: r for r in toxicity.toxicity(
                docs, known, pair_penalty=penalty, identities=(("norns", "elves", "dwarves"),)
            ).collect() if r.held_out
        }
        wrong[penalty] = sum(got[d].predicted for d in neutral if d in got)
        found[penalty] = np.mean([got[d].predicted for d, toxic in labels if toxic and d in got])
        score[penalty] = {d: r.score for d, r in got.items()}
    assert score[0.0] != score[1.0]
    assert wrong[1.0] < 0.5 * wrong[0.0]
    assert found[1.0] > 0.9


def test_toxicity_on_messy_tables(spark, messy, empty):
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, 0), (5, 1), (None, 1), (6, None)], "doc_id long, toxic int")
    rows = toxicity.toxicity(messy, labels).collect()
    assert len(rows) == len(TEXTS)
    assert all(0 <= r.score <= 1 for r in rows)
    assert {r.predicted for r in toxicity.toxicity(messy, labels.limit(0)).collect()} == {0}
    assert toxicity.toxicity(empty, labels).count() == 0
    weights, bias = toxicity.train(messy, labels.limit(0))
    assert toxicity.kept(messy, weights, bias).columns == messy.columns
    assert toxicity.kept(messy, weights, bias).count() == len(TEXTS)


# Quality


def test_quality_agrees_with_labels(spark, sf):
    from pathlib import Path

    sf = str(Path(sf).with_name("sf0.01"))
    known = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in quality.op10_quality(spark, sf).collect() if r.doc_id in known]
    assert np.mean([r.predicted == known[r.doc_id] for r in rows]) > 0.97


def test_label_model_learns_accuracies():
    """Of overlapping labellers on two kinds of faults: on good texts as on bad ones, from votes alone."""
    rng = np.random.default_rng(0)
    kind = rng.choice(3, 20_000, p=[0.1, 0.1, 0.8])
    chance = np.array([[0.9, 0.8, 0.85, 0.01, 0.02], [0.02, 0.01, 0.05, 0.9, 0.7], [0.01, 0.04, 0.002, 0.03, 0.005]])
    votes = np.where(rng.random((20_000, 5)) < chance[kind], -1, 1)
    votes[rng.random(votes.shape) < 0.1] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    posterior, found, prior = quality.label_model(patterns, counts.astype(float), rounds=300)
    assert found[-1] == pytest.approx(chance[2], abs=0.01)
    assert prior[-1] == pytest.approx(0.8, abs=0.02)
    # As good as the rule that knows the true chances.
    known = np.stack([np.prod(np.where(patterns == -1, c, np.where(patterns == 1, 1 - c, 1)), 1) for c in chance]) * np.array([[0.1], [0.1], [0.8]])
    right = [
        np.mean([(of[tuple(v)] >= 0.5) == (k == 2) for v, k in zip(votes.tolist(), kind, strict=True)]) for of in (
            dict(zip(map(tuple, patterns.tolist()), x, strict=True)) for x in (posterior, known[2] / known.sum(0))
        )
    ]
    assert right[0] > right[1] - 0.01


def test_label_model_matches_brute_force():
    """A round of expectation-maximisation after the other, vote by vote, in plain loops."""
    rng = np.random.default_rng(1)
    patterns = np.unique(rng.integers(-1, 2, (40, 3)), axis=0)
    counts = rng.integers(1, 50, len(patterns)).astype(float)
    chance, prior = rng.random((2, 3)).tolist(), [0.3, 0.7]
    got = quality.expectation_maximisation(
        (patterns == -1).astype(float), (patterns == 1).astype(float), counts, np.array(chance), np.array(prior), 7
    )
    for _ in range(7):
        member, logs = [], []
        for p in patterns:
            likely = [prior[k] * math.prod([chance[k][j] if v == -1 else 1 - chance[k][j] for j, v in enumerate(p) if v]) for k in range(2)]
            member.append([x / sum(likely) for x in likely])
            logs.append(math.log(sum(likely)))
        for k in range(2):
            prior[k] = (sum(c * m[k] for c, m in zip(counts, member, strict=True)) + 1) / (counts.sum() + 2)
            for j in range(3):
                bad_votes = sum(c * m[k] for c, m, p in zip(counts, member, patterns, strict=True) if p[j] == -1)
                all_votes = sum(c * m[k] for c, m, p in zip(counts, member, patterns, strict=True) if p[j] != 0)
                chance[k][j] = (bad_votes + 0.5) / (all_votes + 1)
    for one, two in zip(got, (member, chance, prior, logs), strict=True):
        assert one == pytest.approx(np.array(two))


def test_one_bad_vote_alone_may_be_overruled(spark):
    """A labeller that often votes bad alone is doubted; votes that come together are believed. The order of patterns doesn't matter."""
    patterns = np.array([[1, 1, 1, 1], [-1, 1, 1, 1], [-1, -1, -1, 1], [1, -1, -1, 1], [0, 0, 0, 0]])
    counts = np.array([800.0, 60, 70, 60, 10])
    posterior, _, _ = quality.label_model(patterns, counts)
    assert (posterior >= 0.5).tolist() == [True, True, False, False, True]
    turned = quality.label_model(patterns[::-1], counts[::-1])[0]
    assert turned[::-1] == pytest.approx(posterior)


def test_quality_scores_match_brute_force(spark, documents):
    """The scores of the query are those of the linear model over each text's features."""
    some = documents[:60]
    rows = {r.doc_id: r for r in quality.quality(spark.createDataFrame(some, "doc_id long, text string").repartition(3)).collect()}
    profiles = {d: quality.Profile(t) for d, t in some}
    seen = Counter(tuple(quality.votes(p)) for p in profiles.values())
    posterior, _, _ = quality.label_model(np.array(list(seen)), np.array(list(seen.values()), float))
    known = dict(zip(seen, posterior, strict=True))
    assert {d: r.posterior for d, r in rows.items()} == pytest.approx({d: known[tuple(quality.votes(p))] for d, p in profiles.items()})
    lists = {d: np.array(quality.features(p)) for d, p in profiles.items()}
    weights, bias = fit(list(lists.values()), np.array([rows[d].posterior for d in lists]), np.ones(len(lists)))
    for d, r in rows.items():
        z = bias + sum(weights[f] for f in lists[d])
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6)
        assert (r.predicted, r.kept) == (int(r.score >= 0.5), r.score >= 0.5)


def test_quality_on_messy_tables(messy, empty):
    rows = quality.quality(messy).collect()
    assert len(rows) == len(TEXTS)
    assert all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in rows)
    assert quality.quality(empty).count() == 0


def test_toxicity_scores_match_brute_force(spark):
    """The scores of the query are those of the linear model over each text's features, in plain loops."""
    bad, good = "you stupid idiot go away now", "the river runs past the old mill"
    rows = [(i, f"{bad if i % 4 == 0 else good} {i % 13} {'women' if i % 3 else 'men'} say so.", int(i % 4 == 0)) for i in range(240)] + [(999, None, None)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    weights, bias = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        z = bias + sum(weights[f] for f in set(toxicity.features(toxicity.words(text or "")).tolist()))
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)
        assert got[i].predicted == int(got[i].score >= 0.5)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_sentences_of_a_text_are_bounded():
    swaps = toxicity.Swaps(toxicity.IDENTITIES)
    text = ". ".join(f"women number{i} walk" for i in range(1000))
    found = swaps.pairs(text)
    assert len(found) == toxicity.PAIRS
    numbers = sorted(int(w[6:]) for s, _ in found for w in s if w.startswith("number"))
    assert numbers[0] < 50 and numbers[-1] > 950
