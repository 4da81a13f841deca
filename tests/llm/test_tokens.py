"""Tokenizers, packing and the language model against the library and brute force."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from tidemark.llm import bpe, chunks, ctw, packing

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ALPHABET = " \n\t\r\x0b\x0c\x1c\x85\xa0 　  'sdtrevml123\xb2٣\xe9\xe8\xf1\xdfabcXYZİΣ.,!#漢字\U0001f600́​﻿_-"
TEXTS = [None, "", " ", "\n\n x", "don't  'sup 's", "a" * 5000, "<|endoftext|>", "a<|endoftext|>b <|startoftext|> c", "ΣΣ İ", " lead", "trail "]
TEXTS += ["".join(random.Random(k).choices(ALPHABET, k=k % 70)) for k in range(900)] + ["thing " * 30_000]


@pytest.fixture(scope="module")
def library():
    return {p: Tokenizer.from_file(p) for p in (BYTES, WORDS)}


def test_byte_ids_equal_the_library(library):
    got = packing.encoder(BYTES)(pa.array(TEXTS, pa.string()))
    for text, ids in zip(TEXTS, got):
        assert ids == array("I", library[BYTES].encode(text or "", add_special_tokens=False).ids).tobytes(), ascii(text)


def test_word_ids_and_decoding_equal_the_library(library):
    mine = bpe.tokenizer(WORDS)
    ids = mine(pa.array(TEXTS, pa.string())).cast(pa.list_(pa.int32()))
    for text, got, back in zip(TEXTS, ids.to_pylist(), mine.decode(ids).to_pylist()):
        want = library[WORDS].encode(text or "", add_special_tokens=False).ids
        assert got == want, ascii(text)
        assert back == library[WORDS].decode(want, skip_special_tokens=False)


def test_both_ways_of_a_word_agree():
    """Words whose speculation holds and words that are merged get the ids of the exact merges."""
    mine = bpe.WordBpe(WORDS)
    rng = random.Random(2)
    words = list({"".join(rng.choices("abcdeinorst", k=rng.randint(1, 14))) for _ in range(3000)} | {"a" * k for k in range(1, 40)})
    failed = mine.encode_words(words)
    assert 0 < failed < len(words)
    assert [mine._words[w] for w in words] == mine.merged([w + "\x00" for w in words])


def test_memories_may_be_cleared(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE_RUNS", 5)
    monkeypatch.setattr(packing, "CACHE_CHUNKS", 5)
    words, byte = bpe.WordBpe(WORDS), packing.ByteBpe(BYTES)
    for size in (2, 9, 1, 30, 9):
        texts = [f"alpha{k} beta{k} gamma {'long' * 40}{k}" for k in range(size)]
        assert words(pa.array(texts)).to_pylist() == [library[WORDS].encode(t, add_special_tokens=False).ids for t in texts]
        assert byte(pa.array(texts)) == [array("I", library[BYTES].encode(t, add_special_tokens=False).ids).tobytes() for t in texts]


def test_round_trip_on_frames(spark, library):
    df = spark.createDataFrame([(k, t, "x", [1]) for k, t in enumerate(TEXTS[:40])] + [(None, "a b", None, None)], "doc_id long, text string, row string, ids array<int>")
    coded = bpe.encode(df, WORDS)
    assert coded.columns == ["doc_id", "text", "row", "ids"]
    out = bpe.decode(coded, WORDS)
    rows = out.collect()
    assert len(rows) == 41
    for r in rows:
        assert r.ids == library[WORDS].encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded == library[WORDS].decode(r.ids, skip_special_tokens=False)
    assert bpe.decode(bpe.encode(df.limit(0), WORDS), WORDS).count() == 0
    assert bpe.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>"), WORDS).collect()[0].decoded is None


@given(st.lists(st.text(st.sampled_from(" \n\tab\x85　\xe9'1."), max_size=12), max_size=6))
@settings(max_examples=80, deadline=None)
def test_runs_cover_texts(texts):
    held = chunks.Texts(pa.array(texts, pa.string()))
    at, before = chunks.tiles(held)
    assert at[0] == 0 and at[-1] == len(held.bytes) and (np.diff(at) > 0).all()
    assert [int(x) for x in at[before]] == [int(x) for x in held.at]
    data, offsets, n = chunks.words(held)
    for k, t in enumerate(texts):
        assert [data[offsets[j]:offsets[j + 1]].tobytes() for j in range(n[k], n[k + 1])] == t.encode().split()


def check_plan(counts: dict[int, int], capacity: int) -> int:
    planned = packing.plan(counts, capacity)
    used: Counter = Counter()
    for lengths, n in planned:
        assert n > 0 and 0 < sum(lengths) <= capacity
        for x in lengths:
            used[x] += n
    assert used == Counter({k: v for k, v in counts.items() if v})
    return sum(n for _, n in planned)


@given(st.dictionaries(st.integers(1, 30), st.integers(0, 9), max_size=12))
@settings(max_examples=200, deadline=None)
def test_plans_use_every_piece_once(counts):
    n = check_plan(counts, 30)
    assert n >= -(-sum(k * v for k, v in counts.items()) // 30)


def test_exact_complements_leave_no_gap():
    assert check_plan({20: 5, 10: 5}, 30) == 5
    assert check_plan({15: 4, 9: 4, 6: 4}, 30) == 4
    assert check_plan({12: 3, 10: 3, 5: 3, 3: 3}, 30) == 3
    assert check_plan({7: 1}, 30) == 1 and check_plan({}, 30) == 0
    rng = np.random.default_rng(0)
    counts = Counter(rng.integers(1, 2048, 20_000).tolist())
    lower = -(-sum(k * v for k, v in counts.items()) // 2048)
    assert check_plan(counts, 2048) <= lower * 1.005


def test_packing_of_frames(spark, library):
    texts = [None, "", "x", "x", "word " * 5000, "some words here " * 40] + [f"t{k} " * (k % 90) for k in range(120)]
    df = spark.createDataFrame([(k if k % 7 else None, t, 1, 2) for k, t in enumerate(texts)] + [(3, "x", 1, 2)], "doc_id long, text string, sequence_id int, offset int").repartition(4)
    rows = packing.pack(df, BYTES, 64).collect()
    ids = {}
    for k, t in enumerate([*texts, "x"]):
        ids.setdefault((k if k % 7 else None) if k < len(texts) else 3, []).append(library[BYTES].encode(t or "", add_special_tokens=False).ids + [0])
    assert sum(r.length for r in rows) == sum(len(x) for v in ids.values() for x in v)
    for r in rows:
        if r.doc_id is not None and r.doc_id != 3:
            own = ids[r.doc_id][0][r.start: r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(array("I", own).tobytes()) and len(own) == r.length
            assert r.length == 64 or r.piece == 0
    held: dict[int, list] = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(df.limit(0), BYTES).count() == 0
    whole = packing.pieces(df, BYTES, 64, with_ids=True).collect()
    assert all(len(r.ids) == r.length for r in whole)


def brute_ctw(texts: list[str], train: list[bool], depth: int) -> list[float]:
    """Context trees as dictionaries, one choice at a time."""
    nodes: dict[tuple, list[int]] = {}
    coded = []
    for t in texts:
        b = bytes(depth) + t.encode().lower() + b"\xff"
        steps = []
        for p in range(depth, len(b)):
            for j in range(8):
                node, bit = (1 << j) | (b[p] >> (8 - j)), b[p] >> (7 - j) & 1
                steps.append([(b[p - d: p], node, bit) for d in range(depth + 1)])
        coded.append(steps)
    for steps, on in zip(coded, train):
        for path in steps if on else []:
            for context, node, bit in path:
                nodes.setdefault((context, node), [0, 0])[bit] += 1
    estimate = {k: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) for k, (a, b) in nodes.items()}
    weighted, below = {}, Counter()
    for k in sorted(nodes, key=lambda k: -len(k[0])):
        context, node = k
        weighted[k] = estimate[k] if len(context) == depth else math.log(0.5) + np.logaddexp(estimate[k], below[k])
        if context:
            below[context[1:], node] += weighted[k]
    out = []
    for steps in coded:
        total = 0.0
        for path in steps:
            p = None
            for context, node, bit in reversed(path):
                k = (context, node)
                n = nodes.get(k, [0, 0])
                own = (n[bit] + 0.5) / (sum(n) + 1)
                seen_below = p is not None and p[1]
                w = math.exp(math.log(0.5) + estimate[k] - weighted[k]) if k in nodes and len(context) < depth else 1.0
                p = (w * own + (1 - w) * p[0] if seen_below else own, sum(n) > 0)
            total += math.log10(p[0])
        out.append(total)
    return out


def test_context_trees_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ctw, "SLICE", 60)
    rng = random.Random(5)
    texts = ["".join(rng.choices("abC \xe9", k=rng.randint(0, 25))) for _ in range(12)] + ["", "abab" * 6, "zz"]
    train = [k % 3 > 0 for k in range(len(texts))]
    rows = spark.createDataFrame([(k, t, on) for k, (t, on) in enumerate(zip(texts, train))], "uid long, text string, train boolean").repartition(3)
    got = {r.uid: r.score for r in ctw.score_texts(rows, 3).collect()}
    np.testing.assert_allclose([got[k] for k in range(len(texts))], brute_ctw(texts, train, 3), rtol=1e-9)


def test_probabilities_of_next_bytes_add_up():
    """After any context, the probabilities of all bytes are a distribution."""
    seen = chunks.Texts(pa.array(["banana band", "an anagram", "bandana"]))
    found, _ = ctw.grams(seen, 3)
    context = int(found[9]) & ~255
    keys, n = np.unique(np.concatenate([found, context + np.arange(256, dtype=np.uint64)]), return_counts=True)
    own = np.isin(keys, context + np.arange(256, dtype=np.uint64))
    levels, bits, _ = ctw.subtrees(keys, n - own, 0, 3)
    p, known = levels[-1].predict(bits)
    for level in levels[-2::-1]:
        q, now = level.predict(bits)
        p, known = ctw._mixed(q, np.exp(ctw._HALF + level.estimate - level.weighted)[level.at], p, known), now
    assert abs(p.prod(1)[own].sum() - 1) < 1e-9


def test_base_line_and_cases(spark):
    texts = [None, "", "The the THE cat", "cat sat", "unseen words", "\xc9 \xe9", "the cat sat on the mat " * 400]
    docs = spark.createDataFrame([(k, t, 0.5, 1) for k, t in enumerate(texts)] + [(None, "cat", None, None), (3, "cat sat", 0.1, 2)], "doc_id long, text string, score double, uid int").repartition(2)
    train = ~F.col("doc_id").isin(4)
    got = ctw.score(docs, F.coalesce(train, F.lit(True))).collect()
    every = [(t, k != 4) for k, t in enumerate(texts)] + [("cat", True), ("cat sat", True)]
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    c = Counter(w for t, on in every if on for w in tokens(t))
    total, kinds = sum(c.values()), len(c)
    want = sorted(round(sum(math.log10((c[w] + 1) / (total + kinds + 1)) for w in tokens(t)), 6) for t, _ in every)
    assert sorted(round(r.base_score, 6) for r in got) == want
    assert {r.train_tokens for r in got} == {total} and all(r.score < 0 for r in got)
    assert sorted(r.n_known for r in got) == sorted(sum(c[w] > 0 for w in tokens(t)) for t, _ in every)
    assert ctw.score(docs.limit(0), F.lit(True)).count() == 0
    none = ctw.score(docs, F.lit(False)).collect()
    assert all(abs(r.score + 8 * (len((r2 or "").encode()) + 1) * math.log10(2)) < 1e-6 for r, r2 in zip(sorted(none, key=lambda r: -r.score), sorted([t for t, _ in every], key=lambda t: len((t or "").encode()))))


def test_digests_follow_from_ids(spark, tmp_path, library):
    from tidemark.llm.queries import QUERIES

    spark.createDataFrame([(1, "It's a text"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in QUERIES["op4_bpe_round_trip"](spark, str(tmp_path)).collect()}
    for k, t in ((1, "It's a text"), (2, "")):
        ids = library[WORDS].encode(t, add_special_tokens=False).ids
        assert got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(library[WORDS].decode(ids, skip_special_tokens=False).encode()).hexdigest()
