"""Fill-in-the-middle, tree packing and centroid clustering against brute force and round trips."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from array import array
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from tidemark.llm import clusters, fim, treepack
from tidemark.llm.queries import ORACLES, QUERIES
from tests.check_oracles import compare

WORDS = public_tokenizers.path("word_bpe_49k.json")
UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")


def brute_fim(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n, h = len(units), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k: 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [None, "", "a", "<P>", "x<S>y", "< P> <<M", "<", "<P", "M>", "tie", "0123", "\n\t ", "漢字 \U0001f600 é́z", "A" * 70_000, "- " * 50_000, "!" * 140_000, "漢" * 60_000 + "abc", "word 12, " * 30_000]
TEXTS += ["".join(random.Random(k).choices("ab Z.9é漢\U0001f600<PSM>", k=k % 60)) for k in range(300)]


def test_infill_equals_brute_force_and_comes_back(spark):
    rows = [(k if k % 50 else None, t, "n", 7) for k, t in enumerate(TEXTS)] + [(5, TEXTS[5], None, None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, row int").repartition(3)
    made = fim.transform(df)
    assert made.columns == ["doc_id", "text", "row", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute_fim(r.doc_id, r.text)
        assert r.back == (r.text or "")
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.transform(df.limit(0)).count() == 0


def test_boundary_sets_select_in_every_container():
    rng = np.random.default_rng(3)
    data = np.frombuffer(("ab" * 40_000 + "." * 70_000 + "".join(rng.choice(list("ab. "), 200_000)) + "word " * 30_000 + "ü").encode(), np.uint8)
    held = fim.Boundaries(data)
    assert {type(c) for c in held.containers} == {fim.Array, fim.Runs, fim.Bitmap}
    ends = np.cumsum([len(u.encode()) for u in UNIT.findall(data.tobytes().decode())])
    assert len(held) == len(ends) and held.cut(0) == 0
    some = np.unique(np.concatenate([[1, 2, len(ends) - 1, len(ends)], rng.integers(1, len(ends), 3000), held.before[1:], held.before[1:-1] + 1]))
    some = some[some > 0]
    assert [held.cut(int(k)) for k in some] == ends[some - 1].tolist()


def test_infill_sql(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "a b c"), (3, "x y")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert compare(QUERIES["op11_fill_in_middle"](spark, str(tmp_path)).toPandas(), con.execute(ORACLES["op11_fill_in_middle"]).fetchdf()) == ""


# ---- packing


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


ODD = " \n\t\r\x0b\x0c\x1c\x85\xa0 　  'sdtrevml123\xb2٣\xe9\xe8\xf1\xdfabcXYZİΣ.,!#漢字\U0001f600́​﻿_-"
SOME = [None, "", " ", "don't  'sup 's", "<|endoftext|>", "a<|endoftext|>b <|startoftext|> c", "<|startoftext|>", "ΣΣ İ", "thing " * 30_000, "a" * 5000]
SOME += ["Don't. It'S (A.'s b'.S) X.y,z 'Ll.'d a1.b2 É.È,e", "<|EndOfText|> A", "Zé. é.z a\u0301. A\u0301b .\u0301x"]
SOME += ["".join(random.Random(k).choices(ODD, k=k % 70)) for k in range(500)]


def test_runs_are_encoded_as_by_the_library(library, monkeypatch):
    mine = treepack.RunEncoder(WORDS)
    for cache in (200_000, 7):
        monkeypatch.setattr(treepack, "CACHE_RUNS", cache)
        plain = [t for t in SOME if "<|" not in (t or "").lower()]
        for texts in (SOME, plain, plain, SOME[:9], SOME[100:140], ["", None], []):
            flat, at = mine(pa.array(texts, pa.string()))
            assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def naive_first_fit(sizes, capacity):
    free, bins = [], []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        for b, left in enumerate(free):
            if left >= sizes[k]:
                break
        else:
            b = len(free)
            free.append(capacity)
            bins.append([])
        free[b] -= sizes[k]
        bins[b].append(k)
    return bins


@given(st.lists(st.integers(1, 63), max_size=60))
@settings(max_examples=300, deadline=None)
def test_the_tree_is_first_fit_and_fills_leave_no_padding(sizes):
    assert treepack.first_fit(sizes, 64) == naive_first_fit(sizes, 64)
    used = defaultdict(list)
    for sequence in treepack.filled(sizes, 64):
        total = sum(n for _, _, n in sequence)
        assert 0 < total <= 64 and total & (total - 1) == 0
        for k, start, n in sequence:
            assert n > 0
            used[k].append((start, n))
    assert set(used) == set(range(len(sizes)))
    for k, parts in used.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == sizes[k]


def test_packed_pieces_are_whole(spark, library):
    rows = [(k, t, "x") for k, t in enumerate(SOME)] + [(None, "no id", "y"), (9_000, "w " * 2047, "z"), (9_001, "w " * 2048, "z")] + [(8_000 + k, "copy of a text " * 40, "h") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(5)
    got = treepack.pack(df, WORDS, group=100).collect()
    ids = {k: library.encode(t or "", add_special_tokens=False).ids + [1] for k, t, _ in rows}
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        own = ids[r.doc_id][r.start: r.start + r.length]
        assert len(own) == r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(array("I", own).tobytes())
        parts[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for held, size in [(parts[k], len(ids[k])) for k in ids] + [(s, None) for s in sequences.values()]:
        at = 0
        for start, n in sorted(held):
            assert start == at
            at += n
        assert at == size if size else at <= 2048 and at & (at - 1) == 0
    assert len({s >> 32 for s in sequences}) > 3
    assert len(got) < 2.2 * len(ids) + sum(len(v) // 2048 for v in ids.values())  # few cuts
    assert treepack.pack(df.limit(0), WORDS).count() == 0


# ---- clustering


def brute_clusters(rows, k=8, rounds=10, width=64):
    kept = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    draw = lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=draw)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[near(v)[1]].append(v)
        centroids = [[sum(c) // len(members[j]) for c in zip(*members[j])] if members[j] else old for j, old in enumerate(centroids)]
    found = [(i, *near(v)) for i, v in kept]
    inertia = defaultdict(int)
    for _, d, j in found:
        inertia[j] += d
    digest = lambda j: hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()
    return [(i, j, d, inertia[j], sum(inertia.values()), digest(j)) for i, d, j in found]


def vectors(n, seed=1, spread=0.2):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(5, 64))
    return [(i, (middles[i % 5] + spread * rng.normal(size=64)).tolist()) for i in range(n)]


def same(frame, rows):
    key = lambda r: tuple(-1 if x is None else x for x in r)
    return sorted(map(key, map(tuple, frame.collect()))) == sorted(map(key, rows))


def test_clusters_equal_brute_force(spark, tmp_path):
    odd = [(900, None), (901, []), (902, [1.0] * 63), (903, [None] + [1.0] * 63), (904, [float("nan")] + [0.0] * 63), (905, [float("inf")] + [0.0] * 63), (None, [0.5] * 64), (907, [-0.0] * 64), (908, [1e-5] * 64), (909, [-1e-5] * 64)]
    rows = vectors(250) + odd + vectors(20) + [(950 + k, [float(k % 2)] * 64) for k in range(40)]  # repeated rows and ties
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster string").repartition(6)
    clustered, centroids = clusters.cluster(df)
    measured = clustered.agg(F.sum("measured")).first()[0]
    assert len(centroids) == 8 and measured < 0.6 * 8 * clustered.count()  # the bound saves distances
    assert same(clusters.summary(clustered, centroids), brute_clusters(rows))
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert compare(QUERIES["op13_centroid_clustering"](spark, str(tmp_path)).toPandas(), con.execute(ORACLES["op13_centroid_clustering"]).fetchdf()) == ""


def test_few_equal_and_no_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    for rows in ([], vectors(3), [(k % 2, [0.25] * 64) for k in range(30)]):
        clustered, centroids = clusters.cluster(spark.createDataFrame(rows, kind))
        rounded = [(i, np.array(v, np.float32).astype(float).tolist()) for i, v in rows]
        assert same(clusters.summary(clustered, centroids), brute_clusters(rounded))
        assert len(centroids) == min(8, len(rows))


def test_bounds_never_exceed_distances():
    rng = np.random.default_rng(0)
    x = rng.integers(-2000, 2000, (500, 64))
    x[:50] *= 60_000
    centroids = x[rng.integers(0, 500, 8)] + rng.integers(-2, 3, (8, 64))
    rotation = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    found, distance, measured = clusters.assigned(x, *clusters.rotated(x, rotation), clusters.Model(rotation, centroids))
    every = ((x[:, None] - centroids[None]) ** 2).sum(2)
    assert (found == every.argmin(1)).all() and (distance == every.min(1)).all() and measured < every.size
