"""Near duplicates of texts and vectors against brute force, and their edge cases."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tidemark.llm import common, neardup, vectors


def grouped(n: int, links) -> list[int]:
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def near_texts(seed: int, groups: int, copies: int, words: int, edits: int) -> list[str]:
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        base = [f"w{x}" for x in rng.integers(0, 5000, words)]
        for _ in range(copies):
            own = list(base)
            for at in rng.integers(0, words, rng.integers(0, edits + 1)):
                own[at] = f"e{rng.integers(0, 10**6)}"
            out.append(" ".join(own))
    return out


def expected_groups(texts: list[str | None]) -> list[int]:
    """Groups by comparing all pairs, with multisets of shingles spelled out."""
    column = pa.array(texts, pa.string())
    found, first, at, _, shingles = neardup.elements(column)
    df = Counter()
    for a, b in zip(at[:-1], at[1:]):
        df.update(shingles[a:b][first[a:b]].tolist())
    held = neardup._weighted(found, at, neardup.levels(np.array([df[x] for x in shingles.tolist()], np.int64), sum(t is not None for t in texts)))
    links = []
    for i in range(len(texts)):
        for j in range(i):
            if texts[i] is None or texts[j] is None:
                continue
            if not texts[i].split() and not texts[j].split():
                links.append((i, j))
                continue
            (x, u), (y, v) = held[i], held[j]
            a, b = dict(zip(x.tolist(), u.tolist())), dict(zip(y.tolist(), v.tolist()))
            both = a.keys() & b.keys()
            if not a or not b:
                continue
            weighted = sum(a[k] for k in both) / (sum(a.values()) + sum(b.values()) - sum(a[k] for k in both))
            if weighted >= 0.8 - 1e-12 or len(both) >= 0.8 * len(a.keys() | b.keys()) - 1e-12:
                links.append((i, j))
    return grouped(len(texts), links)


def found_groups(spark, texts: list[str | None]) -> pd.DataFrame:
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return neardup.groups(df).toPandas().sort_values("id")


@pytest.mark.parametrize("small", [8, 2])
def test_groups_equal_brute_force(spark, monkeypatch, small):
    """The same groups whether buckets give pairs or blocks."""
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "BLOCK", 7)
    texts = near_texts(1, 12, 8, 80, 4) + near_texts(2, 1, 60, 100, 9) + [None, None, "", "  ", "a b", "A  b", "a b c d e", "a b c d f"]
    got = found_groups(spark, texts)
    assert got.component_id.tolist() == expected_groups(texts)
    assert (got.kept == (got.id == got.component_id)).all()


@pytest.mark.parametrize("words", [400, 10_000])
def test_weights_do_not_depend_on_the_size_of_other_texts(spark, words):
    """Two texts that differ in passages of most texts only: weighted alike, plainly not, however many shingles others hold."""
    rng = np.random.default_rng(9)
    draw = lambda n: " ".join(np.char.add("w", rng.integers(0, 10**6, n).astype(str)))
    base, one, two = draw(504), draw(109), draw(109)
    texts = [f"{base} {one}", f"{base} {two}", *(f"{one} {draw(words)} {two}" for _ in range(398))]
    got = neardup.groups(spark.createDataFrame(pd.DataFrame({"doc_id": range(400), "text": texts}))).toPandas().sort_values("id")
    assert got.component_id.tolist() == [0, 0, *range(2, 400)]


def test_weight_steps_are_exact(spark, monkeypatch):
    """Steps told to blocks against counting by hand, with many small blocks."""
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 500)
    texts = near_texts(5, 6, 12, 60, 6) + [None, "", "a b", "a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "uid long, text string").repartition(3).cache()
    starts = neardup._block_starts(df)
    assert len(starts) > 20
    _, first, at, _, base = neardup.elements(pa.array(texts))
    doc = np.repeat(np.arange(len(texts)), np.diff(at))[first]
    shingles, n = np.unique(base[first], return_counts=True)
    level = dict(zip(shingles.tolist(), neardup.levels(n, 73).tolist()))
    common = neardup.levels(np.ones(1), 73)[0]
    want = {(int(np.searchsorted(starts, d, side="right")) - 1, s, level[s]) for d, s in zip(doc.tolist(), base[first].tolist()) if level[s] != common}
    got = [(r.block, s, x) for r in neardup.frequent_shingles(df, spark.sparkContext.broadcast(starts), 1, 73).collect() for s, x in zip(np.frombuffer(r.shingles, np.uint64).tolist(), r.levels)]
    assert set(got) == want and want


def test_element_hashes_are_multisets():
    one, _, at, digests, _ = neardup.elements(pa.array(["a b c d e a b c d e a b c d e", "A B C D E", "", None]))
    assert len(set(one[at[0]:at[1]].tolist())) == 11 and one[at[1]] in one[at[0]:at[1]]
    assert at.tolist() == [0, 11, 12, 12, 12] and digests[2] == digests[3]


def test_samples_agree_as_weighted_jaccard():
    rng = np.random.default_rng(4)
    sampler = neardup.Sampler()
    x = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    level = rng.integers(0, neardup.LEVELS + 1, 900).astype(np.uint8)
    a, b = np.arange(0, 800), np.arange(100, 900)
    w = 1 + level / neardup.LEVELS
    want = w[100:800].sum() / w.sum()
    hits = []
    for k in range(len(sampler.factors)):
        one = neardup.Sampler()
        one.factors = sampler.factors[k: k + 1]
        monkey = [one.bands(x[i], level[i], np.array([0, len(i)])) for i in (a, b)]
        hits.append(monkey[0][0, 0] == monkey[1][0, 0])
    assert abs(np.mean(hits) - want) < 4 * np.sqrt(want * (1 - want) / len(hits))


def test_dedup_cases(spark):
    schema = "doc_id long, text string, lang string, uid long, row string, kept boolean, root int"
    text = " ".join(f"t{i}" for i in range(50))
    long = " ".join(f"u{i}" for i in range(40_000))
    rows = [(5, text, "en", 1, "r", True, 1), (5, text, "en", 1, "r", True, 1), (None, text, None, None, None, None, None), (2, long, "en", 2, "r", False, 2), (9, long + " end", "en", 2, "r", False, 2),
            (7, None, "en", 3, "r", None, 3), (8, None, "en", 3, "r", None, 3), (4, "", None, 4, None, None, 4)]
    df = spark.createDataFrame(rows, schema)
    kept = neardup.deduplicated(df)
    assert kept.schema == df.schema
    assert sorted((r.doc_id for r in kept.collect())) == [2, 4, 5, 7, 8]
    assert neardup.deduplicated(df.limit(0)).count() == 0
    assert neardup.groups(df.limit(0)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(0)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(k, k + 1) for k in range(500, 560)] + [(3, 3)]
    got = {r.node: r.root for r in common.components(spark, spark.createDataFrame(links, "a long, b long")).collect()}
    want = grouped(600, links)
    assert got == {k: want[k] for a, b in links if a != b for k in (a, b)}
    assert common.components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def clustered(seed: int, n: int, d: int, centres: int, noise: float) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, d))
    return (c[rng.integers(0, centres, n)] + noise * rng.normal(size=(n, d))).astype(np.float32)


def brute_vectors(rows: list[tuple]) -> tuple[list[int], list[int]]:
    unit = []
    for _, v, label in rows:
        x = None if v is None or label is None or any(y is None for y in v) else np.array(v, np.float32).astype(float)
        unit.append(x / np.sqrt(x @ x) if x is not None and len(x) and np.isfinite(x).all() and (x != 0).any() else None)
    n, links = [0] * len(rows), []
    for i in range(len(rows)):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93:
                n[i] += 1
                n[j] += 1
                links.append((i, j))
    return n, grouped(len(rows), links)


@pytest.mark.parametrize("per_pivot,block", [(10, 2048), (10, 16), (10**6, 16)])
def test_vectors_equal_brute_force(spark, monkeypatch, per_pivot, block):
    monkeypatch.setattr(vectors, "PER_PIVOT", per_pivot)
    monkeypatch.setattr(vectors, "BLOCK", block)
    v = np.concatenate([clustered(1, 200, 6, 9, 0.35), clustered(2, 60, 6, 1, 0.02), np.repeat(clustered(3, 1, 6, 1, 0), 40, 0)])
    rows = [(i, x.tolist(), i % 2) for i, x in enumerate(v)]
    k = len(rows)
    rows += [(k, None, 0), (k + 1, [0.0] * 6, 0), (k + 2, [float("nan")] * 6, 1), (k + 3, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (k + 4, v[0].tolist(), None), (k + 5, [], 0), (k + 6, v[0].tolist()[:3], 0), (k + 7, [float("inf")] * 6, 0),
             (k + 8, (v[0] * 1e20).tolist(), 0)]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)).toPandas().sort_values("vec_id")
    links, roots = brute_vectors(rows)
    assert got.n_links.tolist() == links
    assert got.component_id.tolist() == roots
    assert (got.kept == (got.vec_id == got.component_id)).all()


def test_vector_cases(spark):
    schema = "vec_id long, embedding array<double>, label string, uid int, v string, n int"
    rows = [(3, [1.0, 0.0], "a", 1, "x", 1), (3, [1.0, 0.0], "a", 1, "x", 1), (None, [2.0, 0.01], "a", None, None, None), (1, [1.0, 0.0], None, 1, "x", 1)]
    got = vectors.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in got) == [(0, 2, 3), (1, 0, 1), (3, 2, 3), (3, 2, 3)]
    assert vectors.near_duplicates(spark.createDataFrame([], schema)).count() == 0
