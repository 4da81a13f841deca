"""Quality rules and classifier: edge cases, brute force and held-out accuracy."""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import classifier, quality
from tidemark.llm.queries import ORACLES, QUERIES
from tests.check_oracles import compare, duck

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, kept string, row int, score string"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
CASES = [
    (1, None, "en", "a", "x", 1, "s"), (2, "", "en", "a", "x", 2, "s"), (3, "one two three", None, None, None, 3, None), (None, LONG, "en", None, "x", None, "s"),
    (5, "same words here again " * 8, "de", "b", "x", 5, "s"), (5, "same words here again " * 8, "de", "b", "x", 5, "s"), (7, "\n \t\n", "en", "a", "x", 7, "s"),
    (8, " ".join(f"w{i}" for i in range(40)), "en", "a", "x", 8, "s"),
]


@pytest.fixture(scope="module")
def cases(spark):
    return spark.createDataFrame(CASES, SCHEMA)


def base(text: str | None) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {p for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_base_counts(spark):
    rng = np.random.default_rng(3)
    texts = [None, "", "\n\n", " ".join("ab"), "a b c d e f g h " * 3, "a " * 9, LONG, "x\ny\nx\nx\n\n", "|<>&é% 日本 \x1f*"]
    texts += [" ".join(rng.choice(list("abc"), rng.integers(1, 60))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    for r in quality.judge(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(texts[r.doc_id]), r.doc_id
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_quality_cases(cases):
    got = quality.judge(cases).collect()
    assert len(got) == len(CASES) and set(quality.BASE) <= set(got[0].asDict())
    assert [r.kept for r in got if r.doc_id in (1, 2, 3, 5, 7)] == [False] * 6
    kept = quality.filtered(cases)
    assert kept.schema == cases.schema
    assert {r.doc_id for r in kept.collect()} == {None, 8}
    assert quality.judge(cases.limit(0)).count() == 0 and quality.filtered(cases.limit(0)).count() == 0


def test_limits_adapt_to_the_group(spark):
    """Documents full of symbols are normal in one source and rejected in another."""
    plain = [(i, " ".join(f"w{j}" for j in range(40)), "en", "plain") for i in range(300)]
    code = [(1000 + i, " ".join(f"w{j}|" for j in range(40)), "en", "code") for i in range(300)]
    odd = [(5000, " ".join(f"w{j}|" for j in range(40)), "en", "plain"), (5001, " ".join(f"w{j}|" for j in range(40)), "en", "tiny")]
    df = spark.createDataFrame(plain + code + odd, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    assert got[0].kept and got[1000].kept and not got[5000].kept
    m = quality.measured(df, "text", F.col("lang").alias("lang_key"), F.col("source").alias("source_key"))
    limits = {r.source_key: r for r in quality.group_limits(quality.sketches(m, ["lang_key", "source_key"])).collect()}
    assert limits["plain"].symbols_hi < 2000 < 2666 < limits["code"].symbols_hi
    # One document alone takes the limits of its language, but for its own small weight.
    language = quality.limits(quality.sketches(m, ["lang_key"]), ["lang_key"]).first()
    assert abs(limits["tiny"].symbols_hi - language.symbols_hi) <= language.symbols_hi / quality.SHRINK


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_limits_of_the_table_differ(spark):
    """No measure has the same limits everywhere, and each can reject documents that pass the base rules."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    m = quality.measured(docs, "text", F.col("lang").alias("lang_key"), F.col("source").alias("source_key"))
    limits = quality.group_limits(quality.sketches(m, ["lang_key", "source_key"])).toPandas()
    assert all(limits[f"{c}_hi"].nunique() > 5 for c in quality.MEASURES) and limits.word_length_lo.nunique() > 5
    assert (limits.repeats_hi < 3000).any() and (limits.dup_lines_hi < 10_000).any() and limits.symbols_hi.median() < 300


def test_sketches_merge(spark):
    """Limits of a language from its sources' sketches equal those from all its rows."""
    df = spark.createDataFrame([(i, " ".join(f"w{j}" * (1 + i % 7) for j in range(30)), "en", f"s{i % 3}") for i in range(90)], "doc_id long, text string, lang string, source string")
    m = quality.measured(df, "text", F.col("lang").alias("lang_key"), F.col("source").alias("source_key"))
    fine = quality.limits(quality.sketches(m, ["lang_key", "source_key"]), ["lang_key"]).collect()
    assert fine == quality.limits(quality.sketches(m, ["lang_key"]), ["lang_key"]).collect()


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    assert compare(QUERIES[name](spark, SF).toPandas(), duck(SF).execute(ORACLES[name]).fetchdf()) == ""


def test_discriminant_is_the_log_density_difference():
    rng = np.random.default_rng(1)
    x = [rng.normal(k, 1 + k, (400, 3)) for k in (0, 1)]
    model = classifier.discriminant({k: (400.0, x[k].sum(0), x[k].T @ x[k]) for k in (0, 1)})
    cov = [np.cov(v.T) for v in x]
    pooled = (cov[0] + cov[1]) / 2
    want = []
    for k in (0, 1):
        c = (1 - classifier.TOWARDS_MEAN) * cov[k] + classifier.TOWARDS_MEAN * pooled
        c = (1 - classifier.TOWARDS_DIAGONAL) * c + classifier.TOWARDS_DIAGONAL * np.diag(np.diag(c)) + classifier.RIDGE * np.eye(3)
        d = x[0] - x[k].mean(0)
        want.append(-0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) + np.linalg.slogdet(c)[1]))
    np.testing.assert_allclose(model.evidence(x[0]), want[1] - want[0], rtol=1e-8, atol=1e-8)


def test_classifier_cases(spark, cases):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, None, 0), (99_999, 1, 1), (4, 7, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(i, ("good words here. " if i % 2 else "### bad $$$ ") * (3 + i)) for i in range(40)], "doc_id long, text string")
    model = classifier.fit(docs, labels)
    got = classifier.score(cases, model).collect()
    assert len(got) == len(CASES) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert classifier.accepted(cases, model).schema == cases.schema
    assert classifier.score(cases.limit(0), model).count() == 0
    seen = {r.doc_id: r.score for r in classifier.score(docs, model).collect()}
    assert min(v for k, v in seen.items() if k % 2) > max(v for k, v in seen.items() if not k % 2)
    assert {r.score for r in classifier.score(cases, classifier.fit(docs, labels.limit(0))).collect()} == {0.5}


def test_statistics_of_blocks_and_texts_agree():
    texts = ["a b", None, "", "Ü ### x\n" * 50, LONG]
    one = np.concatenate([classifier.statistics(pa.array([t], pa.string())) for t in texts])
    np.testing.assert_allclose(classifier.statistics(pa.array(texts)), one)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="test tables are not here")
def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op6_quality_classifier"](spark, sf).toPandas()
    assert ((got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)) == got.held_out).all()
    m = got.merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    m = m[m.held_out]
    assert (m.predicted == m.quality).mean() > 0.95
