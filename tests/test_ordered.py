from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions.ordered import approximate_quantiles, cumulative, exact_quantiles, take_first
from tidemark.functions.ranks import dense_index

SHAPES = {
    "long tail": lambda r: np.exp(r.normal(0, 6, 400)),
    "both signs": lambda r: np.concatenate([-np.exp(r.normal(0, 3, 200)), np.exp(r.normal(0, 3, 200)), [0.0, 0.0]]),
    "far from zero": lambda r: 1.7e9 + r.integers(0, 50, 300),
    "constant": lambda r: np.full(20, 3.5),
    "single": lambda r: np.array([2.0]),
    "all negative": lambda r: -r.integers(1, 9, 100).astype(float),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_cumulative_and_quantiles(spark, shape):
    values = [float(v) for v in SHAPES[shape](np.random.default_rng(3))]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    counts = df.groupBy("v").agg(F.count("*").alias("n"))
    up = {r["v"]: (r["before_n"], r["total_n"]) for r in cumulative(counts, "v", ["n"]).collect()}
    down = {r["v"]: r["before_n"] for r in cumulative(counts, "v", ["n"], descending=True).collect()}
    for v in set(values):
        assert up[v] == (sum(x < v for x in values), len(values))
        assert down[v] == sum(x > v for x in values)
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 0.95, 1.0]
    got = {r["q"]: r["quantile"] for r in exact_quantiles(df, "v", probs).collect()}
    for p in probs:
        assert np.isclose(got[p], np.quantile(values, p), rtol=1e-12), (shape, p)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.floats(-1e12, 1e12, allow_nan=False), min_size=1, max_size=40), q=st.floats(0, 1))
def test_quantile_property(spark, values, q):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert np.isclose(exact_quantiles(df, "v", [q]).first()["quantile"], np.quantile(values, q), rtol=1e-9, atol=1e-9)


def test_groups_do_not_mix(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 10.0), ("b", None)], "g string, v double")
    got = {(r["g"], r["q"]): r["quantile"] for r in exact_quantiles(df, "v", [0.5], ["g"]).collect()}
    assert got == {("a", 0.5): 2.0, ("b", 0.5): 10.0}


def test_take_first_with_ties(spark):
    rows = [("a", 5, i) for i in range(10)] + [("a", 1, 100), ("b", 5, 200)]
    df = spark.createDataFrame(rows, "g string, v int, id long")
    got = take_first(df, ["g"], "v", "id", F.lit(4)).collect()
    assert sorted((r["g"], r["id"]) for r in got) == [("a", 0), ("a", 1), ("a", 2), ("a", 100), ("b", 200)]
    top = take_first(df, ["g"], "v", "id", F.lit(2), descending=True).collect()
    assert sorted((r["g"], r["id"]) for r in top) == [("a", 0), ("a", 1), ("b", 200)]


def test_dense_index(spark):
    df = spark.createDataFrame([(c,) for c in "qwertyuiop"], "v string").repartition(3)
    got = {r["v"]: r["idx"] for r in dense_index(df, ["v"]).collect()}
    assert got == {c: i + 1 for i, c in enumerate(sorted("qwertyuiop"))}


def test_approximate_quantiles(spark):
    df = spark.range(1000).selectExpr("cast(id as double) as a", "cast(id * 2 as double) as b")
    got = {(r["col"], r["q"]): r["quantile"] for r in approximate_quantiles(df, ["a", "b"], [0.5]).collect()}
    assert abs(got["a", 0.5] - 500) < 5 and abs(got["b", 0.5] - 1000) < 10


def test_ranges_are_balanced(spark):
    """A narrow mass and one far value: no task of the running sums holds much more than its share."""
    from unittest import mock

    from tidemark.functions import ordered

    counts = spark.range(1_000_000).select((F.lit(100.0) + F.col("id") / 1_000_000).alias("v"), F.lit(1).alias("n")).unionByName(spark.createDataFrame([(1e9, 1)], "v double, n int"))
    placed = []
    keep = ordered.cut_lineage
    with mock.patch.object(ordered, "cut_lineage", lambda df, label: placed.append(keep(df, label)) or placed[-1]):
        got = cumulative(counts, "v", ["n"])
    sizes = [r["count"] for r in placed[0].groupBy("range").count().collect()]
    assert len(sizes) > 1 and max(sizes) <= 3 * sum(sizes) / len(sizes)
    assert got.agg(F.max("before_n")).first()[0] == 1_000_000
