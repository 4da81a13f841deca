"""Stored sketches against exact answers."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import profile as P
from tidemark.operators import sketches as S


@pytest.fixture(scope="module")
def frame(spark):
    n = 60_000
    return spark.range(n, numPartitions=6).selectExpr(
        "id", "cast(id % 10 as int) as day", "case when id % 7 > 0 then pow(xxhash64(id) % 100000 / 100000D, 3) end as skewed", "cast(id % 37 as int) as few",
        "case when id % 3 = 0 then concat('v', id % 20011) end as name", "cast(null as double) as nothing").cache()


COLUMNS = ["skewed", "few", "name", "nothing"]


def test_days_merge_to_the_whole(spark, frame, tmp_path):
    S.day_sketches(frame.where("day < 6"), COLUMNS, F.col("day")).write.parquet(str(tmp_path / "s"))
    S.day_sketches(frame.where("day >= 6"), COLUMNS, F.col("day")).write.mode("append").parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    assert stored.count() == 40
    every = S.merged(stored).cache()
    exact = {r["column"]: r["n_unique"] for r in P.cardinality(frame, COLUMNS).collect()}
    for r in S.cardinality(every).collect():
        assert abs(r["n_unique"] - exact[r["column"]]) <= S.DISTINCT_ERROR * exact[r["column"]]
    want = {r["column"]: r for r in P.numeric_profile(frame, ["skewed", "few"]).collect()}
    got = {r["column"]: r for r in S.numeric_profile(every).collect()}
    assert got.keys() == want.keys()
    for c, r in want.items():
        assert all(math.isclose(got[c][k], r[k], rel_tol=1e-9) for k in ("count", "mean", "std", "min", "max"))
    errors = S.rank_errors(frame.select("skewed", "few"), S.numeric_profile(every), {"p50": 0.5, "p95": 0.95}).collect()
    assert len(errors) == 4 and all(r["error"] <= S.RANK_ERROR for r in errors)
    nulls = {r["column"]: r["nan_pct"] for r in S.degree_summary(every).collect()}
    assert nulls["few"] == 0 and math.isclose(nulls["nothing"], 100.0)


def test_a_span_of_days_and_no_days(spark, frame):
    stored = S.day_sketches(frame, COLUMNS, F.col("day"))
    some = {r["column"]: r["n_unique"] for r in S.cardinality(S.merged(stored.where("day in (0, 1)"))).collect()}
    exact = {r["column"]: r["n_unique"] for r in P.cardinality(frame.where("day in (0, 1)"), COLUMNS).collect()}
    assert all(abs(some[c] - exact[c]) <= S.DISTINCT_ERROR * exact[c] for c in COLUMNS)
    assert S.merged(S.day_sketches(frame.limit(0), COLUMNS, F.col("day"))).count() == 0
    by_half = S.merged(stored.withColumn("half", F.col("day") < 5), ["half"])
    assert by_half.count() == 8
