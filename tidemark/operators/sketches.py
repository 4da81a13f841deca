"""Stored sketches of a table by day: distinct counts and quantiles of any span of days without reading rows again.

A day's rows are read once and leave one row per column: counts, sums, a HyperLogLog sketch of its values and,
for numbers, a KLL sketch of their distribution. Sketches of days merge by union, so a new day is added to the
table by itself and any set of days is answered from the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import ratio

LOG_K = 14  # 2^14 registers: a relative standard error of 0.65 % in distinct counts
KLL_K = 800  # an error of 0.4 % in rank
DISTINCT_ERROR, RANK_ERROR = 0.03, 0.01  # bounds that hold in practice always (over four standard errors)


def day_sketches(df: DataFrame, columns: list[str], day: Column) -> DataFrame:
    """(day, column, n, n_missing, total, squares, lo, hi, distinct, spread): one row per day and column; `spread` is NULL for text."""
    numeric = {c for c, t in df.dtypes if t not in ("string", "boolean", "date") and not t.startswith(("timestamp", "array", "struct", "map", "binary"))}
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v"), (F.col(f"`{c}`").cast("double") if c in numeric else F.lit(None).cast("double")).alias("x")) for c in columns])
    long = df.select(day.alias("day"), F.explode(pairs).alias("p")).select("day", "p.*")
    return long.groupBy("day", "column").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("v").isNull()).alias("n_missing"), F.sum("x").alias("total"), F.sum(F.col("x") * F.col("x")).alias("squares"),
        F.min("x").alias("lo"), F.max("x").alias("hi"), F.hll_sketch_agg("v", LOG_K).alias("distinct"),
        F.when(F.count("x") > 0, F.kll_sketch_agg_double("x", KLL_K)).alias("spread"))


def merged(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The sketches of all days of the table (or of each `by`), per column."""
    keys = [*(by or []), "column"]
    return sketches.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("n", "n_missing", "total", "squares")], F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.hll_union_agg("distinct").alias("distinct"),
        F.when(F.count("spread") > 0, F.kll_merge_agg_double("spread")).alias("spread"))


def quantile(spread: Column, p: float) -> Column:
    return F.when(spread.isNotNull(), F.kll_sketch_get_quantile_double(spread, F.lit(float(p))))


def cardinality(sketches: DataFrame) -> DataFrame:
    """Distinct non-null values per column, estimated."""
    return sketches.select("column", F.hll_sketch_estimate("distinct").alias("n_unique"))


def numeric_profile(sketches: DataFrame) -> DataFrame:
    """count, mean, std, min, p50, p95, max of every number column with a value; quantiles are estimated."""
    n = F.col("n") - F.col("n_missing")
    deviations = F.greatest(F.col("squares") - F.col("total") * F.col("total") / n, F.lit(0.0))
    return sketches.where(F.col("spread").isNotNull()).select(
        "column", n.alias("count"), (F.col("total") / n).alias("mean"), F.sqrt(deviations / F.nullif(n - 1, F.lit(0))).alias("std"), F.col("lo").alias("min"), F.col("hi").alias("max"),
        quantile(F.col("spread"), 0.5).alias("p50"), quantile(F.col("spread"), 0.95).alias("p95"))


def degree_summary(sketches: DataFrame) -> DataFrame:
    """Missing share, min, p50, p95, p99 and max per column; quantiles are estimated."""
    return sketches.select("column", (ratio(F.col("n_missing"), F.col("n")) * 100).alias("nan_pct"), F.col("lo").alias("min"), *[quantile(F.col("spread"), p).alias(name) for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))], F.col("hi").alias("max"))


def rank_errors(df: DataFrame, estimates: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """(column, name, error): how far the share of values at or below an estimate lies from its probability, ties taken in its favour."""
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(p).alias("p"), F.col(name).alias("q")) for name, p in quantiles.items()])).alias("a")
    wanted = estimates.select("column", asked).select("column", "a.*").where(F.col("q").isNotNull())
    columns = [c for c in df.columns]
    long = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "v").where(F.col("v").isNotNull())
    counted = long.join(F.broadcast(wanted), "column")  # one row per column and quantile
    share = counted.groupBy("column", "name", "p").agg(F.avg((F.col("v") < F.col("q")).cast("double")).alias("below"), F.avg((F.col("v") <= F.col("q")).cast("double")).alias("upto"))
    return share.select("column", "name", F.greatest(F.lit(0.0), F.col("below") - F.col("p"), F.col("p") - F.col("upto")).alias("error"))
