"""Cumulative sums, exact quantiles and exact top shares over a total order, without a global sort.

Values are reduced to distinct (group, value) counts and dealt into ranges of about equal numbers of
them by a distributed sort, whatever their distribution. The ranges are written once, so that sums
inside a range and the totals of the ranges before it belong to the same placement. A task sees one
range; the table of totals has a row per range and group in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage


def cumulative(counts: DataFrame, value: str, sums: list[str], groups: list[str] | None = None,
               descending: bool = False, with_range: bool = False) -> DataFrame:
    """Add `before_<c>` and `total_<c>`: sums over earlier values and over the group.

    `counts` must already hold one row per (groups, value), with no NULL value. `with_range` keeps `range`,
    the number of the stretch of consecutive values that a row was dealt into.
    """
    groups = groups or []
    part = F.spark_partition_id().alias("range")
    placed = cut_lineage(counts.repartitionByRange(*groups, value).select("*", part), "ordered-ranges")
    totals = placed.groupBy(*groups, "range").agg(*[F.sum(c).alias(f"b_{c}") for c in sums])
    every = Window.partitionBy(*groups)
    ahead = every.orderBy(F.desc("range") if descending else F.asc("range")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*groups, "range", *[F.coalesce(F.sum(f"b_{c}").over(ahead), F.lit(0)).alias(f"a_{c}") for c in sums], *[F.sum(f"b_{c}").over(every).alias(f"total_{c}") for c in sums])
    inside = Window.partitionBy("range", *groups).orderBy(F.desc(value) if descending else F.asc(value)).rowsBetween(Window.unboundedPreceding, -1)
    y = placed.join(totals, ["range", *groups])
    y = y.withColumns({f"before_{c}": F.col(f"a_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums})
    return y.drop(*([] if with_range else ["range"]), *[f"a_{c}" for c in sums])


def between(values: DataFrame, value: str, knots: DataFrame, knot: str, payload: str) -> DataFrame:
    """Each distinct non-null value with the last knot at or before it and the first one at or after it.

    Adds `below` and `above`: structs of a knot and its payload, NULL where there is none. Values and knots are
    dealt into ranges together, so neither side is held by one task; a range learns the nearest knots outside
    it from a table of one row per range.
    """
    mark = F.struct(F.col("v").alias(knot), F.col("p").alias(payload))
    asked = values.where(F.col(value).isNotNull()).select(F.col(value).alias("v"), F.lit(None).cast(knots.schema[payload].dataType).alias("p"), F.lit(True).alias("asked"))
    both = asked.unionByName(knots.select(F.col(knot).alias("v"), F.col(payload).alias("p"), F.lit(False).alias("asked")))
    points = both.groupBy("v").agg(F.max("p").alias("p"), F.max("asked").alias("asked"), F.max(~F.col("asked")).alias("is_knot"))
    placed = cut_lineage(points.repartitionByRange("v").select("*", F.when(F.col("is_knot"), mark).alias("k"), F.spark_partition_id().alias("range")), "knots")
    ends = placed.groupBy("range").agg(F.min("k").alias("first"), F.max("k").alias("last"))
    order = Window.orderBy("range")  # one row per range
    ends = ends.select("range", F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("lower"), F.min("first").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("upper"))
    inside = Window.partitionBy("range").orderBy("v")
    y = placed.join(ends, "range")
    y = y.withColumns({
        "below": F.coalesce(F.last("k", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.col("lower")),
        "above": F.coalesce(F.first("k", ignorenulls=True).over(inside.rowsBetween(0, Window.unboundedFollowing)), F.col("upper"))})
    return y.where("asked").select(F.col("v").alias(value), "below", "above")


def exact_quantiles(df: DataFrame, value: str, probabilities: list[float], groups: list[str] | None = None) -> DataFrame:
    """Linear-interpolation quantiles of non-null values, one row per (groups, probability)."""
    groups = groups or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return quantiles_of_counts(counts, "v", "n", probabilities, groups)


def quantiles_of_counts(counts: DataFrame, value: str, n: str, probabilities: list[float], groups: list[str] | None = None) -> DataFrame:
    """Quantiles of a table of distinct values and their counts."""
    groups = groups or []
    c = cumulative(counts.select(*groups, F.col(value).alias("v"), F.col(n).alias("n")), "v", ["n"], groups)
    probs = F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("q")
    # Only values that cover one of the two neighbouring ranks of a probability go on.
    c = c.select("*", probs)
    rank = F.col("q") * (F.col("total_n") - 1)
    low, high = F.floor(rank), F.ceil(rank)
    first, last = F.col("before_n"), F.col("before_n") + F.col("n") - 1
    hit = c.select(
        *groups, "q", (rank - low).alias("w"),
        F.when((first <= low) & (low <= last), F.col("v")).alias("at_low"),
        F.when((first <= high) & (high <= last), F.col("v")).alias("at_high"),
    ).where(F.col("at_low").isNotNull() | F.col("at_high").isNotNull())
    return hit.groupBy(*groups, "q").agg(F.max("w").alias("w"), F.max("at_low").alias("a"), F.max("at_high").alias("b")).select(
        *groups, "q", (F.col("a") + (F.col("b") - F.col("a")) * F.col("w")).alias("quantile"))


def approximate_quantiles(df: DataFrame, columns: list[str], probabilities: list[float], accuracy: int = 10000) -> DataFrame:
    """One sketch pass over many columns, for when exact cut points are not needed."""
    probs = F.array(*[F.lit(float(p)) for p in probabilities])
    aggs = [F.percentile_approx(F.col(c).cast("double"), probs, accuracy).alias(c) for c in columns]
    wide = df.agg(*aggs)
    pairs = F.arrays_zip(probs.alias("q"), F.col("v").alias("quantile"))
    return wide.unpivot([], columns, "col", "v").select("col", F.explode(pairs).alias("z")).select("col", "z.*")


def take_first(df: DataFrame, groups: list[str], value: str, id_col: str, quota: Column, descending: bool = False,
               extra: list[str] | None = None) -> DataFrame:
    """The first `quota` rows of each group ordered by (value, id), exactly.

    `quota` may use `total_n`, the number of rows in the group. Whole values below the cut are kept by
    count; only rows tied on the value at the cut are ranked by id.
    """
    extra = extra or []
    cols = list(dict.fromkeys([*groups, value, id_col, *extra]))
    rows = df.select(*cols)
    counts = rows.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"))
    pos = cumulative(counts, value, ["n"], groups, descending=descending).withColumn("room", quota - F.col("before_n"))
    pos = pos.where(F.col("room") > 0).select(*groups, value, "n", "room")
    joined = rows.join(pos, [*groups, value])
    whole = joined.where(F.col("n") <= F.col("room"))
    cut = joined.where(F.col("n") > F.col("room"))
    tied = cut.groupBy(*groups, value, id_col).agg(F.count(F.lit(1)).alias("m"), F.max("room").alias("room"))
    ranked = cumulative(tied, id_col, ["m"], [*groups, value]).where(F.col("before_m") < F.col("room")).select(*groups, value, id_col)
    return whole.select(*cols).unionByName(cut.join(ranked, [*groups, value, id_col], "left_semi").select(*cols))
