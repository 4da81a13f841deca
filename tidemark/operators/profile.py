"""Table profiles: label rates by slice, missing values, distributions, correlations, drift over time.

Wide tables are profiled in long form or by one aggregation over all columns, never column by column.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions.numeric import bucket_right_closed, ratio, wilson
from tidemark.functions.ordered import cumulative, exact_quantiles, quantiles_of_counts

LABEL = "isFraud"
# Amount slices for label rates.
AMOUNT_EDGES = [0, 25, 50, 100, 250, 500, 1000, 5000]
# Component-size slices.
SIZE_EDGES = [0, 1, 2, 5, 10, 100, 1000, 10000, 100000]


def label_rate(df: DataFrame, *by: Column, min_n: int = 0, label: str = LABEL) -> DataFrame:
    """n_fraud, n, rate and Wilson interval per group."""
    g = df.groupBy(*by).agg(F.sum(F.col(label).cast("long")).alias("n_fraud"), F.count(label).alias("n"))
    low, high = wilson(F.col("n_fraud"), F.col("n"))
    out = g.withColumns({"fraud_rate": ratio(F.col("n_fraud"), F.col("n")), "ci_low_95": low, "ci_high_95": high})
    return out.where(F.col("n") >= min_n) if min_n else out


def top_by_rate(rates: DataFrame, key: str, k: int) -> DataFrame:
    return rates.orderBy(F.desc("fraud_rate"), key).limit(k)


def interval_name(edges: list[float], i: int) -> str:
    left = f"{edges[i]:g}"
    right = f"{edges[i + 1]:g}" if i + 1 < len(edges) else "inf"
    return f"({left}, {right}]"


def right_closed_name(x: Column, edges: list[float]) -> Column:
    """Name of the (edge, next] interval holding x; the lowest edge belongs to the first."""
    idx = bucket_right_closed(x, edges[1:])
    names = F.array(*[F.lit(interval_name(edges, i)) for i in range(len(edges))])
    return F.when(x >= edges[0], F.element_at(names, idx + 1))


def pivot_rate(df: DataFrame, row: str, column: str, values: list, label: str = LABEL) -> DataFrame:
    return df.groupBy(row).pivot(column, values).agg(F.avg(F.col(label).cast("double")))


def coverage(df: DataFrame, columns: list[str]) -> Column:
    """Whether any of the columns is filled."""
    return F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull()


def class_histogram(df: DataFrame, value: Column, bins: int, label: str = LABEL) -> DataFrame:
    """Density per class over equal-width bins shared by both classes."""
    x = df.select(F.col(label).alias("label"), value.alias("x")).where(F.col("x").isNotNull())
    span = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    # A constant column has one bin of no width and hence no density.
    pos = F.coalesce(F.least(F.floor((F.col("x") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins), F.lit(bins - 1)), F.lit(0))
    counts = x.crossJoin(F.broadcast(span)).groupBy("label", pos.cast("int").alias("bin"), ((F.col("hi") - F.col("lo")) / bins).alias("width")).agg(F.count(F.lit(1)).alias("n"))
    total = Window.partitionBy("label")  # one row per bin
    return counts.select("label", "bin", "n", ratio(F.col("n"), F.sum("n").over(total) * F.col("width")).alias("density"))


def long_form(df: DataFrame, columns: list[str], keep: list[str] | None = None, kind: str = "double") -> DataFrame:
    keep = keep or []
    return df.select(*keep, *[F.col(f"`{c}`").cast(kind).alias(c) for c in columns]).unpivot(keep, columns, "column", "v")


def cardinality(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """Distinct non-null values per column."""
    if not exact:
        wide = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns])
        return wide.unpivot([], columns, "column", "n_unique")
    # Distinct pairs first (combined before the shuffle), then a count per column.
    pairs = long_form(df, columns, kind="string").groupBy("column", "v").agg(F.lit(1).alias("x"))
    return pairs.groupBy("column").agg(F.count("v").alias("n_unique"))


def value_counts(df: DataFrame, columns: list[str], k: int = 10) -> DataFrame:
    """The k most frequent values of each column, NULL included.

    The rank filter lets Spark keep only k rows per column in each task before the shuffle.
    """
    counts = long_form(df, columns, kind="string").groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), F.asc_nulls_first("v")))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def missing_table(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n_missing, null_rate) from one aggregation."""
    columns = columns or df.columns
    wide = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in columns])
    return wide.unpivot(["__n"], columns, "column", "n_missing").select("column", "n_missing", ratio(F.col("n_missing"), F.col("__n")).alias("null_rate"))


# Column families by name.
FAMILIES = {"V": r"^V\d+$", "C": r"^C\d+$", "D": r"^D\d+$", "M": r"^M\d+$", "id": r"^(id_.*|DeviceType|DeviceInfo)$",
            "card": r"^card.*$", "addr": r"^addr.*$", "dist": r"^dist.*$"}


def family(column: Column) -> Column:
    out = None
    for name, pattern in FAMILIES.items():
        hit = column.rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def missing_by_family(table: DataFrame) -> DataFrame:
    return table.withColumn("family", family(F.col("column"))).where(F.col("family").isNotNull()).groupBy("family").agg(
        F.count(F.lit(1)).alias("n_columns"), F.avg("null_rate").alias("mean_null_rate"))


def predictive_missingness(df: DataFrame, columns: list[str], min_n: int = 500, label: str = LABEL) -> DataFrame:
    """Label rate where a column is missing against where it is not, for every column with `min_n` rows of both kinds."""
    y = F.col(label).cast("long")
    aggs = []
    for c in columns:
        gone = F.col(f"`{c}`").isNull()
        aggs.append(F.struct(
            F.count_if(gone).alias("n_null"), F.count_if(~gone).alias("n_not_null"),
            F.coalesce(F.sum(F.when(gone, y)), F.lit(0)).alias("k_null"), F.coalesce(F.sum(F.when(~gone, y)), F.lit(0)).alias("k_not_null")).alias(c))
    long = df.agg(*aggs).unpivot([], columns, "column", "s").select("column", "s.*")
    long = long.where((F.col("n_null") >= min_n) & (F.col("n_not_null") >= min_n))
    low0, high0 = wilson(F.col("k_null"), F.col("n_null"))
    low1, high1 = wilson(F.col("k_not_null"), F.col("n_not_null"))
    return long.withColumns({
        "rate_null": F.col("k_null") / F.col("n_null"), "rate_not_null": F.col("k_not_null") / F.col("n_not_null"),
        "ci_low_null": low0, "ci_high_null": high0, "ci_low_not_null": low1, "ci_high_not_null": high1})


def null_signatures(df: DataFrame, columns: list[str], id_col: str = "TransactionID") -> DataFrame:
    """(column, signature, n_missing): columns missing on the same rows share a signature.

    XOR of two 64-bit hashes of the ids with a missing value, plus their number: it needs no row order
    and merges across tasks, so one aggregation covers all columns. Rows with the same columns missing are put together
    first, so that hashes are not added up once per column and row; a table has far fewer such patterns than rows.
    """
    h1, h2 = F.xxhash64(id_col), F.xxhash64(F.lit("second"), id_col)
    words = [columns[i:i + 63] for i in range(0, len(columns), 63)]
    bits = [sum((F.when(F.col(f"`{c}`").isNull(), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, c in enumerate(word)), F.lit(0).cast("long")) for word in words]
    marks = [f"_w{i}" for i in range(len(words))]
    patterns = df.select(h1.alias("_h1"), h2.alias("_h2"), *[b.alias(m) for b, m in zip(bits, marks)]).groupBy(*marks).agg(
        F.bit_xor("_h1").alias("_x1"), F.bit_xor("_h2").alias("_x2"), F.count(F.lit(1)).alias("_n"))
    aggs = []
    for i, c in enumerate(columns):
        gone = F.col(marks[i // 63]).bitwiseAND(F.lit(1 << (i % 63))) != 0
        missing = F.coalesce(F.sum(F.when(gone, F.col("_n"))), F.lit(0))
        sig = F.concat_ws(":", *[F.coalesce(F.bit_xor(F.when(gone, F.col(x))), F.lit(0)).cast("string") for x in ("_x1", "_x2")], missing.cast("string"))
        aggs.append(F.struct(sig.alias("signature"), missing.alias("n_missing"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).alias(c))
    return patterns.agg(*aggs).unpivot([], columns, "column", "s").select("column", "s.*")


def null_groups(signatures: DataFrame, min_columns: int = 2, min_rate: float = 0.01) -> DataFrame:
    """Groups of columns with one missing-value pattern; the table has one row per column."""
    g = signatures.groupBy("signature").agg(
        F.count(F.lit(1)).alias("n_columns"), F.max("n_missing").alias("n_rows_missing"), F.max("n").alias("n"),
        F.array_join(F.array_sort(F.collect_list("column")), ",").alias("columns"))
    return g.select("columns", "n_columns", "n_rows_missing", (F.col("n_rows_missing") / F.col("n")).alias("missing_rate")).where(
        (F.col("n_columns") >= min_columns) & (F.col("missing_rate") >= min_rate))


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, p50, p95, max of every column that has a value.

    Moments come from one aggregation over the table, exact quantiles from its distinct values.
    """
    aggs = [F.struct(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")).alias(c) for c in columns]
    moments = df.agg(*aggs).unpivot([], columns, "column", "s").select("column", "s.*")
    q = exact_quantiles(long_form(df, columns), "v", [0.5, 0.95], ["column"])
    q = q.groupBy("column").agg(F.max(F.when(F.col("q") < 0.9, F.col("quantile"))).alias("p50"), F.max(F.when(F.col("q") > 0.9, F.col("quantile"))).alias("p95"))
    return moments.where(F.col("count") > 0).join(q, "column")


def box_stats(df: DataFrame, columns: list[str], label: str = LABEL) -> DataFrame:
    """Quartiles and whiskers (last value within 1.5 box lengths) per column and class."""
    counts = long_form(df, columns, [label]).where(F.col("v").isNotNull()).groupBy("column", label, "v").agg(F.count(F.lit(1)).alias("n"))
    q = quantiles_of_counts(counts, "v", "n", [0.25, 0.5, 0.75], ["column", label])
    box = q.groupBy("column", label).agg(*[F.max(F.when(F.col("q") == p, F.col("quantile"))).alias(name) for p, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = counts.join(box, ["column", label]).where((F.col("v") >= F.col("q1") - reach) & (F.col("v") <= F.col("q3") + reach))
    return inside.groupBy("column", label, "q1", "median", "q3").agg(F.min("v").alias("whisker_low"), F.max("v").alias("whisker_high"))


def mean_gap_ranking(df: DataFrame, columns: list[str], label: str = LABEL, k: int = 10) -> DataFrame:
    """Columns by the gap between class means in standard deviations."""
    y = F.col(label)
    aggs = [F.struct(F.avg(F.when(y == 1, F.col(c))).alias("m1"), F.avg(F.when(y == 0, F.col(c))).alias("m0"), F.stddev_pop(c).alias("sd")).alias(c) for c in columns]
    long = df.agg(*aggs).unpivot([], columns, "column", "s").select("column", "s.*")
    out = long.where(F.col("sd") > 0).withColumn("smd", F.abs(F.col("m1") - F.col("m0")) / F.col("sd")).where(F.col("smd").isNotNull())
    return out.orderBy(F.desc("smd"), "column").limit(k).select("column", "smd")


def ks_p_value(stat: Column, n1: Column, n2: Column, terms: int = 100) -> Column:
    """Two-sided asymptotic p-value: the Kolmogorov series, 1 where it does not converge."""
    lam = F.sqrt(n1 * n2 / (n1 + n2)) * stat
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
        lambda acc, j: acc + F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * j * j * lam * lam))
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))


def ks_by_half(df: DataFrame, columns: list[str], time_col: str = "TransactionDT", min_n: int = 1000, alpha: float = 0.01) -> DataFrame:
    """Largest gap between the two halves' distribution functions, per column; halves split at the median time."""
    median = exact_quantiles(df, time_col, [0.5]).select(F.col("quantile").alias("__mid"))
    first = df.crossJoin(F.broadcast(median)).withColumn("__first", (F.col(time_col) < F.col("__mid")).cast("long"))
    counts = long_form(first, columns, ["__first"]).where(F.col("v").isNotNull()).groupBy("column", "v").agg(
        F.sum("__first").alias("a"), F.sum(1 - F.col("__first")).alias("b"))
    c = cumulative(counts, "v", ["a", "b"], ["column"])
    gap = F.abs((F.col("before_a") + F.col("a")) / F.nullif(F.col("total_a"), F.lit(0)) - (F.col("before_b") + F.col("b")) / F.nullif(F.col("total_b"), F.lit(0)))
    out = c.groupBy("column").agg(F.max(gap).alias("ks_stat"), F.max("total_a").alias("n_half1"), F.max("total_b").alias("n_half2"))
    out = out.where((F.col("n_half1") >= min_n) & (F.col("n_half2") >= min_n))
    p = ks_p_value(F.col("ks_stat"), F.col("n_half1").cast("double"), F.col("n_half2").cast("double"))
    return out.withColumn("p_value", p).withColumn("drifts", F.col("p_value") < alpha)


def numbered(columns: list[str], letter: str = "V") -> list[str]:
    """Columns named by the letter and a number, in numeric order."""
    return sorted((c for c in columns if re.fullmatch(rf"{letter}\d+", c)), key=lambda c: int(c[1:]))


def medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact medians; one number per column comes to the driver."""
    q = exact_quantiles(long_form(df, columns), "v", [0.5], ["column"])
    return {r["column"]: r["quantile"] for r in q.collect()}


def vector(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=columns, outputCol="x").transform(df).select(*(keep or []), "x")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair after median imputation, as (a, b, rho) with a before b.

    The matrix has one entry per pair of columns; only it reaches the driver.
    """
    from pyspark.ml.stat import Correlation

    filled = df.select(*columns).fillna(medians(df, columns))
    m = Correlation.corr(vector(filled, columns), "x").first()[0].toArray()
    rows = [(columns[i], columns[j], float(m[i, j])) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    return df.sparkSession.createDataFrame(rows, "a string, b string, rho double")


def correlation_summary(pairs: DataFrame, limit: float = 0.95) -> DataFrame:
    high = pairs.where(F.abs("rho") > limit)
    partners = high.select(F.explode(F.array("a", "b")).alias("c")).agg(F.countDistinct("c").alias("n_columns_with_partner"))
    return high.agg(F.count(F.lit(1)).alias("n_high_pairs")).crossJoin(partners)


def scree(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of variance of every principal component after median imputation; all-null columns are left out."""
    from pyspark.ml.feature import PCA

    mid = medians(df, columns)
    used = [c for c in columns if c in mid]
    filled = vector(df.select(*used).fillna(mid), used)
    model = PCA(k=len(used), inputCol="x", outputCol="p").fit(filled)
    shares = [float(v) for v in model.explainedVariance.toArray()]
    rows, total = [], 0.0
    for i, s in enumerate(shares):
        total += s
        rows.append((i + 1, s, total))
    return df.sparkSession.createDataFrame(rows, "component int, share double, cumulative double")


def frame_stats(df: DataFrame) -> DataFrame:
    """Rows, missing cells, full-row duplicates and columns per type."""
    gone = sum((F.col(f"`{c}`").isNull().cast("long") for c in df.columns), F.lit(0))
    cells = df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(gone).alias("n_missing"))
    kinds = sorted({t for _, t in df.dtypes})
    distinct = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.lit(1).alias("x")).agg(F.count(F.lit(1)).alias("__d"))
    out = cells.crossJoin(distinct).withColumn("n_duplicates", F.col("n_rows") - F.col("__d")).drop("__d")
    return out.withColumns({f"n_{k}": F.lit(sum(t == k for _, t in df.dtypes)).cast("long") for k in kinds})


def raw_summary(df: DataFrame, identity_columns: list[str], time_col: str = "TransactionDT", label: str = LABEL) -> DataFrame:
    """Rows, columns, time span, label rate, identity coverage and columns more than half missing."""
    base = df.agg(
        F.count(F.lit(1)).alias("rows"), F.min(time_col).alias("dt_min"), F.max(time_col).alias("dt_max"),
        F.avg(F.col(label).cast("double")).alias("fraud_rate"), F.avg(coverage(df, identity_columns).cast("double")).alias("identity_coverage"))
    sparse = missing_table(df).agg(F.count_if(F.col("null_rate") > 0.5).alias("cols_above_50pct_null"))
    return base.crossJoin(sparse).withColumns({
        "cols": F.lit(len(df.columns)).cast("long"), "span_days": F.round((F.col("dt_max") - F.col("dt_min")) / 86400.0, 2)})


def degree_summary(degrees: DataFrame, columns: list[str]) -> DataFrame:
    """Missing share, min, p50, p95, p99 and max per column."""
    q = exact_quantiles(long_form(degrees, columns), "v", [0.0, 0.5, 0.95, 0.99, 1.0], ["column"])
    names = {0.0: "min", 0.5: "p50", 0.95: "p95", 0.99: "p99", 1.0: "max"}
    wide = q.groupBy("column").agg(*[F.max(F.when(F.col("q") == p, F.col("quantile"))).alias(n) for p, n in names.items()])
    return missing_table(degrees, columns).select("column", (F.col("null_rate") * 100).alias("nan_pct")).join(wide, "column", "left")


def size_bucket_rate(df: DataFrame, size: str, label: str = LABEL) -> DataFrame:
    """Rows and label rate per size bucket; empty buckets stay."""
    spark = df.sparkSession
    edges = SIZE_EDGES
    names = spark.createDataFrame([(i, f"{lo}-{edges[i + 1] if i + 1 < len(edges) else 'inf'}") for i, lo in enumerate(edges)], "idx int, bucket string")
    counts = df.where(F.col(size) >= 0).groupBy(bucket_right_closed(F.col(size), edges[1:]).alias("idx")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("fraud_rate"))
    return names.join(counts, "idx", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), "fraud_rate")


def size_distribution(sizes: DataFrame, column: str) -> DataFrame:
    """count, mean, std, min, p50, p90, p99, p99.9, max of a numeric column."""
    m = sizes.agg(F.count(column).alias("count"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"),
                  F.min(column).cast("double").alias("min"), F.max(column).cast("double").alias("max"))
    q = exact_quantiles(sizes, column, [0.5, 0.9, 0.99, 0.999])
    wide = q.agg(*[F.max(F.when(F.col("q") == p, F.col("quantile"))).alias(n) for p, n in ((0.5, "p50"), (0.9, "p90"), (0.99, "p99"), (0.999, "p999"))])
    return m.crossJoin(wide)


def next_largest(components: DataFrame, size: str, k: int = 5) -> DataFrame:
    """The k largest distinct component sizes after the largest one, with how many components have each."""
    return components.groupBy(size).agg(F.count(F.lit(1)).alias("n_components")).orderBy(F.desc(size)).offset(1).limit(k)
