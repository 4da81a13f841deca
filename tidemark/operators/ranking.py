"""Exact ranking and calibration metrics, per group where asked."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions.numeric import bucket_left_closed, bucket_right_closed, ratio
from tidemark.functions.ordered import cumulative, exact_quantiles
from tidemark.operators.cost import Costs

LOG_LOSS_EPS = 1e-15


def score_counts(df: DataFrame, label: str, score: str, groups: list[str] | None = None) -> DataFrame:
    """Positives and negatives per (group, distinct score)."""
    y = F.col(label) == 1
    return df.groupBy(*(groups or []), F.col(score).cast("double").alias("score")).agg(
        F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))


def roc_points(counts: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Per distinct score, highest first, positives and negatives strictly above it."""
    return cumulative(counts, "score", ["pos", "neg"], groups, descending=True)


def ranking_metrics(points: DataFrame, groups: list[str] | None = None, also: dict[str, Column] | None = None) -> DataFrame:
    """`auc` (ties count half) and `average_precision`; NULL when a class is missing. `also` names aggregates taken in the same pass."""
    groups, also = groups or [], also or {}
    pos, neg, p, n = F.col("pos"), F.col("neg"), F.col("total_pos"), F.col("total_neg")
    above_p, above_n = F.col("before_pos"), F.col("before_neg")
    below = n - above_n - neg
    wins = pos * (below + neg / 2.0)
    step = (pos / F.nullif(p, F.lit(0))) * ((above_p + pos) / (above_p + pos + above_n + neg))
    out = points.groupBy(*groups).agg(
        F.max("total_pos").alias("n_pos"), F.max("total_neg").alias("n_neg"), F.sum(wins).alias("wins"), F.sum(step).alias("ap"), *[c.alias(n) for n, c in also.items()])
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return out.select(
        *groups, "n_pos", "n_neg",
        F.when(both, F.col("wins") / (F.col("n_pos").cast("double") * F.col("n_neg"))).alias("auc"),
        F.when(both, F.col("ap")).alias("average_precision"), *also)


def recall_at_fpr(points: DataFrame, target: float, groups: list[str] | None = None) -> DataFrame:
    """Largest recall among operating points whose false-positive rate is at most the target."""
    fpr = (F.col("before_neg") + F.col("neg")) / F.nullif(F.col("total_neg"), F.lit(0))
    tpr = (F.col("before_pos") + F.col("pos")) / F.nullif(F.col("total_pos"), F.lit(0))
    return points.groupBy(*(groups or [])).agg(F.coalesce(F.max(F.when(fpr <= target, tpr)), F.lit(0.0)).alias("recall"))


def precision_recall_at(df: DataFrame, label: str, score: str, fractions: list[float], id_col: str) -> DataFrame:
    """Precision and recall of the top share by score (ties by id) for each share; at least one row is taken.

    Whole scores above a cut are known from the counts per score. Only rows tied on the score at a cut
    are ranked by id, for all shares together.
    """
    if not all(0.0 < f <= 1.0 for f in fractions):
        raise ValueError("fractions must be in (0, 1]")
    points = roc_points(score_counts(df, label, score)).withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
    n = F.col("total_pos") + F.col("total_neg")
    points = points.withColumn("k_count", F.greatest(F.lit(1), F.ceil(F.col("fraction") * n)))
    first = F.col("before_pos") + F.col("before_neg")
    # The one score per share that holds its k-th row.
    cut = points.where((first < F.col("k_count")) & (F.col("k_count") <= first + F.col("pos") + F.col("neg")))
    cut = cut.select("fraction", "k_count", "score", "before_pos", "pos", "total_pos", (F.col("k_count") - first).alias("room"), (F.col("pos") + F.col("neg")).alias("tied"))
    partial = cut.where(F.col("room") < F.col("tied"))
    rows = df.select(F.col(score).cast("double").alias("score"), F.col(id_col).alias("id"), (F.col(label) == 1).cast("long").alias("y"))
    at_cut = rows.join(partial.select("score").distinct(), "score", "left_semi").groupBy("score", "id").agg(F.count(F.lit(1)).alias("m"), F.sum("y").alias("y"))
    ranked = cumulative(at_cut, "id", ["m"], ["score"]).select("score", "y", "before_m")
    hits = ranked.join(partial.select("fraction", "score", "room"), "score").where(F.col("before_m") < F.col("room")).groupBy("fraction").agg(F.sum("y").alias("some"))
    out = cut.join(hits, "fraction", "left")
    top = F.col("before_pos") + F.when(F.col("room") == F.col("tied"), F.col("pos")).otherwise(F.coalesce("some", F.lit(0)))
    return out.select("fraction", "k_count", (top / F.col("k_count")).alias("precision"), F.coalesce(ratio(top, F.col("total_pos")), F.lit(0.0)).alias("recall"))


def brier(label: Column, score: Column) -> Column:
    return F.avg((score - label) * (score - label))


def log_loss(label: Column, score: Column, eps: float = LOG_LOSS_EPS) -> Column:
    p = F.least(F.greatest(score, F.lit(eps)), F.lit(1.0 - eps))
    return F.avg(-(label * F.ln(p) + (1 - label) * F.ln(1 - p)))


def unit_edges(bins: int) -> list[float]:
    return [float(e) for e in np.linspace(0.0, 1.0, bins + 1)]


def reliability(df: DataFrame, label: str, score: str, bins: int = 10, groups: list[str] | None = None) -> DataFrame:
    """Mean score, label rate and rows per non-empty bin; bins are (a, b], 0 is in the first."""
    inner = unit_edges(bins)[1:-1]
    return df.groupBy(*(groups or []), bucket_right_closed(F.col(score), inner).alias("bin")).agg(
        F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("label_rate"), F.count(F.lit(1)).alias("n"))


def calibration_error(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    table = reliability(df, label, score, bins)
    err = F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("label_rate"))) / F.sum("n")
    return table.agg(F.coalesce(err, F.lit(0.0)).alias("ece"))


def quantile_edges(df: DataFrame, value: str, bins: int = config.PSI_BINS) -> list[float]:
    """Distinct quantiles of non-null values; at most bins + 1 numbers come to the driver."""
    probs = [float(p) for p in np.linspace(0.0, 1.0, bins + 1)]
    return sorted({r["quantile"] for r in exact_quantiles(df, value, probs).select("quantile").collect() if r["quantile"] is not None})


def psi_term(base: Column, current: Column, eps: float = config.PSI_EPSILON) -> Column:
    """One bin's share of the index; NULL when a share is unknown."""
    b, c = F.greatest(base, F.lit(eps)), F.greatest(current, F.lit(eps))
    return F.when(base.isNotNull() & current.isNotNull(), (c - b) * F.ln(c / b))


def psi(baseline: DataFrame, current: DataFrame, value: str, bins: int = config.PSI_BINS) -> DataFrame:
    """Population stability index over the baseline's quantile bins; 0 for a constant baseline."""
    edges = quantile_edges(baseline, value, bins)
    spark = baseline.sparkSession
    if len(edges) < 2:
        return baseline.limit(1).agg(F.lit(0.0).alias("psi"))
    idx = bucket_left_closed(F.col(value), edges[1:-1]).alias("bin")

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.where(F.col(value).isNotNull()).groupBy(idx).agg(F.count(F.lit(1)).alias(name))

    grid = spark.createDataFrame([(i,) for i in range(len(edges) - 1)], "bin int")
    t = grid.join(counted(baseline, "a"), "bin", "left").join(counted(current, "b"), "bin", "left").fillna(0)
    totals = t.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    return t.crossJoin(totals).agg(F.sum(psi_term(ratio(F.col("a"), F.col("ta")), ratio(F.col("b"), F.col("tb")))).alias("psi"))


# Amount strata, left-closed.
AMOUNT_STRATA = [("<$50", None, 50.0), ("$50-200", 50.0, 200.0), ("$200-500", 200.0, 500.0), ("$500-1K", 500.0, 1000.0), (">$1K", 1000.0, None)]
MIN_STRATUM = 50


def strata(df: DataFrame) -> dict[str, Column]:
    """The name of a row's stratum on each axis; axes whose column is missing are left out."""
    pairs = []
    if "TransactionAmt" in df.columns:
        name = None
        for label, lo, hi in AMOUNT_STRATA:
            cond = F.lit(True)
            if lo is not None:
                cond = cond & (F.col("TransactionAmt") >= lo)
            if hi is not None:
                cond = cond & (F.col("TransactionAmt") < hi)
            name = F.when(cond, label) if name is None else name.when(cond, label)
        pairs.append(("amount_bucket", name))
    if "ProductCD" in df.columns:
        pairs.append(("product_cd", F.coalesce(F.col("ProductCD").cast("string"), F.lit("(missing)"))))
    if "DeviceType" in df.columns:
        pairs.append(("device_type", F.coalesce(F.col("DeviceType").cast("string"), F.lit("(null)"))))
    if "id_01" in df.columns:
        pairs.append(("identity_coverage", F.when(F.col("id_01").isNotNull(), "has_identity").otherwise("no_identity")))
    if "month" in df.columns:
        pairs.append(("month", F.col("month").cast("string")))
    return dict(pairs)


def stratum_counts(df: DataFrame) -> DataFrame:
    """Positives and negatives per (axis, value, distinct score).

    Rows are counted per combination of strata and score first; grouping sets then add the combinations up
    along every axis in one aggregation.
    """
    axes = strata(df)
    named = df.select(F.col("score").cast("double").alias("score"), (F.col("label") == 1).alias("y"), *[c.alias(a) for a, c in axes.items()])
    cells = named.groupBy(*axes, "score").agg(F.count_if("y").alias("p"), F.count_if(~F.col("y")).alias("n"))
    by_axis = cells.groupingSets([[a, "score"] for a in axes], *axes, "score").agg(F.sum("p").alias("pos"), F.sum("n").alias("neg"), *[F.grouping(a).alias(f"other_{a}") for a in axes])
    axis = F.coalesce(*[F.when(F.col(f"other_{a}") == 0, F.lit(a)) for a in axes])
    value = F.coalesce(*[F.when(F.col(f"other_{a}") == 0, F.col(a)) for a in axes])
    return by_axis.select(axis.alias("axis"), value.alias("value"), "score", "pos", "neg").where(F.col("value").isNotNull())


def stratified(df: DataFrame, threshold: float = config.DEFAULT_THRESHOLD, costs: Costs = Costs(), min_rows: int = MIN_STRATUM) -> DataFrame:
    """Rows, rate, AUC, average precision and cost of every stratum of every axis, in one job.

    Everything follows from the counts per (axis, value, score), so rows are shuffled once, reduced.
    """
    keys = ["axis", "value"]
    hit = F.col("score") >= threshold
    some = lambda when, c: F.sum(F.when(when, F.col(c)).otherwise(0))
    cells = {"tp": some(hit, "pos"), "fp": some(hit, "neg"), "fn": some(~hit, "pos"), "tn": some(~hit, "neg")}
    table = ranking_metrics(roc_points(stratum_counts(df), keys), keys, cells)
    spark = df.sparkSession
    fixed = []
    if "TransactionAmt" in df.columns:
        fixed += [("amount_bucket", label) for label, _, _ in AMOUNT_STRATA]
    if "id_01" in df.columns:
        fixed += [("identity_coverage", v) for v in ("has_identity", "no_identity")]
    # Fixed strata are reported even when empty.
    if fixed:
        table = table.join(F.broadcast(spark.createDataFrame(fixed, "axis string, value string")), keys, "full")
    table = table.fillna(0, ["tp", "fp", "fn", "tn"])
    n, n_pos = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"), F.col("tp") + F.col("fn")
    total = costs.total(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))
    return table.select(
        *keys, n.alias("n_rows"), n_pos.alias("n_pos"), ratio(n_pos, n).alias("fraud_rate"),
        F.when(n >= min_rows, F.col("auc")).alias("auc"), F.when(n >= min_rows, F.col("average_precision")).alias("pr_auc"),
        total.alias("total_cost"), ratio(total, n).alias("cost_per_txn"))


HIGHER_IS_WORSE = ("cost_per_txn", "total_cost")


def zscore_table(table: DataFrame, metrics: list[str]) -> DataFrame:
    """Per metric, how far each stratum is from the mean of the strata, positive meaning worse."""
    long = table.select("axis", "value", *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(["axis", "value"], metrics, "metric", "x")
    stats = long.groupBy("metric").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.count("x").alias("n"))
    z = (F.col("x") - F.col("mean")) / F.nullif(F.col("std"), F.lit(0.0))
    signed = F.when(F.col("metric").isin(*HIGHER_IS_WORSE), z).otherwise(-z)
    flat = (F.col("n") < 2) | (F.col("std") == 0)
    return long.join(stats, "metric").select("axis", "value", "metric", F.when(F.col("x").isNotNull(), F.when(flat, F.lit(0.0)).otherwise(signed)).alias("z"))
