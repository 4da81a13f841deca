"""Drift against a stored baseline, performance against expected values, champion against challenger."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions.numeric import ratio
from tidemark.functions.ordered import exact_quantiles, quantiles_of_counts
from tidemark.operators.cost import Costs
from tidemark.operators.profile import long_form
from tidemark.operators.ranking import psi_term, ranking_metrics, roc_points, score_counts
from tidemark.session import cut_lineage

BASELINE_COLUMNS = ["feature_name", "bin_idx", "edge_low", "edge_high", "baseline_pct", "n_baseline"]


def _bin_of(value: Column, interior: Column) -> Column:
    """Bin number among at most a dozen interior edges; a value on an edge goes up."""
    return F.size(F.filter(interior, lambda e: value >= e))


def drift_baseline(df: DataFrame, features: list[str], bins: int = config.PSI_BINS) -> DataFrame:
    """One row per feature and quantile bin; features that are absent, all null or constant are left out."""
    present = [f for f in features if f in df.columns]
    if not present:
        raise ValueError("none of the features is in the frame")
    # Edges, bins and totals all follow from the counts per value, which are made once.
    counts = cut_lineage(long_form(df, present).where(F.col("v").isNotNull()).groupBy("column", "v").agg(F.count(F.lit(1)).alias("n")), "drift-counts")
    probs = [float(p) for p in np.linspace(0.0, 1.0, bins + 1)]
    q = quantiles_of_counts(counts, "v", "n", probs, ["column"])
    # At most bins + 1 edges per feature.
    edges = q.groupBy("column").agg(F.array_sort(F.collect_set("quantile")).alias("edges")).where(F.size("edges") >= 2)
    interior = F.slice("edges", F.lit(2), F.size("edges") - 2)
    filled = counts.join(F.broadcast(edges), "column").groupBy("column", _bin_of(F.col("v"), interior).alias("bin_idx")).agg(F.sum("n").alias("n"))
    bins_all = edges.select("column", "edges", F.explode(F.sequence(F.lit(0), F.size("edges") - 2)).alias("bin_idx"))
    total = counts.groupBy("column").agg(F.sum("n").alias("n_baseline"))
    out = bins_all.join(filled, ["column", "bin_idx"], "left").join(total, "column")
    last = F.size("edges") - 2
    inf = F.lit(float("inf"))
    return out.select(
        F.col("column").alias("feature_name"), "bin_idx",
        F.when(F.col("bin_idx") == 0, -inf).otherwise(F.element_at("edges", F.col("bin_idx") + 1)).alias("edge_low"),
        F.when(F.col("bin_idx") == last, inf).otherwise(F.element_at("edges", F.col("bin_idx") + 2)).alias("edge_high"),
        (F.coalesce("n", F.lit(0)) / F.col("n_baseline")).alias("baseline_pct"), "n_baseline")


def baseline_problems(baseline: DataFrame) -> DataFrame:
    """Features whose bins are not numbered 0..n-1 once each, or whose shares do not add up."""
    missing = [c for c in BASELINE_COLUMNS if c not in baseline.columns]
    if missing:
        raise ValueError(f"baseline lacks columns: {missing}")
    g = baseline.groupBy("feature_name").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("bin_idx").alias("d"), F.min("bin_idx").alias("lo"), F.max("bin_idx").alias("hi"), F.sum("baseline_pct").alias("pct"))
    bad_bins = (F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1) | (F.col("d") != F.col("n"))
    bad_pct = F.abs(F.col("pct") - 1.0) > 1e-9
    return g.where(bad_bins | bad_pct).select("feature_name", F.when(bad_bins, "bins").otherwise("shares").alias("problem"))


def feature_psi(recent: DataFrame, baseline: DataFrame, features: list[str] | None = None) -> DataFrame:
    """(feature_name, psi, n_recent); NULL psi for a feature without baseline, column or recent values.

    A baseline has one row per feature and bin. It is read once and becomes literal edges, so recent
    rows are binned where they are read: one scan, and a shuffle of one row per feature, bin and task.
    """
    spark = recent.sparkSession
    held: dict[str, list] = {}
    for r in baseline.select("feature_name", "bin_idx", "edge_high", "baseline_pct").orderBy("feature_name", "bin_idx").collect():
        held.setdefault(r["feature_name"], []).append(r)
    names = features if features is not None else sorted(held)
    present = [f for f in names if f in held and f in recent.columns]
    shares = [(f, r["bin_idx"], r["baseline_pct"]) for f in present for r in held[f]]
    known = spark.createDataFrame([(f,) for f in names], "feature_name string")
    if not present:
        return known.withColumns({"psi": F.lit(None).cast("double"), "n_recent": F.lit(0).cast("long")})

    def binned(f: str) -> Column:
        v = F.col(f"`{f}`").cast("double")
        at = F.aggregate(F.array(*[F.lit(r["edge_high"]) for r in held[f][:-1]]).cast("array<double>"), F.lit(0), lambda n, e: n + (v >= e).cast("int"))
        return F.struct(F.lit(f).alias("feature_name"), F.when(v.isNotNull(), at).alias("bin_idx"))

    counts = recent.select(F.explode(F.array(*[binned(f) for f in present])).alias("b")).where("b.bin_idx IS NOT NULL").groupBy("b.feature_name", "b.bin_idx").agg(F.count(F.lit(1)).alias("n"))
    total = counts.withColumn("n_recent", F.sum("n").over(Window.partitionBy("feature_name")))
    wanted = F.broadcast(spark.createDataFrame(shares, "feature_name string, bin_idx int, baseline_pct double"))  # features x bins
    # Bins without recent values count as empty: they add what their share alone gives.
    per = total.groupBy("feature_name").agg(F.max("n_recent").alias("n_recent"), F.map_from_entries(F.collect_list(F.struct("bin_idx", "n"))).alias("held"))
    terms = per.join(wanted, "feature_name")
    value = terms.groupBy("feature_name").agg(
        F.sum(psi_term(F.col("baseline_pct"), F.coalesce(F.try_element_at("held", F.col("bin_idx")), F.lit(0)) / F.col("n_recent"))).alias("psi"), F.max("n_recent").alias("n_recent"))
    return known.join(value, "feature_name", "left").fillna(0, ["n_recent"])


def top_drift(table: DataFrame, k: int) -> DataFrame:
    return table.orderBy(F.desc_nulls_last("psi"), "feature_name").limit(k)


def drift_alerts(table: DataFrame, limit: float = config.PSI_ALERT) -> DataFrame:
    finite = F.col("psi").isNotNull() & ~F.isnan("psi") & (F.abs("psi") != float("inf"))
    return table.where(finite & (F.col("psi") > limit)).select("feature_name", "psi", F.lit(limit).alias("threshold"), "n_recent")


def recent_rows(df: DataFrame, n: int, time_col: str, id_col: str) -> DataFrame:
    """The last n labelled rows; n is a set window, so this is a bounded top-n."""
    return df.where(F.col("label").isNotNull()).orderBy(F.desc(time_col), F.desc(id_col)).limit(n)


def rolling_metrics(window: DataFrame, threshold: float = config.DEFAULT_THRESHOLD, costs: Costs = Costs()) -> DataFrame:
    """auc, auc_pr, cost and rows of a window; decisions are used where the column exists."""
    decided = F.col("decision") == 1 if "decision" in window.columns else F.col("score") >= threshold
    y = F.col("label") == 1
    cells = window.agg(F.count_if(y & decided).alias("tp"), F.count_if(~y & decided).alias("fp"), F.count_if(y & ~decided).alias("fn"), F.count_if(~y & ~decided).alias("tn"))
    ranks = ranking_metrics(roc_points(score_counts(window, "label", "score")))
    return cells.crossJoin(ranks).select(
        "auc", F.col("average_precision").alias("auc_pr"), costs.total(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")).alias("cost"),
        (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n_recent"))


def degradation(metrics: DataFrame, baselines: dict[str, float]) -> DataFrame:
    """(metric, baseline, current, degradation), positive meaning worse; baselines at or below 0 and NULL metrics are skipped."""
    long = metrics.select(*[F.col(m).cast("double").alias(m) for m in baselines]).unpivot([], list(baselines), "metric", "current")
    base = F.create_map(*[x for m, b in baselines.items() for x in (F.lit(m), F.lit(float(b)))])[F.col("metric")]
    out = long.withColumn("baseline", base).where(F.col("current").isNotNull() & (F.col("baseline") > 0))
    drop = (F.col("baseline") - F.col("current")) / F.col("baseline")
    return out.select("metric", "baseline", "current", F.when(F.col("metric") == "cost", -drop).otherwise(drop).alias("degradation"))


def performance_alerts(table: DataFrame, limit: float = config.DEGRADATION_ALERT) -> DataFrame:
    return table.where(F.col("degradation") > limit).withColumn("threshold", F.lit(limit))


def decision_cost(decision: Column, label: Column, costs: Costs = Costs()) -> Column:
    """Cost of one decision: blocking fraud, blocking good, letting fraud through."""
    return (F.when((decision == "block") & (label == 1), costs.tp).when((decision == "block") & (label == 0), costs.fp)
            .when((decision == "allow") & (label == 1), costs.fn).otherwise(0.0))


def agreement(df: DataFrame) -> DataFrame:
    """Share of equal decisions and correlation of scores (NULL when either is constant)."""
    # Not `corr`, which divides by zero for a constant column under ANSI rules.
    spread = F.nullif(F.stddev_pop("champion_score") * F.stddev_pop("shadow_score"), F.lit(0.0))
    varied = (F.min("champion_score") < F.max("champion_score")) & (F.min("shadow_score") < F.max("shadow_score"))
    return df.agg(
        F.count(F.lit(1)).alias("n_total"), F.avg((F.col("champion_decision") == F.col("shadow_decision")).cast("double")).alias("agreement_rate"),
        F.when(varied, F.covar_pop("champion_score", "shadow_score") / spread).alias("score_correlation"))


def cost_improvement(df: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """Mean cost of both on labelled rows and the relative saving (NULL if the champion costs nothing)."""
    labelled = df.where(F.col("is_fraud").isNotNull())
    out = labelled.agg(
        F.count(F.lit(1)).alias("n_labeled"), F.avg(decision_cost(F.col("champion_decision"), F.col("is_fraud"), costs)).alias("champion_cost_per_txn"),
        F.avg(decision_cost(F.col("shadow_decision"), F.col("is_fraud"), costs)).alias("shadow_cost_per_txn"))
    gain = F.when(F.col("champion_cost_per_txn") > 0, (F.col("champion_cost_per_txn") - F.col("shadow_cost_per_txn")) / F.col("champion_cost_per_txn"))
    return out.withColumn("cost_improvement", gain)


def difference_cells(df: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """Labelled rows per (label, champion, shadow) with the cost difference of the cell: at most eight rows."""
    diff = decision_cost(F.col("champion_decision"), F.col("is_fraud"), costs) - decision_cost(F.col("shadow_decision"), F.col("is_fraud"), costs)
    return df.where(F.col("is_fraud").isNotNull()).groupBy("is_fraud", "champion_decision", "shadow_decision").agg(F.count(F.lit(1)).alias("n"), F.max(diff).alias("diff"))


def paired_bootstrap(df: DataFrame, iterations: int = 10000, seed: int = config.SEED, costs: Costs = Costs()) -> DataFrame:
    """Mean, 95 % interval and two-sided p-value of the mean cost difference under resampling.

    A row's difference depends only on its cell, so resampling rows is drawing multinomial cell
    counts: each draw costs eight numbers, whatever the size of the table.
    """
    cells = [(r["n"], float(r["diff"])) for r in difference_cells(df, costs).orderBy("is_fraud", "champion_decision", "shadow_decision").collect()]
    if not cells:
        raise ValueError("no labelled rows")
    n = sum(c for c, _ in cells)
    shares = [c / n for c, _ in cells]
    values = np.array([d for _, d in cells])
    block = 250

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for b in pdf["id"]:
                rng = np.random.default_rng([seed, int(b)])
                counts = rng.multinomial(n, shares, size=block)
                yield pd.DataFrame({"draw": int(b) * block + np.arange(block), "diff": counts @ values / n})

    blocks = (iterations + block - 1) // block
    draws = df.sparkSession.range(blocks, numPartitions=min(blocks, 8)).mapInPandas(draw, "draw long, diff double").where(F.col("draw") < iterations)
    low, high = (F.percentile("diff", F.lit(p)) for p in (0.025, 0.975))  # over `iterations` numbers
    below, above = F.avg((F.col("diff") <= 0).cast("double")), F.avg((F.col("diff") >= 0).cast("double"))
    return draws.agg(F.avg("diff").alias("mean_diff"), low.alias("ci_low"), high.alias("ci_high"), (F.least(below, above) * 2.0).alias("p_value"))


# What a challenger must reach.
MIN_AGREEMENT, MIN_IMPROVEMENT, MAX_P = 0.85, 0.02, 0.05


def verdict(report: DataFrame) -> DataFrame:
    """Promotion decision from agreement_rate, cost_improvement and p_value.

    `criteria` has (criterion, value, needed, passed) of each; `reasons` says the same in words. A value that needs
    labels and has none fails.
    """
    rules = [("agreement_rate", MIN_AGREEMENT, True), ("cost_improvement", MIN_IMPROVEMENT, True), ("p_value", MAX_P, False)]
    ok = {c: F.coalesce(F.col(c) > need if above else F.col(c) < need, F.lit(False)) for c, need, above in rules}
    criteria = F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(c).cast("double").alias("value"), F.lit(need).alias("needed"), ok[c].alias("passed")) for c, need, _ in rules])

    def words(c: str, need: float, above: bool) -> Column:
        shown = F.coalesce(F.format_string("is %.4f", F.col(c)), F.lit("is unknown"))
        return F.concat(F.when(ok[c], "PASS").otherwise("FAIL"), F.lit(f" {c} "), shown, F.lit(f", {'above' if above else 'below'} {need:g} needed"))

    out = {f"{c.removesuffix('_rate')}_pass": x for c, x in ok.items()}
    return report.withColumns({**out, "promote": ok["agreement_rate"] & ok["cost_improvement"] & ok["p_value"], "criteria": criteria, "reasons": F.array(*[words(*r) for r in rules])})


def join_shadow(predictions: DataFrame, shadow: DataFrame, labels: DataFrame) -> DataFrame:
    """Decisions of both models with the label where it is known."""
    p = predictions.select("request_id", "txn_id", F.col("score").alias("champion_score"), F.col("decision").alias("champion_decision"))
    s = shadow.select("request_id", "shadow_score", "shadow_decision")
    return p.join(s, "request_id").join(labels.select("txn_id", "is_fraud"), "txn_id", "left")


def histogram(df: DataFrame, value: str, bounds: list[float], groups: list[Column] | None = None) -> DataFrame:
    """Cumulative counts at each upper bound and in total: (le, n)."""
    wide = df.groupBy(*(groups or [])).agg(
        *[F.count_if(F.col(value) <= b).alias(f"le{i}") for i, b in enumerate(bounds)], F.count(value).alias("le_inf"))
    keep = [c for c in wide.columns if not c.startswith("le")]
    pairs = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"le{i}").alias("n")) for i, b in enumerate(bounds)],
                    F.struct(F.lit(float("inf")).alias("le"), F.col("le_inf").alias("n")))
    return wide.select(*keep, F.explode(pairs).alias("h")).select(*keep, "h.*")


def bucket_quantile(buckets: Column, total: Column, q: float) -> Column:
    """Quantile read from an ascending array of cumulative (le, n) buckets, linear inside a bucket.

    The first bucket starts at 0; the open last bucket gives its lower bound.
    """
    rank = F.lit(q) * total
    i = F.size(F.filter(buckets, lambda x: x["n"] < rank))  # buckets wholly below the rank
    at, prev = F.get(buckets, i), F.get(buckets, i - 1)
    low = F.when(i == 0, F.lit(0.0)).otherwise(prev["le"])
    below = F.when(i == 0, F.lit(0)).otherwise(prev["n"])
    inside = low + (at["le"] - low) * (rank - below) / F.nullif(at["n"] - below, F.lit(0))
    return (F.when(total == 0, F.lit(None).cast("double")).when(at["le"] == float("inf"), low)
            .when((i == 0) & (at["le"] <= 0), at["le"]).otherwise(inside))


def histogram_quantile(hist: DataFrame, q: float, groups: list[str] | None = None) -> DataFrame:
    """The same from a table of (le, n) rows, per group."""
    groups = groups or []
    arr = F.array_sort(F.collect_list(F.struct("le", "n")))  # one entry per bucket
    g = hist.groupBy(*groups).agg(arr.alias("b"), F.max("n").alias("total"))
    return g.select(*groups, F.lit(q).alias("q"), bucket_quantile(F.col("b"), F.col("total"), q).alias("value"))
