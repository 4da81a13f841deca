"""Money: confusion costs, threshold sweeps and their optimum, sensitivity, savings."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config

# The sweep and the gates.
N_THRESHOLDS, LOWEST, HIGHEST = 99, 0.01, 0.99
MONTHLY_VOLUME = 1_000_000
SAVINGS_FLOOR = 500_000.0
BAND = (0.3, 0.5)
SPREAD_CEILING = 0.2


@dataclass(frozen=True)
class Costs:
    fn: float = config.FN_COST
    fp: float = config.FP_COST
    tp: float = config.TP_COST
    tn: float = config.TN_COST

    def total(self, tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
        return fn * self.fn + fp * self.fp + tp * self.tp + tn * self.tn

    def bayes_threshold(self) -> float:
        """Where blocking and allowing cost the same on average."""
        return self.fp / (self.fp + self.fn - self.tp)


def default_thresholds() -> list[float]:
    return [float(t) for t in np.linspace(LOWEST, HIGHEST, N_THRESHOLDS)]


def confusion(df: DataFrame, label: str, predicted: Column, costs: Costs = Costs(), groups: list[str] | None = None) -> DataFrame:
    y = F.col(label) == 1
    counts = df.groupBy(*(groups or [])).agg(
        F.count_if(y & predicted).alias("tp"), F.count_if(~y & predicted).alias("fp"),
        F.count_if(y & ~predicted).alias("fn"), F.count_if(~y & ~predicted).alias("tn"))
    return with_cost(counts, costs)


def with_cost(counts: DataFrame, costs: Costs) -> DataFrame:
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    total = costs.total(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))
    return counts.withColumn("total_cost", total).withColumn("cost_per_txn", F.when(n > 0, F.col("total_cost") / n).otherwise(F.lit(0.0)))


def edges_at_or_below(x: Column, edges: list[float], start: int = 0) -> Column:
    """How many sorted edges are <= x, by halving: seven comparisons for ninety-nine edges."""
    if not edges:
        return F.lit(start)
    mid = len(edges) // 2
    return F.when(x >= F.lit(edges[mid]), edges_at_or_below(x, edges[mid + 1:], start + mid + 1)).otherwise(edges_at_or_below(x, edges[:mid], start))


def sweep(df: DataFrame, label: str, score: str, thresholds: list[float] | None = None, costs: Costs = Costs()) -> DataFrame:
    """Confusion counts and cost at every threshold (predict positive at or above it), in one scan.

    Rows are counted by how many thresholds they reach; suffix sums over that table of at most
    `len(thresholds) + 1` rows give each threshold's counts.
    """
    taus = thresholds if thresholds is not None else default_thresholds()
    if sorted(set(taus)) != list(taus):
        raise ValueError("thresholds must be distinct and ascending")
    y = F.col(label) == 1
    cells = df.groupBy(edges_at_or_below(F.col(score), taus).alias("reached")).agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))
    grid = df.sparkSession.createDataFrame([(i + 1, t) for i, t in enumerate(taus)] + [(0, None)], "i int, threshold double")
    table = grid.join(F.broadcast(cells), F.col("i") == F.col("reached"), "left").fillna(0, ["pos", "neg"])
    above = Window.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)  # one row per threshold
    whole = Window.partitionBy()
    counts = table.select(
        "i", "threshold", F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"),
        (F.sum("pos").over(whole) - F.sum("pos").over(above)).alias("fn"), (F.sum("neg").over(whole) - F.sum("neg").over(above)).alias("tn"))
    return with_cost(counts.where(F.col("i") > 0).drop("i"), costs)


def optimum(curve: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """The cheapest threshold; the larger one on a tie."""
    best = F.min_by(F.struct("threshold", "total_cost", "cost_per_txn"), F.struct(F.col("total_cost"), -F.col("threshold")))
    out = curve.groupBy(*(groups or [])).agg(best.alias("b"))
    return out.select(*(groups or []), F.col("b.threshold").alias("optimal_threshold"), F.col("b.total_cost").alias("optimal_total_cost"), F.col("b.cost_per_txn").alias("optimal_cost_per_txn"))


def sensitivity(df: DataFrame, label: str, score: str, ranges: dict[str, list[float]] | None = None, costs: Costs = Costs(),
                thresholds: list[float] | None = None) -> DataFrame:
    """The optimum for every combination of cost values; axes left out keep their own cost.

    The combinations are exploded over the threshold counts, a table of fixed size.
    """
    base = {"fraud_cost": costs.fn, "fp_cost": costs.fp, "tp_cost": costs.tp}
    if ranges is None:
        ranges = {k: [v * m for m in config.COST_MULTIPLIERS] for k, v in base.items()}
    unknown = sorted(set(ranges) - set(base))
    if unknown:
        raise ValueError(f"unknown cost axes: {unknown}")
    if any(v < 0 for vs in ranges.values() for v in vs):
        raise ValueError("costs must not be negative")
    axes = {k: ranges.get(k, [v]) for k, v in base.items()}
    curve = sweep(df, label, score, thresholds, costs).select("threshold", "tp", "fp", "fn", "tn")
    for name, values in axes.items():
        curve = curve.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))
    total = F.col("fn") * F.col("fraud_cost") + F.col("fp") * F.col("fp_cost") + F.col("tp") * F.col("tp_cost") + F.col("tn") * F.lit(costs.tn)
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    priced = curve.withColumn("total_cost", total).withColumn("cost_per_txn", F.when(n > 0, F.col("total_cost") / n).otherwise(0.0))
    return optimum(priced, list(base))


def savings(curve: DataFrame, cells: DataFrame, monthly: int = MONTHLY_VOLUME, baseline: float = 0.5) -> DataFrame:
    """Yearly savings of the optimum over the threshold nearest `baseline`, spread of optima, and the gates."""
    best = optimum(curve)
    near = curve.agg(F.min_by("cost_per_txn", F.struct(F.abs(F.col("threshold") - baseline), F.col("threshold"))).alias("baseline_cost_per_txn"))
    spread = cells.agg((F.max("optimal_threshold") - F.min("optimal_threshold")).alias("spread"))
    saved = (F.col("baseline_cost_per_txn") - F.col("optimal_cost_per_txn")) * (monthly * 12)
    return best.crossJoin(near).crossJoin(spread).select(
        "optimal_threshold", "optimal_cost_per_txn", "baseline_cost_per_txn", saved.alias("annual_savings"), "spread",
        F.col("optimal_threshold").between(*BAND).alias("band_gate"), (saved >= SAVINGS_FLOOR).alias("savings_gate"), (F.col("spread") < SPREAD_CEILING).alias("spread_gate"))


def score_problems(df: DataFrame, score: str, label: str) -> DataFrame:
    """Counts of scores outside [0, 1] or missing, and of labels that are not 0 or 1."""
    s, y = F.col(score), F.col(label)
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(s.isNull() | F.isnan(s)).alias("missing_scores"),
        F.count_if((s < 0) | (s > 1)).alias("scores_outside"), F.count_if(y.isNull() | ~y.isin(0, 1)).alias("bad_labels"))


def require_scores(df: DataFrame, score: str, label: str) -> None:
    row = score_problems(df, score, label).first()
    if row["n"] == 0 or row["missing_scores"] or row["scores_outside"] or row["bad_labels"]:
        raise ValueError(f"unusable scores or labels: {row.asDict()}")
