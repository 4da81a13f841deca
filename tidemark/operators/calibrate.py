"""Score calibration: logistic (MLlib), isotonic (merged convex hulls), and the choice between them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions.ordered import between, cumulative
from tidemark.operators.clean import stratified_take
from tidemark.operators.ranking import log_loss
from tidemark.session import cut_lineage

HOLDOUT = 0.2


def _weighted(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row per (score, label) with its number of rows: both fits depend on nothing else."""
    return df.groupBy(F.col(score).cast("double").alias("score"), F.col(label).cast("double").alias("label")).agg(F.count(F.lit(1)).cast("double").alias("w"))


def fit_platt(df: DataFrame, label: str, score: str) -> tuple[float, float]:
    """Slope and intercept of an unregularised logistic fit on the score."""
    x = _weighted(df, label, score).withColumn("x", array_to_vector(F.array("score")))
    model = LogisticRegression(featuresCol="x", labelCol="label", weightCol="w", regParam=0.0, maxIter=1000, tol=1e-12).fit(x)
    return float(model.coefficients[0]), float(model.intercept)


def platt(score: Column, slope: float, intercept: float) -> Column:
    return 1.0 / (1.0 + F.exp(-(score * slope + intercept)))


HULL = "x double, y double, w double, hits double, lo double, hi double"  # an edge of a hull: where it starts, its extent, the scores it spans
FAN_IN = 8  # hulls that are merged by one task


def lower_hull(edges: pa.Table) -> pa.Table:
    """The lower convex hull of edges that follow each other along the cumulative sum diagram.

    An edge that isn't steeper than the one before it is joined with it, and so on backwards: slopes then increase.
    """
    edges = edges.sort_by("x")
    columns = [edges.column(c).to_numpy() for c in ("x", "y", "w", "hits", "lo", "hi")]
    kept: list[list[float]] = []
    for edge in zip(*(c.tolist() for c in columns)):
        top = list(edge)
        while kept and kept[-1][3] * top[2] >= top[3] * kept[-1][2]:
            x, y, w, hits, lo, _ = kept.pop()
            top = [x, y, w + top[2], hits + top[3], lo, top[5]]
        kept.append(top)
    out = np.array(kept, float).reshape(-1, 6).T
    return pa.table({c: pa.array(v) for c, v in zip(("x", "y", "w", "hits", "lo", "hi"), out)})


def fit_isotonic(df: DataFrame, label: str, score: str) -> DataFrame:
    """Increasing step-free fit: (score, value) at both ends of each block of equal values.

    The fit is the slope of the greatest convex minorant of the points (rows so far, labels so far) in order of
    score. Distinct scores are dealt into ranges, each range keeps the lower hull of its stretch of the
    diagram, and neighbouring hulls are merged, FAN_IN at a time, until one is left. A task holds blocks of
    the fit of its ranges, never scores that were joined already.
    """
    spark = df.sparkSession
    counts = df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("score")).agg(F.count(F.lit(1)).cast("double").alias("w"), F.sum(F.col(label).cast("double")).alias("hits"))
    edges = cumulative(counts, "score", ["w", "hits"], with_range=True)
    hulls = edges.select("range", F.col("before_w").cast("double").alias("x"), F.col("before_hits").cast("double").alias("y"), "w", "hits", F.col("score").alias("lo"), F.col("score").alias("hi"))
    left = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hulls = hulls.groupBy("range").applyInArrow(_kept_range, f"range int, {HULL}")
    while left > 1:
        hulls = hulls.withColumn("range", F.floor(F.col("range") / FAN_IN).cast("int")).groupBy("range").applyInArrow(_kept_range, f"range int, {HULL}")
        left = -(-left // FAN_IN)
    value = F.col("hits") / F.col("w")
    ends = F.array(F.struct(F.col("lo").alias("score"), value.alias("value")), F.struct(F.col("hi").alias("score"), value.alias("value")))
    return cut_lineage(hulls.select(F.explode(F.array_distinct(ends)).alias("e")).select("e.*"), "isotonic")


def _kept_range(edges: pa.Table) -> pa.Table:
    made = lower_hull(edges)
    return made.add_column(0, "range", pa.array([edges.column("range")[0].as_py()] * made.num_rows, pa.int32()))


def isotonic(df: DataFrame, model: DataFrame, score: str, out: str) -> DataFrame:
    """Calibrated scores: linear between the fitted ones; outside their range the end values hold, and results stay in [0, 1]."""
    given = F.col(f"`{score}`").cast("double")
    found = between(df.select(given.alias("_score")).distinct(), "_score", model, "score", "value")
    a, b = F.col("below"), F.col("above")
    inner = a["value"] + (b["value"] - a["value"]) * (F.col("_score") - a["score"]) / F.nullif(b["score"] - a["score"], F.lit(0.0))
    value = F.coalesce(inner, a["value"], b["value"])
    found = found.select("_score", F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)).alias("_value"))
    names = [c for c in df.columns if c != out]
    return df.join(found, given == F.col("_score"), "left").select(*[F.col(f"`{c}`") for c in names], F.col("_value").alias(out))


def hold_out(df: DataFrame, label: str, fraction: float = HOLDOUT, seed: int = config.SEED) -> DataFrame:
    """Add `held`: an exact stratified share of the rows, by seeded hash order."""
    part = stratified_take(df, fraction, label, seed).select("TransactionID", F.lit(True).alias("held"))
    return df.join(part, "TransactionID", "left").fillna(False, ["held"])


def method_losses(df: DataFrame, label: str, score: str) -> DataFrame:
    """Log loss of no, logistic and isotonic calibration on the held-out share, in one row."""
    x = hold_out(df, label)
    fit, held = x.where(~F.col("held")), x.where(F.col("held"))
    slope, intercept = fit_platt(fit, label, score)
    model = fit_isotonic(fit, label, score)
    y, s = F.col(label).cast("double"), F.col(score)
    scored = isotonic(held, model, score, "iso").withColumn("platt", platt(s, slope, intercept))
    return scored.agg(log_loss(y, s).alias("none"), log_loss(y, F.col("platt")).alias("platt"), log_loss(y, F.col("iso")).alias("isotonic"))


def select_method(df: DataFrame, label: str, score: str) -> tuple[str, object]:
    """The method with the least held-out loss (earlier wins a tie), refitted on all rows."""
    losses = method_losses(df, label, score).first().asDict()
    best = min(("none", "platt", "isotonic"), key=lambda m: losses[m])
    if best == "platt":
        return best, fit_platt(df, label, score)
    if best == "isotonic":
        return best, fit_isotonic(df, label, score)
    return best, None


def probability(df: DataFrame, out: str = "p") -> DataFrame:
    """The positive class probability of an MLlib classifier's output."""
    return df.withColumn(out, vector_to_array("probability")[1])
