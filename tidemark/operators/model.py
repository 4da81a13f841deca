"""Training, scoring and explaining with MLlib."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions.numeric import ratio
from tidemark.operators.calibrate import fit_isotonic, isotonic, probability
from tidemark.operators.leakcheck import hash_order
from tidemark.operators.profile import medians
from tidemark.operators.ranking import ranking_metrics, roc_points, score_counts
from tidemark.session import cut_lineage, scratch_path

LABEL = "isFraud"


def class_weight(df: DataFrame, label: str = LABEL) -> float:
    """Negatives per positive; both classes must occur."""
    row = df.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).first()
    if not row["p"] or not row["n"]:
        raise ValueError("training needs both classes")
    return row["n"] / row["p"]


def assembled(df: DataFrame, features: list[str], fill: dict[str, float]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features").transform(df.fillna(fill, [c for c in features if c in fill]))


def train_boosted(train: DataFrame, val: DataFrame, features: list[str], label: str = LABEL, rounds: int = 20, depth: int = 4,
                  step: float = 0.1, subsample: float = 1.0, columns: float = 1.0, least_rows: int = 1, least_gain: float = 0.0,
                  least_weight: float = 0.0, bins: int = 32, seed: int = config.SEED):
    """Boosted trees weighted by class, stopped by the validation rows. Returns (model, fill values).

    `columns` is the share of features a split looks at, `least_rows` and `least_weight` what a leaf must hold,
    `least_gain` what a split must gain.
    """
    fill = {c: -999.0 for c in features}
    weight = class_weight(train, label)
    both = train.withColumn("is_val", F.lit(False)).unionByName(val.withColumn("is_val", F.lit(True)))
    both = both.withColumn("w", F.when(F.col(label) == 1, weight).otherwise(1.0)).withColumn(label, F.col(label).cast("double"))
    x = assembled(both.select(*[F.col(c).cast("double").alias(c) for c in features], label, "w", "is_val"), features, fill)
    gbt = GBTClassifier(featuresCol="features", labelCol=label, weightCol="w", validationIndicatorCol="is_val", maxIter=rounds,
                        maxDepth=depth, stepSize=step, subsamplingRate=subsample, featureSubsetStrategy="all" if columns >= 1 else str(columns),
                        minInstancesPerNode=least_rows, minInfoGain=least_gain, minWeightFractionPerNode=least_weight, maxBins=bins, seed=seed)
    return gbt.fit(x), fill


def score_rows(df: DataFrame, model, features: list[str], fill: dict[str, float], out: str = "p") -> DataFrame:
    x = assembled(df.withColumns({c: F.col(c).cast("double") for c in features}), features, fill)
    return probability(model.transform(x), out).drop("features", "rawPrediction", "probability", "prediction")


def decide(df: DataFrame, threshold: float, version: str, p: str = "p") -> DataFrame:
    """`block` at or above the threshold, with the model version."""
    return df.withColumns({"decision": F.when(F.col(p) >= threshold, "block").otherwise("allow"), "model_version": F.lit(version)})


@dataclass
class Scorer:
    """A boosted model, the calibration of its probabilities, and what fills missing features."""

    model: GBTClassificationModel
    calibration: DataFrame  # (score, value), as `fit_isotonic` gives it
    features: list[str]
    fill: dict[str, float]

    def probabilities(self, df: DataFrame, out: str = "p") -> DataFrame:
        raw = score_rows(df, self.model, self.features, self.fill, "__raw")
        return isotonic(raw, self.calibration, "__raw", out).drop("__raw")

    def decisions(self, df: DataFrame, threshold: float, version: str) -> DataFrame:
        return decide(self.probabilities(df), threshold, version)

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        self.calibration.write.mode("overwrite").parquet(f"{path}/calibration")
        spark = SparkSession.active()
        spark.createDataFrame([(self.features, self.fill)], "features array<string>, fill map<string, double>").coalesce(1).write.mode("overwrite").json(f"{path}/inputs")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Scorer:
        r = spark.read.schema("features array<string>, fill map<string, double>").json(f"{path}/inputs").first()
        return Scorer(GBTClassificationModel.load(f"{path}/model"), spark.read.parquet(f"{path}/calibration"), list(r["features"]), dict(r["fill"]))


def fit_scorer(train: DataFrame, val: DataFrame, features: list[str], label: str = LABEL, **parameters) -> Scorer:
    """Train on the first rows; the others stop the boosting and fit the calibration."""
    model, fill = train_boosted(train, val, features, label, **parameters)
    raw = score_rows(val, model, features, fill, "__raw")
    return Scorer(model, fit_isotonic(raw, label, "__raw"), features, fill)


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    return ranking_metrics(roc_points(score_counts(df, label, score)))


def importances(model, features: list[str], df: DataFrame, families: dict[str, str] | None = None) -> DataFrame:
    """All features by importance, highest first, with the family given for them."""
    known = families or {}
    rows = [(f, float(v), known.get(f, OTHER)) for f, v in zip(features, model.featureImportances.toArray())]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double, family string").orderBy(F.desc("importance"), "feature")


RAW, OTHER = "raw", "other"


def feature_families(made: list[tuple[str, str]], raw: list[str]) -> dict[str, str]:
    """Family of each known column: the generator that made it, by (generator, feature), or `raw` for an input column."""
    return {c: RAW for c in raw} | {feature: generator for generator, feature in made}


def fit_scaler(df: DataFrame, columns: list[str]) -> list[tuple[str, float, float, float]]:
    """(column, median, mean, std) with the mean and deviation taken after median imputation."""
    mid = medians(df, columns)
    aggs = []
    for c in columns:
        filled = F.coalesce(F.col(c).cast("double"), F.lit(mid.get(c)))
        aggs += [F.avg(filled).alias(f"{c}__m"), F.stddev_pop(filled).alias(f"{c}__s")]
    row = df.agg(*aggs).first()
    return [(c, mid.get(c), row[f"{c}__m"], row[f"{c}__s"]) for c in columns]


def scaled(df: DataFrame, fitted: list[tuple[str, float, float, float]]) -> DataFrame:
    """Impute, standardise, and put 0 where nothing is known."""
    cols = {}
    for c, mid, mean, std in fitted:
        if mean is None:
            cols[c] = F.lit(0.0)
            continue
        filled = F.coalesce(F.col(c).cast("double"), F.lit(mid))
        cols[c] = F.coalesce((filled - F.lit(mean)) / F.lit(std if std else 1.0), F.lit(0.0))
    return df.withColumns(cols)


def linear_contributions(df: DataFrame, fitted: list[tuple[str, float, float, float]], weights: dict[str, float], id_col: str = "TransactionID") -> DataFrame:
    """Long table (id, feature, value): coefficient times standardised value."""
    names = [c for c, *_ in fitted]
    z = scaled(df, fitted).select(id_col, *[(F.col(c) * F.lit(weights[c])).alias(c) for c in names])
    return z.unpivot([id_col], names, "feature", "value")


@dataclass
class PathContributions:
    """What each leaf of each boosted tree owes to the features on its path.

    A tree's value moves from the root's mean to the leaf's; each step is owed to the feature split on. Summed over
    the trees, the contributions of a row and `base` add up to its raw score. The tables have one row per leaf.
    """

    features: list[str]
    base: float
    leaves: list[np.ndarray]  # of each tree: one row per leaf, one column per feature

    @staticmethod
    def of(model: GBTClassificationModel, features: list[str]) -> PathContributions:
        spark, path = SparkSession.active(), scratch_path(SparkSession.active(), "trees")
        model.write().save(path)
        trees: dict[int, dict[int, dict]] = {}
        for r in spark.read.parquet(f"{path}/data").collect():  # a row per node
            trees.setdefault(r["treeID"], {})[r["nodeData"]["id"]] = r["nodeData"].asDict(recursive=True)
        base, tables = 0.0, []
        for (_, nodes), weight in zip(sorted(trees.items()), model.treeWeights):
            base += weight * nodes[0]["prediction"]
            made: list[np.ndarray] = []
            waiting = [(0, np.zeros(len(features)))]
            while waiting:  # left first, which is the order of MLlib's leaf numbers
                k, owed = waiting.pop()
                node = nodes[k]
                if node["leftChild"] < 0:
                    made.append(owed)
                    continue
                for child in (node["rightChild"], node["leftChild"]):
                    step = np.zeros(len(features))
                    step[node["split"]["featureIndex"]] = weight * (nodes[child]["prediction"] - node["prediction"])
                    waiting.append((child, owed + step))
            tables.append(np.array(made))
        return PathContributions(features, base, tables)


def boosted_contributions(df: DataFrame, model: GBTClassificationModel, features: list[str], fill: dict[str, float], id_col: str = "TransactionID") -> DataFrame:
    """Long table (id, feature, value) of a boosted model's scores; a row's values and the base add up to its raw score."""
    paths = PathContributions.of(model, features)
    shared = df.sparkSession.sparkContext.broadcast(paths.leaves)

    @F.arrow_udf("array<double>")
    def added(leaf: pa.Array) -> pa.Array:
        tables = shared.value
        at = leaf.flatten().to_numpy().astype(np.int64).reshape(-1, len(tables))
        total = sum(table[at[:, t]] for t, table in enumerate(tables))
        return pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(total).ravel()), len(features)).cast(pa.list_(pa.float64()))

    x = assembled(df.select(id_col, *[F.col(c).cast("double").alias(c) for c in features]), features, fill)
    owed = model.copy().setLeafCol("leaf").transform(x).select(id_col, added(vector_to_array("leaf")).alias("v"))
    pairs = F.arrays_zip(F.array(*[F.lit(c) for c in features]).alias("feature"), F.col("v").alias("value"))
    return owed.select(id_col, F.explode(pairs).alias("p")).select(id_col, "p.feature", "p.value")


def fit_linear(df: DataFrame, features: list[str], label: str = LABEL) -> tuple[list, dict[str, float], float]:
    """Scaler, coefficients and intercept of a logistic model on standardised features."""
    fitted = fit_scaler(df, features)
    x = VectorAssembler(inputCols=features, outputCol="features").transform(
        scaled(df, fitted).select(*features, F.col(label).cast("double").alias("y")))
    model = LogisticRegression(labelCol="y", regParam=1e-4, maxIter=100).fit(x)
    return fitted, dict(zip(features, [float(v) for v in model.coefficients.toArray()])), float(model.intercept)


def top_contributions(long: DataFrame, k: int = 3, id_col: str = "TransactionID") -> DataFrame:
    """The k strongest non-zero contributions per row with their direction. A row has few features."""
    if k < 0:
        raise ValueError("k must not be negative")
    entries = F.struct((-F.abs("value")).alias("order"), F.col("feature"), F.col("value"))
    ranked = long.where(F.col("value") != 0).groupBy(id_col).agg(F.slice(F.array_sort(F.collect_list(entries)), 1, max(k, 1)).alias("top"))
    if k == 0:
        ranked = ranked.limit(0)
    out = ranked.select(id_col, F.posexplode("top").alias("pos", "t"))
    return out.select(id_col, (F.col("pos") + 1).alias("rank"), "t.feature", "t.value", F.when(F.col("t.value") > 0, "high").otherwise("low").alias("direction"))


def reason_table(spark) -> DataFrame:
    rows = [(f, "high", t) for f, t in config.REASON_HIGH.items()] + [(f, "low", t) for f, t in config.REASON_LOW.items()]
    return spark.createDataFrame(rows, "feature string, direction string, reason string")


def reasons(top: DataFrame, id_col: str = "TransactionID") -> DataFrame:
    """Reason texts per row in contribution order; features without a text are skipped."""
    hit = top.join(F.broadcast(reason_table(top.sparkSession)), ["feature", "direction"])
    return hit.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "reason"))), lambda x: x["reason"]).alias("reasons"))


def sampled_parameters(n: int, seed: int = config.SEED) -> list[dict[str, float]]:
    """Seeded draws of the nine parameters; step, gain and leaf weight evenly on a log scale."""
    rng = np.random.default_rng(seed)
    log = lambda lo, hi: float(np.exp(rng.uniform(np.log(lo), np.log(hi))))
    return [{"depth": int(rng.integers(2, 6)), "step": round(log(0.01, 0.3), 4), "rounds": int(rng.integers(5, 16)), "subsample": float(round(rng.uniform(0.6, 1.0), 2)),
             "columns": float(round(rng.uniform(0.5, 1.0), 2)), "least_rows": int(rng.integers(1, 101)), "least_gain": log(1e-8, 1e-2), "least_weight": log(1e-6, 1e-2), "bins": int(rng.integers(16, 129))}
            for _ in range(n)]


SEARCH_SCHEMA = "trial int, depth int, step double, rounds int, subsample double, columns double, least_rows int, least_gain double, least_weight double, bins int, rung int, share double, auc double"


def trial_auc(train: DataFrame, val: DataFrame, features: list[str], label: str, parameters: dict[str, float]) -> float:
    model, fill = train_boosted(train, val, features, label, **parameters)
    return auc(score_rows(val, model, features, fill), label, "p").first()["auc"]


def search(train: DataFrame, val: DataFrame, features: list[str], trials: int, label: str = LABEL, at_once: int = 4, rungs: int = 3, keep: int = 3,
           measure: Callable[[DataFrame, DataFrame, list[str], str, dict[str, float]], float] = trial_auc) -> DataFrame:
    """Validation AUC of sampled parameter sets by successive halving, best first: one row per trial at the last rung it reached.

    The first rung trains every set on a share of the rows; the best of every `keep` sets go on to a rung with
    `keep` times the rows, until the last one trains on all. The share is a threshold on a hash of the id, so a
    rung's rows contain those of the rung before. Trials of a rung share the cluster, `at_once` at a time.
    """
    sets = sampled_parameters(trials)
    digits = F.conv(F.substring(hash_order(config.SEED, "TransactionID"), 1, 8), 16, 10).cast("long")
    alive, results = list(range(trials)), {}
    for rung in range(rungs):
        share = float(keep) ** (rung + 1 - rungs)
        rows = train if share >= 1 else cut_lineage(train.where(digits < int(share * (1 << 32))), "search-rung")
        with ThreadPoolExecutor(at_once) as pool:
            found = list(pool.map(lambda i: measure(rows, val, features, label, sets[i]), alive))
        for i, score in zip(alive, found):
            results[i] = (rung, share, score)
        best = sorted(alive, key=lambda i: (-(results[i][2] if results[i][2] is not None else -1.0), i))
        alive = best[: -(-len(alive) // keep)] if rung + 1 < rungs else best
    rows = [(i, *sets[i].values(), *results[i]) for i in range(trials)]
    return train.sparkSession.createDataFrame(rows, SEARCH_SCHEMA).orderBy(F.desc("rung"), F.desc("auc"), "trial")


def label_quality(df: DataFrame, features: list[str], folds: int = 3, label: str = LABEL, limit: float = 0.05) -> DataFrame:
    """Out-of-fold probability of each row's own label, flagged where it is small.

    Features and folds are written once: training passes over them many times, and none goes back to `df`.
    """
    from tidemark.operators.encode import exact_stratified_folds

    rows = cut_lineage(df.select("TransactionID", label, *[F.col(c).cast("double").alias(c) for c in features]), "quality-rows")
    x = cut_lineage(rows.join(exact_stratified_folds(rows, label=label, folds=folds).select("TransactionID", "fold"), "TransactionID"), "quality-folds")
    parts = None
    for k in range(folds):
        train, held = x.where(F.col("fold") != k), x.where(F.col("fold") == k)
        # Every fourth training row, by id hash, stops the boosting.
        stop = F.pmod(F.xxhash64("TransactionID"), F.lit(4)) == 0
        model, fill = train_boosted(train.where(~stop), train.where(stop), features, label, rounds=10)
        scored = score_rows(held, model, features, fill).select("TransactionID", F.when(F.col(label) == 1, F.col("p")).otherwise(1 - F.col("p")).alias("quality_score"))
        parts = scored if parts is None else parts.unionByName(scored)
    return parts.withColumn("below_threshold", F.col("quality_score") < limit)


def share_below(quality: DataFrame) -> DataFrame:
    return quality.agg(F.count(F.lit(1)).alias("n"), F.count_if("below_threshold").alias("n_below")).withColumn("pct_below", ratio(F.col("n_below") * 100.0, F.col("n")))
