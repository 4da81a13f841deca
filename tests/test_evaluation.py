"""Costs, ranking, calibration, strata, drift and comparison against small brute-force versions."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import calibrate as K
from tidemark.operators import cost as M
from tidemark.operators import monitor as D
from tidemark.operators import ranking as R


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(5)
    return [(i, int(rng.random() < 0.3), round(min(1.0, max(0.0, rng.gauss(0.5, 0.25))), 2)) for i in range(300)]


@pytest.fixture(scope="module")
def frame(spark, pairs):
    return spark.createDataFrame(pairs, "id long, y int, s double").cache()


def counts_at(pairs, t):
    return tuple(sum(1 for _, y, s in pairs if (y == 1) == pos and (s >= t) == hit) for pos, hit in ((True, True), (False, True), (True, False), (False, False)))


def test_sweep_and_optimum(frame, pairs):
    curve = {round(r["threshold"], 4): r for r in M.sweep(frame, "y", "s").collect()}
    assert len(curve) == 99
    best = None
    for t in M.default_thresholds():
        r = curve[round(t, 4)]
        tp, fp, fn, tn = counts_at(pairs, t)
        assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (tp, fp, fn, tn)
        cost = fn * 450 + fp * 35 + tp * 5
        assert r["total_cost"] == cost and math.isclose(r["cost_per_txn"], cost / 300)
        if best is None or cost <= best[0]:
            best = (cost, t)
    got = M.optimum(M.sweep(frame, "y", "s")).first()
    assert (got["optimal_total_cost"], got["optimal_threshold"]) == best


def test_sweep_rejects_disorder_and_empty_cost_is_zero(frame):
    with pytest.raises(ValueError):
        M.sweep(frame, "y", "s", [0.5, 0.2])
    assert M.confusion(frame.where("false"), "y", F.col("s") > 0.5).first()["cost_per_txn"] == 0.0


def test_sensitivity_guards_and_size(frame):
    assert M.sensitivity(frame, "y", "s").count() == 125
    assert M.sensitivity(frame, "y", "s", {"fp_cost": [1.0, 1000.0]}).count() == 2
    with pytest.raises(ValueError):
        M.sensitivity(frame, "y", "s", {"other": [1.0]})
    with pytest.raises(ValueError):
        M.sensitivity(frame, "y", "s", {"fp_cost": [-1.0]})


def test_cost_grows_with_missed_fraud(spark):
    def cost(n):
        return M.confusion(spark.createDataFrame([(1, 0.0)] * n, "y int, s double"), "y", F.col("s") > 0.5).first()["total_cost"]

    assert cost(1) < cost(2) < cost(5)


def test_score_guard(spark):
    with pytest.raises(ValueError):
        M.require_scores(spark.createDataFrame([(1, 1.2)], "y int, s double"), "s", "y")
    M.require_scores(spark.createDataFrame([(1, 1.0)], "y int, s double"), "s", "y")


def test_auc_and_average_precision(frame, pairs):
    pos, neg = [s for _, y, s in pairs if y], [s for _, y, s in pairs if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ap, tp_before = 0.0, 0
    for t in sorted({s for *_, s in pairs}, reverse=True):
        tp, fp, *_ = counts_at(pairs, t)
        ap += (tp - tp_before) / len(pos) * tp / (tp + fp)
        tp_before = tp
    got = R.ranking_metrics(R.roc_points(R.score_counts(frame, "y", "s"))).first()
    assert math.isclose(got["auc"], auc) and math.isclose(got["average_precision"], ap)
    one = R.ranking_metrics(R.roc_points(R.score_counts(frame.where("y = 1"), "y", "s"))).first()
    assert one["auc"] is None and one["average_precision"] is None


def test_recall_at_fpr(frame, pairs):
    points = R.roc_points(R.score_counts(frame, "y", "s"))
    p, n = sum(y for _, y, _ in pairs), sum(1 - y for _, y, _ in pairs)
    for target in (0.0, 0.1, 0.33, 1.0):
        want = max([tp / p for tp, fp, *_ in (counts_at(pairs, t) for t in {s for *_, s in pairs}) if fp / n <= target], default=0.0)
        assert math.isclose(R.recall_at_fpr(points, target).first()["recall"], want)


def test_precision_recall_at_k(frame, pairs):
    ordered = sorted(pairs, key=lambda r: (-r[2], r[0]))
    total = sum(y for _, y, _ in pairs)
    fractions = [0.001, 0.05, 0.333, 0.5, 1.0]
    got = {r["fraction"]: r for r in R.precision_recall_at(frame, "y", "s", fractions, "id").collect()}
    for f in fractions:
        k = max(1, math.ceil(f * len(pairs)))
        hits = sum(y for _, y, _ in ordered[:k])
        assert got[f]["k_count"] == k and math.isclose(got[f]["precision"], hits / k) and math.isclose(got[f]["recall"], hits / total)
    with pytest.raises(ValueError):
        R.precision_recall_at(frame, "y", "s", [0.0], "id")
    none = R.precision_recall_at(frame.where("y = 0"), "y", "s", [0.5], "id").first()
    assert none["recall"] == 0.0


def test_calibration_error_edges(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 0.1), (1, 1.0)], "y int, s double")
    assert sorted((r["bin"], r["n"]) for r in R.reliability(df, "y", "s").collect()) == [(0, 2), (9, 1)]
    assert math.isclose(R.calibration_error(df, "y", "s").first()["ece"], 2 / 3 * abs(0.05 - 0.5))
    assert R.calibration_error(df.where("false"), "y", "s").first()["ece"] == 0.0


def test_psi(spark, frame):
    assert abs(R.psi(frame, frame, "s").first()["psi"]) < 1e-12
    shifted = frame.withColumn("s", F.col("s") + 0.4)
    assert R.psi(frame, shifted, "s").first()["psi"] > 0.2
    flat = spark.createDataFrame([(1.0,)] * 5, "s double")
    assert R.psi(flat, frame, "s").first()["psi"] == 0.0


def test_stratified_degenerate_cases(spark):
    rows = [(i % 2, i / 200, 20.0, "W", None, 1.0, 1) for i in range(100)] + [(1, 0.9, 5000.0, None, "mobile", None, 2)] * 3
    df = spark.createDataFrame(rows, "label int, score double, TransactionAmt double, ProductCD string, DeviceType string, id_01 double, month int")
    got = {(r["axis"], r["value"]): r for r in R.stratified(df).collect()}
    assert got["amount_bucket", "$50-200"]["n_rows"] == 0 and got["amount_bucket", "$50-200"]["auc"] is None and got["amount_bucket", "$50-200"]["total_cost"] == 0
    assert got["product_cd", "(missing)"]["n_rows"] == 3 and got["product_cd", "(missing)"]["auc"] is None
    assert got["device_type", "(null)"]["auc"] is not None and got["identity_coverage", "no_identity"]["total_cost"] == 15.0
    assert ("month", "2") in got
    assert not any(r["axis"] == "device_type" for r in R.stratified(df.drop("DeviceType")).collect())


def test_zscores_flip_and_flatten(spark):
    df = spark.createDataFrame([("a", "1", 1.0, 5.0, 3.0), ("a", "2", 3.0, 7.0, 3.0), ("a", "3", None, None, 3.0)], "axis string, value string, auc double, total_cost double, same double")
    got = {(r["value"], r["metric"]): r["z"] for r in R.zscore_table(df, ["auc", "total_cost", "same"]).collect()}
    assert got["1", "auc"] == 1.0 and got["2", "auc"] == -1.0 and got["1", "total_cost"] == -1.0
    assert got["1", "same"] == 0.0 and got["3", "auc"] is None


def test_platt_solves_its_equations(frame):
    slope, intercept = K.fit_platt(frame, "y", "s")
    g = frame.withColumn("p", K.platt(F.col("s"), slope, intercept)).agg(F.avg(F.col("p") - F.col("y")), F.avg((F.col("p") - F.col("y")) * F.col("s"))).first()
    assert abs(g[0]) < 1e-6 and abs(g[1]) < 1e-6


def test_isotonic_is_increasing_and_clipped(spark, frame):
    model = K.fit_isotonic(frame, "y", "s")
    got = [r["c"] for r in K.isotonic(spark.createDataFrame([(i / 20 - 0.2,) for i in range(30)], "s double"), model, "s", "c").orderBy("s").collect()]
    assert got == sorted(got) and 0.0 <= got[0] and got[-1] <= 1.0


def pooled(points):
    """Pool adjacent violators over (score, rows, labels)."""
    blocks = []
    for x, w, y in points:
        blocks.append([w, y, [x]])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w2, y2, xs = blocks.pop()
            blocks[-1][0] += w2
            blocks[-1][1] += y2
            blocks[-1][2].extend(xs)
    return {x: y / w for w, y, xs in blocks for x in xs}


def test_hulls_of_many_ranges_equal_pooling(spark):
    """A million distinct scores over 64 ranges: long flat stretches and many blocks."""
    n = 1_000_000
    df = spark.range(n).selectExpr("id / 1000000D as s", "cast(xxhash64(id) % 1000 / 1000D < pow(id / 1000000D, 3) - 0.4 * sin(id / 100000D) as int) as y")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        model = K.fit_isotonic(df, "y", "s").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    want = pooled((r["s"], 1, r["y"]) for r in sorted(df.collect()))
    assert 20 < len({r["value"] for r in model}) < n and all(math.isclose(want[r["score"]], r["value"], rel_tol=1e-12) for r in model)
    knots = sorted((r["score"], r["value"]) for r in model)
    assert [v for _, v in knots] == sorted(v for _, v in knots)
    at = {s for s, _ in knots}
    assert min(at) == min(want) and max(at) == max(want)


def test_calibrated_scores_lie_on_the_fit(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 1), (0.3, 0), (0.5, 1), (0.5, 1), (0.9, 1), (None, 1)], "s double, y int")
    model = K.fit_isotonic(df, "y", "s")
    assert sorted(map(tuple, model.collect())) == [(0.1, 0.0), (0.2, 0.5), (0.3, 0.5), (0.5, 1.0), (0.9, 1.0)]
    asked = spark.createDataFrame([(x, "k") for x in (-1.0, 0.1, 0.15, 0.25, 0.4, 0.7, 2.0, None)], "s double, c string")
    got = {r["s"]: r["p"] for r in K.isotonic(asked, model, "s", "p").collect()}
    assert got[None] is None and [round(got[x], 9) for x in (-1.0, 0.1, 0.15, 0.25, 0.4, 0.7, 2.0)] == [0.0, 0.0, 0.25, 0.5, 0.75, 1.0, 1.0]
    assert K.fit_isotonic(df.limit(0), "y", "s").count() == 0


def test_method_choice(spark, frame):
    miscalibrated = spark.range(400).selectExpr("id as TransactionID", "cast(id % 10 < 1 as int) as y", "0.9 as s0").withColumn("s", F.col("s0").cast("double"))
    name, fitted = K.select_method(miscalibrated, "y", "s")
    assert name in ("platt", "isotonic") and fitted is not None


# ---- drift, performance, comparison


def test_baseline_skips_what_it_cannot_use(spark):
    df = spark.createDataFrame([(float(i), 1.0, None) for i in range(100)], "a double, b double, c double")
    base = D.drift_baseline(df, ["a", "b", "c", "absent"])
    rows = sorted(base.collect(), key=lambda r: r["bin_idx"])
    assert {r["feature_name"] for r in rows} == {"a"} and len(rows) == 10
    assert rows[0]["edge_low"] == -math.inf and rows[-1]["edge_high"] == math.inf and rows[0]["n_baseline"] == 100
    assert math.isclose(sum(r["baseline_pct"] for r in rows), 1.0)
    assert D.baseline_problems(base).count() == 0
    with pytest.raises(ValueError):
        D.drift_baseline(df, ["absent"])
    with pytest.raises(ValueError):
        D.baseline_problems(base.drop("n_baseline"))


def test_feature_psi_equals_direct_psi(spark, frame):
    now = frame.withColumn("s", F.col("s") * F.col("s"))
    table = {r["feature_name"]: r for r in D.feature_psi(now, D.drift_baseline(frame, ["s"]), ["s", "gone"]).collect()}
    assert math.isclose(table["s"]["psi"], R.psi(frame, now, "s").first()["psi"], rel_tol=1e-9)
    assert table["gone"]["psi"] is None and table["gone"]["n_recent"] == 0
    empty = D.feature_psi(now.withColumn("s", F.lit(None).cast("double")), D.drift_baseline(frame, ["s"]), ["s"]).first()
    assert empty["psi"] is None


def test_alerts_need_a_finite_value(spark):
    df = spark.createDataFrame([("a", 0.3, 5), ("b", float("inf"), 5), ("c", None, 0), ("d", 0.2, 5)], "feature_name string, psi double, n_recent long")
    assert [r["feature_name"] for r in D.drift_alerts(df).collect()] == ["a"]
    assert [r["feature_name"] for r in D.top_drift(df, 4).collect()] == ["b", "a", "d", "c"]


def test_degradation_signs_and_skips(spark):
    m = spark.createDataFrame([(0.8, None, 120.0)], "auc double, auc_pr double, cost double")
    got = {r["metric"]: r["degradation"] for r in D.degradation(m, {"auc": 0.9, "auc_pr": 0.5, "cost": 100.0}).collect()}
    assert set(got) == {"auc", "cost"} and math.isclose(got["auc"], 0.1 / 0.9) and math.isclose(got["cost"], 0.2)
    assert D.degradation(m, {"auc": 0.0}).count() == 0


def test_decisions_override_the_threshold(spark):
    w = spark.createDataFrame([(1, 0.9, 0), (0, 0.1, 1)], "label int, score double, decision int")
    assert D.rolling_metrics(w).first()["cost"] == 450 + 35
    assert D.rolling_metrics(w.drop("decision")).first()["cost"] == 5


def shadow(spark, rows):
    return spark.createDataFrame(rows, "champion_score double, shadow_score double, champion_decision string, shadow_decision string, is_fraud double")


def test_bootstrap_tracks_resampling(spark):
    rng = random.Random(1)
    rows = [(0.5, 0.5, rng.choice(["block", "allow"]), rng.choice(["block", "allow"]), float(rng.random() < 0.3)) for _ in range(200)]

    def price(d, y):
        return {("block", 1.0): 5, ("block", 0.0): 35, ("allow", 1.0): 450, ("allow", 0.0): 0}[d, y]

    diffs = np.array([price(c, y) - price(s, y) for _, _, c, s, y in rows], float)
    gen = np.random.default_rng(0)
    draws = np.array([diffs[gen.integers(0, 200, 200)].mean() for _ in range(4000)])
    got = D.paired_bootstrap(shadow(spark, rows), 4000).first()
    se = diffs.std() / math.sqrt(200)
    assert abs(got["mean_diff"] - diffs.mean()) < 0.1 * se
    assert abs(got["ci_low"] - np.percentile(draws, 2.5)) < 0.25 * se and abs(got["ci_high"] - np.percentile(draws, 97.5)) < 0.25 * se
    assert abs(got["p_value"] - 2 * min((draws <= 0).mean(), (draws >= 0).mean())) < 0.06


def test_identical_models_and_no_labels(spark):
    same = shadow(spark, [(0.2, 0.2, "allow", "allow", 0.0)] * 5)
    assert D.paired_bootstrap(same, 100).first()["p_value"] == 2.0
    assert D.cost_improvement(same).first()["cost_improvement"] is None
    assert D.agreement(same).first()["score_correlation"] is None
    with pytest.raises(ValueError):
        D.paired_bootstrap(shadow(spark, [(0.2, 0.2, "allow", "allow", None)]), 10)


def test_bucket_quantile(spark):
    df = spark.createDataFrame([(v,) for v in (0.01, 0.02, 0.03, 9.0)], "x double")
    hist = D.histogram(df, "x", [0.02, 0.04])
    assert math.isclose(D.histogram_quantile(hist, 0.5).first()["value"], 0.02)
    assert math.isclose(D.histogram_quantile(hist, 0.75).first()["value"], 0.04)
    assert math.isclose(D.histogram_quantile(hist, 0.99).first()["value"], 0.04)
