"""Queries over costs, ranking, calibration and strata."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions.numeric import r6, round_columns, sql6
from tidemark.operators import calibrate as K
from tidemark.operators import chain as CH
from tidemark.operators import cost as M
from tidemark.operators import model as L
from tidemark.operators import ranking as R
from tidemark.sources.views import FULL_SQL, N_VECTOR_COLUMNS, SCORED_SQL, full_transactions, scored, transactions

TAUS = M.default_thresholds()
TAU_SQL = "taus AS (SELECT unnest([" + ", ".join(f"CAST('{t!r}' AS DOUBLE)" for t in TAUS) + "]) AS threshold)"


def e1(spark, sf):
    return round_columns(M.confusion(scored(spark, sf), "label", F.col("score") >= 0.08))


E1_SQL = f"""WITH {SCORED_SQL}, c AS (SELECT count(*) FILTER (label = 1 AND score >= 0.08) AS tp, count(*) FILTER (label = 0 AND score >= 0.08) AS fp,
  count(*) FILTER (label = 1 AND NOT score >= 0.08) AS fn, count(*) FILTER (label = 0 AND NOT score >= 0.08) AS tn FROM scored)
SELECT *, {sql6('(fn * 450 + fp * 35 + tp * 5)::DOUBLE')} AS total_cost, {sql6('(fn * 450 + fp * 35 + tp * 5)::DOUBLE / (tp + fp + fn + tn)')} AS cost_per_txn FROM c"""

CURVE_SQL = f"""{SCORED_SQL}, {TAU_SQL},
cells AS (SELECT threshold, count(*) FILTER (label = 1 AND score >= threshold) AS tp, count(*) FILTER (label = 0 AND score >= threshold) AS fp,
  count(*) FILTER (label = 1 AND score < threshold) AS fn, count(*) FILTER (label = 0 AND score < threshold) AS tn FROM scored, taus GROUP BY 1),
curve AS (SELECT *, (fn * 450 + fp * 35 + tp * 5)::DOUBLE AS total_cost, (fn * 450 + fp * 35 + tp * 5)::DOUBLE / (tp + fp + fn + tn) AS cost_per_txn FROM cells)"""


def e2(spark, sf):
    return round_columns(M.sweep(scored(spark, sf), "label", "score"))


E2_SQL = f"WITH {CURVE_SQL}\nSELECT {sql6('threshold')} AS threshold, tp, fp, fn, tn, {sql6('total_cost')} AS total_cost, {sql6('cost_per_txn')} AS cost_per_txn FROM curve"


def e3(spark, sf):
    return round_columns(M.optimum(M.sweep(scored(spark, sf), "label", "score")))


E3_SQL = f"""WITH {CURVE_SQL}
SELECT {sql6('threshold')} AS optimal_threshold, {sql6('total_cost')} AS optimal_total_cost, {sql6('cost_per_txn')} AS optimal_cost_per_txn FROM curve ORDER BY curve.total_cost, curve.threshold DESC LIMIT 1"""


def e4(spark, sf):
    return round_columns(M.sensitivity(scored(spark, sf), "label", "score"))


def _axis(base):
    return "[" + ", ".join(f"CAST('{base * m!r}' AS DOUBLE)" for m in (0.8, 0.9, 1.0, 1.1, 1.2)) + "]"


GRID_SQL = f"""{CURVE_SQL},
grid AS (SELECT * FROM (SELECT unnest({_axis(450.0)}) AS fraud_cost), (SELECT unnest({_axis(35.0)}) AS fp_cost), (SELECT unnest({_axis(5.0)}) AS tp_cost)),
best AS (SELECT fraud_cost, fp_cost, tp_cost, threshold, fn * fraud_cost + fp * fp_cost + tp * tp_cost AS total, tp + fp + fn + tn AS n FROM cells, grid
  QUALIFY row_number() OVER (PARTITION BY fraud_cost, fp_cost, tp_cost ORDER BY total, threshold DESC) = 1)"""
E4_SQL = f"""WITH {GRID_SQL}
SELECT {sql6('fraud_cost')} AS fraud_cost, {sql6('fp_cost')} AS fp_cost, {sql6('tp_cost')} AS tp_cost, {sql6('threshold')} AS optimal_threshold,
  {sql6('total')} AS optimal_total_cost, {sql6('total / n')} AS optimal_cost_per_txn FROM best"""


def e5(spark, sf):
    bad = scored(spark, sf).withColumn("score", F.when(F.col("k") % 50 == 0, F.col("score") + 1.5).when(F.col("k") % 50 == 1, -0.1).when(F.col("k") % 50 != 2, F.col("score")))
    return M.score_problems(bad.withColumn("label", F.when(F.col("k") % 50 == 3, 2).otherwise(F.col("label"))), "score", "label")


E5_SQL = f"""WITH {SCORED_SQL}
SELECT count(*) AS n, count(*) FILTER (k % 50 = 2) AS missing_scores, count(*) FILTER (k % 50 IN (0, 1)) AS scores_outside, count(*) FILTER (k % 50 = 3) AS bad_labels FROM scored"""


def e6(spark, sf):
    s = scored(spark, sf)
    return round_columns(M.savings(M.sweep(s, "label", "score"), M.sensitivity(s, "label", "score")))


E6_SQL = f"""WITH {GRID_SQL},
o AS (SELECT threshold AS t, cost_per_txn AS c FROM curve ORDER BY total_cost, threshold DESC LIMIT 1),
b AS (SELECT cost_per_txn AS c FROM curve ORDER BY abs(threshold - 0.5), threshold LIMIT 1),
s AS (SELECT max(threshold) - min(threshold) AS spread FROM best)
SELECT {sql6('o.t')} AS optimal_threshold, {sql6('o.c')} AS optimal_cost_per_txn, {sql6('b.c')} AS baseline_cost_per_txn, {sql6('(b.c - o.c) * 12000000')} AS annual_savings,
  {sql6('spread')} AS spread, o.t BETWEEN 0.3 AND 0.5 AS band_gate, (b.c - o.c) * 12000000 >= 500000 AS savings_gate, spread < 0.2 AS spread_gate FROM o, b, s"""


def e7(spark, sf):
    """Cost at the closed-form threshold against the sweep's optimum."""
    s = scored(spark, sf)
    tau = M.Costs().bayes_threshold()
    at = M.confusion(s, "label", F.col("score") >= tau).select(F.lit(tau).alias("bayes_threshold"), "total_cost")
    return round_columns(at.crossJoin(M.optimum(M.sweep(s, "label", "score")).select("optimal_threshold", "optimal_total_cost")))


E7_SQL = f"""WITH {CURVE_SQL}, t AS (SELECT 35.0::DOUBLE / (35.0::DOUBLE + 450 - 5) AS tau)
SELECT {sql6('any_value(tau)')} AS bayes_threshold, {sql6('sum(CASE WHEN label = 1 THEN CASE WHEN score >= tau THEN 5 ELSE 450 END WHEN score >= tau THEN 35 ELSE 0 END)::DOUBLE')} AS total_cost,
  (SELECT {sql6('threshold')} FROM curve ORDER BY curve.total_cost, threshold DESC LIMIT 1) AS optimal_threshold,
  (SELECT {sql6('min(curve.total_cost)')} FROM curve) AS optimal_total_cost FROM scored, t"""


def e8(spark, sf):
    pts = R.roc_points(R.score_counts(scored(spark, sf), "label", "score", ["ProductCD"]), ["ProductCD"])
    return round_columns(R.ranking_metrics(pts, ["ProductCD"]).select("ProductCD", "n_pos", "n_neg", "auc"))


E8_SQL = f"""WITH {SCORED_SQL}, r AS (SELECT "ProductCD", label, rank() OVER (PARTITION BY "ProductCD" ORDER BY score) + (count(*) OVER (PARTITION BY "ProductCD", score) - 1) / 2.0::DOUBLE AS r FROM scored),
s AS (SELECT "ProductCD", count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n, sum(r) FILTER (label = 1) AS rs FROM r GROUP BY 1)
SELECT "ProductCD", p AS n_pos, n AS n_neg, {sql6('(rs - p * (p + 1) / 2.0::DOUBLE) / (p::DOUBLE * n)')} AS auc FROM s"""


def e9(spark, sf):
    pts = R.roc_points(R.score_counts(scored(spark, sf), "label", "score"))
    return round_columns(R.ranking_metrics(pts).select("average_precision"))


POINTS_SQL = f"""{SCORED_SQL}, d AS (SELECT score, sum(label) AS pos, count(*) - sum(label) AS neg FROM scored GROUP BY 1),
c AS (SELECT score, pos, neg, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM d WINDOW w AS (ORDER BY score DESC))"""
E9_SQL = f"WITH {POINTS_SQL}\nSELECT {sql6('sum(pos::DOUBLE / p * cp / (cp + cn))')} AS average_precision FROM c"


def e10(spark, sf):
    y, s = F.col("label").cast("double"), F.col("score")
    return round_columns(scored(spark, sf).agg(R.brier(y, s).alias("brier"), R.log_loss(y, s).alias("log_loss")))


E10_SQL = f"""WITH {SCORED_SQL}, x AS (SELECT label, score, least(greatest(score, 1e-15::DOUBLE), 1.0::DOUBLE - 1e-15::DOUBLE) AS p FROM scored)
SELECT {sql6('avg((score - label) * (score - label))')} AS brier, {sql6('avg(-(label * ln(p) + (1 - label) * ln(1 - p)))')} AS log_loss FROM x"""


def e12(spark, sf):
    return round_columns(R.calibration_error(scored(spark, sf), "label", "score"))


def e13(spark, sf):
    return round_columns(R.reliability(scored(spark, sf), "label", "score"))


_EDGE_BIN = " + ".join(f"(score > CAST('{e!r}' AS DOUBLE))::INTEGER" for e in R.unit_edges(10)[1:-1])
BINS_SQL = f"{SCORED_SQL}, bins AS (SELECT {_EDGE_BIN} AS bin, avg(score) AS ms, avg(label) AS lr, count(*) AS n FROM scored GROUP BY 1)"
E12_SQL = f"WITH {BINS_SQL}\nSELECT {sql6('sum(n * abs(ms - lr)) / sum(n)')} AS ece FROM bins"
E13_SQL = f"WITH {BINS_SQL}\nSELECT bin, {sql6('ms')} AS mean_score, {sql6('lr')} AS label_rate, n FROM bins"


def e14(spark, sf):
    return round_columns(R.precision_recall_at(scored(spark, sf), "label", "score", [0.001, 0.01, 0.05, 0.2, 1.0], "TransactionID"))


E14_SQL = f"""WITH {SCORED_SQL}, r AS (SELECT label, row_number() OVER (ORDER BY score DESC, "TransactionID") AS rn, count(*) OVER () AS n, sum(label) OVER () AS p FROM scored)
SELECT {sql6('f')} AS fraction, count(*) AS k_count, {sql6('avg(label)')} AS precision, {sql6('sum(label)::DOUBLE / any_value(p)')} AS recall
FROM r, (SELECT unnest([0.001::DOUBLE, 0.01::DOUBLE, 0.05::DOUBLE, 0.2::DOUBLE, 1.0::DOUBLE]) AS f) WHERE rn <= greatest(1, ceil(f * n)) GROUP BY f"""


def e15(spark, sf):
    pts = R.roc_points(R.score_counts(scored(spark, sf), "label", "score"))
    out = None
    for t in (0.0, 0.01, 0.1, 0.5):
        one = R.recall_at_fpr(pts, t).select(F.lit(t).alias("target_fpr"), "recall")
        out = one if out is None else out.unionByName(one)
    return round_columns(out)


E15_SQL = f"""WITH {POINTS_SQL}
SELECT {sql6('t')} AS target_fpr, {sql6('coalesce(max(cp::DOUBLE / p) FILTER (cn::DOUBLE / n <= t), 0.0::DOUBLE)')} AS recall
FROM c, (SELECT unnest([0.0::DOUBLE, 0.01::DOUBLE, 0.1::DOUBLE, 0.5::DOUBLE]) AS t) GROUP BY t"""

HALF = 15 * 86400


def e16(spark, sf):
    s = scored(spark, sf)
    base, now = s.where(F.col("TransactionDT") < HALF), s.where(F.col("TransactionDT") >= HALF)
    shifted = R.psi(base, now.withColumn("score", F.col("score") * 1.4), "score").withColumnRenamed("psi", "psi_shadow_shift")
    return round_columns(R.psi(base, now, "score").crossJoin(shifted))


def _psi_sql(name: str, scale: str) -> str:
    return f"""
{name} AS (SELECT sum((greatest(b, 1e-6) - greatest(a, 1e-6)) * ln(greatest(b, 1e-6) / greatest(a, 1e-6))) AS psi FROM (
  SELECT i, count(*) FILTER (half = 0)::DOUBLE / (SELECT count(*) FROM x WHERE half = 0) AS a, count(*) FILTER (half = 1)::DOUBLE / (SELECT count(*) FROM x WHERE half = 1) AS b
  FROM (SELECT half, len(list_filter(inner_edges, lambda e: v >= e)) AS i FROM (SELECT half, CASE WHEN half = 1 THEN score * {scale} ELSE score END AS v FROM x), ed) GROUP BY i))"""


E16_SQL = f"""WITH {SCORED_SQL}, x AS (SELECT score, ("TransactionDT" >= {HALF})::INTEGER AS half FROM scored),
q AS (SELECT list_sort(list_distinct(quantile_cont(score, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]))) AS e FROM x WHERE half = 0), ed AS (SELECT e[2:len(e) - 1] AS inner_edges FROM q),
{_psi_sql('p1', '1.0::DOUBLE')},{_psi_sql('p2', '1.4::DOUBLE')}
SELECT {sql6('p1.psi')} AS psi, {sql6('p2.psi')} AS psi_shadow_shift FROM p1, p2"""


def e17(spark, sf):
    return round_columns(R.stratified(scored(spark, sf), 0.08))


_AMT = "CASE WHEN \"TransactionAmt\" < 50 THEN '<$50' WHEN \"TransactionAmt\" < 200 THEN '$50-200' WHEN \"TransactionAmt\" < 500 THEN '$200-500' WHEN \"TransactionAmt\" < 1000 THEN '$500-1K' ELSE '>$1K' END"
STRATA_SQL = f"""{SCORED_SQL},
l AS (SELECT 'amount_bucket' AS axis, {_AMT} AS value, label, score FROM scored UNION ALL SELECT 'product_cd', coalesce("ProductCD", '(missing)'), label, score FROM scored
  UNION ALL SELECT 'device_type', coalesce("DeviceType", '(null)'), label, score FROM scored
  UNION ALL SELECT 'identity_coverage', CASE WHEN id_01 IS NULL THEN 'no_identity' ELSE 'has_identity' END, label, score FROM scored
  UNION ALL SELECT 'month', "month"::VARCHAR, label, score FROM scored),
d AS (SELECT axis, value, score, sum(label) AS pos, count(*) - sum(label) AS neg FROM l GROUP BY 1, 2, 3),
cc AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER g AS p, sum(neg) OVER g AS n FROM d WINDOW w AS (PARTITION BY axis, value ORDER BY score DESC), g AS (PARTITION BY axis, value)),
st AS (SELECT axis, value, any_value(p + n)::BIGINT AS n_rows, any_value(p)::BIGINT AS n_pos,
  CASE WHEN any_value(p) > 0 AND any_value(n) > 0 AND any_value(p + n) >= 50 THEN sum(pos * (n - cn + neg / 2.0::DOUBLE)) / (any_value(p)::DOUBLE * any_value(n)) END AS auc,
  CASE WHEN any_value(p) > 0 AND any_value(n) > 0 AND any_value(p + n) >= 50 THEN sum(pos::DOUBLE / nullif(p, 0) * cp / (cp + cn)) END AS pr_auc,
  sum(CASE WHEN score >= 0.08 THEN pos * 5 + neg * 35 ELSE pos * 450 END)::DOUBLE AS total_cost FROM cc GROUP BY 1, 2),
full_st AS (SELECT axis, value, n_rows, n_pos, n_pos::DOUBLE / n_rows AS fraud_rate, auc, pr_auc, total_cost, total_cost / n_rows AS cost_per_txn FROM st
  UNION ALL SELECT axis, v, 0, 0, NULL, NULL, NULL, 0, NULL FROM (SELECT 'amount_bucket' AS axis, unnest(['$500-1K', '>$1K']) AS v) WHERE v NOT IN (SELECT value FROM st))"""
E17_SQL = f"""WITH {STRATA_SQL}
SELECT axis, value, n_rows, n_pos, {sql6('fraud_rate')} AS fraud_rate, {sql6('auc')} AS auc, {sql6('pr_auc')} AS pr_auc, {sql6('total_cost')} AS total_cost, {sql6('cost_per_txn')} AS cost_per_txn FROM full_st"""
Z_METRICS = ["fraud_rate", "auc", "pr_auc", "cost_per_txn"]


def e18(spark, sf):
    return round_columns(R.zscore_table(R.stratified(scored(spark, sf), 0.08), Z_METRICS))


E18_SQL = f"WITH {STRATA_SQL}, m AS (" + " UNION ALL ".join(f"SELECT axis, value, '{m}' AS metric, {m} AS x FROM full_st" for m in Z_METRICS) + f""")
SELECT axis, value, metric, {sql6("CASE WHEN metric = 'cost_per_txn' THEN 1 ELSE -1 END * (x - avg(x) OVER w) / stddev_pop(x) OVER w")} AS z FROM m WINDOW w AS (PARTITION BY metric)"""


def e19(spark, sf):
    s = scored(spark, sf)
    slope, intercept = K.fit_platt(s, "label", "score")
    p = s.withColumn("p", K.platt(F.col("score"), slope, intercept))
    y = F.col("label").cast("double")
    return p.agg((F.round(F.avg("p") - F.avg(y), 5) + 0.0).alias("bias"), F.round(R.log_loss(y, F.col("p")), 4).alias("log_loss"))


# Newton steps on the rows' counts, from 0.
E19_SQL = f"""WITH RECURSIVE {SCORED_SQL}, c AS (SELECT score AS x, label AS y, count(*)::DOUBLE AS w FROM scored GROUP BY 1, 2),
it(n, a, b) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL
  SELECT n + 1, a + (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12), b + (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) FROM (
    SELECT n, a, b, sum(w * (y - p) * x) AS g1, sum(w * (y - p)) AS g2, sum(w * p * (1 - p) * x * x) AS h11, sum(w * p * (1 - p) * x) AS h12, sum(w * p * (1 - p)) AS h22
    FROM (SELECT n, a, b, x, y, w, 1 / (1 + exp(-(a * x + b))) AS p FROM it, c WHERE n < 25) GROUP BY n, a, b)),
p AS (SELECT y, w, 1 / (1 + exp(-(a * x + b))) AS p FROM c, (SELECT a, b FROM it WHERE n = 25))
SELECT round(sum(w * (p - y)) / sum(w), 5) + 0.0 AS bias, round(-sum(w * CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END) / sum(w), 4) AS log_loss FROM p"""


def e20(spark, sf):
    s = scored(spark, sf)
    model = K.fit_isotonic(s, "label", "score")
    grid = s.select("score").distinct()
    return round_columns(K.isotonic(grid, model, "score", "calibrated").select("score", "calibrated"))


# Isotonic values by the max-min formula: over all score blocks starting at or before and ending at or after the score.
E20_SQL = f"""WITH {SCORED_SQL}, d AS (SELECT score, sum(label)::DOUBLE AS p, count(*)::DOUBLE AS n FROM scored GROUP BY 1),
c AS (SELECT score, row_number() OVER (ORDER BY score) AS i, sum(p) OVER (ORDER BY score) AS cp, sum(n) OVER (ORDER BY score) AS cn, p, n FROM d),
b AS (SELECT a.i AS lo, z.i AS hi, (z.cp - a.cp + a.p) / (z.cn - a.cn + a.n) AS mean FROM c a JOIN c z ON a.i <= z.i),
r AS (SELECT lo, hi, min(mean) OVER (PARTITION BY lo ORDER BY hi DESC) AS m FROM b)
SELECT {sql6('any_value(c.score)')} AS score, {sql6('max(r.m)')} AS calibrated FROM r JOIN c ON c.i = r.hi AND r.lo <= c.i GROUP BY c.i"""


def e21(spark, sf):
    losses = K.method_losses(scored(spark, sf), "label", "score")
    best = F.when((F.col("none") <= F.col("platt")) & (F.col("none") <= F.col("isotonic")), "none").when(F.col("platt") <= F.col("isotonic"), "platt").otherwise("isotonic")
    return losses.select(*[F.round(c, 4).alias(c) for c in ("none", "platt", "isotonic")], best.alias("best"))


FEATURES = ["TransactionAmt", "k", "card1", "hour", "id_01"]


def _model_frame(spark, sf):
    return scored(spark, sf).withColumn("hour", F.expr("(TransactionDT div 3600) % 24")).withColumnRenamed("label", "isFraud")


def _parts(spark, sf):
    x = _model_frame(spark, sf)
    t = F.col("TransactionDT")
    return x.where(t < 18 * 86400), x.where((t >= 18 * 86400) & (t < 24 * 86400)), x.where(t >= 24 * 86400)


def e22(spark, sf):
    train, val, _ = _parts(spark, sf)
    model, _fill = L.train_boosted(train, val, FEATURES, rounds=5, depth=3)
    return L.importances(model, FEATURES, train, {**L.feature_families([], train.columns), **_families(transactions(spark, sf), ("amount", "calendar"))})


def _families(train, parts=None):
    """Families of the features of the whole chain or of some of its parts, and of the raw columns."""
    chain = CH.FeatureChain([(n, make()) for n, make in CH.DEFAULT if parts is None or n in parts], thin_columns=False)
    chain.fit_transform(train)
    return chain.families(train.columns)


def e22_families(spark, sf):
    """How many columns each generator of the chain made for this table, and how many are raw."""
    found = _families(full_transactions(spark, sf))
    return spark.createDataFrame(sorted(found.items()), "feature string, family string").groupBy("family").agg(F.count(F.lit(1)).alias("n_features"))


_WIDTH = {"amount": 2, "calendar": 6, "mail": 4, "velocity": len(config.VELOCITY_ENTITIES) * len(config.VELOCITY_WINDOWS), "stats": sum(map(len, config.STATS_BY_ENTITY.values())) * len(config.STATS_WINDOWS),
          "encoding": 3, "behaviour": 5, "cold_start": 1, "decay": 2 * len(config.VELOCITY_ENTITIES) * len(config.EWM_LAMBDAS), "graph": 4 + len(config.VELOCITY_ENTITIES)}
_RAW = ["TransactionID", "TransactionDT", "TransactionAmt", "card1", "k", "addr1", "DeviceInfo", "P_emaildomain", "ProductCD", "isFraud", "card4"]
# Indicators exist for the columns that this table often lacks: of the raw ones, and of the V block by its rules.
E22_FAMILIES_SQL = f"""WITH {FULL_SQL},
m AS (SELECT unnest([{', '.join(f'avg(("{c}" IS NULL)::INTEGER)' for c in _RAW)}]) AS share FROM branded),
v AS (SELECT "TransactionID" % (SELECT count(*) FROM embeddings) AS vec FROM branded),
w AS (SELECT avg((vec % 3 = 0)::INTEGER) AS third, avg((vec % 10 = 1)::INTEGER) AS tenth FROM v)
SELECT * FROM (VALUES {', '.join(f"('{f}', {n}::BIGINT)" for f, n in _WIDTH.items())}) AS t(family, n_features)
UNION ALL SELECT 'missing', (SELECT count(*) FROM m WHERE share > {config.MISSING_THRESHOLD}) + (SELECT (third > {config.MISSING_THRESHOLD})::BIGINT * 8 + (tenth > {config.MISSING_THRESHOLD})::BIGINT * {N_VECTOR_COLUMNS - 19} FROM w)
UNION ALL SELECT 'raw', {len(_RAW) + N_VECTOR_COLUMNS}"""


QUERIES = {
    "e1_confusion_cost": e1, "e2_threshold_sweep": e2, "e3_optimal_threshold": e3, "e4_sensitivity": e4, "e5_score_problems": e5, "e6_savings": e6,
    "e7_bayes_threshold": e7, "e8_roc_auc": e8, "e9_average_precision": e9, "e10_brier_log_loss": e10, "e12_calibration_error": e12, "e13_reliability": e13,
    "e14_precision_recall_at_k": e14, "e15_recall_at_fpr": e15, "e16_psi": e16, "e17_stratified": e17, "e18_strata_zscores": e18, "e19_platt": e19,
    "e20_isotonic": e20, "e21_calibration_choice": e21, "e22_importances": e22, "e22_feature_families": e22_families,
}
ORACLES = {
    "e1_confusion_cost": E1_SQL, "e2_threshold_sweep": E2_SQL, "e19_platt": E19_SQL, "e22_feature_families": E22_FAMILIES_SQL, "e3_optimal_threshold": E3_SQL, "e4_sensitivity": E4_SQL, "e5_score_problems": E5_SQL, "e6_savings": E6_SQL,
    "e7_bayes_threshold": E7_SQL, "e8_roc_auc": E8_SQL, "e9_average_precision": E9_SQL, "e10_brier_log_loss": E10_SQL, "e12_calibration_error": E12_SQL, "e13_reliability": E13_SQL,
    "e14_precision_recall_at_k": E14_SQL, "e15_recall_at_fpr": E15_SQL, "e16_psi": E16_SQL, "e17_stratified": E17_SQL, "e18_strata_zscores": E18_SQL, "e20_isotonic": E20_SQL,
}
