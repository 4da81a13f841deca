"""Queries over drift, performance and champion / challenger comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions.numeric import r6, round_columns, sql6
from tidemark.operators import monitor as M
from tidemark.operators.cost import Costs
from tidemark.session import scratch_path
from tidemark.sources import tables as S
from tidemark.sources.views import PREDICTIONS_SQL, SCORED_SQL, predictions, scored

HALF = 15 * 86400
FEATURES = ["TransactionAmt", "k", "score", "constant", "empty", "id_01", "absent"]


def _halves(spark, sf):
    s = scored(spark, sf).withColumns({"constant": F.lit(1.0), "empty": F.lit(None).cast("double")})
    grown = F.col("TransactionAmt") * 1.8  # the recent half drifts in one feature
    return s.where(F.col("TransactionDT") < HALF), s.where(F.col("TransactionDT") >= HALF).withColumn("TransactionAmt", grown)


def _finite(df):
    """Open edges as NULL, which both engines print alike."""
    inf = float("inf")
    return df.withColumns({"edge_low": F.when(F.col("edge_low") > -inf, F.col("edge_low")), "edge_high": F.when(F.col("edge_high") < inf, F.col("edge_high"))})


def m1(spark, sf):
    return round_columns(_finite(M.drift_baseline(_halves(spark, sf)[0], FEATURES)))


_USED = [("TransactionAmt", '"TransactionAmt"', '"TransactionAmt" * 1.8'), ("k", "k::DOUBLE", "k::DOUBLE"), ("score", "score", "score"), ("id_01", "id_01", "id_01")]
BASE_SQL = f"""{SCORED_SQL},
b AS ({' UNION ALL '.join(f"SELECT '{n}' AS f, {e} AS v FROM scored WHERE {chr(34)}TransactionDT{chr(34)} < {HALF}" for n, e, _ in _USED)}),
rc AS ({' UNION ALL '.join(f"SELECT '{n}' AS f, {e} AS v FROM scored WHERE {chr(34)}TransactionDT{chr(34)} >= {HALF}" for n, _, e in _USED)}),
ed AS (SELECT f, list_sort(list_distinct(quantile_cont(v, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]))) AS e FROM b WHERE v IS NOT NULL GROUP BY f),
bb AS (SELECT f, len(list_filter(e[2:len(e) - 1], lambda x: v >= x)) AS i, count(*) AS n FROM b JOIN ed USING (f) WHERE v IS NOT NULL GROUP BY ALL),
rb AS (SELECT f, len(list_filter(e[2:len(e) - 1], lambda x: v >= x)) AS i, count(*) AS n FROM rc JOIN ed USING (f) WHERE v IS NOT NULL GROUP BY ALL),
bins AS (SELECT f, e, unnest(range(0, len(e) - 1)) AS i FROM ed),
base AS (SELECT f, i, CASE WHEN i > 0 THEN e[i + 1] END AS lo, CASE WHEN i < len(e) - 2 THEN e[i + 2] END AS hi,
   coalesce(n, 0)::DOUBLE / (SELECT sum(n) FROM bb t WHERE t.f = bins.f) AS pct, (SELECT sum(n) FROM bb t WHERE t.f = bins.f)::BIGINT AS nb FROM bins LEFT JOIN bb USING (f, i)),
psi AS (SELECT base.f, sum((greatest(coalesce(rb.n, 0)::DOUBLE / t.n, 1e-6) - greatest(pct, 1e-6)) * ln(greatest(coalesce(rb.n, 0)::DOUBLE / t.n, 1e-6) / greatest(pct, 1e-6))) AS psi, any_value(t.n)::BIGINT AS n_recent
   FROM base LEFT JOIN rb ON rb.f = base.f AND rb.i = base.i JOIN (SELECT f, sum(n) AS n FROM rb GROUP BY 1) t ON t.f = base.f GROUP BY 1)"""
M1_SQL = f"WITH {BASE_SQL}\nSELECT f AS feature_name, i::INTEGER AS bin_idx, {sql6('lo')} AS edge_low, {sql6('hi')} AS edge_high, {sql6('pct')} AS baseline_pct, nb AS n_baseline FROM base"


def m2(spark, sf):
    """A good baseline has no problems; one with a lost bin and one with a wrong share do."""
    good = M.drift_baseline(_halves(spark, sf)[0], FEATURES)
    bad = good.where((F.col("feature_name") != "k") | (F.col("bin_idx") != 3)).withColumn(
        "baseline_pct", F.when(F.col("feature_name") == "score", F.col("baseline_pct") * 2).otherwise(F.col("baseline_pct")))
    return M.baseline_problems(good).unionByName(M.baseline_problems(bad))


M2_SQL = f"""WITH {BASE_SQL}, bad AS (SELECT f, i, pct * CASE WHEN f = 'score' THEN 2 ELSE 1 END AS pct FROM base WHERE f <> 'k' OR i <> 3)
SELECT f AS feature_name, CASE WHEN max(i) <> count(*) - 1 THEN 'bins' ELSE 'shares' END AS problem FROM bad GROUP BY f HAVING max(i) <> count(*) - 1 OR abs(sum(pct) - 1) > 1e-9"""


def _psi(spark, sf):
    base, now = _halves(spark, sf)
    return M.feature_psi(now, M.drift_baseline(base, FEATURES), ["TransactionAmt", "k", "score", "id_01", "constant", "absent"])


def m3(spark, sf):
    return round_columns(_psi(spark, sf))


M3_SQL = f"""WITH {BASE_SQL}
SELECT x.f AS feature_name, {sql6('psi')} AS psi, coalesce(n_recent, 0) AS n_recent FROM (SELECT unnest(['TransactionAmt', 'k', 'score', 'id_01', 'constant', 'absent']) AS f) x LEFT JOIN psi USING (f)"""


def m3_scored(spark, sf):
    # Without a list, every feature of the baseline is compared.
    base, now = _halves(spark, sf)
    return round_columns(M.feature_psi(now.drop("k"), M.drift_baseline(base, FEATURES)))


M3S_SQL = f"""WITH {BASE_SQL}
SELECT f AS feature_name, CASE WHEN f <> 'k' THEN {sql6('psi')} END AS psi, CASE WHEN f <> 'k' THEN n_recent ELSE 0 END AS n_recent FROM psi"""


def m4(spark, sf):
    return round_columns(M.top_drift(_psi(spark, sf), 3))


def m5(spark, sf):
    path = scratch_path(spark, "drift-alerts")
    alerts = M.drift_alerts(_psi(spark, sf))
    S.append_lines(alerts, path)
    return round_columns(spark.read.schema(alerts.schema).json(path))


M5_SQL = f"WITH {BASE_SQL}\nSELECT f AS feature_name, {sql6('psi')} AS psi, {sql6('0.2::DOUBLE')} AS threshold, n_recent FROM psi WHERE psi > 0.2"

WINDOW = 1000


def _rolling(spark, sf):
    return M.rolling_metrics(M.recent_rows(scored(spark, sf), WINDOW, "TransactionDT", "TransactionID"), 0.08)


def m6(spark, sf):
    return round_columns(_rolling(spark, sf))


ROLL_SQL = f"""{SCORED_SQL}, r AS (SELECT * FROM scored ORDER BY "TransactionDT" DESC, "TransactionID" DESC LIMIT {WINDOW}),
d AS (SELECT score, sum(label) AS pos, count(*) - sum(label) AS neg FROM r GROUP BY 1),
c AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM d WINDOW w AS (ORDER BY score DESC)),
roll AS (SELECT sum(pos * (n - cn + neg / 2.0::DOUBLE)) / (any_value(p)::DOUBLE * any_value(n)) AS auc, sum(pos::DOUBLE / p * cp / (cp + cn)) AS auc_pr,
  sum(CASE WHEN score >= 0.08 THEN pos * 5 + neg * 35 ELSE pos * 450 END)::DOUBLE AS cost, any_value(p + n)::BIGINT AS n_recent FROM c)"""
M6_SQL = f"WITH {ROLL_SQL}\nSELECT {sql6('auc')} AS auc, {sql6('auc_pr')} AS auc_pr, {sql6('cost')} AS cost, n_recent FROM roll"
EXPECTED = {"auc": 0.9, "auc_pr": 0.1, "cost": 30000.0}


def m7(spark, sf):
    return round_columns(M.degradation(_rolling(spark, sf), EXPECTED))


DEGRADE_SQL = f"""{ROLL_SQL}, deg AS (SELECT 'auc' AS metric, 0.9::DOUBLE AS baseline, auc AS current, (0.9 - auc) / 0.9::DOUBLE AS degradation FROM roll
  UNION ALL SELECT 'auc_pr', 0.1::DOUBLE, auc_pr, (0.1 - auc_pr) / 0.1::DOUBLE FROM roll UNION ALL SELECT 'cost', 30000.0::DOUBLE, cost, (cost - 30000) / 30000.0::DOUBLE FROM roll)"""
_DEG = f"metric, {sql6('baseline')} AS baseline, {sql6('current')} AS current, {sql6('degradation')} AS degradation"


def m8(spark, sf):
    path = scratch_path(spark, "performance-alerts")
    alerts = M.performance_alerts(M.degradation(_rolling(spark, sf), EXPECTED))
    S.append_lines(alerts, path)
    return round_columns(spark.read.schema(alerts.schema).json(path))


def shadow_frame(spark, sf):
    """Both models' decisions at one threshold, joined as production tables; a tenth of the labels is unknown."""
    s = scored(spark, sf)
    rid = F.concat(F.lit("r"), F.col("TransactionID").cast("string"))
    p = s.select(rid.alias("request_id"), F.col("TransactionID").alias("txn_id"), "score", F.when(F.col("score") >= 0.1, "block").otherwise("allow").alias("decision"))
    c = s.select(rid.alias("request_id"), "shadow_score", F.when(F.col("shadow_score") >= 0.1, "block").otherwise("allow").alias("shadow_decision"))
    labels = s.where(F.col("k") % 10 != 9).select(F.col("TransactionID").alias("txn_id"), F.col("label").cast("double").alias("is_fraud"))
    return M.join_shadow(p, c, labels)


SHADOW_SQL = f"""{SCORED_SQL},
sh AS (SELECT 'r' || "TransactionID" AS request_id, "TransactionID" AS txn_id, score AS champion_score, CASE WHEN score >= 0.1 THEN 'block' ELSE 'allow' END AS champion_decision,
  shadow_score, CASE WHEN shadow_score >= 0.1 THEN 'block' ELSE 'allow' END AS shadow_decision, CASE WHEN k % 10 <> 9 THEN label::DOUBLE END AS is_fraud FROM scored),
co AS (SELECT *, CASE WHEN champion_decision = 'block' THEN CASE WHEN is_fraud = 1 THEN 5 ELSE 35 END WHEN is_fraud = 1 THEN 450 ELSE 0 END::DOUBLE AS cc,
  CASE WHEN shadow_decision = 'block' THEN CASE WHEN is_fraud = 1 THEN 5 ELSE 35 END WHEN is_fraud = 1 THEN 450 ELSE 0 END::DOUBLE AS sc FROM sh WHERE is_fraud IS NOT NULL),
agg AS (SELECT count(*) AS n_labeled, avg(cc) AS champ, avg(sc) AS shad FROM co)"""


def m9(spark, sf):
    return round_columns(M.agreement(shadow_frame(spark, sf)))


M9_SQL = f"""WITH {SHADOW_SQL}
SELECT count(*) AS n_total, {sql6('avg((champion_decision = shadow_decision)::INTEGER)')} AS agreement_rate, {sql6('corr(champion_score, shadow_score)')} AS score_correlation FROM sh"""


def m10(spark, sf):
    s = shadow_frame(spark, sf).where(F.col("is_fraud").isNotNull())
    return s.select("request_id", M.decision_cost(F.col("champion_decision"), F.col("is_fraud")).alias("champion_cost"),
                    M.decision_cost(F.col("shadow_decision"), F.col("is_fraud")).alias("shadow_cost"))


def m11(spark, sf):
    return round_columns(M.cost_improvement(shadow_frame(spark, sf)))


M11_SQL = f"""WITH {SHADOW_SQL}
SELECT n_labeled, {sql6('champ')} AS champion_cost_per_txn, {sql6('shad')} AS shadow_cost_per_txn, {sql6('(champ - shad) / champ')} AS cost_improvement FROM agg"""


# A difference has at most a few values, so its mean over many draws is close to normal. Means and interval ends are
# compared in steps of half a standard error, shifted so that no end lies near the border of a step.
STEP_SQL = "floor(({x} - exact_mean) / standard_error * 2 + 0.5)"


def _bootstrap(spark, sf):
    s = shadow_frame(spark, sf)
    cells = M.difference_cells(s)
    n = F.sum("n")
    mean = F.sum(F.col("n") * F.col("diff")) / n
    exact = cells.agg(mean.alias("exact_mean"), F.sqrt(F.sum(F.col("n") * F.col("diff") * F.col("diff")) / n - mean * mean).alias("sd"), n.alias("n_labeled"))
    return M.paired_bootstrap(s).crossJoin(exact.withColumn("standard_error", F.col("sd") / F.sqrt("n_labeled")))


def m12(spark, sf):
    """The bootstrap in numbers: mean and interval ends in half standard errors, and the p-value to one decimal."""
    b = _bootstrap(spark, sf)
    return b.select("n_labeled", r6("exact_mean").alias("exact_mean"), r6("standard_error").alias("standard_error"),
                    *[F.expr(STEP_SQL.format(x=c)).cast("double").alias(f"{c}_steps") for c in ("mean_diff", "ci_low", "ci_high")], F.round("p_value", 1).alias("p_value"))


# The upper tail of the normal distribution by Abramowitz and Stegun 26.2.17, to 1e-7.
TAIL_SQL = "(exp(-z * z / 2) / sqrt(2 * pi()) * (0.319381530::DOUBLE * k - 0.356563782::DOUBLE * k ** 2 + 1.781477937::DOUBLE * k ** 3 - 1.821255978::DOUBLE * k ** 4 + 1.330274429::DOUBLE * k ** 5))"
NORMAL_SQL = f"""n AS (SELECT count(*) AS n_labeled, avg(cc - sc) AS exact_mean, stddev_pop(cc - sc) / sqrt(count(*)) AS se FROM co),
z AS (SELECT *, abs(exact_mean) / se AS z, 1 / (1 + 0.2316419::DOUBLE * abs(exact_mean) / se) AS k FROM n)"""
M12_SQL = f"""WITH {SHADOW_SQL}, {NORMAL_SQL}
SELECT n_labeled, {sql6('exact_mean')} AS exact_mean, {sql6('se')} AS standard_error, 0.0::DOUBLE AS mean_diff_steps, -4.0::DOUBLE AS ci_low_steps, 4.0::DOUBLE AS ci_high_steps,
  round(least(2 * {TAIL_SQL}, 1.0), 1) AS p_value FROM z"""


def m13(spark, sf):
    """Verdicts of the report with the p-value of the bootstrap, and of a report without labels."""
    s = shadow_frame(spark, sf)
    report = M.agreement(s).crossJoin(M.cost_improvement(s)).crossJoin(M.paired_bootstrap(s).select("p_value"))
    unlabeled = M.agreement(s).withColumns({"cost_improvement": F.lit(None).cast("double"), "p_value": F.lit(None).cast("double")})

    def shown(df, name):
        v = M.verdict(df)
        known = F.transform("criteria", lambda c: F.struct(c["criterion"], F.when(c["criterion"] != "p_value", c["value"]).alias("value"), c["needed"], c["passed"]))
        text = F.concat_ws("; ", F.transform(known, lambda c: F.concat_ws(" ", c["criterion"], F.format_string("%.4f", c["value"]), F.format_string("%.2f", c["needed"]), c["passed"].cast("string"))))
        return v.select(F.lit(name).alias("report"), "agreement_pass", "cost_improvement_pass", "p_value_pass", "promote", text.alias("criteria"), F.size("reasons").alias("n_reasons"))

    return shown(report, "labelled").unionByName(shown(unlabeled, "unlabelled"))


M13_SQL = f"""WITH {SHADOW_SQL}, {NORMAL_SQL}, a AS (SELECT avg((champion_decision = shadow_decision)::INTEGER) AS a FROM sh),
v AS (SELECT a, (champ - shad) / champ AS c, 2 * {TAIL_SQL} AS p FROM a, agg, z),
t AS (SELECT *, a > {M.MIN_AGREEMENT} AS pa, c > {M.MIN_IMPROVEMENT} AS pc, p < {M.MAX_P} AS pp FROM v)
SELECT 'labelled' AS report, pa AS agreement_pass, pc AS cost_improvement_pass, pp AS p_value_pass, pa AND pc AND pp AS promote,
  printf('agreement_rate %.4f %.2f %s; cost_improvement %.4f %.2f %s; p_value null %.2f %s', a, {M.MIN_AGREEMENT}::DOUBLE, pa::VARCHAR, c, {M.MIN_IMPROVEMENT}::DOUBLE, pc::VARCHAR, {M.MAX_P}::DOUBLE, pp::VARCHAR) AS criteria, 3 AS n_reasons FROM t
UNION ALL SELECT 'unlabelled', pa, false, false, false,
  printf('agreement_rate %.4f %.2f %s; cost_improvement null %.2f false; p_value null %.2f false', a, {M.MIN_AGREEMENT}::DOUBLE, pa::VARCHAR, {M.MIN_IMPROVEMENT}::DOUBLE, {M.MAX_P}::DOUBLE), 3 FROM t"""


def m14(spark, sf):
    return shadow_frame(spark, sf)


def m15(spark, sf):
    p = predictions(spark, sf).withColumn("latency", F.col("latency_ms") / 1000.0)
    lat = M.histogram(p, "latency", config.LATENCY_BOUNDS).withColumn("series", F.lit("latency"))
    score = M.histogram(p, "score", config.SCORE_BOUNDS).withColumn("series", F.lit("score"))
    both = lat.unionByName(score)
    return both.select("series", F.when(F.col("le") < float("inf"), F.col("le")).alias("le"), "n")


def _hist_sql(series, column, bounds):
    parts = [f"SELECT '{series}' AS series, {b!r}::DOUBLE AS le, count(*) FILTER ({column} <= {b!r}::DOUBLE) AS n FROM preds" for b in bounds]
    return " UNION ALL ".join([*parts, f"SELECT '{series}', NULL, count({column}) FROM preds"])


M15_SQL = f"WITH {PREDICTIONS_SQL}\n{_hist_sql('latency', 'latency_ms / 1000.0::DOUBLE', config.LATENCY_BOUNDS)} UNION ALL {_hist_sql('score', 'score', config.SCORE_BOUNDS)}"


def m16(spark, sf):
    p = predictions(spark, sf).withColumn("latency", F.col("latency_ms") / 1000.0)
    hist = M.histogram(p, "latency", config.LATENCY_BOUNDS, [F.col("decision")])
    out = None
    for q in (0.5, 0.95, 0.99):
        one = M.histogram_quantile(hist, q, ["decision"])
        out = one if out is None else out.unionByName(one)
    return round_columns(out)


M16_SQL = f"""WITH {PREDICTIONS_SQL}, bnd AS (SELECT unnest({config.LATENCY_BOUNDS + [1e18]}::DOUBLE[]) AS le),
h AS (SELECT decision, le, count(*) FILTER (latency_ms / 1000.0::DOUBLE <= le) AS n FROM preds, bnd GROUP BY 1, 2),
l AS (SELECT *, coalesce(lag(le) OVER w, 0) AS lo, coalesce(lag(n) OVER w, 0) AS below, max(n) OVER (PARTITION BY decision) AS total FROM h WINDOW w AS (PARTITION BY decision ORDER BY le))
SELECT decision, {sql6('q')} AS q, {sql6('any_value(CASE WHEN le > 1e17 THEN lo ELSE lo + (le - lo) * (q * total - below) / (n - below) END)')} AS value
FROM l, (SELECT unnest([0.5::DOUBLE, 0.95::DOUBLE, 0.99::DOUBLE]) AS q) WHERE n >= q * total AND below < q * total GROUP BY decision, q"""

QUERIES = {
    "m1_drift_baseline": m1, "m2_baseline_problems": m2, "m3_feature_psi": m3, "m3_all_psi": m3_scored, "m4_top_drift": m4, "m5_drift_alerts": m5, "m6_rolling_metrics": m6,
    "m7_degradation": m7, "m8_performance_alerts": m8, "m9_agreement": m9, "m10_decision_cost": m10, "m11_cost_improvement": m11, "m12_paired_bootstrap": m12, "m13_verdict": m13,
    "m14_shadow_join": m14, "m15_histograms": m15, "m16_histogram_quantiles": m16,
}
ORACLES = {
    "m1_drift_baseline": M1_SQL, "m2_baseline_problems": M2_SQL, "m3_feature_psi": M3_SQL, "m3_all_psi": M3S_SQL,
    "m4_top_drift": f"WITH {BASE_SQL}\nSELECT f AS feature_name, {sql6('psi')} AS psi, n_recent FROM psi ORDER BY psi.psi DESC, f LIMIT 3", "m5_drift_alerts": M5_SQL,
    "m6_rolling_metrics": M6_SQL, "m7_degradation": f"WITH {DEGRADE_SQL}\nSELECT {_DEG} FROM deg",
    "m8_performance_alerts": f"WITH {DEGRADE_SQL}\nSELECT {_DEG}, {sql6('0.05::DOUBLE')} AS threshold FROM deg WHERE degradation > 0.05", "m9_agreement": M9_SQL,
    "m10_decision_cost": f"WITH {SHADOW_SQL}\nSELECT request_id, cc AS champion_cost, sc AS shadow_cost FROM co", "m11_cost_improvement": M11_SQL, "m12_paired_bootstrap": M12_SQL, "m13_verdict": M13_SQL,
    "m14_shadow_join": f"WITH {SHADOW_SQL}\nSELECT * FROM sh", "m15_histograms": M15_SQL, "m16_histogram_quantiles": M16_SQL,
}
