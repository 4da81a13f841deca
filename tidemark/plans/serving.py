"""Queries over the feature store, feature assembly, training, scoring and explaining."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions.numeric import r6, round_columns, sql6
from tidemark.operators import basic as B
from tidemark.operators import chain as C
from tidemark.operators import clean
from tidemark.operators import model as L
from tidemark.operators import pastpass as P
from tidemark.operators import monitor as M
from tidemark.operators import store as S
from tidemark.operators.profile import numbered
from tidemark.plans.evaluation import FEATURES, _model_frame, _parts
from tidemark.plans.point_in_time import SPLIT_AT, W1_SQL, W3_SQL, W4_SQL, W5_SQL, W6_SQL, W9_SQL, tied
from tidemark.session import cut_lineage, scratch_path
from tidemark.sources.views import FULL_SQL, SCORED_SQL, TXN_SQL, TXN_TIES_SQL, full_transactions, scored, transactions

CARD_FEATURES = ["card1_seen_amt", "card1_amt_max_30d", "card1_velocity_1h"]


def _carded(spark, sf):
    """Rows carrying features named after the card, so a snapshot can be taken of them."""
    t = tied(spark, sf)
    return t.withColumns({"card1_seen_amt": F.col("TransactionAmt"), "card1_amt_max_30d": F.col("TransactionAmt") * 2, "card1_velocity_1h": F.col("k").cast("double"),
                          "addr1_seen_k": F.col("k").cast("double")})


_CARDED = """carded AS (SELECT *, "TransactionAmt" AS card1_seen_amt, "TransactionAmt" * 2 AS card1_amt_max_30d, k::DOUBLE AS card1_velocity_1h, k::DOUBLE AS addr1_seen_k FROM tied)"""


def p1(spark, sf):
    t = _carded(spark, sf)
    cards = S.newest(t, "card1", S.entity_features(t.columns, "card1")).withColumn("entity", F.lit("card1"))
    areas = S.newest(t, "addr1", S.entity_features(t.columns, "addr1")).withColumn("entity", F.lit("addr1"))
    return round_columns(cards.unionByName(areas, allowMissingColumns=True))


P1_SQL = f"""WITH {TXN_TIES_SQL}, {_CARDED},
c AS (SELECT * FROM carded WHERE card1 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY card1 ORDER BY "TransactionDT" DESC, "TransactionID") = 1),
a AS (SELECT * FROM carded WHERE addr1 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY addr1 ORDER BY "TransactionDT" DESC, "TransactionID") = 1)
SELECT 'card1' AS entity, card1::VARCHAR AS entity_id, "TransactionDT" AS as_of, {sql6('card1_seen_amt')} AS card1_seen_amt, {sql6('card1_amt_max_30d')} AS card1_amt_max_30d,
  {sql6('card1_velocity_1h')} AS card1_velocity_1h, NULL::DOUBLE AS addr1_seen_k FROM c
UNION ALL SELECT 'addr1', addr1::VARCHAR, "TransactionDT", NULL, NULL, NULL, {sql6('addr1_seen_k')} FROM a"""


def p2(spark, sf):
    return round_columns(S.snapshot(_carded(spark, sf), ["card1", "addr1"], ["card1_seen_amt", "card1_amt_max_30d", "card1_velocity_1h", "addr1_seen_k", "hour_of_day"]))


_LONG = [("c", "card1", "card1_seen_amt", 604800), ("c", "card1", "card1_amt_max_30d", 2592000), ("c", "card1", "card1_velocity_1h", 3600), ("a", "addr1", "addr1_seen_k", 604800)]
SNAP_SQL = P1_SQL.split("\nSELECT 'card1'", 1)[0] + ", snap AS (" + " UNION ALL ".join(
    f"""SELECT '{e}' AS entity_type, {e}::VARCHAR AS entity_id, '{f}' AS feature_name, {f} AS value, "TransactionDT" AS written_at, "TransactionDT" + {ttl} AS expires_at FROM {src}""" for src, e, f, ttl in _LONG) + ")"
AS_OF = 30 * 86400


def p3(spark, sf):
    return round_columns(S.visible(S.snapshot(_carded(spark, sf), ["card1", "addr1"], [*CARD_FEATURES, "addr1_seen_k"]), AS_OF))


MODEL_FEATURES = ["log_amount", "hour_of_day", "P_emaildomain_is_free", "card1_seen_amt", "card1_amt_max_30d", "card1_velocity_1h", "pagerank_score", "fraud_neighbor_rate", "entity_degree_card1", "ProductCD", "unknown_feature"]


def _assembled(spark, sf):
    """Daily snapshots of each card, read by later rows as of their own time."""
    t = _carded(spark, sf)
    day = F.floor(F.col("TransactionDT") / 86400)
    daily = t.groupBy("card1", day.alias("d")).agg(F.max_by(F.struct(*CARD_FEATURES), F.struct("TransactionDT", -F.col("TransactionID"))).alias("r"))
    snaps = daily.select(F.col("card1").cast("string").alias("entity_id"), ((F.col("d") + 1) * 86400).cast("long").alias("written_at"), "r.*")
    rows = B.mail_columns(B.log_amount(transactions(spark, sf)), "P_emaildomain").withColumn("hour_of_day", F.expr("(TransactionDT div 3600) % 24"))
    found = S.as_of(rows, "card1", snaps, CARD_FEATURES).drop("card1_snapshot_at")
    batch = rows.where(F.col("TransactionID") % 3 == 0).select("TransactionID", (F.col("k") / 100.0).alias("fraud_neighbor_rate"))
    return rows, found, batch


def p4(spark, sf):
    rows, found, batch = _assembled(spark, sf)
    return round_columns(S.assemble(rows, [found], batch, MODEL_FEATURES))


P4_SQL = f"""WITH {TXN_TIES_SQL}, {_CARDED},
daily AS (SELECT card1, ("TransactionDT" // 86400 + 1) * 86400 AS w, card1_seen_amt, card1_amt_max_30d, card1_velocity_1h FROM carded
  QUALIFY row_number() OVER (PARTITION BY card1, "TransactionDT" // 86400 ORDER BY "TransactionDT" DESC, "TransactionID") = 1),
j AS (SELECT t.*, d.w, d.card1_seen_amt, d.card1_amt_max_30d, d.card1_velocity_1h FROM txn t ASOF LEFT JOIN daily d ON t.card1 = d.card1 AND t."TransactionDT" >= d.w)
SELECT "TransactionID", {sql6('ln(1 + "TransactionAmt")')} AS log_amount, {sql6('(("TransactionDT" // 3600) % 24)::DOUBLE')} AS hour_of_day,
  {sql6('''CASE WHEN "P_emaildomain" IS NOT NULL THEN ("P_emaildomain" IN ('gmail.com', 'yahoo.com'))::INTEGER::DOUBLE END''')} AS "P_emaildomain_is_free",
  {sql6('CASE WHEN "TransactionDT" < w + 604800 THEN card1_seen_amt ELSE 0 END')} AS card1_seen_amt, {sql6('CASE WHEN "TransactionDT" < w + 2592000 THEN card1_amt_max_30d ELSE 0 END')} AS card1_amt_max_30d,
  {sql6('CASE WHEN "TransactionDT" < w + 3600 THEN card1_velocity_1h ELSE 0 END')} AS card1_velocity_1h, {sql6('0.0001::DOUBLE')} AS pagerank_score,
  {sql6('CASE WHEN "TransactionID" % 3 = 0 THEN k / 100.0::DOUBLE ELSE 0.035 END')} AS fraud_neighbor_rate, {sql6('0.0::DOUBLE')} AS entity_degree_card1, NULL::DOUBLE AS "ProductCD",
  {sql6('0.0::DOUBLE')} AS unknown_feature, false AS degraded_mode FROM j"""


def p5(spark, sf):
    """The same assembly with one source gone: defaults everywhere it would have spoken."""
    rows, found, batch = _assembled(spark, sf)
    parts = [("all", S.assemble(rows, [found], batch, MODEL_FEATURES)), ("no entities", S.assemble(rows, [None], batch, MODEL_FEATURES)), ("no batch", S.assemble(rows, [found], None, MODEL_FEATURES))]
    out = None
    for name, df in parts:
        one = df.agg(F.lit(name).alias("sources"), F.bool_and("degraded_mode").alias("degraded_mode"), r6(F.avg("card1_seen_amt")).alias("mean_seen"), r6(F.avg("fraud_neighbor_rate")).alias("mean_rate"))
        out = one if out is None else out.unionByName(one)
    return out


P5_SQL = P4_SQL.split("\nSELECT \"TransactionID\"", 1)[0] + f""", x AS (SELECT CASE WHEN "TransactionDT" < w + 604800 THEN card1_seen_amt ELSE 0 END AS seen, CASE WHEN "TransactionID" % 3 = 0 THEN k / 100.0::DOUBLE ELSE 0.035 END AS rate FROM j)
SELECT 'all' AS sources, false AS degraded_mode, {sql6('avg(seen)')} AS mean_seen, {sql6('avg(rate)')} AS mean_rate FROM x
UNION ALL SELECT 'no entities', true, 0.0, {sql6('avg(rate)')} FROM x UNION ALL SELECT 'no batch', true, {sql6('avg(seen)')}, 0.035 FROM x"""


def p6(spark, sf):
    """Decisions at the tuned threshold from a calibrated probability."""
    return L.decide(scored(spark, sf).withColumn("p", F.col("score")), 0.08, "m1").select("TransactionID", "p", "decision", "model_version")


P6_SQL = f"WITH {SCORED_SQL}\nSELECT \"TransactionID\", score AS p, CASE WHEN score >= 0.08 THEN 'block' ELSE 'allow' END AS decision, 'm1' AS model_version FROM scored"
WEIGHTS = {"TransactionAmt": 0.8, "k": -1.1, "hour": 0.3, "id_01": 0.5}
_NAMES = {"TransactionAmt": "log_amount", "k": "card1_velocity_24h", "hour": "hour_of_day", "id_01": "pagerank_score"}


def _contributions(spark, sf):
    x = _model_frame(spark, sf)
    fitted = L.fit_scaler(x, list(WEIGHTS))
    return L.linear_contributions(x, fitted, WEIGHTS)


def p6_model(spark, sf):
    """Decisions of a stored model with its calibration: how many rows keep what decisions must."""
    train, val, test = _parts(spark, sf)
    path = scratch_path(spark, "scorer")
    L.fit_scorer(train, val, FEATURES, rounds=5, depth=3).save(path)
    d = L.Scorer.load(spark, path).decisions(test, 0.08, "gbt-1")
    return d.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("p").between(0, 1)).alias("n_probabilities"),
                 F.count_if((F.col("decision") == "block") == (F.col("p") >= 0.08)).alias("n_consistent"), F.count_if(F.col("model_version") == "gbt-1").alias("n_versioned"))


P6_MODEL_SQL = f"""WITH {SCORED_SQL} SELECT count(*) AS n_rows, count(*) AS n_probabilities, count(*) AS n_consistent, count(*) AS n_versioned FROM scored WHERE "TransactionDT" >= {24 * 86400}"""


def p7(spark, sf):
    return L.top_contributions(_contributions(spark, sf), 3).select("TransactionID", F.col("rank").cast("long").alias("rank"), "feature", F.round(F.col("value") + 3.7e-9, 6).alias("value"), "direction")


def p7_boosted(spark, sf):
    """Contributions of a boosted model: per row of the last slice, whether they and the base add up to its raw score, and how many count."""
    train, val, test = _parts(spark, sf)
    model, fill = L.train_boosted(train, val, FEATURES, rounds=6, depth=3)
    base = L.PathContributions.of(model, FEATURES).base
    owed = L.boosted_contributions(test, model, FEATURES, fill)
    x = L.assembled(test.select("TransactionID", *[F.col(c).cast("double").alias(c) for c in FEATURES]), FEATURES, fill)
    raw = model.transform(x).select("TransactionID", vector_to_array("rawPrediction")[1].alias("raw"))
    sums = owed.groupBy("TransactionID").agg(F.sum("value").alias("v"), F.count(F.lit(1)).alias("n_features"))
    return sums.join(raw, "TransactionID").select("TransactionID", "n_features", (F.abs(F.col("v") + base - F.col("raw")) < 1e-9).alias("adds_up"))


P7_BOOSTED_SQL = f"""WITH {SCORED_SQL} SELECT "TransactionID", {len(FEATURES)}::BIGINT AS n_features, true AS adds_up FROM scored WHERE "TransactionDT" >= {24 * 86400}"""


CONTRIB_SQL = f"""{SCORED_SQL}, m AS (SELECT *, ("TransactionDT" // 3600) % 24 AS hour FROM scored),
f AS (SELECT "TransactionID", {', '.join(f'coalesce("{c}"::DOUBLE, (SELECT median("{c}"::DOUBLE) FROM m)) AS "{c}"' for c in WEIGHTS)} FROM m),
l AS ({' UNION ALL '.join(f"""SELECT "TransactionID", '{c}' AS feature, {w}::DOUBLE * ("{c}" - avg("{c}") OVER ()) / stddev_pop("{c}") OVER () AS value FROM f""" for c, w in WEIGHTS.items())}),
top AS (SELECT "TransactionID", feature, value, row_number() OVER (PARTITION BY "TransactionID" ORDER BY abs(value) DESC, feature) AS rank, CASE WHEN value > 0 THEN 'high' ELSE 'low' END AS direction
  FROM l WHERE value <> 0 QUALIFY rank <= 3)"""
P7_SQL = f"WITH {CONTRIB_SQL}\nSELECT \"TransactionID\", rank, feature, round(value + 3.7e-9::DOUBLE, 6) AS value, direction FROM top"


def p8(spark, sf):
    """Reason texts; the demo features stand in for the model's own names."""
    top = L.top_contributions(_contributions(spark, sf), 3)
    named = F.create_map(*[F.lit(x) for kv in _NAMES.items() for x in kv])[F.col("feature")]
    return L.reasons(top.withColumn("feature", named)).select("TransactionID", F.array_join("reasons", " | ").alias("reasons"))


_TEXT = {"log_amount": "TransactionAmt", "card1_velocity_24h": "k", "hour_of_day": "hour", "pagerank_score": "id_01"}


def _p8_sql():
    rows = [(src, "high", config.REASON_HIGH[f]) for f, src in _TEXT.items()] + [("TransactionAmt", "low", config.REASON_LOW["log_amount"])]
    values = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in rows)
    return f"""WITH {CONTRIB_SQL}, t(feature, direction, text) AS (VALUES {values})
SELECT "TransactionID", string_agg(text, ' | ' ORDER BY rank) AS reasons FROM top JOIN t USING (feature, direction) GROUP BY 1"""


def p9(spark, sf):
    s = scored(spark, sf)
    champion, shadow = (F.when(F.col(c) >= 0.08, "block").otherwise("allow") for c in ("score", "shadow_score"))
    return s.select("TransactionID", champion.alias("decision"), shadow.alias("shadow_decision"), (champion == shadow).alias("agree"))


P9_SQL = f"""WITH {SCORED_SQL}, d AS (SELECT "TransactionID", CASE WHEN score >= 0.08 THEN 'block' ELSE 'allow' END AS decision, CASE WHEN shadow_score >= 0.08 THEN 'block' ELSE 'allow' END AS shadow_decision FROM scored)
SELECT *, decision = shadow_decision AS agree FROM d"""


def p10(spark, sf):
    """Train on the first split, stop on the second, report AUC and cost-tuned blocks on the third."""
    train, val, test = _parts(spark, sf)
    model, fill = L.train_boosted(train, val, FEATURES, rounds=8, depth=3)
    scored_test = L.decide(L.score_rows(test, model, FEATURES, fill), 0.5, "gbt")
    n = scored_test.agg(F.count(F.lit(1)).alias("n_test"), F.count_if((F.col("p") < 0) | (F.col("p") > 1)).alias("bad_scores"), F.count_if(F.col("decision") == "block").alias("n_block"))
    return L.auc(scored_test, "isFraud", "p").crossJoin(n)


def p11(spark, sf):
    t = scored(spark, sf)
    fitted = L.fit_scaler(t, ["TransactionAmt", "k", "id_01"])
    return round_columns(L.scaled(t, fitted).select("TransactionID", "TransactionAmt", "k", "id_01"))


P11_SQL = f"""WITH {SCORED_SQL}, f AS (SELECT "TransactionID", "TransactionAmt", k::DOUBLE AS k, coalesce(id_01, (SELECT median(id_01) FROM scored)) AS id_01 FROM scored)
SELECT "TransactionID", """ + ", ".join(f'{sql6(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()")} AS {c}' for c in ('"TransactionAmt"', "k", "id_01")) + " FROM f"


def p12(spark, sf):
    train, val, _ = _parts(spark, sf)
    return L.search(cut_lineage(train, "search"), cut_lineage(val, "search"), FEATURES, 9)


def _slices(spark, sf):
    t = full_transactions(spark, sf)
    return t.where(F.col("TransactionDT") < SPLIT_AT), t.where(F.col("TransactionDT") >= SPLIT_AT)


def p13(spark, sf):
    """All feature tiers, the V block and its thinning on a training slice and a later slice; the mean of every feature."""
    chain = C.FeatureChain()
    with chain.slices(*_slices(spark, sf)) as wide:
        kept = {c for c, t_ in wide.dtypes if t_ != "string"} - {"slice"}
        cols = [f for _, f, t_, _ in chain.features if f in kept] + [c for c in numbered(wide.columns)]
        means = wide.groupBy("slice").agg(*[F.avg(F.col(f"`{f}`").cast("double")).alias(f.replace(".", "_")) for f in cols])
        long = means.unpivot(["slice"], [f.replace(".", "_") for f in cols], "feature", "mean")
        return cut_lineage(round_columns(long), "feature-means")


PAST_TIER = [*P.family_columns(["velocity"])["velocity"], *P.family_columns(["stats"])["stats"], "amt_zscore_vs_card1_history", "time_since_last_txn_zscore",
             "addr_change_flag", "device_change_flag", "is_coldstart_card1"]


def p13_past(spark, sf):
    """The past tiers of the chain, row by row, over both slices."""
    chain = C.FeatureChain([(n, make()) for n, make in C.DEFAULT if n in ("velocity", "stats", "behaviour", "cold_start")], thin_columns=False)
    with chain.slices(*_slices(spark, sf)) as wide:
        return cut_lineage(round_columns(wide.select("TransactionID", *PAST_TIER)), "past-tier")


def _past_tier_sql():
    stats = ", ".join(f"""CASE WHEN "{e}" IS NOT NULL THEN {sql6(f'{dict(mean="avg", std="stddev_samp", max="max")[s]}("TransactionAmt") OVER (PARTITION BY "{e}" ORDER BY "TransactionDT" RANGE BETWEEN {secs} PRECEDING AND 1 PRECEDING)')} END AS "{e}_amt_{s}_{w}" """
                      for e, some in config.STATS_BY_ENTITY.items() for s in some for w, secs in config.STATS_WINDOWS.items())
    joins = " ".join(f'JOIN ({q}) AS q{i} USING ("TransactionID")' for i, q in enumerate((W1_SQL, W3_SQL, W4_SQL, W5_SQL, W6_SQL, W9_SQL)))
    return f"""SELECT "TransactionID", {', '.join(f'"{c}"' for c in PAST_TIER)} FROM (WITH {TXN_TIES_SQL} SELECT "TransactionID", {stats} FROM tied) AS s {joins}"""


def p13_encoding(spark, sf):
    """The encoding tier: out of fold on the training slice, the learned table on the later one."""
    chain = C.FeatureChain([("encoding", C.Encoding())], thin_columns=False)
    with chain.slices(*_slices(spark, sf)) as wide:
        return cut_lineage(round_columns(wide.select("TransactionID", *[f"{c}_target_enc" for c in ENCODED])), "encoding-tier")


ENCODED = ["card4", "addr1", "P_emaildomain"]


def _encoding_tier_sql():
    a, k = config.ENCODING_ALPHA, config.N_FOLDS
    ctes, cols, joins = [], [], []
    for c in ENCODED:
        ctes.append(f"""n_{c} AS (SELECT "{c}" AS cat, fold, count(*) AS n, sum(y) AS h FROM x WHERE early GROUP BY 1, 2),
t_{c} AS (SELECT cat, sum(n) AS n, sum(h) AS h FROM n_{c} GROUP BY 1)""")
        joins.append(f"""LEFT JOIN n_{c} ON n_{c}.cat IS NOT DISTINCT FROM x."{c}" AND n_{c}.fold = x.fold LEFT JOIN t_{c} ON t_{c}.cat IS NOT DISTINCT FROM x."{c}" """)
        cols.append(f"""CASE WHEN early THEN {sql6(f'(t_{c}.h - n_{c}.h + {a}::DOUBLE * o.prior) / (t_{c}.n - n_{c}.n + {a}::DOUBLE)')}
  ELSE {sql6(f'CASE WHEN t_{c}.n IS NULL THEN g.prior ELSE (t_{c}.h + {a}::DOUBLE * g.prior) / (t_{c}.n + {a}::DOUBLE) END')} END AS "{c}_target_enc" """)
    return f"""WITH {FULL_SQL},
x AS (SELECT *, "isFraud"::DOUBLE AS y, "TransactionDT" < {SPLIT_AT} AS early, (('0x' || substr(md5('{config.SEED}:' || "TransactionID"), 1, 8))::BIGINT % {k}) AS fold FROM branded),
g AS (SELECT avg(y) AS prior FROM x WHERE early),
o AS (SELECT f.fold, avg(y) AS prior FROM (SELECT unnest(range({k})) AS fold) f JOIN x ON x.fold <> f.fold AND early GROUP BY 1),
{', '.join(ctes)}
SELECT "TransactionID", {', '.join(cols)} FROM x JOIN o ON o.fold = x.fold CROSS JOIN g {' '.join(joins)}"""


def p13_manifest(spark, sf):
    t = full_transactions(spark, sf)
    parts = C.FeatureChain([(n, make()) for n, make in C.DEFAULT if n in ("amount", "calendar", "mail", "velocity", "stats", "cold_start")])
    parts.fit_transform(t)
    return parts.manifest(spark).select("generator", "feature", "dtype")


def _manifest_sql():
    made = [("amount", {"log_amount": "double", "amount_decile": "int"}),
            ("calendar", {**{c: "int" for c in ("hour_of_day", "day_of_week", "is_weekend", "is_business_hours")}, "hour_sin": "double", "hour_cos": "double"}),
            ("mail", {f"P_emaildomain_{k}": t for k, t in (("provider", "string"), ("tld", "string"), ("is_free", "tinyint"), ("is_disposable", "tinyint"))}),
            ("velocity", {f"{e}_velocity_{w}": "bigint" for e in config.VELOCITY_ENTITIES for w in config.VELOCITY_WINDOWS}),
            ("stats", {**{f"card1_amt_{k}_30d": "double" for k in ("mean", "std", "max")}, **{f"addr1_amt_{k}_30d": "double" for k in ("mean", "std")}}),
            ("cold_start", {"is_coldstart_card1": "int"})]
    return "SELECT * FROM (VALUES " + ", ".join(f"('{g}', '{f}', '{t}')" for g, fs in made for f, t in fs.items()) + ") AS t(generator, feature, dtype)"


def p14(spark, sf):
    """AUC under a random split against a split by time."""
    x = _model_frame(spark, sf)
    held = clean.stratified_take(x, 0.2).select("TransactionID", F.lit(True).alias("held"))
    marked = cut_lineage(x.join(held, "TransactionID", "left").fillna(False, ["held"]), "split-gap")
    by_time = F.col("TransactionDT") >= 24 * 86400
    rows = []
    for name, test in (("random", F.col("held")), ("by time", by_time)):
        train, held_rows = marked.where(~test), marked.where(test)
        stop = F.pmod(F.xxhash64("TransactionID"), F.lit(5)) == 0
        model, fill = L.train_boosted(train.where(~stop), train.where(stop), FEATURES, rounds=8, depth=3)
        r = L.auc(L.score_rows(held_rows, model, FEATURES, fill), "isFraud", "p").first()
        rows.append((name, r["n_pos"] + r["n_neg"], r["auc"]))
    return spark.createDataFrame(rows, "split string, n_test long, auc double")


def a23(spark, sf):
    """Deciles of out-of-fold label quality and the share below the limit."""
    from tidemark.functions.ordered import exact_quantiles

    q = cut_lineage(L.label_quality(_model_frame(spark, sf), FEATURES), "label-quality")
    deciles = exact_quantiles(q, "quality_score", [i / 10 for i in range(11)])
    return deciles.crossJoin(L.share_below(q))


QUERIES = {
    "p1_newest_snapshot": p1, "p2_long_rows_ttl": p2, "p3_visible_values": p3, "p4_feature_assembly": p4, "p5_degraded_mode": p5, "p6_decisions": p6, "p6_model_decisions": p6_model, "p7_top_contributions": p7, "p7_boosted_contributions": p7_boosted,
    "p8_reason_texts": p8, "p9_shadow_columns": p9, "p10_boosted_trees": p10, "p11_impute_scale": p11, "p12_parameter_search": p12, "p13_feature_tiers": p13, "p13_past_tier": p13_past, "p13_encoding_tier": p13_encoding,
    "p13_feature_manifest": p13_manifest, "p14_split_gap": p14, "a23_label_quality": a23,
}
ORACLES = {
    "p1_newest_snapshot": P1_SQL, "p2_long_rows_ttl": f"{SNAP_SQL}\nSELECT * REPLACE ({sql6('value')} AS value) FROM snap",
    "p3_visible_values": f"{SNAP_SQL}\nSELECT * REPLACE ({sql6('value')} AS value) FROM snap WHERE written_at <= {AS_OF} AND expires_at > {AS_OF}",
    "p4_feature_assembly": P4_SQL, "p5_degraded_mode": P5_SQL, "p6_decisions": P6_SQL, "p6_model_decisions": P6_MODEL_SQL, "p7_top_contributions": P7_SQL, "p7_boosted_contributions": P7_BOOSTED_SQL, "p8_reason_texts": _p8_sql(), "p9_shadow_columns": P9_SQL, "p13_feature_manifest": _manifest_sql(), "p13_past_tier": _past_tier_sql(), "p13_encoding_tier": _encoding_tier_sql(), "p11_impute_scale": P11_SQL,
}
