"""Queries over sources, sinks, contracts, cleaning and row features."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import config
from tidemark.functions.numeric import r6, round_columns, sql6
from tidemark.operators import basic as B
from tidemark.operators import clean as C
from tidemark.operators import contracts as K
from tidemark.operators import store
from tidemark.session import scratch_path
from tidemark.sources import tables as S
from tidemark.sources.views import PREDICTIONS_SQL, TXN_SQL, predictions, transactions

RAW = ["TransactionID", "isFraud", "TransactionDT", "TransactionAmt", "ProductCD", "card1", "addr1", "P_emaildomain"]


def raw(spark, sf):
    return transactions(spark, sf).select(*RAW)


def identity(spark, sf):
    """A quarter of the transactions carry device attributes."""
    t = transactions(spark, sf).where(F.col("k") % 4 == 0)
    return t.select("TransactionID", F.when(F.col("k") % 8 == 0, "mobile").otherwise("desktop").alias("DeviceType"),
                    "DeviceInfo", F.col("k").cast("double").alias("id_01"), F.concat(F.lit("os"), F.col("k") % 3).alias("id_30"))


IDENTITY_SQL = """
ident AS (SELECT "TransactionID", CASE WHEN k % 8 = 0 THEN 'mobile' ELSE 'desktop' END AS "DeviceType", "DeviceInfo",
                 k::DOUBLE AS id_01, 'os' || (k % 3) AS id_30 FROM txn WHERE k % 4 = 0)"""
_RAW_COLS = ", ".join(f'"{c}"' for c in RAW)


def s1(spark, sf):
    path = scratch_path(spark, "transactions-csv")
    raw(spark, sf).write.option("header", True).csv(path)
    return S.read_transactions(spark, path)


S1_SQL = f'WITH {TXN_SQL}\nSELECT * REPLACE (addr1::DOUBLE AS addr1) FROM (SELECT {_RAW_COLS} FROM txn)'


def s2(spark, sf):
    path = scratch_path(spark, "identity-csv")
    identity(spark, sf).withColumnsRenamed({"id_01": "id-01", "id_30": "id-30"}).write.option("header", True).csv(path)
    return S.read_identity(spark, path)


S2_SQL = f"WITH {TXN_SQL},{IDENTITY_SQL}\nSELECT * FROM ident"


def s3(spark, sf):
    return S.merge_identity(raw(spark, sf), identity(spark, sf))


S3_SQL = f'WITH {TXN_SQL},{IDENTITY_SQL}\nSELECT t.*, ident.* EXCLUDE ("TransactionID") FROM (SELECT {_RAW_COLS} FROM txn) t LEFT JOIN ident ON ident."TransactionID" = t."TransactionID"'

T_END, V_END = 18 * 86400, 24 * 86400


def s4(spark, sf):
    path = scratch_path(spark, "splits")
    S.write_splits(C.with_split(raw(spark, sf), T_END, V_END), path)
    return S.read_split(spark, path, "val")


S4_SQL = f'WITH {TXN_SQL}\nSELECT {_RAW_COLS} FROM txn WHERE "TransactionDT" >= {T_END} AND "TransactionDT" < {V_END}'


def _manifest(spark, sf):
    return round_columns(C.split_manifest(C.with_split(raw(spark, sf), T_END, V_END), T_END, V_END))


def s5(spark, sf):
    path = scratch_path(spark, "manifest")
    m = _manifest(spark, sf)
    S.write_manifest(m, path)
    return S.read_manifest(spark, path, T.StructType(sorted(m.schema.fields, key=lambda f: f.name)))


_SPLIT_AGGS = ", ".join(
    f"""count(*) FILTER (split = '{s}') AS n_{s}, {sql6(f"avg(\"isFraud\"::DOUBLE) FILTER (split = '{s}')")} AS fraud_rate_{s},
    min("TransactionDT") FILTER (split = '{s}') AS min_dt_{s}, max("TransactionDT") FILTER (split = '{s}') AS max_dt_{s}""" for s in ("train", "val", "test"))
SPLIT_SQL = f"""{TXN_SQL},
sp AS (SELECT *, CASE WHEN "TransactionDT" < {T_END} THEN 'train' WHEN "TransactionDT" < {V_END} THEN 'val' ELSE 'test' END AS split FROM txn)"""
C6_SQL = f"WITH {SPLIT_SQL}\nSELECT {_SPLIT_AGGS}, {T_END}::BIGINT AS train_end_dt, {V_END}::BIGINT AS val_end_dt, 42::BIGINT AS seed FROM sp"


def s6(spark, sf):
    """Two appends and one empty append: the empty one leaves no file."""
    path = scratch_path(spark, "alerts")
    t = raw(spark, sf)
    alerts = t.where(F.col("TransactionAmt") > 200).select("TransactionID", r6("TransactionAmt").alias("TransactionAmt"), "ProductCD")
    wrote = [
        S.append_lines(alerts.where(F.col("ProductCD") == "view"), path),
        S.append_lines(alerts.where(F.col("TransactionAmt") < 0), path),
        S.append_lines(alerts.where(F.col("ProductCD") != "view"), path),
    ]
    back = spark.read.schema(alerts.schema).json(path)
    return back.withColumn("appends", F.lit(sum(wrote)).cast("long"))


S6_SQL = f'WITH {TXN_SQL}\nSELECT "TransactionID", {sql6("\"TransactionAmt\"")} AS "TransactionAmt", "ProductCD", 2::BIGINT AS appends FROM txn WHERE "TransactionAmt" > 200'

PRED_COLS = ["id", "request_id", "txn_id", "client_id", "score", "decision", "latency_ms", "model_version", "degraded_mode"]


def s7(spark, sf):
    path = scratch_path(spark, "predictions")
    p = predictions(spark, sf)
    S.append_predictions(p.where(F.col("id") % 2 == 0), path)
    S.append_predictions(p.where(F.col("id") % 2 == 1), path)
    back = spark.read.parquet(path)
    return back.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day"), "decision", "degraded_mode").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("latency_ms")).alias("mean_latency_ms"), F.countDistinct("request_id").alias("requests"))


S7_SQL = f"""WITH {PREDICTIONS_SQL}
SELECT strftime(created_at, '%Y-%m-%d') AS day, decision, degraded_mode, count(*) AS n, {sql6('avg(latency_ms)')} AS mean_latency_ms,
       count(DISTINCT request_id) AS requests FROM preds GROUP BY 1, 2, 3"""


def s8(spark, sf):
    """Write a feature snapshot and read the rows still valid two hours after the write."""
    path = scratch_path(spark, "feature-store")
    wide = _entity_features(spark, sf)
    store.write_snapshot(store.to_long(wide, "card1", "value", ["card1_velocity_1h", "card1_amt_max_30d", "odd name"], written_at=1000000), path)
    back = store.visible(spark.read.parquet(path), as_of=1000000 + 7200)
    return back.select("entity_type", "entity_id", "feature_name", r6("value").alias("value"), "written_at", "expires_at")


def _entity_features(spark, sf):
    t = raw(spark, sf)
    return t.groupBy(F.col("card1").cast("string").alias("value")).agg(
        F.count(F.lit(1)).cast("double").alias("card1_velocity_1h"), F.max("TransactionAmt").alias("card1_amt_max_30d"),
        F.min("TransactionAmt").alias("odd name"))


S8_SQL = f"""WITH {TXN_SQL}
SELECT 'card1' AS entity_type, card1::VARCHAR AS entity_id, 'card1_amt_max_30d' AS feature_name, {sql6('max("TransactionAmt")')} AS value,
       1000000::BIGINT AS written_at, 1000000::BIGINT + 2592000 AS expires_at FROM txn GROUP BY card1"""


def s9(spark, sf):
    return S.load_report(raw(spark, sf)).select("rows", "columns", "schema_version")


S9_SQL = f"WITH {TXN_SQL}\nSELECT count(*) AS rows, 8::BIGINT AS columns, 1::BIGINT AS schema_version FROM txn"


def l5(spark, sf):
    return K.narrow_types(raw(spark, sf))


def _int_rule(c, t):
    q = f'"{c}"'
    return f"""SELECT '{c}' AS "column", '{t}' AS from_type, CASE WHEN min({q}) >= -128 AND max({q}) <= 127 THEN 'tinyint'
  WHEN min({q}) >= -32768 AND max({q}) <= 32767 THEN 'smallint' WHEN min({q}) >= -2147483648 AND max({q}) <= 2147483647 THEN 'int' ELSE 'bigint' END AS to_type FROM txn"""


L5_SQL = f"WITH {TXN_SQL}\n" + "\nUNION ALL ".join(
    [_int_rule(c, t) for c, t in (("TransactionID", "bigint"), ("isFraud", "int"), ("TransactionDT", "bigint"), ("card1", "bigint"), ("addr1", "int"))]
    + ["SELECT 'TransactionAmt', 'double', 'float'"]
    + [f"""SELECT '{c}', 'string', CASE WHEN count(DISTINCT "{c}")::DOUBLE / count(*) < 0.5 THEN 'category' ELSE 'string' END FROM txn""" for c in ("ProductCD", "P_emaildomain")])

# The raw contract's own columns, on rows made to break it.
V1_RULES = K.Contract("demo", 1, [
    K.Rule("TransactionID", "long", nullable=False, unique=True), K.Rule("isFraud", "long", nullable=False, one_of=[0, 1]),
    K.Rule("TransactionDT", "long", nullable=False, at_least=0), K.Rule("TransactionAmt", "double", nullable=False, above=0.0),
    K.Rule("ProductCD", "string", nullable=False, one_of=["view", "click", "purchase"]), K.Rule("card4", "string"),
    K.Rule("card1", "string"), K.Rule(r"^V\d{1,3}$", "double", required=False, pattern=True, nullable=False, at_most=50.0),
])


def v1(spark, sf):
    t = transactions(spark, sf)
    broken = t.select(
        F.expr("TransactionID div 2").alias("TransactionID"), (F.col("isFraud") * (1 + F.col("k") % 2)).alias("isFraud"), "TransactionDT",
        (F.col("TransactionAmt") - 20).alias("TransactionAmt"), "ProductCD", "card1",
        F.col("k").cast("double").alias("V1"), F.col("addr1").cast("double").alias("V22"))
    return K.violations(broken, V1_RULES)


V1_SQL = f"""WITH {TXN_SQL},
b AS (SELECT "TransactionID" // 2 AS id, "isFraud" * (1 + k % 2) AS f, "TransactionAmt" - 20 AS amt, "ProductCD" AS p, k, addr1 FROM txn)
SELECT * FROM (
  SELECT 'unique' AS rule, 'TransactionID' AS "column", count(*) - count(DISTINCT id) AS n_bad FROM b
  UNION ALL SELECT 'one_of', 'isFraud', count(*) FILTER (f NOT IN (0, 1)) FROM b
  UNION ALL SELECT 'above', 'TransactionAmt', count(*) FILTER (amt <= 0) FROM b
  UNION ALL SELECT 'one_of', 'ProductCD', count(*) FILTER (p NOT IN ('view', 'click', 'purchase')) FROM b
  UNION ALL SELECT 'required', 'card4', 1 UNION ALL SELECT 'dtype', 'card1', 1
  UNION ALL SELECT 'at_most', 'V1', count(*) FILTER (k > 50) FROM b
  UNION ALL SELECT 'not_null', 'V22', count(*) FILTER (addr1 IS NULL) FROM b) WHERE n_bad > 0"""


def v3(spark, sf):
    """Lineage of load, clean and split, written and read back."""
    return _lineage(spark, sf)[0].select("step", "input_rows", "output_rows", (F.col("input_schema") == F.col("output_schema")).alias("same_schema"))


def _lineage(spark, sf):
    t = raw(spark, sf).withColumn("TransactionAmt", F.col("TransactionAmt") - 20)
    folder = scratch_path(spark, "lineage")

    def sink(name):
        return lambda df: df.write.parquet(f"{folder}/{name}")

    def back(name):
        return spark.read.parquet(f"{folder}/{name}")

    steps = K.traced("load_merged", t, lambda df: df, sink("load"))
    steps = steps.unionByName(K.traced("interim_clean", back("load"), lambda df: C.with_split(C.drop_invalid(df), T_END, V_END), sink("clean")))
    for s in ("train", "val", "test"):
        steps = steps.unionByName(K.traced(f"split_{s}", back("clean"), lambda df, s=s: df.where(F.col("split") == s), sink(s)))
    stored = None
    for s in ("train", "val", "test"):
        one = back(s).agg(F.count(F.lit(1)).alias("rows")).withColumn("split", F.lit(s))
        stored = one if stored is None else stored.unionByName(one)
    return steps, stored


V3_SQL = f"""WITH {SPLIT_SQL}, good AS (SELECT * FROM sp WHERE "TransactionAmt" - 20 > 0)
SELECT 'load_merged' AS step, count(*) AS input_rows, count(*) AS output_rows, true AS same_schema FROM sp
UNION ALL SELECT 'interim_clean', (SELECT count(*) FROM sp), count(*), false FROM good
UNION ALL SELECT 'split_' || split, (SELECT count(*) FROM good), count(*), true FROM good GROUP BY split"""


def v4(spark, sf):
    """The honest trail passes; one with a lost step, invented rows and an old manifest does not."""
    steps, stored = _lineage(spark, sf)
    forged = steps.where(F.col("step") != "split_val").withColumn(
        "output_rows", F.when(F.col("step") == "interim_clean", F.col("input_rows") + 1).otherwise(F.col("output_rows")))
    return K.lineage_failures(steps, stored, 1).select(F.lit("honest").alias("trail"), "contract").unionByName(
        K.lineage_failures(forged, stored, 2).select(F.lit("forged").alias("trail"), "contract"))


# Without its step a split's rows are not compared and the sum of the splits is unknown.
V4_SQL = """SELECT 'forged' AS trail, unnest(['steps_present', 'clean_only_drops', 'manifest_version']) AS contract WHERE (SELECT count(*) FROM events) > 0"""


def v5(spark, sf):
    return S.file_hashes(spark, sf, "*.parquet")


def c1(spark, sf):
    return C.drop_report(raw(spark, sf).withColumn("TransactionAmt", F.col("TransactionAmt") - 20))


C1_SQL = f"""WITH {TXN_SQL}
SELECT count(*) AS rows_in, count(*) FILTER (NOT "TransactionAmt" - 20 <= 0) AS rows_out, 'non_positive_amount' AS reason,
  count(*) FILTER ("TransactionAmt" - 20 <= 0) AS dropped,
  (SELECT string_agg(i, ',' ORDER BY i) FROM (SELECT "TransactionID" AS i FROM txn WHERE "TransactionAmt" - 20 <= 0 ORDER BY 1 LIMIT 10)) AS sample_ids FROM txn"""


def c2(spark, sf):
    t = C.calendar(C.anchored(raw(spark, sf)))
    return t.select("TransactionID", F.unix_seconds("timestamp").alias("epoch"), "hour", "day_of_week", "is_weekend")


C2_SQL = f"""WITH {TXN_SQL}, x AS (SELECT "TransactionID", TIMESTAMP '2017-12-01' + to_seconds("TransactionDT") AS ts FROM txn)
SELECT "TransactionID", epoch(ts)::BIGINT AS epoch, hour(ts)::INTEGER AS hour, (isodow(ts) - 1)::INTEGER AS day_of_week, (isodow(ts) >= 6)::INTEGER AS is_weekend FROM x"""


def _messy(t):
    return F.when(F.col("k") % 3 == 0, F.concat(F.lit(" \t"), F.upper("P_emaildomain"), F.lit("\n "))).otherwise(F.col("P_emaildomain"))


def c4(spark, sf):
    t = transactions(spark, sf)
    t = t.withColumn("P_emaildomain", _messy(t))
    return C.standard_email(t, ["P_emaildomain", "R_emaildomain"]).select("TransactionID", "P_emaildomain")


C4_SQL = f'WITH {TXN_SQL}\nSELECT "TransactionID", "P_emaildomain" FROM txn'


def c5(spark, sf):
    return C.with_split(raw(spark, sf), T_END, V_END).select("TransactionID", "split")


def c7(spark, sf):
    return C.overlap_report(C.with_split(raw(spark, sf), T_END, V_END))


C7_SQL = f"""WITH {SPLIT_SQL}, d AS (SELECT "TransactionID", count(DISTINCT split) AS s FROM sp GROUP BY 1)
SELECT (SELECT count(*) FILTER (s > 1) FROM d) AS shared_ids, (SELECT count(*) FROM d) AS distinct_ids, count(*) AS rows,
  max("TransactionDT") FILTER (split = 'train') < min("TransactionDT") FILTER (split = 'val') AS train_before_val,
  max("TransactionDT") FILTER (split = 'val') < min("TransactionDT") FILTER (split = 'test') AS val_before_test FROM sp"""


def c8(spark, sf):
    t = transactions(spark, sf)
    cols = C.numeric_features(t)
    return t.select(*[r6(F.avg(c)).alias(c) for c in cols])


C8_SQL = f'WITH {TXN_SQL}\nSELECT {sql6("avg(\"TransactionAmt\")")} AS "TransactionAmt", {sql6("avg(card1)")} AS card1, {sql6("avg(k)")} AS k, {sql6("avg(addr1)")} AS addr1 FROM txn'


def c9(spark, sf):
    return C.stratified_take(raw(spark, sf), 0.1)


C9_SQL = f"""WITH {TXN_SQL}, h AS (SELECT "TransactionID", "isFraud", substr(md5('42:' || "TransactionID"), 1, 8) AS h FROM txn)
SELECT "TransactionID", "isFraud" FROM h QUALIFY row_number() OVER (PARTITION BY "isFraud" ORDER BY h, "TransactionID")
  <= floor(count(*) OVER (PARTITION BY "isFraud") * 0.1::DOUBLE + 0.5::DOUBLE)"""


def c10(spark, sf):
    t = transactions(spark, sf)
    nested = t.select(
        "TransactionID", "TransactionAmt",
        F.create_map(F.lit("V1"), F.col("k").cast("double"), F.lit("V2"), F.col("addr1").cast("double")).alias("vesta_v"),
        F.from_json(F.concat(F.lit('{"C1": '), F.col("k").cast("string"), F.lit("}")), "map<string,double>").alias("vesta_c"))
    return C.flatten_groups(nested, {"vesta_v": ["V1", "V2", "V3"], "vesta_c": ["C1"]})


C10_SQL = f'WITH {TXN_SQL}\nSELECT "TransactionID", "TransactionAmt", k::DOUBLE AS "V1", addr1::DOUBLE AS "V2", NULL::DOUBLE AS "V3", k::DOUBLE AS "C1", NULL::INTEGER AS "isFraud" FROM txn'


def f1(spark, sf):
    return B.log_amount(raw(spark, sf)).select("TransactionID", r6("log_amount").alias("log_amount"))


F1_SQL = f'WITH {TXN_SQL}\nSELECT "TransactionID", {sql6("ln(1 + \"TransactionAmt\")")} AS log_amount FROM txn'


def f2(spark, sf):
    t = raw(spark, sf)
    edges = B.decile_edges(t.where(F.col("TransactionDT") < T_END))
    # Later amounts are scaled so that some fall outside the fitted range on either side.
    later = t.withColumn("TransactionAmt", F.when(F.col("TransactionID") % 50 == 0, 0.001).when(F.col("TransactionID") % 50 == 1, 1e6)
                         .when(F.col("TransactionID") % 50 != 2, F.col("TransactionAmt")))
    return B.amount_decile(later, edges).select("TransactionID", "amount_decile")


F2_SQL = f"""WITH {TXN_SQL},
e AS (SELECT quantile_cont("TransactionAmt", [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]) AS e FROM txn WHERE "TransactionDT" < {T_END}),
x AS (SELECT "TransactionID", CASE "TransactionID" % 50 WHEN 0 THEN 0.001 WHEN 1 THEN 1e6 WHEN 2 THEN NULL ELSE "TransactionAmt" END AS a FROM txn)
SELECT "TransactionID", CASE WHEN a >= e[1] AND a <= e[11] THEN len(list_filter(e[2:10], lambda v: a > v)) ELSE 9 END::INTEGER AS amount_decile FROM x, e"""


def f3(spark, sf):
    out = B.calendar_set(raw(spark, sf))
    return round_columns(out.select("TransactionID", "hour_of_day", "day_of_week", "is_weekend", "is_business_hours", "hour_sin", "hour_cos"))


F3_SQL = f"""WITH {TXN_SQL}, x AS (SELECT "TransactionID", TIMESTAMP '2017-12-01' + to_seconds("TransactionDT") AS ts FROM txn)
SELECT "TransactionID", hour(ts)::INTEGER AS hour_of_day, (isodow(ts) - 1)::INTEGER AS day_of_week, (isodow(ts) >= 6)::INTEGER AS is_weekend,
  (hour(ts) BETWEEN 9 AND 16)::INTEGER AS is_business_hours, {sql6('sin(2 * pi() * hour(ts) / 24)')} AS hour_sin, {sql6('cos(2 * pi() * hour(ts) / 24)')} AS hour_cos FROM x"""


def f4(spark, sf):
    return B.mail_columns(raw(spark, sf), "P_emaildomain").select("TransactionID", "P_emaildomain_provider", "P_emaildomain_tld")


F4_SQL = f"""WITH {TXN_SQL}
SELECT "TransactionID", CASE WHEN contains("P_emaildomain", '.') THEN regexp_extract("P_emaildomain", '^(.*)\\.', 1) ELSE "P_emaildomain" END AS "P_emaildomain_provider",
  CASE WHEN contains("P_emaildomain", '.') THEN string_split("P_emaildomain", '.')[-1] WHEN "P_emaildomain" IS NOT NULL THEN '' END AS "P_emaildomain_tld" FROM txn"""


def f5(spark, sf):
    out = B.mail_columns(raw(spark, sf), "P_emaildomain")
    return out.select("TransactionID", F.col("P_emaildomain_is_free").cast("int").alias("is_free"), F.col("P_emaildomain_is_disposable").cast("int").alias("is_disposable"))


F5_SQL = f"""WITH {TXN_SQL}
SELECT "TransactionID", CASE WHEN "P_emaildomain" IS NOT NULL THEN ("P_emaildomain" IN ('gmail.com', 'yahoo.com'))::INTEGER END AS is_free,
  CASE WHEN "P_emaildomain" IS NOT NULL THEN ("P_emaildomain" = 'mailinator.com')::INTEGER END AS is_disposable FROM txn"""


def f6(spark, sf):
    t = transactions(spark, sf)
    cols = B.columns_often_missing(t)
    return B.missing_indicators(t.drop("addr1"), cols).select("TransactionID", *[f"is_null_{c}" for c in cols])


F6_SQL = f"""WITH {TXN_SQL}
SELECT "TransactionID", ("DeviceInfo" IS NULL)::INTEGER AS "is_null_DeviceInfo", ("P_emaildomain" IS NULL)::INTEGER AS "is_null_P_emaildomain" FROM txn"""

QUERIES = {
    "s1_csv_transactions": s1, "s2_csv_identity": s2, "s3_merged": s3, "s4_split_parquet": s4, "s5_manifest_json": s5, "s6_json_lines": s6,
    "s7_predictions_sink": s7, "s8_feature_snapshot": s8, "s9_load_report": s9, "l5_narrow_types": l5, "v1_contract": v1, "v3_lineage": v3,
    "v4_lineage_checks": v4, "v5_file_hashes": v5, "c1_drop_report": c1, "c2_calendar": c2, "c4_email": c4, "c5_split": c5, "c6_split_manifest": _manifest,
    "c7_overlap": c7, "c8_numeric_features": c8, "c9_stratified_take": c9, "c10_flatten": c10, "f1_log_amount": f1, "f2_amount_decile": f2,
    "f3_calendar_set": f3, "f4_email_split": f4, "f5_email_flags": f5, "f6_missing_indicators": f6,
}
ORACLES = {
    "s1_csv_transactions": S1_SQL, "s2_csv_identity": S2_SQL, "s3_merged": S3_SQL, "s4_split_parquet": S4_SQL, "s5_manifest_json": C6_SQL, "s6_json_lines": S6_SQL,
    "s7_predictions_sink": S7_SQL, "s8_feature_snapshot": S8_SQL, "s9_load_report": S9_SQL, "l5_narrow_types": L5_SQL, "v1_contract": V1_SQL, "v3_lineage": V3_SQL,
    "v4_lineage_checks": V4_SQL, "c1_drop_report": C1_SQL, "c2_calendar": C2_SQL, "c4_email": C4_SQL,
    "c5_split": f'WITH {SPLIT_SQL}\nSELECT "TransactionID", split FROM sp', "c6_split_manifest": C6_SQL,
    "c7_overlap": C7_SQL, "c8_numeric_features": C8_SQL, "c9_stratified_take": C9_SQL, "c10_flatten": C10_SQL, "f1_log_amount": F1_SQL, "f2_amount_decile": F2_SQL,
    "f3_calendar_set": F3_SQL, "f4_email_split": F4_SQL, "f5_email_flags": F5_SQL, "f6_missing_indicators": F6_SQL,
}
