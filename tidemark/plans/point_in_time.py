"""Queries over strictly-past features, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions.numeric import r6, round_columns
from tidemark.operators import velocity as V
from tidemark.operators.folds import Fold, past_fold
from tidemark.operators.history import running, sliding_counts
from tidemark.operators.leakcheck import future_leaks, leaks_of_any_past
from tidemark.session import cut_lineage
from tidemark.sources.views import TXN_SQL, TXN_TIES_SQL, order_transactions, ORDERS_SQL, transactions

ENT = config.VELOCITY_ENTITIES


def tied(spark: SparkSession, sf: str) -> DataFrame:
    t = transactions(spark, sf, ties=True)
    return t.withColumn("hour_of_day", F.expr("(TransactionDT div 3600) % 24"))


def w1(spark, sf):
    return V.velocity(tied(spark, sf))


W1_SQL = f"WITH {TXN_TIES_SQL}\nSELECT \"TransactionID\",\n" + ",\n".join(
    f'CASE WHEN "{e}" IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY "{e}" ORDER BY "TransactionDT" '
    f'RANGE BETWEEN {s} PRECEDING AND 1 PRECEDING) END AS "{e}_velocity_{w}"'
    for e in ENT for w, s in config.VELOCITY_WINDOWS.items()
) + "\nFROM tied"


def w2(spark, sf):
    # One amount in nine is missing, so the statistics skip rows.
    t = tied(spark, sf).withColumn("TransactionAmt", F.when(F.col("k") % 9 != 0, F.col("TransactionAmt")))
    return round_columns(V.amount_stats(t, windows={"30d": 2592000, "7d": 604800}))


_FN = {"mean": "avg", "std": "stddev_samp", "max": "max"}
W2_SQL = f"WITH {TXN_TIES_SQL},\nx AS (SELECT * REPLACE (CASE WHEN k % 9 <> 0 THEN \"TransactionAmt\" END AS \"TransactionAmt\") FROM tied)\nSELECT \"TransactionID\",\n" + ",\n".join(
    f'CASE WHEN "{e}" IS NOT NULL THEN round({_FN[s]}("TransactionAmt") OVER (PARTITION BY "{e}" ORDER BY "TransactionDT" '
    f'RANGE BETWEEN {secs} PRECEDING AND 1 PRECEDING) + 3.7e-9::DOUBLE, 6) + 0.0 END AS "{e}_amt_{s}_{w}"'
    for e, stats in config.STATS_BY_ENTITY.items() for s in stats for w, secs in {"30d": 2592000, "7d": 604800}.items()
) + "\nFROM x"


def w2_orders(spark, sf):
    return round_columns(V.amount_stats(order_transactions(spark, sf)))


W2_ORDERS_SQL = f"WITH {ORDERS_SQL}\nSELECT \"TransactionID\",\n" + ",\n".join(
    f'round({_FN[s]}("TransactionAmt") OVER (PARTITION BY "{e}" ORDER BY "TransactionDT" '
    f'RANGE BETWEEN 2592000 PRECEDING AND 1 PRECEDING) + 3.7e-9::DOUBLE, 6) + 0.0 AS "{e}_amt_{s}_30d"'
    for e, stats in config.STATS_BY_ENTITY.items() for s in stats
) + "\nFROM otxn"

# A naive pass over each row's own past; the running frames are spelled out as a join.
PAST = """
past AS (
  SELECT a."TransactionID" AS id, a."TransactionDT" AS t, a."TransactionAmt" AS amt, (a."TransactionDT" // 3600) % 24 AS hr,
         a.addr1 AS addr, a."DeviceInfo" AS dev,
         b."TransactionID" AS pid, b."TransactionDT" AS pt, b."TransactionAmt" AS pamt, (b."TransactionDT" // 3600) % 24 AS phr,
         b.addr1 AS paddr, b."DeviceInfo" AS pdev
  FROM tied a JOIN tied b ON a.card1 = b.card1 AND b."TransactionDT" < a."TransactionDT")"""


def w3(spark, sf):
    # Parts on which the score is well conditioned; tests cover a constant past.
    return round_columns(V.zscores(tied(spark, sf)).select("TransactionID", "amt_zscore_vs_card1_history"))


W3_SQL = f"""WITH {TXN_TIES_SQL},{PAST},
s AS (SELECT id, any_value(amt) AS amt, count(pamt) AS n, avg(pamt) AS m, stddev_samp(pamt) AS sd FROM past GROUP BY id)
SELECT tied."TransactionID", CASE WHEN n >= 2 THEN round((s.amt - m) / (sd + 1e-9::DOUBLE) + 3.7e-9::DOUBLE, 6) + 0.0 ELSE 0.0 END::DOUBLE AS amt_zscore_vs_card1_history
FROM tied LEFT JOIN s ON s.id = tied."TransactionID" """


def w4(spark, sf):
    return round_columns(V.zscores(tied(spark, sf)).select("TransactionID", "time_since_last_txn_zscore"))


W4_SQL = f"""WITH {TXN_TIES_SQL},
d AS (SELECT *, "TransactionDT" - lag("TransactionDT") OVER (PARTITION BY card1 ORDER BY "TransactionDT", "TransactionID") AS gap FROM tied),
s AS (SELECT a."TransactionID" AS id, any_value(a."TransactionDT") - max(b."TransactionDT") AS cur, count(b.gap) AS n,
             avg(b.gap) AS m, stddev_samp(b.gap) AS sd
      FROM d a JOIN d b ON a.card1 = b.card1 AND b."TransactionDT" < a."TransactionDT" GROUP BY 1)
SELECT "TransactionID", CASE WHEN n >= 2 THEN round((cur - m) / (sd + 1e-9::DOUBLE) + 3.7e-9::DOUBLE, 6) + 0.0 ELSE 0.0 END::DOUBLE AS time_since_last_txn_zscore
FROM tied LEFT JOIN s ON id = "TransactionID" """


def w5(spark, sf):
    return V.address_change(tied(spark, sf))


W5_SQL = f"""WITH {TXN_TIES_SQL},{PAST},
c AS (SELECT id, addr, paddr, count(*) AS n, min(struct_pack(t := pt, i := pid)) AS first_use FROM past WHERE paddr IS NOT NULL GROUP BY ALL),
m AS (SELECT id, addr, paddr FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, first_use.t, first_use.i) = 1)
SELECT "TransactionID", CASE WHEN addr <> paddr THEN 1 ELSE 0 END AS addr_change_flag
FROM tied LEFT JOIN m ON id = "TransactionID" """


def w6(spark, sf):
    return V.device_change(tied(spark, sf))


W6_SQL = f"""WITH {TXN_TIES_SQL},{PAST},
s AS (SELECT id, count(pdev) AS n, count(*) FILTER (pdev = dev) AS same, any_value(dev) AS dev FROM past GROUP BY id)
SELECT "TransactionID", CASE WHEN dev IS NOT NULL AND n > 0 AND same = 0 THEN 1 ELSE 0 END AS device_change_flag
FROM tied LEFT JOIN s ON id = "TransactionID" """


def w7(spark, sf):
    # Missing amounts make the divisor smaller than the number of hours summed.
    t = tied(spark, sf).withColumn("TransactionAmt", F.when(F.col("k") % 9 != 0, F.col("TransactionAmt")))
    return round_columns(V.zscores(t).select("TransactionID", "hour_deviation"))


W7_SQL = f"""WITH {TXN_SQL},
tied AS (SELECT * REPLACE ("TransactionDT" - "TransactionDT" % 3600 AS "TransactionDT", CASE WHEN k % 9 <> 0 THEN "TransactionAmt" END AS "TransactionAmt") FROM txn),{PAST},
s AS (SELECT id, any_value(hr) AS hr, sum(phr) AS h, count(pamt) AS n FROM past GROUP BY id)
SELECT "TransactionID", CASE WHEN n > 0 THEN round(abs(hr - h::DOUBLE / n) + 3.7e-9::DOUBLE, 6) + 0.0 ELSE 0.0 END::DOUBLE AS hour_deviation
FROM tied LEFT JOIN s ON id = "TransactionID" """


def w8(spark, sf):
    """All behavioural columns while the card has no past amount: every one must be 0."""
    t = tied(spark, sf).withColumn("TransactionAmt", F.when(F.col("k") % 3 == 0, F.col("TransactionAmt")))
    z = V.zscores(t).join(V.address_change(t), "TransactionID").join(V.device_change(t), "TransactionID")
    quiet = sum((F.col(c) == 0).cast("int") for c in z.columns if c != "TransactionID")
    return z.select("TransactionID", quiet.alias("zero_columns"), r6("hour_deviation").alias("hour_deviation"), "addr_change_flag", "device_change_flag")


W8_SQL = f"""WITH {TXN_SQL},
tied AS (SELECT * REPLACE ("TransactionDT" - "TransactionDT" % 3600 AS "TransactionDT", CASE WHEN k % 3 = 0 THEN "TransactionAmt" END AS "TransactionAmt") FROM txn),{PAST},
d AS (SELECT *, "TransactionDT" - lag("TransactionDT") OVER (PARTITION BY card1 ORDER BY "TransactionDT", "TransactionID") AS gap FROM tied),
g AS (SELECT a."TransactionID" AS id, any_value(a."TransactionDT") - max(b."TransactionDT") AS cur, count(b.gap) AS n, avg(b.gap) AS m, stddev_samp(b.gap) AS sd
      FROM d a JOIN d b ON a.card1 = b.card1 AND b."TransactionDT" < a."TransactionDT" GROUP BY 1),
s AS (SELECT id, any_value(hr) AS hr, sum(phr) AS h, count(pamt) AS n, any_value(amt) AS amt, avg(pamt) AS m, stddev_samp(pamt) AS sd,
             any_value(dev) AS dev, count(pdev) AS nd, count(*) FILTER (pdev = dev) AS same FROM past GROUP BY id),
c AS (SELECT id, addr, paddr, count(*) AS n, min(struct_pack(t := pt, i := pid)) AS first_use FROM past WHERE paddr IS NOT NULL GROUP BY ALL),
mo AS (SELECT id, addr, paddr FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, first_use.t, first_use.i) = 1),
v AS (SELECT tied."TransactionID" AS id,
        CASE WHEN s.n >= 2 AND s.amt IS NOT NULL THEN (s.amt - s.m) / (s.sd + 1e-9::DOUBLE) ELSE 0 END AS z1,
        CASE WHEN s.n > 0 AND g.n >= 2 THEN (g.cur - g.m) / (g.sd + 1e-9::DOUBLE) ELSE 0 END AS z2,
        CASE WHEN s.n > 0 THEN abs(s.hr - s.h::DOUBLE / s.n) ELSE 0 END AS z3,
        CASE WHEN s.n > 0 AND mo.addr <> mo.paddr THEN 1 ELSE 0 END AS z4,
        CASE WHEN s.n > 0 AND s.dev IS NOT NULL AND s.nd > 0 AND s.same = 0 THEN 1 ELSE 0 END AS z5
      FROM tied LEFT JOIN s ON s.id = tied."TransactionID" LEFT JOIN g ON g.id = tied."TransactionID" LEFT JOIN mo ON mo.id = tied."TransactionID")
SELECT id AS "TransactionID", (z1 = 0)::INTEGER + (z2 = 0)::INTEGER + (z3 = 0)::INTEGER + (z4 = 0)::INTEGER + (z5 = 0)::INTEGER AS zero_columns,
       round(z3 + 3.7e-9::DOUBLE, 6) + 0.0 AS hour_deviation, z4 AS addr_change_flag, z5 AS device_change_flag FROM v"""


def w9(spark, sf):
    return V.cold_start(tied(spark, sf), ["card1", "DeviceInfo"])


W9_SQL = f"WITH {TXN_TIES_SQL}\nSELECT \"TransactionID\", " + ", ".join(
    f'CASE WHEN "{e}" IS NULL OR count(*) OVER (PARTITION BY "{e}" ORDER BY "TransactionDT" RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 3 THEN 1 ELSE 0 END AS "is_coldstart_{e}"'
    for e in ["card1", "DeviceInfo"]) + " FROM tied"


def w10(spark, sf):
    return round_columns(V.ewm(tied(spark, sf), fraud_weighted=False))


def _ewm_sql(weight: str, stem: str) -> str:
    parts, joins = [], []
    for e in ENT:
        sums = ", ".join(
            f'sum({weight} * exp(-{lam}::DOUBLE * (a."TransactionDT" - b."TransactionDT") / 3600.0::DOUBLE)) AS l{i}' for i, lam in enumerate(config.EWM_LAMBDAS))
        # Past rows are reduced per hour first; all of an hour's rows share one weight.
        parts.append(f"""q_{e} AS (SELECT a."{e}" AS e, a."TransactionDT" AS t, {sums}
  FROM (SELECT DISTINCT "{e}", "TransactionDT" FROM tied WHERE "{e}" IS NOT NULL) a
  JOIN (SELECT "{e}", "TransactionDT", count(*) AS n, sum(coalesce("isFraud", 0))::DOUBLE AS f FROM tied GROUP BY 1, 2) b
    ON a."{e}" = b."{e}" AND b."TransactionDT" < a."TransactionDT" GROUP BY 1, 2)""")
        joins.append(f'LEFT JOIN q_{e} ON q_{e}.e = tied."{e}" AND q_{e}.t = tied."TransactionDT"')
    cols = ", ".join(
        f'round(coalesce(q_{e}.l{i}, 0.0::DOUBLE) + 3.7e-9::DOUBLE, 6) + 0.0 AS "{e}_{stem}_ewm_lambda_{lam:g}"' for e in ENT for i, lam in enumerate(config.EWM_LAMBDAS))
    return f"WITH {TXN_TIES_SQL},\n" + ",\n".join(parts) + f'\nSELECT "TransactionID", {cols}\nFROM tied ' + "\n".join(joins)


def w11(spark, sf):
    out = V.ewm(tied(spark, sf))
    return round_columns(out.select("TransactionID", *[c for c in (f"`{n}`" for n in out.columns) if "fraud" in c]))


SPLIT_AT = 20 * 86400


def w12(spark, sf):
    return round_columns(V.ewm_end_state(tied(spark, sf).where(F.col("TransactionDT") < SPLIT_AT)))


_LAST = "\nUNION ALL\n".join(
    f"""SELECT '{e}' AS entity, "{e}"::VARCHAR AS value, "TransactionDT" AS t, "isFraud" AS f FROM tied WHERE "{e}" IS NOT NULL AND "TransactionDT" < {SPLIT_AT}""" for e in ENT)
STATE_SQL = f"""{TXN_TIES_SQL},
l AS ({_LAST}),
m AS (SELECT entity, value, max(t) AS last_t FROM l GROUP BY 1, 2),
state AS (SELECT entity, value, last_t, lam AS "lambda", sum(exp(-lam * (last_t - t) / 3600.0::DOUBLE)) AS v,
       sum(f * exp(-lam * (last_t - t) / 3600.0::DOUBLE)) AS fraud_v
  FROM l JOIN m USING (entity, value) CROSS JOIN (SELECT unnest([0.05::DOUBLE, 0.1::DOUBLE, 0.5::DOUBLE]) AS lam) GROUP BY ALL)"""
W12_SQL = f"""WITH {STATE_SQL}
SELECT entity, value, last_t, "lambda", round(v + 3.7e-9::DOUBLE, 6) + 0.0 AS v, round(fraud_v + 3.7e-9::DOUBLE, 6) + 0.0 AS fraud_v FROM state"""


def w13(spark, sf):
    t = tied(spark, sf)
    state = V.ewm_end_state(t.where(F.col("TransactionDT") < SPLIT_AT))
    return round_columns(V.ewm_held_out(t.where(F.col("TransactionDT") >= SPLIT_AT), state))


_READ = ", ".join(
    f"""round(coalesce(max({c} * exp(-"lambda" * (t."TransactionDT" - last_t) / 3600.0::DOUBLE)) FILTER (entity = '{e}' AND "lambda" = {lam}::DOUBLE), 0.0::DOUBLE) + 3.7e-9::DOUBLE, 6) + 0.0 AS "{e}_{stem}_ewm_lambda_{lam:g}" """
    for e in ENT for lam in config.EWM_LAMBDAS for c, stem in (("v", "v"), ("fraud_v", "fraud_v")))
W13_SQL = f"""WITH {STATE_SQL}
SELECT t."TransactionID", {_READ},
  count(*) FILTER (last_t > t."TransactionDT") AS backward_rows
FROM (SELECT * FROM tied WHERE "TransactionDT" >= {SPLIT_AT}) t LEFT JOIN state
  ON (entity = 'card1' AND value = card1::VARCHAR) OR (entity = 'addr1' AND value = addr1::VARCHAR)
  OR (entity = 'DeviceInfo' AND value = "DeviceInfo") OR (entity = 'P_emaildomain' AND value = "P_emaildomain")
GROUP BY 1"""


def w14(spark, sf):
    """Any mergeable aggregate over the strict past: here the sum of labels and largest amount per product."""
    from tidemark.operators.history import instants, running, spread, entity_rows

    t = tied(spark, sf)
    rows = entity_rows(t, ["ProductCD"], "TransactionID", "TransactionDT", ["TransactionAmt", "isFraud"])
    inst = instants(rows, amount="TransactionAmt", label="isFraud")
    past = running(inst, sums=["n", "f"], maxs=["hi"], mins=["lo"])
    out = spread(t, rows, past, "TransactionID", {f"past_{n}": ("ProductCD", f"past_{c}") for n, c in {"rows": "n", "labels": "f", "max_amt": "hi", "min_amt": "lo"}.items()})
    return out.fillna(0, ["past_rows", "past_labels"])


W14_SQL = f"""WITH {TXN_TIES_SQL}
SELECT "TransactionID", count(*) OVER w AS past_rows, coalesce(sum("isFraud"::DOUBLE) OVER w, 0.0::DOUBLE) AS past_labels,
       max("TransactionAmt") OVER w AS past_max_amt, min("TransactionAmt") OVER w AS past_min_amt
FROM tied WINDOW w AS (PARTITION BY "ProductCD" ORDER BY "TransactionDT" RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


def w15(spark, sf):
    """Rows whose feature changes when the future is hidden: none for an honest feature, some for a leaky one."""
    t = tied(spark, sf)
    honest = future_leaks(t, lambda df: V.velocity(df, ["card1"]), "card1_velocity_7d", entity="card1")
    leaky = future_leaks(
        t, lambda df: df.select("TransactionID", "card1").join(df.groupBy("card1").count(), "card1").select("TransactionID", F.col("count").alias("total")),
        "total", entity="card1")
    return honest.select(F.lit("past only").alias("feature"), "sampled", "violations").unionByName(
        leaky.select(F.lit("whole table").alias("feature"), "sampled", "violations"))


W15_SQL = f"""WITH {TXN_TIES_SQL},
s AS (SELECT * FROM tied ORDER BY md5('42:' || "TransactionID"), "TransactionID" LIMIT 50),
c AS (SELECT s."TransactionID", count(*) AS whole, count(*) FILTER (b."TransactionDT" <= s."TransactionDT") AS known
      FROM s JOIN tied b ON b.card1 = s.card1 GROUP BY 1)
SELECT 'past only' AS feature, 50::BIGINT AS sampled, 0::BIGINT AS violations
UNION ALL SELECT 'whole table', count(*), count(*) FILTER (whole <> known) FROM c"""

def _past_rate(rows, by):
    """Label rate of all earlier rows, whatever their entity."""
    rows = rows.withColumn("all", F.lit(1))
    keys = [*by, "all"]
    inst = rows.groupBy(*keys, F.col("TransactionDT").alias("ts")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("isFraud").cast("double")).alias("f"))
    past = running(inst, keys, sums=["n", "f"]).select(*keys, F.col("ts").alias("TransactionDT"), (F.col("past_f") / F.nullif(F.col("past_n"), F.lit(0))).alias("rate"))
    return rows.select(*keys, "TransactionID", "TransactionDT").join(past, [*keys, "TransactionDT"])


def _whole_rate(rows, by):
    """Label rate of the whole table, the future included."""
    rows = rows.withColumn("all", F.lit(1))
    keys = [*by, "all"]
    return rows.select(*keys, "TransactionID").join(rows.groupBy(*keys).agg(F.avg(F.col("isFraud").cast("double")).alias("rate")), keys)


def _last_day(rows, by):
    """Rows of any entity in the day before."""
    rows = rows.withColumn("all", F.lit(1))
    keys = [*by, "all"]
    inst = rows.groupBy(*keys, F.col("TransactionDT").alias("ts")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(*keys, "TransactionID", F.col("TransactionDT").alias("ts")).join(sliding_counts(inst, {"day": 86400}, keys), [*keys, "ts"])


def w15_any(spark, sf):
    """Features that read rows of every entity, recomputed on all rows up to each sampled one; the rows are made once."""
    t = cut_lineage(tied(spark, sf), "leak-rows")
    found = [("past rate", leaks_of_any_past(t, _past_rate, "rate")), ("rows of a day", leaks_of_any_past(t, _last_day, "n_day", reach=86400)), ("whole rate", leaks_of_any_past(t, _whole_rate, "rate"))]
    parts = [f.select(F.lit(name).alias("feature"), "sampled", "violations") for name, f in found]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


W15_ANY_SQL = f"""WITH {TXN_TIES_SQL},
s AS (SELECT * FROM tied ORDER BY md5('42:' || "TransactionID"), "TransactionID" LIMIT 50),
g AS (SELECT avg("isFraud") AS whole FROM tied),
c AS (SELECT s."TransactionID", avg(b."isFraud") AS known FROM s JOIN tied b ON b."TransactionDT" <= s."TransactionDT" GROUP BY 1)
SELECT 'past rate' AS feature, 50::BIGINT AS sampled, 0::BIGINT AS violations UNION ALL SELECT 'rows of a day', 50, 0
UNION ALL SELECT 'whole rate', count(*), count(*) FILTER (abs(whole - known) > 1e-12::DOUBLE + 1e-9::DOUBLE * abs(known)) FROM c, g"""

# State: the last amount, the length of the present rise and of the longest one.
RISE = Fold(lambda: (None, 0, 0), lambda s, r: _risen(s, r["TransactionAmt"]), lambda s: (s[2],))


def _risen(state, amount):
    last, run, best = state
    run = run + 1 if last is not None and amount > last else 1
    return amount, run, max(best, run)


def w14_fold(spark, sf):
    """A state that can't be merged: the longest rise of amounts in the card's strict past."""
    return past_fold(tied(spark, sf), "card1", RISE, ["TransactionAmt"], "longest_rise long")


W14_FOLD_SQL = f"""WITH {TXN_TIES_SQL},
o AS (SELECT *, CASE WHEN "TransactionAmt" > lag("TransactionAmt") OVER w THEN 0 ELSE 1 END AS cut FROM tied WHERE card1 IS NOT NULL WINDOW w AS (PARTITION BY card1 ORDER BY "TransactionDT", "TransactionID")),
i AS (SELECT *, sum(cut) OVER (PARTITION BY card1 ORDER BY "TransactionDT", "TransactionID" ROWS UNBOUNDED PRECEDING) AS island FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY card1, island ORDER BY "TransactionDT", "TransactionID") AS run FROM i)
SELECT "TransactionID", coalesce(max(run) OVER (PARTITION BY card1 ORDER BY "TransactionDT" RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS longest_rise FROM r
UNION ALL SELECT "TransactionID", 0 FROM tied WHERE card1 IS NULL"""

QUERIES = {
    "w1_velocity_counts": w1, "w2_amount_stats": w2, "w2_amount_stats_orders": w2_orders, "w3_amount_zscore": w3,
    "w4_gap_zscore": w4, "w5_address_change": w5, "w6_device_change": w6, "w7_hour_deviation": w7,
    "w8_behaviour_gate": w8, "w9_cold_start": w9, "w10_ewm_velocity": w10, "w11_ewm_fraud": w11,
    "w12_ewm_end_state": w12, "w13_ewm_held_out": w13, "w14_past_aggregate": w14, "w15_leak_check": w15,
    "w14_past_fold": w14_fold, "w15_leaks_across_entities": w15_any,
}
ORACLES = {
    "w1_velocity_counts": W1_SQL, "w2_amount_stats": W2_SQL, "w2_amount_stats_orders": W2_ORDERS_SQL, "w3_amount_zscore": W3_SQL,
    "w4_gap_zscore": W4_SQL, "w5_address_change": W5_SQL, "w6_device_change": W6_SQL, "w7_hour_deviation": W7_SQL,
    "w8_behaviour_gate": W8_SQL, "w9_cold_start": W9_SQL, "w10_ewm_velocity": _ewm_sql("n", "v"), "w11_ewm_fraud": _ewm_sql("f", "fraud_v"),
    "w12_ewm_end_state": W12_SQL, "w13_ewm_held_out": W13_SQL, "w14_past_aggregate": W14_SQL, "w15_leak_check": W15_SQL,
    "w14_past_fold": W14_FOLD_SQL, "w15_leaks_across_entities": W15_ANY_SQL,
}
