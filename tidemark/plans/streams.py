"""Streaming queries: each drains the event files and returns what the stream wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions.numeric import r6, round_columns, sql6
from tidemark.operators import monitor as M
from tidemark.operators import store as S
from tidemark.operators.sessions import sessions
from tidemark.plans.monitoring import BASE_SQL
from tidemark.plans.point_in_time import ENT
from tidemark.session import scratch_path
from tidemark.sources.views import PREDICTIONS_SQL, TXN_SQL, prediction_columns, scored, seconds_since, table, transaction_columns, transactions
from tidemark.streaming import rates as R
from tidemark.streaming.runner import closed_event_stream, closing_event, drain, drain_batches, event_stream, per_batch, split_event_stream, stream_of
from tidemark.streaming.stateful import DecayStream, VelocityStream


def prediction_stream(spark, sf):
    return prediction_columns(event_stream(spark, sf))


def closed_predictions(spark, sf):
    """The decision log up to its end: every window closes."""
    return prediction_columns(closed_event_stream(spark, sf))


def t1s(spark, sf):
    job = VelocityStream(spark, delay=3600)
    job.run(transaction_columns(split_event_stream(spark, sf, close_days=3)))
    return job.output()


T1_SQL = f"WITH {TXN_SQL}\nSELECT \"TransactionID\", " + ", ".join(
    f'CASE WHEN "{e}" IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY "{e}" ORDER BY "TransactionDT" RANGE BETWEEN {s} PRECEDING AND 1 PRECEDING) END AS "{e}_velocity_{w}"'
    for e in ENT for w, s in config.VELOCITY_WINDOWS.items()) + " FROM txn"


def t2s(spark, sf):
    job = DecayStream(spark, ["card1", "addr1"], delay=1)
    job.run(transaction_columns(split_event_stream(spark, sf, close_days=3)))
    return round_columns(job.output())


def _t2_sql():
    parts = []
    for e in ("card1", "addr1"):
        sums = ", ".join(f"""sum({w} * exp(-{lam}::DOUBLE * (a."TransactionDT" - b."TransactionDT") / 3600.0::DOUBLE)) AS {stem}_{i}"""
                         for i, lam in enumerate(config.EWM_LAMBDAS) for w, stem in (("1.0::DOUBLE", "v"), ('b."isFraud"', "f")))
        parts.append(f"""q_{e} AS (SELECT a."TransactionID" AS id, {sums} FROM txn a JOIN txn b ON a.{e} = b.{e} AND b."TransactionDT" < a."TransactionDT" GROUP BY 1)""")
    cols = ", ".join(f'{sql6(f"coalesce(q_{e}.{stem}_{i}, 0.0::DOUBLE)")} AS "{e}_{name}_ewm_lambda_{lam:g}"'
                     for e in ("card1", "addr1") for i, lam in enumerate(config.EWM_LAMBDAS) for stem, name in (("v", "v"), ("f", "fraud_v")))
    return f"WITH {TXN_SQL}, " + ", ".join(parts) + f'\nSELECT "TransactionID", {cols} FROM txn LEFT JOIN q_card1 ON q_card1.id = "TransactionID" LEFT JOIN q_addr1 ON q_addr1.id = "TransactionID"'


def t3s(spark, sf):
    """Three micro-batches, the last with the early days again: how many rows are on time and late."""
    ev, at = table(spark, sf, "events"), seconds_since("ts", "2024-01-01")
    job = VelocityStream(spark, ["card1"], {"24h": 86400}, delay=1)
    late = job.run(transaction_columns(stream_of([
        ev.where(at < 10 * 86400), ev.where(at.between(10 * 86400, 20 * 86400)),
        ev.where((at > 20 * 86400) | (at < 5 * 86400)), closing_event(ev, 3)])))
    return job.output().agg(F.count(F.lit(1)).alias("emitted")).withColumn("late", F.lit(late).cast("long"))


T3_SQL = f"""WITH {TXN_SQL} SELECT count(*) AS emitted, count(*) FILTER ("TransactionDT" < {5 * 86400}) AS late FROM txn"""

def _t4(spark, sf):
    return drain(R.block_rate(closed_predictions(spark, sf)), "block-rate")


def t4s(spark, sf):
    return round_columns(_t4(spark, sf))


SLIDE_SQL = f"""{PREDICTIONS_SQL},
w AS (SELECT time_bucket(INTERVAL 1 MINUTE, created_at) - INTERVAL 1 MINUTE * i AS ws, decision FROM preds, (SELECT unnest(range(0, 5)) AS i)),
win AS (SELECT ws, ws + INTERVAL 5 MINUTES AS we, count(*) AS total, count(*) FILTER (decision = 'block') AS hits FROM w GROUP BY ws)"""
T4_SQL = f"""WITH {SLIDE_SQL}
SELECT epoch(ws)::BIGINT AS window_start, epoch(we)::BIGINT AS window_end, total, hits, {sql6('hits::DOUBLE / total')} AS share, hits::DOUBLE / total > 0.15 AS breach FROM win"""


def t5s(spark, sf):
    return round_columns(drain(R.latency_quantile(closed_predictions(spark, sf), size="1 hour", limit=0.01), "latency"))


T5_SQL = f"""WITH {PREDICTIONS_SQL}, bnd AS (SELECT unnest({config.LATENCY_BOUNDS + [1e18]}::DOUBLE[]) AS le),
p AS (SELECT time_bucket(INTERVAL 1 HOUR, created_at) AS ws, latency_ms / 1000.0::DOUBLE AS x FROM preds),
h AS (SELECT ws, le, count(*) FILTER (x <= le) AS n, count(*) AS total FROM p, bnd GROUP BY 1, 2),
l AS (SELECT *, coalesce(lag(le) OVER w, 0) AS lo, coalesce(lag(n) OVER w, 0) AS below FROM h WINDOW w AS (PARTITION BY ws ORDER BY le)),
v AS (SELECT ws, total, CASE WHEN le > 1e17 THEN lo ELSE lo + (le - lo) * (0.95 * total - below) / (n - below) END AS latency FROM l WHERE n >= 0.95 * total AND below < 0.95 * total)
SELECT epoch(ws)::BIGINT AS window_start, epoch(ws)::BIGINT + 3600 AS window_end, total, {sql6('latency')} AS latency, latency > 0.01 AS breach FROM v"""


def shadow_stream(spark, sf):
    ev = closed_event_stream(spark, sf)
    p = prediction_columns(ev)
    lag = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("k") % 60).cast("decimal(18,6)"))
    other = F.when(F.col("score") + ((F.col("k") * 7) % 11 - 5) / 100.0 >= 0.08, "block").otherwise("allow")
    return p.select("request_id", (F.col("created_at") + lag).alias("shadow_at"), other.alias("shadow_decision"))


def t6s(spark, sf):
    return round_columns(drain(R.disagreement(closed_predictions(spark, sf), shadow_stream(spark, sf)), "disagreement"))


T6_SQL = f"""WITH {PREDICTIONS_SQL}, x AS (SELECT time_bucket(INTERVAL 15 MINUTES, created_at) AS ws, decision <> CASE WHEN score + ((k * 7) % 11 - 5)::DOUBLE / 100.0::DOUBLE >= 0.08 THEN 'block' ELSE 'allow' END AS d FROM preds),
g AS (SELECT epoch(ws)::BIGINT AS window_start, epoch(ws)::BIGINT + 900 AS window_end, count(*) AS total, count(*) FILTER (d) AS hits FROM x GROUP BY ws)
SELECT window_start, window_end, total, hits, {sql6('hits::DOUBLE / total')} AS share, hits::DOUBLE / total > 0.1 AS breach FROM g"""

HALF = 15 * 86400
DRIFT_FEATURES = ["TransactionAmt", "k", "score", "id_01"]


def t7s(spark, sf):
    """Drift alerts of each micro-batch against a baseline of the first half."""
    base = M.drift_baseline(scored(spark, sf).where(F.col("TransactionDT") < HALF), DRIFT_FEATURES)
    path = scratch_path(spark, "drift-stream")
    base.write.parquet(f"{path}/baseline")
    stored = spark.read.parquet(f"{path}/baseline")

    def alerts(batch):
        t = transaction_columns(batch)
        recent = t.where(F.col("TransactionDT") >= HALF).select(
            (F.col("TransactionAmt") * 1.8).alias("TransactionAmt"), "k", F.round(F.least(F.lit(1.0), F.col("TransactionAmt") / 500.0) + 3.7e-9, 3).alias("score"),
            F.when(F.col("k") % 4 == 0, F.col("k").cast("double")).alias("id_01"))
        return M.drift_alerts(M.feature_psi(recent, stored, DRIFT_FEATURES))

    drain_batches(event_stream(spark, sf), f"{path}/progress", per_batch(alerts, f"{path}/alerts"))
    return round_columns(spark.read.schema("feature_name string, psi double, threshold double, n_recent long, epoch int").json(f"{path}/alerts"))


T7_SQL = f"WITH {BASE_SQL}\nSELECT f AS feature_name, {sql6('psi')} AS psi, {sql6('0.2::DOUBLE')} AS threshold, n_recent, 0 AS epoch FROM psi WHERE psi > 0.2"


def t8s(spark, sf):
    return round_columns(drain(R.error_rate(closed_predictions(spark, sf), "6 hours"), "errors"))


T8_SQL = f"""WITH {PREDICTIONS_SQL}, w AS (SELECT time_bucket(INTERVAL 6 HOURS, created_at) AS ws, count(*) AS total, count(*) FILTER (status >= 500) AS hits FROM preds GROUP BY 1)
SELECT epoch(ws)::BIGINT AS window_start, epoch(ws)::BIGINT + 21600 AS window_end, total, hits, {sql6('hits::DOUBLE / total')} AS share, hits::DOUBLE / total > 0.01 AS breach FROM w"""


def t9s(spark, sf):
    return drain(R.decision_mix(closed_predictions(spark, sf)), "decision-mix")


T9_SQL = f"""WITH {PREDICTIONS_SQL}, w AS (SELECT time_bucket(INTERVAL 1 MINUTE, created_at) AS ws, decision, count(*) AS n FROM preds GROUP BY 1, 2)
SELECT epoch(ws)::BIGINT AS window_start, epoch(ws)::BIGINT + 60 AS window_end, decision, n FROM w"""


def t10s(spark, sf):
    return drain(R.score_distribution(closed_predictions(spark, sf), "6 hours"), "scores")


_LE = " UNION ALL ".join([f"SELECT ws, {b!r}::DOUBLE AS le, count(*) FILTER (score <= {b!r}::DOUBLE) AS n FROM p GROUP BY 1" for b in config.SCORE_BOUNDS] + ["SELECT ws, NULL, count(*) FROM p GROUP BY 1"])
T10_SQL = f"""WITH {PREDICTIONS_SQL}, p AS (SELECT time_bucket(INTERVAL 6 HOURS, created_at) AS ws, score FROM preds), h AS ({_LE})
SELECT epoch(ws)::BIGINT AS window_start, le, n FROM h"""


def t11s(spark, sf):
    """Block-rate windows in breach for three minutes on end."""
    return R.sustained(_t4(spark, sf), 180, 60).select("window_start", "window_end", "total", "hits")


T11_SQL = f"""WITH {SLIDE_SQL}, b AS (SELECT ws, we, total, hits, count(*) OVER (ORDER BY we RANGE BETWEEN INTERVAL 3 MINUTES PRECEDING AND CURRENT ROW) AS c FROM win WHERE hits::DOUBLE / total > 0.15)
SELECT epoch(ws)::BIGINT AS window_start, epoch(we)::BIGINT AS window_end, total, hits FROM b WHERE c = 4"""


def t12s(spark, sf):
    """Every request arrives twice and is written once."""
    p = prediction_stream(spark, sf)
    twice = p.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    out = drain(R.once_per_request(twice).select("request_id", "txn_id", "decision", "score"), "audit")
    return out


T12_SQL = f"WITH {PREDICTIONS_SQL}\nSELECT request_id, txn_id, decision, score FROM preds"


def t13s(spark, sf):
    """Stream rows with their client's snapshot from before the stream; new clients get the default."""
    t = transactions(spark, sf).where((F.col("TransactionDT") < 5 * 86400) & (F.col("card1") % 5 != 0))
    feats = t.withColumns({"card1_seen_amt": F.col("TransactionAmt"), "card1_seen_k": F.col("k").cast("double")})
    snap = S.newest(feats, "card1", ["card1_seen_amt", "card1_seen_k"])
    out = R.enrich(prediction_stream(spark, sf).select("request_id", "client_id", "score"), snap, ["card1_seen_amt", "card1_seen_k"])
    return drain(out, "enriched").select("request_id", "client_id", "score", r6("card1_seen_amt").alias("card1_seen_amt"), r6("card1_seen_k").alias("card1_seen_k"))


T13_SQL = f"""WITH {TXN_SQL}, s AS (SELECT card1::VARCHAR AS c, "TransactionAmt" AS a, k::DOUBLE AS k FROM txn WHERE "TransactionDT" < {5 * 86400} AND card1 % 5 <> 0
  QUALIFY row_number() OVER (PARTITION BY card1 ORDER BY "TransactionDT" DESC, "TransactionID") = 1),
{PREDICTIONS_SQL.strip()}
SELECT request_id, client_id, score, {sql6('coalesce(s.a, 0.0::DOUBLE)')} AS card1_seen_amt, {sql6('coalesce(s.k, 0.0::DOUBLE)')} AS card1_seen_k FROM preds LEFT JOIN s ON s.c = client_id"""

def t14s(spark, sf):
    """Bursts of requests of a client, half an hour apart."""
    return drain(R.card_sessions(closed_predictions(spark, sf)), "sessions")


T14_SQL = f"""WITH {PREDICTIONS_SQL},
o AS (SELECT client_id, created_at, decision, CASE WHEN created_at < lag(created_at) OVER w + INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS cut FROM preds WINDOW w AS (PARTITION BY client_id ORDER BY created_at)),
s AS (SELECT *, sum(cut) OVER (PARTITION BY client_id ORDER BY created_at ROWS UNBOUNDED PRECEDING) AS session FROM o)
SELECT client_id, epoch(min(date_trunc('second', created_at)))::BIGINT AS window_start, epoch(date_trunc('second', max(created_at) + INTERVAL 30 MINUTES))::BIGINT AS window_end,
  count(*) AS n, count(*) FILTER (decision = 'block') AS blocks FROM s GROUP BY client_id, session"""


def sessions_of_cards(spark, sf):
    """The same over a table at rest: sessions inside days first, joined at midnight."""
    t = transactions(spark, sf)
    return sessions(t, "card1", F.col("TransactionDT"), 1800, {"labels": F.col("isFraud").cast("long")}).select(F.col("entity").alias("card1"), "start", "end", "n", "labels")


SESSIONS_SQL = f"""WITH {TXN_SQL},
o AS (SELECT card1, "TransactionDT" AS t, "isFraud" AS y, CASE WHEN "TransactionDT" - lag("TransactionDT") OVER w < 1800 THEN 0 ELSE 1 END AS cut FROM txn WINDOW w AS (PARTITION BY card1 ORDER BY "TransactionDT")),
s AS (SELECT *, sum(cut) OVER (PARTITION BY card1 ORDER BY t ROWS UNBOUNDED PRECEDING) AS session FROM o)
SELECT card1, min(t) AS start, max(t) + 1800 AS "end", count(*) AS n, sum(y)::BIGINT AS labels FROM s GROUP BY card1, session"""


QUERIES = {
    "t1s_velocity_stream": t1s, "t2s_decay_stream": t2s, "t3s_late_rows": t3s, "t4s_block_rate": t4s, "t5s_latency_quantile": t5s, "t6s_disagreement": t6s, "t7s_drift_alerts": t7s,
    "t8s_error_rate": t8s, "t9s_decision_mix": t9s, "t10s_score_distribution": t10s, "t11s_sustained": t11s, "t12s_once_per_request": t12s, "t13s_enrichment": t13s, "t14s_session_stream": t14s, "t14s_card_sessions": sessions_of_cards,
}
ORACLES = {
    "t1s_velocity_stream": T1_SQL, "t2s_decay_stream": _t2_sql(), "t3s_late_rows": T3_SQL, "t4s_block_rate": T4_SQL, "t5s_latency_quantile": T5_SQL, "t6s_disagreement": T6_SQL,
    "t7s_drift_alerts": T7_SQL, "t8s_error_rate": T8_SQL, "t9s_decision_mix": T9_SQL, "t10s_score_distribution": T10_SQL, "t11s_sustained": T11_SQL, "t12s_once_per_request": T12_SQL,
    "t13s_enrichment": T13_SQL, "t14s_session_stream": T14_SQL, "t14s_card_sessions": SESSIONS_SQL,
}
