"""Canonical inputs over the driver tables, once as DataFrames and once as SQL text.

The SQL text is the oracle's side: it is written for DuckDB and shares no code with the
DataFrame side, so a slip in one shows up as a mismatch.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import ready


# Card brands.
CARD_BRANDS = ["american express", "discover", "mastercard", "visa"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def seconds_since(ts: str, first_day: str) -> Column:
    """Whole seconds since midnight of `first_day`, read from a timestamp without zone."""
    day = F.datediff(F.to_date(ts), F.lit(first_day).cast("date")).cast("long")
    return day * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def with_k(ev: DataFrame) -> DataFrame:
    """The number inside `props`, parsed once in a projection of its own."""
    return ev.withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def transactions(spark: SparkSession, sf_dir: str, ties: bool = False) -> DataFrame:
    """Card transactions from `events`; `ties` rounds times down to the hour."""
    return transaction_columns(table(spark, sf_dir, "events"), ties)


def transaction_columns(ev: DataFrame, ties: bool = False) -> DataFrame:
    """Transaction columns over `events`, usable on a batch or a stream."""
    ev = with_k(ev)
    k = F.col("k")
    dt = seconds_since("ts", "2024-01-01")
    mail = F.col("user_id") % 8
    out = ev.select(
        F.col("event_id").alias("TransactionID"),
        (dt - dt % 3600 if ties else dt).cast("long").alias("TransactionDT"),
        F.col("value").alias("TransactionAmt"),
        F.col("user_id").alias("card1"),
        k,
        F.expr("nullif(k % 20, 0)").alias("addr1"),
        F.when(k % 7 >= 2, F.concat(F.lit("dev"), (k % 13).cast("string"))).alias("DeviceInfo"),
        F.when(mail == 0, "gmail.com")
        .when(mail == 1, "yahoo.com")
        .when(mail == 2, "mailinator.com")
        .when(mail == 3, "corp.co.uk")
        .when(mail == 4, "localhost")
        .when(mail == 5, "anonymous.net")
        .alias("P_emaildomain"),
        F.col("event_type").alias("ProductCD"),
        (k < 10).cast("int").alias("isFraud"),
    )
    return out


TXN_SQL = """
txn AS (
  SELECT event_id AS "TransactionID",
         date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts))::BIGINT AS "TransactionDT",
         value AS "TransactionAmt", user_id AS card1, k,
         nullif(k % 20, 0) AS addr1,
         CASE WHEN k % 7 < 2 THEN NULL ELSE 'dev' || (k % 13) END AS "DeviceInfo",
         CASE user_id % 8 WHEN 0 THEN 'gmail.com' WHEN 1 THEN 'yahoo.com' WHEN 2 THEN 'mailinator.com'
              WHEN 3 THEN 'corp.co.uk' WHEN 4 THEN 'localhost' WHEN 5 THEN 'anonymous.net' END AS "P_emaildomain",
         event_type AS "ProductCD", (k < 10)::INTEGER AS "isFraud"
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
)"""

TXN_TIES_SQL = TXN_SQL + """,
tied AS (
  SELECT * REPLACE ("TransactionDT" - "TransactionDT" % 3600 AS "TransactionDT") FROM txn
)"""


def full_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tied transactions with a card brand and the V block; vectors repeat in order of their ids."""
    t = transactions(spark, sf_dir, ties=True)
    block = wide_block(spark, sf_dir).drop("isFraud").withColumnRenamed("TransactionID", "_vec")
    n = table(spark, sf_dir, "embeddings").agg(F.count(F.lit(1)).alias("_n"))  # one row
    brand = F.element_at(F.array(*[F.lit(b) for b in CARD_BRANDS]), (F.col("card1") % len(CARD_BRANDS) + 1).cast("int"))
    t = t.withColumn("card4", F.when(F.col("card1") % 9 != 0, brand)).crossJoin(F.broadcast(n))
    return t.join(block, F.try_mod(F.col("TransactionID"), F.col("_n")) == F.col("_vec"), "left").drop("_vec", "_n")


FULL_SQL = TXN_TIES_SQL + f""",
branded AS (
  SELECT *, CASE WHEN card1 % 9 <> 0 THEN {CARD_BRANDS}[card1 % {len(CARD_BRANDS)} + 1] END AS card4 FROM tied
)"""


def order_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions from `orders`: one-day time grain, so many rows are tied."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    joined = o.join(c, o.o_custkey == c.c_custkey, "left")
    return joined.select(
        F.col("o_orderkey").alias("TransactionID"),
        (F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")).cast("long") * 86400).alias("TransactionDT"),
        F.col("o_totalprice").alias("TransactionAmt"),
        F.col("o_custkey").alias("card1"),
        F.col("c_nationkey").alias("addr1"),
        F.col("o_orderpriority").alias("ProductCD"),
        (F.col("o_orderstatus") == "F").cast("int").alias("isFraud"),
    )


ORDERS_SQL = """
otxn AS (
  SELECT o_orderkey AS "TransactionID",
         date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::BIGINT * 86400 AS "TransactionDT",
         o_totalprice AS "TransactionAmt", o_custkey AS card1, c_nationkey AS addr1,
         o_orderpriority AS "ProductCD", (o_orderstatus = 'F')::INTEGER AS "isFraud"
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
)"""


def linked_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions whose entities form many components: card, a rare shared address, a rare device."""
    o = table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        key.alias("TransactionID"),
        F.when(key % 11 != 0, cust).alias("card1"),
        F.when(key % 17 == 0, (cust % 211).cast("int")).alias("addr1"),
        F.when(key % 13 == 0, F.concat(F.lit("d"), F.expr("o_custkey div 3").cast("string"))).alias("DeviceInfo"),
        F.when(key % 503 == 0, F.concat(F.lit("m"), (cust % 40).cast("string"))).alias("P_emaildomain"),
        (F.col("o_orderstatus") == "F").cast("int").alias("isFraud"),
    )


LINKED_SQL = """
linked AS (
  SELECT o_orderkey AS "TransactionID",
         CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey END AS card1,
         CASE WHEN o_orderkey % 17 = 0 THEN (o_custkey % 211)::INTEGER END AS addr1,
         CASE WHEN o_orderkey % 13 = 0 THEN 'd' || (o_custkey // 3) END AS "DeviceInfo",
         CASE WHEN o_orderkey % 503 = 0 THEN 'm' || (o_custkey % 40) END AS "P_emaildomain",
         (o_orderstatus = 'F')::INTEGER AS "isFraud"
  FROM orders
),
edges AS (
  SELECT DISTINCT "TransactionID" AS txn, subtype, val FROM (
    SELECT "TransactionID", 'card1' AS subtype, card1::VARCHAR AS val FROM linked
    UNION ALL SELECT "TransactionID", 'addr1', addr1::VARCHAR FROM linked
    UNION ALL SELECT "TransactionID", 'DeviceInfo', "DeviceInfo" FROM linked
    UNION ALL SELECT "TransactionID", 'P_emaildomain', "P_emaildomain" FROM linked) WHERE val IS NOT NULL
)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored transactions: a champion and a challenger score in [0, 1] and a label."""
    t = transactions(spark, sf_dir)
    base = F.least(F.lit(1.0), F.col("TransactionAmt") / 500.0)
    # The label leans on the score so that ranking metrics are away from one half.
    label = ((F.col("k") < 10) | ((F.col("k") < 35) & (F.col("TransactionAmt") > 60.0))).cast("int")
    bump = ((F.col("k") * 7) % 11 - 5) / 100.0
    return t.select(
        "TransactionID", "TransactionDT", "TransactionAmt", "ProductCD", "card1", "k",
        F.when(F.col("k") % 5 != 0, F.when(F.col("k") % 2 == 0, "mobile").otherwise("desktop")).alias("DeviceType"),
        F.when(F.col("k") % 4 == 0, F.col("k").cast("double")).alias("id_01"),
        F.expr("cast(TransactionDT div 604800 as int)").alias("month"),
        label.alias("label"),
        # The small constant keeps sums of two fractions off exact halves of the third decimal.
        F.round(base + 3.7e-9, 3).alias("score"),
        F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), base + bump)) + 3.7e-9, 3).alias("shadow_score"),
    )


SCORED_SQL = TXN_SQL + """,
scored AS (
  SELECT "TransactionID", "TransactionDT", "TransactionAmt", "ProductCD", card1, k,
         CASE WHEN k % 5 <> 0 THEN CASE WHEN k % 2 = 0 THEN 'mobile' ELSE 'desktop' END END AS "DeviceType",
         CASE WHEN k % 4 = 0 THEN k::DOUBLE END AS id_01,
         ("TransactionDT" // 604800)::INTEGER AS "month",
         (k < 10 OR (k < 35 AND "TransactionAmt" > 60.0))::INTEGER AS label,
         round(least(1.0::DOUBLE, "TransactionAmt" / 500.0::DOUBLE) + 3.7e-9::DOUBLE, 3) AS score,
         round(least(1.0::DOUBLE, greatest(0.0::DOUBLE,
               least(1.0::DOUBLE, "TransactionAmt" / 500.0::DOUBLE) + ((k * 7) % 11 - 5)::DOUBLE / 100.0::DOUBLE)) + 3.7e-9::DOUBLE, 3) AS shadow_score
  FROM txn
)"""

N_VECTOR_COLUMNS = 64  # positions of `embedding` in the given tables, for the SQL text; the query reads the width from the data


def wide_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A numeric block V1..Vn from every position of `embeddings`; three missing-value patterns, some near copies.

    V3 follows V1 and V9 follows V8 closely enough to be pruned as correlated.
    """
    e = table(spark, sf_dir, "embeddings")
    vid = F.col("vec_id")
    n = e.agg(F.max(F.size("embedding"))).first()[0] or 0

    def raw(i: int) -> Column:
        return F.element_at("embedding", i).cast("double")

    cols = []
    for i in range(1, n + 1):
        value = raw(i)
        if i == 3:
            value = raw(1) * 2.0 + raw(2) * 0.05
        if i == 9:
            value = raw(8) * -1.5 + raw(7) * 0.02
        if 8 <= i <= 15:
            value = F.when(vid % 3 != 0, value)
        elif i >= 20:
            value = F.when(vid % 10 != 1, value)
        cols.append(value.alias(f"V{i}"))
    label = ((F.col("label") < 3) | (raw(1) > 0.15)).cast("int")
    return e.select(vid.alias("TransactionID"), label.alias("isFraud"), *cols)


def _wide_sql() -> str:
    cols = []
    for i in range(1, N_VECTOR_COLUMNS + 1):
        value = f"embedding[{i}]::DOUBLE"
        if i == 3:
            value = "embedding[1]::DOUBLE * 2.0::DOUBLE + embedding[2]::DOUBLE * 0.05::DOUBLE"
        if i == 9:
            value = "embedding[8]::DOUBLE * (-1.5)::DOUBLE + embedding[7]::DOUBLE * 0.02::DOUBLE"
        if 8 <= i <= 15:
            value = f"CASE WHEN vec_id % 3 <> 0 THEN {value} END"
        elif i >= 20:
            value = f"CASE WHEN vec_id % 10 <> 1 THEN {value} END"
        cols.append(f'{value} AS "V{i}"')
    body = ",\n         ".join(cols)
    return f"""
wide AS (
  SELECT vec_id AS "TransactionID", (label < 3 OR embedding[1]::DOUBLE > 0.15)::INTEGER AS "isFraud",
         {body}
  FROM embeddings
),
wlong AS (
  SELECT "TransactionID", "isFraud", col, v FROM wide UNPIVOT INCLUDE NULLS (v FOR col IN ({", ".join(f'"V{i}"' for i in range(1, N_VECTOR_COLUMNS + 1))}))
)"""


WIDE_SQL = _wide_sql()


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored-decision log: one row per request, built from `events`."""
    ev = table(spark, sf_dir, "events")
    return prediction_columns(ev)


def prediction_columns(ev: DataFrame) -> DataFrame:
    """Decision-log columns over `events`, usable on a batch or a stream."""
    ev = with_k(ev)
    k = F.col("k")
    score = F.round(F.least(F.lit(1.0), F.col("value") / 500.0) + 3.7e-9, 3)
    return ev.select(
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("request_id"),
        F.col("event_id").alias("txn_id"),
        F.col("user_id").cast("string").alias("client_id"),
        score.alias("score"),
        F.when(score >= 0.08, "block").otherwise("allow").alias("decision"),
        (F.col("value") / 10.0).alias("latency_ms"),
        F.lit("m1").alias("model_version"),
        (k % 50 == 0).alias("degraded_mode"),
        F.when(k % 40 == 0, 500).otherwise(200).alias("status"),
        k,
    )


PREDICTIONS_SQL = """
preds AS (
  SELECT event_id AS id, ts AS created_at, 'r' || event_id AS request_id, event_id AS txn_id,
         user_id::VARCHAR AS client_id, score,
         CASE WHEN score >= 0.08 THEN 'block' ELSE 'allow' END AS decision,
         value / 10.0::DOUBLE AS latency_ms, 'm1' AS model_version, k % 50 = 0 AS degraded_mode,
         CASE WHEN k % 40 = 0 THEN 500 ELSE 200 END AS status, k
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
               round(least(1.0::DOUBLE, value / 500.0::DOUBLE) + 3.7e-9::DOUBLE, 3) AS score FROM events)
)"""


def unpivot(df: DataFrame, ids: list[str], columns: list[str], name: str = "col", value: str = "v") -> DataFrame:
    """Wide to long, one row per (row, column)."""
    return df.unpivot(ids, columns, name, value)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
