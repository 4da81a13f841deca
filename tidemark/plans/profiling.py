"""Queries over encodings and table profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.numeric import r6, round_columns, sql6
from tidemark.operators import clean as C
from tidemark.operators import encode as E
from tidemark.operators import profile as P
from tidemark.operators import sketches as K
from tidemark.plans.ingest import IDENTITY_SQL, identity, raw
from tidemark.session import cut_lineage
from tidemark.sources import tables as S
from tidemark.sources.views import TXN_SQL, WIDE_SQL, transactions, wide_block

CUT = 20 * 86400
ENC_COLS = ["addr1", "P_emaildomain", "DeviceInfo"]
ID_COLS = ["DeviceType", "DeviceInfo", "id_01", "id_30"]


def _block(spark, sf):
    """The V block and all of its columns."""
    block = wide_block(spark, sf)
    return block, P.numbered(block.columns)


def merged(spark, sf):
    return S.merge_identity(raw(spark, sf), identity(spark, sf), check=False)


_RAW = '"TransactionID", "isFraud", "TransactionDT", "TransactionAmt", "ProductCD", card1, addr1, "P_emaildomain"'
MERGED_SQL = f"""{TXN_SQL},{IDENTITY_SQL},
merged AS (SELECT t.*, ident.* EXCLUDE ("TransactionID") FROM (SELECT {_RAW} FROM txn) t LEFT JOIN ident ON ident."TransactionID" = t."TransactionID")"""
MERGED_COLS = ["TransactionID", "isFraud", "TransactionDT", "TransactionAmt", "ProductCD", "card1", "addr1", "P_emaildomain", "DeviceType", "DeviceInfo", "id_01", "id_30"]
# NULLs survive the union only as text.
MLONG_SQL = MERGED_SQL + ",\nmlong AS (" + " UNION ALL ".join(f"""SELECT "TransactionID" AS id, "isFraud" AS y, '{c}' AS "column", "{c}"::VARCHAR AS v FROM merged""" for c in MERGED_COLS) + ")"


def a1(spark, sf):
    t = transactions(spark, sf)
    train, later = t.where(F.col("TransactionDT") < CUT), t.where(F.col("TransactionDT") >= CUT)
    prior = train.agg(F.avg(F.col("isFraud").cast("double")).alias("prior"))
    for c in [*ENC_COLS, "k"]:
        # A value of k above 95 never occurs in training, so it falls back to the prior.
        fit_on = train.where(F.col("k") < 95) if c == "k" else train
        later = E.apply_encoding(later, c, E.fit_encoding(fit_on, c), prior)
    return round_columns(later.select("TransactionID", *[f"{c}_target_enc" for c in [*ENC_COLS, "k"]]))


def _a1_sql():
    parts, joins, cols = [], [], []
    for c in [*ENC_COLS, "k"]:
        cond = ' AND k < 95' if c == "k" else ""
        parts.append(f"""e_{c} AS (SELECT "{c}" AS cat, (sum("isFraud") + 10.0::DOUBLE * (SELECT avg("isFraud") FROM txn WHERE "TransactionDT" < {CUT}{cond})) / (count(*) + 10.0::DOUBLE) AS enc
  FROM txn WHERE "TransactionDT" < {CUT}{cond} GROUP BY 1)""")
        joins.append(f'LEFT JOIN e_{c} ON e_{c}.cat IS NOT DISTINCT FROM t."{c}"')
        cols.append(f'{sql6(f"coalesce(e_{c}.enc, (SELECT avg(\"isFraud\") FROM txn WHERE \"TransactionDT\" < {CUT}))")} AS "{c}_target_enc"')
    return f"WITH {TXN_SQL},\n" + ",\n".join(parts) + f'\nSELECT t."TransactionID", {", ".join(cols)} FROM (SELECT * FROM txn WHERE "TransactionDT" >= {CUT}) t ' + " ".join(joins)


def a2(spark, sf):
    return round_columns(E.out_of_fold(transactions(spark, sf), ENC_COLS).select("TransactionID", *[f"{c}_target_enc" for c in ENC_COLS]))


FOLD_EXPR = """(('0x' || substr(md5('42:' || "TransactionID"), 1, 8))::BIGINT % 5)::INTEGER"""


def _a2_sql():
    # One refit per fold on the other folds' rows, as the definition has it.
    parts, joins, cols = [], [], []
    for c in ENC_COLS:
        parts.append(f"""e_{c} AS (SELECT f.fold, "{c}" AS cat, sum("isFraud") AS h, count(*) AS n FROM folds f JOIN x ON x.fold <> f.fold GROUP BY 1, 2)""")
        joins.append(f'LEFT JOIN e_{c} ON e_{c}.fold = x.fold AND e_{c}.cat IS NOT DISTINCT FROM x."{c}"')
        cols.append(f"""{sql6(f"(coalesce(e_{c}.h, 0) + 10.0::DOUBLE * g.prior) / (coalesce(e_{c}.n, 0) + 10.0::DOUBLE)")} AS "{c}_target_enc" """)
    return f"""WITH {TXN_SQL}, x AS (SELECT *, {FOLD_EXPR} AS fold FROM txn), folds AS (SELECT DISTINCT fold FROM x),
g AS (SELECT f.fold, avg("isFraud") AS prior FROM folds f JOIN x ON x.fold <> f.fold GROUP BY 1),
{", ".join(parts)}
SELECT x."TransactionID", {", ".join(cols)} FROM x JOIN g ON g.fold = x.fold {" ".join(joins)}"""


def a3(spark, sf):
    t = transactions(spark, sf)
    exact = E.exact_stratified_folds(t).withColumnRenamed("fold", "stratified_fold")
    return t.select("TransactionID", C.hash_fold().alias("hash_fold")).join(exact.drop("isFraud"), "TransactionID")


A3_SQL = f"""WITH {TXN_SQL}, x AS (SELECT "TransactionID", "isFraud", ('0x' || substr(md5('42:' || "TransactionID"), 1, 8))::BIGINT AS h FROM txn)
SELECT "TransactionID", (h % 5)::INTEGER AS hash_fold, ((row_number() OVER (PARTITION BY "isFraud" ORDER BY h, "TransactionID") - 1) % 5)::INTEGER AS stratified_fold FROM x"""


def wilson_sql(k: str, n: str, prefix: str) -> str:
    z = "1.959963984540054::DOUBLE"
    p = f"({k}::DOUBLE / {n})"
    centre = f"({p} + {z} * {z} / (2 * {n})) / (1 + {z} * {z} / {n})"
    half = f"{z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4 * {n}::DOUBLE * {n})) / (1 + {z} * {z} / {n})"
    return f"{sql6(f'greatest({centre} - {half}, 0.0::DOUBLE)')} AS {prefix[0]}, {sql6(f'least({centre} + {half}, 1.0::DOUBLE)')} AS {prefix[1]}"


def rate_sql(source: str, by: str, tail: str = "", y: str = '"isFraud"') -> str:
    return (f'SELECT {by}, n_fraud, n, {sql6("n_fraud::DOUBLE / n")} AS fraud_rate, {wilson_sql("n_fraud", "n", ("ci_low_95", "ci_high_95"))} '
            f"FROM (SELECT {by}, sum({y})::BIGINT AS n_fraud, count({y}) AS n FROM {source} GROUP BY ALL) {tail}")


def a4(spark, sf):
    return round_columns(P.label_rate(merged(spark, sf), F.col("DeviceType").isNotNull().alias("has_identity")))


A4_SQL = f"WITH {MERGED_SQL}, x AS (SELECT \"DeviceType\" IS NOT NULL AS has_identity, \"isFraud\" FROM merged)\n" + rate_sql("x", "has_identity")


def a5(spark, sf):
    m = merged(spark, sf)
    hour = F.expr("(TransactionDT div 3600) % 24")
    week = F.expr("TransactionDT div 604800")

    def named(rates, slice_name, key):
        return rates.select(F.lit(slice_name).alias("slice"), F.col(key).cast("string").alias("key"), "n_fraud", "n", "fraud_rate", "ci_low_95", "ci_high_95")

    parts = [
        named(P.label_rate(m, P.right_closed_name(F.col("TransactionAmt"), P.AMOUNT_EDGES).alias("key")), "amount", "key"),
        named(P.label_rate(m, F.col("ProductCD").alias("key")), "product", "key"),
        named(P.label_rate(m, hour.alias("key")), "hour", "key"),
        named(P.label_rate(m, week.alias("key")), "week", "key"),
        named(P.top_by_rate(P.label_rate(m.where(F.col("P_emaildomain").isNotNull()), F.col("P_emaildomain").alias("key"), min_n=500), "key", 20), "mail", "key"),
        named(P.top_by_rate(P.label_rate(m, F.coalesce(F.col("addr1").cast("string"), F.lit("(null)")).alias("key"), min_n=200), "key", 10), "address", "key"),
        named(P.label_rate(m, F.coalesce(F.col("DeviceType"), F.lit("(no identity)")).alias("key")), "device type", "key"),
        named(P.top_by_rate(P.label_rate(m.where(F.col("DeviceInfo").isNotNull()), F.col("DeviceInfo").alias("key"), min_n=100), "key", 15), "device", "key"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return round_columns(out)


def _a5_sql():
    amount = "CASE " + " ".join(
        f"""WHEN "TransactionAmt" <= {hi} THEN '({lo}, {hi}]'""" for lo, hi in zip(P.AMOUNT_EDGES[:-1], P.AMOUNT_EDGES[1:])) + " ELSE '(5000, inf]' END"
    slices = [
        ("amount", amount, "", ""), ("product", '"ProductCD"', "", ""), ("hour", '(("TransactionDT" // 3600) % 24)::VARCHAR', "", ""),
        ("week", '("TransactionDT" // 604800)::VARCHAR', "", ""),
        ("mail", '"P_emaildomain"', 'WHERE "P_emaildomain" IS NOT NULL', "WHERE n >= 500 ORDER BY n_fraud::DOUBLE / n DESC, key LIMIT 20"),
        ("address", "coalesce(addr1::VARCHAR, '(null)')", "", "WHERE n >= 200 ORDER BY n_fraud::DOUBLE / n DESC, key LIMIT 10"),
        ("device type", "coalesce(\"DeviceType\", '(no identity)')", "", ""),
        ("device", '"DeviceInfo"', 'WHERE "DeviceInfo" IS NOT NULL', "WHERE n >= 100 ORDER BY n_fraud::DOUBLE / n DESC, key LIMIT 15"),
    ]
    body = "\nUNION ALL ".join(f"""(SELECT '{name}' AS slice, r.* FROM ({rate_sql(f'(SELECT {expr} AS key, "isFraud" FROM merged {where})', 'key', tail)}) r)""" for name, expr, where, tail in slices)
    return f"WITH {MERGED_SQL}\n{body}"


def a6(spark, sf):
    t = raw(spark, sf).withColumns({"dow": F.expr("cast((TransactionDT div 86400) % 7 as int)"), "hour": F.expr("(TransactionDT div 3600) % 24")})
    out = P.pivot_rate(t, "dow", "hour", list(range(24)))
    return out.select("dow", *[r6(str(h)).alias(f"h{h}") for h in range(24)])


A6_SQL = f"""WITH {TXN_SQL}
SELECT (("TransactionDT" // 86400) % 7)::INTEGER AS dow, """ + ", ".join(
    sql6(f'avg("isFraud") FILTER (("TransactionDT" // 3600) % 24 = {h})') + f" AS h{h}" for h in range(24)) + " FROM txn GROUP BY 1"


def a7(spark, sf):
    t = raw(spark, sf).withColumn("day", F.date_format(F.date_add(F.lit("2017-12-01").cast("date"), F.expr("cast(TransactionDT div 86400 as int)")), "yyyy-MM-dd"))
    daily = t.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    span = t.agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.countDistinct("day").alias("n_days"))
    return daily.crossJoin(F.broadcast(span))


A7_SQL = f"""WITH {TXN_SQL}, x AS (SELECT strftime(DATE '2017-12-01' + ("TransactionDT" // 86400)::INTEGER, '%Y-%m-%d') AS day FROM txn)
SELECT day, count(*) AS n, (SELECT min(day) FROM x) AS first_day, (SELECT max(day) FROM x) AS last_day, (SELECT count(DISTINCT day) FROM x) AS n_days FROM x GROUP BY 1"""


def a8(spark, sf):
    m = merged(spark, sf)
    has = P.coverage(m, ID_COLS)
    out = P.label_rate(m, has.alias("has_identity"))
    return round_columns(out.crossJoin(m.agg(F.avg(has.cast("double")).alias("coverage"))))


A8_SQL = f"""WITH {MERGED_SQL}, x AS (SELECT "DeviceType" IS NOT NULL OR "DeviceInfo" IS NOT NULL OR id_01 IS NOT NULL OR id_30 IS NOT NULL AS has_identity, "isFraud" FROM merged)
SELECT r.*, {sql6('(SELECT avg(has_identity::INTEGER) FROM x)')} AS coverage FROM ({rate_sql('x', 'has_identity')}) r"""


def a9(spark, sf):
    return round_columns(P.class_histogram(raw(spark, sf), F.log1p("TransactionAmt"), 79))


A9_SQL = f"""WITH {TXN_SQL}, x AS (SELECT "isFraud" AS label, ln(1 + "TransactionAmt") AS x FROM txn), s AS (SELECT min(x) AS lo, max(x) AS hi FROM x),
b AS (SELECT label, least(floor((x - lo) / (hi - lo) * 79), 78)::INTEGER AS bin, (hi - lo) / 79 AS width FROM x, s)
SELECT label, bin, count(*) AS n, {sql6('count(*) / (sum(count(*)) OVER (PARTITION BY label) * any_value(width))')} AS density FROM b GROUP BY label, bin"""


def a10(spark, sf):
    return P.cardinality(merged(spark, sf), MERGED_COLS)


def _sketched(spark, sf):
    """The merged sketches of a stored table of sketches by day."""
    m = merged(spark, sf)
    stored = cut_lineage(K.day_sketches(m, MERGED_COLS, F.expr("TransactionDT div 86400")), "sketches")
    return m, K.merged(stored)


def a10_sketched(spark, sf):
    """Distinct values from sketches by day, and whether each estimate is within its bound of the exact count."""
    m, every = _sketched(spark, sf)
    exact = P.cardinality(m, MERGED_COLS).withColumnRenamed("n_unique", "n_exact")
    off = F.abs(F.col("n_unique") - F.col("n_exact"))
    return K.cardinality(every).join(exact, "column").select("column", "n_exact", (off <= K.DISTINCT_ERROR * F.col("n_exact")).alias("within"))


A10_SKETCHED_SQL = f"""WITH {MLONG_SQL}
SELECT "column", count(DISTINCT v) AS n_exact, true AS within FROM mlong GROUP BY 1"""


def a15_sketched(spark, sf):
    """Counts and moments from sketches by day, and whether each quantile is within its bound in rank."""
    m, every = _sketched(spark, sf)
    found = K.numeric_profile(every).where(F.col("column").isin(NUM_COLS))
    errors = K.rank_errors(m.select(*NUM_COLS), found, {"p50": 0.5, "p95": 0.95})
    wide = errors.groupBy("column").agg(F.bool_and(F.col("error") <= K.RANK_ERROR).alias("within"))
    return round_columns(found.select("column", "count", "mean", "std", "min", "max").join(wide, "column"))


def a11(spark, sf):
    return P.value_counts(merged(spark, sf), ["ProductCD", "addr1", "P_emaildomain", "DeviceInfo", "id_30"]).select("column", F.coalesce("v", F.lit("(null)")).alias("v"), "n", F.col("rank").cast("long").alias("rank"))


A11_SQL = f"""WITH {MLONG_SQL}
SELECT "column", coalesce(v, '(null)') AS v, n, rank FROM (SELECT "column", v, count(*) AS n, row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC, v NULLS FIRST) AS rank
  FROM mlong WHERE "column" IN ('ProductCD', 'addr1', 'P_emaildomain', 'DeviceInfo', 'id_30') GROUP BY 1, 2) WHERE rank <= 10"""


def a12(spark, sf):
    return round_columns(P.missing_table(merged(spark, sf)))


def a12_family(spark, sf):
    m = merged(spark, sf).join(wide_block(spark, sf).drop("isFraud"), "TransactionID", "left")
    return round_columns(P.missing_by_family(P.missing_table(m)))


A12F_SQL = f"""WITH {MLONG_SQL.replace('AS (SELECT t.*', 'AS (SELECT t.*')},{WIDE_SQL},
f AS (SELECT "column", avg((v IS NULL)::INTEGER) AS r FROM mlong GROUP BY 1
      UNION ALL SELECT col, avg((v IS NULL)::INTEGER) FROM (SELECT w.col, x.v FROM merged CROSS JOIN (SELECT DISTINCT col FROM wlong) w LEFT JOIN wlong x ON x."TransactionID" = merged."TransactionID" AND x.col = w.col) GROUP BY 1)
SELECT family, count(*) AS n_columns, {sql6('avg(r)')} AS mean_null_rate FROM (SELECT r, CASE WHEN regexp_full_match("column", 'V\\d+') THEN 'V'
   WHEN "column" LIKE 'id\\_%' ESCAPE '\\' OR "column" LIKE 'Device%' THEN 'id' WHEN "column" LIKE 'card%' THEN 'card' WHEN "column" LIKE 'addr%' THEN 'addr' END AS family FROM f)
WHERE family IS NOT NULL GROUP BY 1"""


def a13(spark, sf):
    return round_columns(P.predictive_missingness(merged(spark, sf), MERGED_COLS))


A13_SQL = f"""WITH {MLONG_SQL}, s AS (SELECT "column", count(*) FILTER (v IS NULL) AS n_null, count(v) AS n_not_null, coalesce(sum(y) FILTER (v IS NULL), 0)::BIGINT AS k_null,
  coalesce(sum(y) FILTER (v IS NOT NULL), 0)::BIGINT AS k_not_null FROM mlong GROUP BY 1)
SELECT *, {sql6('k_null::DOUBLE / n_null')} AS rate_null, {sql6('k_not_null::DOUBLE / n_not_null')} AS rate_not_null,
  {wilson_sql('k_null', 'n_null', ('ci_low_null', 'ci_high_null'))}, {wilson_sql('k_not_null', 'n_not_null', ('ci_low_not_null', 'ci_high_not_null'))}
FROM s WHERE n_null >= 500 AND n_not_null >= 500"""


def a14(spark, sf):
    return round_columns(P.null_groups(P.null_signatures(*_block(spark, sf))))


A14_SQL = f"""WITH {WIDE_SQL},
sig AS (SELECT col, md5(string_agg((v IS NULL)::INTEGER::VARCHAR, '' ORDER BY "TransactionID")) AS s, count(*) FILTER (v IS NULL) AS m, count(*) AS n FROM wlong GROUP BY 1)
SELECT string_agg(col, ',' ORDER BY col) AS columns, count(*) AS n_columns, any_value(m) AS n_rows_missing, {sql6('any_value(m)::DOUBLE / any_value(n)')} AS missing_rate
FROM sig GROUP BY s HAVING count(*) >= 2 AND any_value(m)::DOUBLE / any_value(n) >= 0.01"""

NUM_COLS = ["TransactionAmt", "card1", "addr1", "id_01"]


def a15(spark, sf):
    return round_columns(P.numeric_profile(merged(spark, sf), NUM_COLS))


A15_SQL = f"WITH {MERGED_SQL}\n" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count("{c}") AS count, {sql6(f'avg("{c}")')} AS mean, {sql6(f'stddev_samp("{c}")')} AS std, {sql6(f'min("{c}")::DOUBLE')} AS min,
  {sql6(f'max("{c}")::DOUBLE')} AS max, {sql6(f'quantile_cont("{c}"::DOUBLE, 0.5)')} AS p50, {sql6(f'quantile_cont("{c}"::DOUBLE, 0.95)')} AS p95 FROM merged""" for c in NUM_COLS)


A15_SKETCHED_SQL = f"""SELECT "column", count, mean, std, min, max, true AS within FROM ({A15_SQL})"""


def a16(spark, sf):
    return round_columns(P.raw_summary(merged(spark, sf), ["id_01", "id_30"]))


A16_SQL = f"""WITH {MLONG_SQL}
SELECT count(*) AS rows, 12::BIGINT AS cols, min("TransactionDT") AS dt_min, max("TransactionDT") AS dt_max, {sql6('avg("isFraud")')} AS fraud_rate,
  {sql6('avg((id_01 IS NOT NULL OR id_30 IS NOT NULL)::INTEGER)')} AS identity_coverage, {sql6('round((max("TransactionDT") - min("TransactionDT")) / 86400.0::DOUBLE, 2)')} AS span_days,
  (SELECT count(*) FROM (SELECT 1 FROM mlong GROUP BY "column" HAVING avg((v IS NULL)::INTEGER) > 0.5)) AS cols_above_50pct_null FROM merged"""


def a17(spark, sf):
    # Without the id, rows repeat.
    return P.frame_stats(merged(spark, sf).select("isFraud", "ProductCD", "addr1", "DeviceType", "id_01"))


A17_SQL = f"""WITH {MERGED_SQL}, x AS (SELECT "isFraud", "ProductCD", addr1, "DeviceType", id_01 FROM merged)
SELECT count(*) AS n_rows, sum((addr1 IS NULL)::BIGINT + ("DeviceType" IS NULL)::BIGINT + (id_01 IS NULL)::BIGINT)::BIGINT AS n_missing,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM x)) AS n_duplicates, 1::BIGINT AS n_double, 2::BIGINT AS n_int, 2::BIGINT AS n_string FROM x"""


def a18(spark, sf):
    return round_columns(P.box_stats(merged(spark, sf), ["TransactionAmt", "addr1", "id_01"]))


A18_SQL = f"""WITH {MERGED_SQL}, l AS ({' UNION ALL '.join(f'''SELECT '{c}' AS "column", "isFraud", "{c}"::DOUBLE AS v FROM merged WHERE "{c}" IS NOT NULL''' for c in ("TransactionAmt", "addr1", "id_01"))}),
q AS (SELECT "column", "isFraud", quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM l GROUP BY 1, 2)
SELECT "column", "isFraud", {sql6('any_value(q1)')} AS q1, {sql6('any_value(median)')} AS median, {sql6('any_value(q3)')} AS q3,
  {sql6('min(v) FILTER (v >= q1 - 1.5 * (q3 - q1))')} AS whisker_low, {sql6('max(v) FILTER (v <= q3 + 1.5 * (q3 - q1))')} AS whisker_high
FROM l JOIN q USING ("column", "isFraud") GROUP BY 1, 2"""


def a19(spark, sf):
    return round_columns(P.correlations(*_block(spark, sf)))


FILLED_SQL = f"""{WIDE_SQL},
med AS (SELECT col, median(v) AS m FROM wlong GROUP BY 1),
filled AS (SELECT "TransactionID", wlong.col, coalesce(v, m) AS v FROM wlong JOIN med ON med.col = wlong.col),
pairs AS (SELECT a.col AS a, b.col AS b, corr(a.v, b.v) AS rho FROM filled a JOIN filled b ON a."TransactionID" = b."TransactionID"
   AND substr(a.col, 2)::INTEGER < substr(b.col, 2)::INTEGER GROUP BY 1, 2)"""


def a19_summary(spark, sf):
    return P.correlation_summary(P.correlations(*_block(spark, sf)))


A19S_SQL = f"""WITH {FILLED_SQL}
SELECT count(*) AS n_high_pairs, (SELECT count(DISTINCT c) FROM (SELECT a AS c FROM pairs WHERE abs(rho) > 0.95 UNION ALL SELECT b FROM pairs WHERE abs(rho) > 0.95)) AS n_columns_with_partner
FROM pairs WHERE abs(rho) > 0.95"""


def a20(spark, sf):
    return round_columns(P.scree(*_block(spark, sf)))


def a21(spark, sf):
    return round_columns(P.mean_gap_ranking(*_block(spark, sf)))


A21_SQL = f"""WITH {WIDE_SQL}
SELECT col AS "column", {sql6('abs(avg(v) FILTER ("isFraud" = 1) - avg(v) FILTER ("isFraud" = 0)) / stddev_pop(v)')} AS smd FROM wlong GROUP BY 1
ORDER BY abs(avg(v) FILTER ("isFraud" = 1) - avg(v) FILTER ("isFraud" = 0)) / stddev_pop(v) DESC, col LIMIT 10"""


def a22(spark, sf):
    # One column drifts by construction: the amount grows with time.
    t = transactions(spark, sf).withColumn("grown", F.round(F.col("TransactionAmt") * (1 + F.col("TransactionDT") / 2.0e6), 2))
    return round_columns(P.ks_by_half(t, ["TransactionAmt", "grown", "addr1", "k"], min_n=400))


A22_SQL = f"""WITH {TXN_SQL}, m AS (SELECT quantile_cont("TransactionDT"::DOUBLE, 0.5) AS mid FROM txn),
l AS ({' UNION ALL '.join(f'''SELECT '{n}' AS "column", "TransactionDT" < mid AS first, ({e})::DOUBLE AS v FROM txn, m''' for n, e in (("TransactionAmt", '"TransactionAmt"'), ("grown", 'round("TransactionAmt" * (1 + "TransactionDT" / 2.0e6::DOUBLE), 2)'), ("addr1", "addr1"), ("k", "k")))}),
c AS (SELECT "column", v, count(*) FILTER (first) AS a, count(*) FILTER (NOT first) AS b FROM l WHERE v IS NOT NULL GROUP BY 1, 2),
s AS (SELECT "column", (sum(a) OVER w)::DOUBLE / sum(a) OVER p - (sum(b) OVER w)::DOUBLE / sum(b) OVER p AS gap, sum(a) OVER p AS na, sum(b) OVER p AS nb FROM c
      WINDOW w AS (PARTITION BY "column" ORDER BY v), p AS (PARTITION BY "column")),
k AS (SELECT "column", max(abs(gap)) AS d, any_value(na)::BIGINT AS n1, any_value(nb)::BIGINT AS n2 FROM s GROUP BY 1),
pv AS (SELECT "column", any_value(d) AS d, any_value(n1) AS n1, any_value(n2) AS n2, CASE WHEN any_value(sqrt(n1::DOUBLE * n2 / (n1 + n2)) * d) < 0.2 THEN 1.0
  ELSE least(greatest(sum((CASE WHEN j % 2 = 1 THEN 2 ELSE -2 END) * exp(-2.0::DOUBLE * j * j * (n1::DOUBLE * n2 / (n1 + n2)) * d * d)), 0.0::DOUBLE), 1.0::DOUBLE) END AS p
  FROM k, (SELECT unnest(range(1, 101)) AS j) GROUP BY 1)
SELECT "column", {sql6('d')} AS ks_stat, n1 AS n_half1, n2 AS n_half2, {sql6('p')} AS p_value, p < 0.01 AS drifts FROM pv WHERE n1 >= 400 AND n2 >= 400"""

QUERIES = {
    "a1_target_encoding": a1, "a2_oof_encoding": a2, "a3_folds": a3, "a4_wilson_rate": a4, "a5_rates_by_slice": a5, "a6_dow_hour_pivot": a6, "a7_daily_volume": a7,
    "a8_identity_coverage": a8, "a9_class_histogram": a9, "a10_cardinality": a10, "a11_value_counts": a11, "a10_sketched_cardinality": a10_sketched, "a15_sketched_profile": a15_sketched, "a12_missing_table": a12, "a12_missing_by_family": a12_family,
    "a13_predictive_missingness": a13, "a14_null_groups": a14, "a15_numeric_profile": a15, "a16_raw_summary": a16, "a17_frame_stats": a17, "a18_box_stats": a18,
    "a19_correlations": a19, "a19_correlation_summary": a19_summary, "a20_pca_scree": a20, "a21_mean_gap": a21, "a22_ks_drift": a22,
}
ORACLES = {
    "a1_target_encoding": _a1_sql(), "a2_oof_encoding": _a2_sql(), "a3_folds": A3_SQL, "a4_wilson_rate": A4_SQL, "a5_rates_by_slice": _a5_sql(), "a6_dow_hour_pivot": A6_SQL,
    "a7_daily_volume": A7_SQL, "a8_identity_coverage": A8_SQL, "a9_class_histogram": A9_SQL,
    "a10_cardinality": f'WITH {MLONG_SQL}\nSELECT "column", count(DISTINCT v) AS n_unique FROM mlong GROUP BY 1', "a11_value_counts": A11_SQL, "a10_sketched_cardinality": A10_SKETCHED_SQL, "a15_sketched_profile": A15_SKETCHED_SQL,
    "a12_missing_table": f'WITH {MLONG_SQL}\nSELECT "column", count(*) FILTER (v IS NULL) AS n_missing, {sql6("avg((v IS NULL)::INTEGER)")} AS null_rate FROM mlong GROUP BY 1',
    "a12_missing_by_family": A12F_SQL, "a13_predictive_missingness": A13_SQL, "a14_null_groups": A14_SQL, "a15_numeric_profile": A15_SQL, "a16_raw_summary": A16_SQL,
    "a17_frame_stats": A17_SQL, "a18_box_stats": A18_SQL, "a19_correlations": f"WITH {FILLED_SQL}\nSELECT a, b, {sql6('rho')} AS rho FROM pairs",
    "a19_correlation_summary": A19S_SQL, "a21_mean_gap": A21_SQL, "a22_ks_drift": A22_SQL,
}
