"""Queries over the transaction graph and the wide column block."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.numeric import r6, round_columns, sql6
from tidemark.operators import graph as G
from tidemark.operators import profile as P
from tidemark.operators import reduce as R
from tidemark.plans.profiling import FOLD_EXPR
from tidemark.sources.views import LINKED_SQL, TXN_SQL, WIDE_SQL, linked_orders, transactions, wide_block

ENT = G.ENTITIES
SPLIT = 9  # orders with key % 10 < 9 are training rows


def g1(spark, sf):
    return G.edges(linked_orders(spark, sf))


def g2(spark, sf):
    return G.graph_stats(linked_orders(spark, sf))


_BY_TYPE = ", ".join(f"""count(DISTINCT val) FILTER (subtype = '{e}') AS "n_{e}" """ for e in ENT)
G2_SQL = f"""WITH {LINKED_SQL}
SELECT count(*) AS n_edges, count(DISTINCT subtype || '|' || val) AS n_entities, {_BY_TYPE}, (SELECT count(*) FROM linked) AS n_txn,
  (SELECT count(*) FROM linked) + count(DISTINCT subtype || '|' || val) AS n_nodes FROM edges"""

# Plain label propagation over entity values, rounds until nothing changes.
COMP_SQL = f"""{LINKED_SQL},
ent AS (SELECT DISTINCT subtype || '|' || val AS node FROM edges),
link AS (SELECT DISTINCT a.subtype || '|' || a.val AS x, b.subtype || '|' || b.val AS y FROM edges a JOIN edges b ON a.txn = b.txn),
reach AS (SELECT node, node AS root FROM ent UNION SELECT link.y, reach.root FROM reach JOIN link ON link.x = reach.node),
comp AS (SELECT node, min(root) AS root FROM reach GROUP BY 1),
txn_comp AS (SELECT txn, min(root) AS root FROM edges JOIN comp ON comp.node = subtype || '|' || val GROUP BY 1),
sizes AS (SELECT root, sum(c) AS n, sum(t) AS t FROM (SELECT root, count(*) AS c, 0 AS t FROM comp GROUP BY 1 UNION ALL SELECT root, count(*), count(*) FROM txn_comp GROUP BY 1) GROUP BY 1)"""
RECURSIVE = f"WITH RECURSIVE {COMP_SQL}"


def g3(spark, sf):
    return G.component_sizes(linked_orders(spark, sf))


G3_SQL = f"""{RECURSIVE}
SELECT "TransactionID", coalesce(n, 1)::BIGINT AS connected_component_size FROM linked LEFT JOIN txn_comp ON txn = "TransactionID" LEFT JOIN sizes ON sizes.root = txn_comp.root"""


def _train_rows(spark, sf):
    t = linked_orders(spark, sf)
    return t.where(F.col("TransactionID") % 10 < SPLIT), t.where(F.col("TransactionID") % 10 >= SPLIT)


def g4(spark, sf):
    train, rows = _train_rows(spark, sf)
    return G.entity_degrees(train, rows)


def _held_joins() -> tuple[str, str]:
    joins = " ".join(f"""LEFT JOIN st s_{e} ON s_{e}.subtype = '{e}' AND s_{e}.val = l."{e}"::VARCHAR""" for e in ENT)
    return joins, ", ".join(f's_{e}.n AS "entity_degree_{e}"' for e in ENT)


HELD_SQL = f"""{LINKED_SQL},
st AS (SELECT subtype, val, count(*) AS n, sum("isFraud")::DOUBLE AS h FROM edges JOIN linked ON "TransactionID" = txn WHERE txn % 10 < {SPLIT} GROUP BY 1, 2)"""
_JOINS, _DEGREES = _held_joins()
_NUM = " + ".join(f"coalesce(s_{e}.h, 0)" for e in ENT)
_DEN = " + ".join(f"coalesce(s_{e}.n, 0)" for e in ENT)
G4_SQL = f'WITH {HELD_SQL}\nSELECT l."TransactionID", {_DEGREES} FROM (SELECT * FROM linked WHERE "TransactionID" % 10 >= {SPLIT}) l {_JOINS}'
_RATE = f"{sql6(f'({_NUM}) / nullif({_DEN}, 0)')} AS fraud_neighbor_rate"


def g5(spark, sf):
    train, rows = _train_rows(spark, sf)
    return round_columns(G.neighbour_rate(train, rows))


G5_SQL = f'WITH {HELD_SQL}\nSELECT l."TransactionID", {_RATE} FROM (SELECT * FROM linked WHERE "TransactionID" % 10 >= {SPLIT}) l {_JOINS}'


def g6(spark, sf):
    return round_columns(G.neighbour_rate_out_of_fold(linked_orders(spark, sf)))


G6_SQL = f"""WITH {LINKED_SQL}, f AS (SELECT "TransactionID" AS t, "isFraud" AS y, {FOLD_EXPR} AS fold FROM linked), folds AS (SELECT DISTINCT fold FROM f),
st AS (SELECT folds.fold, subtype, val, count(*) AS n, sum(y)::DOUBLE AS h FROM folds JOIN f ON f.fold <> folds.fold JOIN edges ON txn = f.t GROUP BY 1, 2, 3),
r AS (SELECT txn, sum(h) / sum(n) AS rate FROM edges JOIN f ON f.t = txn JOIN st ON st.fold = f.fold AND st.subtype = edges.subtype AND st.val = edges.val GROUP BY 1)
SELECT "TransactionID", {sql6('rate')} AS fraud_neighbor_rate FROM linked LEFT JOIN r ON txn = "TransactionID" """


def g7(spark, sf):
    # The stop that the SQL fixes; it ends after the first round.
    ranks, rounds = G.page_rank(linked_orders(spark, sf), tolerance=G.TOLERANCE)
    return ranks.select("TransactionID", (F.round(F.col("pagerank_score") * 1e6 + 3.7e-9, 6)).alias("pagerank_ppm"), F.lit(rounds).alias("iterations"))


G7_SQL = f"""WITH {LINKED_SQL}, n AS (SELECT (SELECT count(*) FROM linked) + (SELECT count(*) FROM (SELECT DISTINCT subtype, val FROM edges)) AS n),
d AS (SELECT subtype, val, count(*) AS deg FROM edges GROUP BY 1, 2),
iso AS (SELECT count(*) AS k FROM linked WHERE "TransactionID" NOT IN (SELECT txn FROM edges)),
s AS (SELECT txn, sum(1.0::DOUBLE / n.n / deg) AS s FROM edges JOIN d USING (subtype, val), n GROUP BY 1)
SELECT "TransactionID", round((0.85::DOUBLE * coalesce(s, 0) + 0.85::DOUBLE * (k::DOUBLE / n.n) / n.n + 0.15::DOUBLE / n.n) * 1e6::DOUBLE + 3.7e-9::DOUBLE, 6) AS pagerank_ppm, 1 AS iterations
FROM linked LEFT JOIN s ON txn = "TransactionID", n, iso"""


def g8(spark, sf):
    return round_columns(G.clustering(linked_orders(spark, sf)))


G8_SQL = f"""WITH {LINKED_SQL}, deg AS (SELECT txn, count(*) AS d FROM edges GROUP BY 1),
p AS (SELECT a.txn AS u, b.txn AS v, count(*) AS shared FROM edges a JOIN edges b ON a.subtype = b.subtype AND a.val = b.val AND a.txn <> b.txn GROUP BY 1, 2),
c AS (SELECT u, avg(shared::DOUBLE / (du.d + dv.d - shared)) AS c FROM p JOIN deg du ON du.txn = u JOIN deg dv ON dv.txn = v GROUP BY 1)
SELECT "TransactionID", {sql6('coalesce(c, 0.0::DOUBLE)')} AS clustering_coefficient FROM linked LEFT JOIN c ON u = "TransactionID" """


def g9(spark, sf):
    train, rows = _train_rows(spark, sf)
    return round_columns(G.held_out_features(train, rows))


G9_SQL = f"""WITH {HELD_SQL}
SELECT l."TransactionID", {_DEGREES}, {_RATE}, NULL::BIGINT AS connected_component_size, NULL::DOUBLE AS pagerank_score, NULL::DOUBLE AS clustering_coefficient
FROM (SELECT * FROM linked WHERE "TransactionID" % 10 >= {SPLIT}) l {_JOINS}"""


def g10(spark, sf):
    train, rows = _train_rows(spark, sf)
    out = rows.select("TransactionID", "card1", "DeviceInfo")
    out = G.encode(out, "card1", G.vocabulary([train], "card1"), "card1_idx")
    # The device vocabulary covers both parts.
    out = G.encode(out, "DeviceInfo", G.vocabulary([train, rows], "DeviceInfo"), "device_idx")
    return out.select("TransactionID", "card1_idx", "device_idx")


G10_SQL = f"""WITH {LINKED_SQL}, c AS (SELECT card1, row_number() OVER (ORDER BY card1) AS i FROM (SELECT DISTINCT card1 FROM linked WHERE card1 IS NOT NULL AND "TransactionID" % 10 < {SPLIT})),
d AS (SELECT "DeviceInfo" AS dev, row_number() OVER (ORDER BY "DeviceInfo") AS i FROM (SELECT DISTINCT "DeviceInfo" FROM linked WHERE "DeviceInfo" IS NOT NULL))
SELECT "TransactionID", coalesce(c.i, 0) AS card1_idx, coalesce(d.i, 0) AS device_idx FROM linked LEFT JOIN c USING (card1) LEFT JOIN d ON dev = "DeviceInfo" WHERE "TransactionID" % 10 >= {SPLIT}"""


def g11(spark, sf):
    return G.indexed_edges(linked_orders(spark, sf))


G11_SQL = f"""WITH {LINKED_SQL}, t AS (SELECT "TransactionID" AS txn, row_number() OVER (ORDER BY "TransactionID") - 1 AS src FROM linked),
o AS (SELECT subtype, val, (SELECT count(*) FROM linked) + row_number() OVER (ORDER BY list_position(['card1', 'addr1', 'DeviceInfo', 'P_emaildomain'], subtype), TRY_CAST(val AS DOUBLE), val) - 1 AS dst
  FROM (SELECT DISTINCT subtype, val FROM edges)),
f AS (SELECT src, dst FROM edges JOIN t USING (txn) JOIN o USING (subtype, val))
SELECT src, dst FROM f UNION ALL SELECT dst, src FROM f"""


def a24(spark, sf):
    train, rows = _train_rows(spark, sf)
    return round_columns(P.degree_summary(G.entity_degrees(train, rows), [f"entity_degree_{e}" for e in ENT]))


A24_SQL = f"""WITH {HELD_SQL},
x AS (SELECT l."TransactionID", {_DEGREES} FROM (SELECT * FROM linked WHERE "TransactionID" % 10 >= {SPLIT}) l {_JOINS}),
""" + "y AS (" + " UNION ALL ".join(f"""SELECT 'entity_degree_{e}' AS "column", "entity_degree_{e}"::DOUBLE AS v FROM x""" for e in ENT) + f""")
SELECT "column", {sql6('avg((v IS NULL)::INTEGER) * 100')} AS nan_pct, {sql6('min(v)')} AS min, {sql6('quantile_cont(v, 0.5)')} AS p50, {sql6('quantile_cont(v, 0.95)')} AS p95,
  {sql6('quantile_cont(v, 0.99)')} AS p99, {sql6('max(v)')} AS max FROM y GROUP BY 1"""


def a25(spark, sf):
    t = linked_orders(spark, sf)
    return round_columns(P.size_bucket_rate(G.component_sizes(t).join(t.select("TransactionID", "isFraud"), "TransactionID"), "connected_component_size"))


_BUCKETS = "[" + ", ".join(f"struct_pack(lo := {lo}, hi := {hi})" for lo, hi in zip(P.SIZE_EDGES, [*P.SIZE_EDGES[1:], 10**15])) + "]"
A25_SQL = f"""{RECURSIVE}, cs AS (SELECT coalesce(n, 1) AS size, "isFraud" FROM linked LEFT JOIN txn_comp ON txn = "TransactionID" LEFT JOIN sizes ON sizes.root = txn_comp.root),
b AS (SELECT unnest({_BUCKETS}) AS b)
SELECT b.lo || '-' || CASE WHEN b.hi > 100000 THEN 'inf' ELSE b.hi::VARCHAR END AS bucket, count(size) AS n, {sql6('avg("isFraud")')} AS fraud_rate
FROM b LEFT JOIN cs ON size <= b.hi AND (size > b.lo OR (b.lo = 0 AND size = 0)) GROUP BY b"""


def a26(spark, sf):
    return round_columns(P.size_distribution(G.component_sizes(linked_orders(spark, sf)), "connected_component_size"))


A26_SQL = f"""{RECURSIVE}, cs AS (SELECT coalesce(n, 1)::DOUBLE AS s FROM linked LEFT JOIN txn_comp ON txn = "TransactionID" LEFT JOIN sizes ON sizes.root = txn_comp.root)
SELECT count(*) AS count, {sql6('avg(s)')} AS mean, {sql6('stddev_samp(s)')} AS std, {sql6('min(s)')} AS min, {sql6('max(s)')} AS max, {sql6('quantile_cont(s, 0.5)')} AS p50,
  {sql6('quantile_cont(s, 0.9)')} AS p90, {sql6('quantile_cont(s, 0.99)')} AS p99, {sql6('quantile_cont(s, 0.999)')} AS p999 FROM cs"""


def a26_next(spark, sf):
    return P.next_largest(G.component_table(linked_orders(spark, sf)), "n_nodes")


A26N_SQL = f"""{RECURSIVE}, c AS (SELECT n FROM sizes UNION ALL SELECT 1 FROM linked WHERE "TransactionID" NOT IN (SELECT txn FROM edges))
SELECT n::BIGINT AS n_nodes, count(*) AS n_components FROM c GROUP BY 1 ORDER BY 1 DESC LIMIT 5 OFFSET 1"""


def r1(spark, sf):
    cols = P.numbered(wide_block(spark, sf).columns)
    e = wide_block(spark, sf)
    return e.select(*[F.count(c).alias(c) for c in cols]).unpivot([], cols, "column", "n_present").join(
        spark.createDataFrame([(c, i + 1) for i, c in enumerate(cols)], "column string, position int"), "column")


R1_SQL = f"""WITH {WIDE_SQL} SELECT col AS "column", count(v) AS n_present, substr(col, 2)::INTEGER AS position FROM wlong GROUP BY 1"""


def r2(spark, sf):
    groups = R.pattern_groups(wide_block(spark, sf))
    return spark.createDataFrame([(g.group_id, len(g.columns), ",".join(g.columns)) for g in groups], "group_id int, size int, columns string")


R2_SQL = f"""WITH {WIDE_SQL}, s AS (SELECT col, md5(string_agg((v IS NULL)::INTEGER::VARCHAR, '' ORDER BY "TransactionID")) AS s FROM wlong GROUP BY 1),
g AS (SELECT count(*) AS size, string_agg(col, ',' ORDER BY substr(col, 2)::INTEGER) AS columns, min(col) AS first FROM s GROUP BY s)
SELECT (row_number() OVER (ORDER BY size DESC, first) - 1)::INTEGER AS group_id, size::INTEGER AS size, columns FROM g"""


def r3(spark, sf):
    w = wide_block(spark, sf)
    return round_columns(R.manifest(R.prune_correlated(w, "isFraud"), spark).where(F.col("state") == "dropped").drop("group_id"))


# Highly correlated pairs are disjoint in this block, so each loses its member further from the target.
R3_SQL = f"""WITH {WIDE_SQL}, w AS (SELECT * FROM wlong WHERE v IS NOT NULL),
m AS (SELECT col, md5(string_agg((v IS NULL)::INTEGER::VARCHAR, '' ORDER BY "TransactionID")) AS s FROM wlong GROUP BY 1),
t AS (SELECT col, abs(corr(v, "isFraud"::DOUBLE)) AS r FROM w GROUP BY 1),
p AS (SELECT a.col AS a, b.col AS b, abs(corr(a.v, b.v)) AS rho FROM w a JOIN w b ON a."TransactionID" = b."TransactionID" AND a.col <> b.col
      JOIN m ma ON ma.col = a.col JOIN m mb ON mb.col = b.col AND ma.s = mb.s GROUP BY 1, 2)
SELECT a AS "column", 'dropped' AS state, b AS anchor, {sql6('rho')} AS rho_to_kept, {sql6('ta.r')} AS rho_to_target FROM p JOIN t ta ON ta.col = a JOIN t tb ON tb.col = b
WHERE rho > 0.95 AND (tb.r > ta.r OR (tb.r = ta.r AND b < a))"""


def r4(spark, sf):
    """Groups after PCA: components needed and the share of variance they hold."""
    w = wide_block(spark, sf)
    proj = R.fit_projections(w)
    out = R.apply_projections(w, proj)
    names = [n for p in proj for n in p.names]
    held = {n: s for p in proj for n, s in zip(p.names, p.shares)}
    table = out.agg(*[F.var_pop(n).alias(n) for n in names]).unpivot([], names, "component", "variance")
    return round_columns(table.join(spark.createDataFrame(list(held.items()), "component string, share double"), "component"))


def r5(spark, sf):
    return R.manifest(R.prune_correlated(wide_block(spark, sf), "isFraud"), spark).groupBy("group_id").agg(
        F.count_if(F.col("state") == "kept").alias("n_kept"), F.count_if(F.col("state") == "dropped").alias("n_dropped"))


R5_SQL = f"""WITH {WIDE_SQL}, s AS (SELECT col, md5(string_agg((v IS NULL)::INTEGER::VARCHAR, '' ORDER BY "TransactionID")) AS s FROM wlong GROUP BY 1),
g AS (SELECT s, count(*) AS size, min(col) AS first FROM s GROUP BY s),
w AS (SELECT * FROM wlong WHERE v IS NOT NULL),
p AS (SELECT sa.s AS s, count(*) AS dropped FROM (SELECT a.col AS a, b.col AS b, abs(corr(a.v, b.v)) AS rho FROM w a JOIN w b ON a."TransactionID" = b."TransactionID" AND a.col < b.col GROUP BY 1, 2)
   JOIN s sa ON sa.col = a JOIN s sb ON sb.col = b AND sa.s = sb.s WHERE rho > 0.95 GROUP BY 1)
SELECT (row_number() OVER (ORDER BY size DESC, first) - 1)::INTEGER AS group_id, size - coalesce(dropped, 0) AS n_kept, coalesce(dropped, 0) AS n_dropped FROM g LEFT JOIN p USING (s)"""

QUERIES = {
    "g1_edges": g1, "g2_graph_stats": g2, "g3_component_size": g3, "g4_entity_degree": g4, "g5_neighbour_rate": g5, "g6_neighbour_rate_oof": g6, "g7_page_rank": g7,
    "g8_clustering": g8, "g9_held_out": g9, "g10_vocabulary": g10, "g11_indexed_edges": g11, "a24_degree_summary": a24, "a25_size_bucket_rate": a25,
    "a26_size_distribution": a26, "a26_next_largest": a26_next, "r1_numbered_columns": r1, "r2_pattern_groups": r2, "r3_correlation_pruning": r3, "r4_group_pca": r4, "r5_reduction_manifest": r5,
}
ORACLES = {
    "g1_edges": f"WITH {LINKED_SQL}\nSELECT txn, subtype, val AS value FROM edges", "g2_graph_stats": G2_SQL, "g3_component_size": G3_SQL, "g4_entity_degree": G4_SQL,
    "g5_neighbour_rate": G5_SQL, "g6_neighbour_rate_oof": G6_SQL, "g7_page_rank": G7_SQL, "g8_clustering": G8_SQL, "g9_held_out": G9_SQL, "g10_vocabulary": G10_SQL,
    "g11_indexed_edges": G11_SQL, "a24_degree_summary": A24_SQL, "a25_size_bucket_rate": A25_SQL, "a26_size_distribution": A26_SQL, "a26_next_largest": A26N_SQL,
    "r1_numbered_columns": R1_SQL, "r2_pattern_groups": R2_SQL, "r3_correlation_pruning": R3_SQL, "r5_reduction_manifest": R5_SQL,
}
