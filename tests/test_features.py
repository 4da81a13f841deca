"""Encodings, graph features, column thinning, feature store, models and the feature chain."""

from __future__ import annotations

import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import chain as CH
from tidemark.operators import encode as E
from tidemark.operators import graph as G
from tidemark.operators import model as L
from tidemark.operators import profile as P
from tidemark.operators import reduce as R
from tidemark.operators import store as S

LINKS = "TransactionID long, card1 long, addr1 int, DeviceInfo string, P_emaildomain string, isFraud int"
ENT = ["card1", "addr1", "DeviceInfo", "P_emaildomain"]


def collected(df, key="TransactionID"):
    return {r[key]: r.asDict() for r in df.collect()}


# ---- encodings


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None, "c"]), int(rng.random() < 0.3)) for i in range(240)]
    return rows, spark.createDataFrame(rows, "TransactionID long, cat string, isFraud int").cache()


def test_full_encoding_limits(spark, labelled):
    rows, df = labelled
    g = sum(y for *_, y in rows) / len(rows)
    for alpha in (0.0, 10.0, 1e12):
        got = {r["cat"]: r["enc"] for r in E.fit_encoding(df, "cat", alpha).collect()}
        for c in ("a", "b", None, "c"):
            ys = [y for _, k, y in rows if k == c]
            assert math.isclose(got[c], (sum(ys) + alpha * g) / (len(ys) + alpha))
    prior = df.agg(F.avg("isFraud").alias("p"))
    asked = spark.createDataFrame([(1, "zzz"), (2, None)], "TransactionID long, cat string")
    out = collected(E.apply_encoding(asked, "cat", E.fit_encoding(df, "cat"), prior))
    assert math.isclose(out[1]["cat_target_enc"], g) and out[2]["cat_target_enc"] != g


def test_out_of_fold_never_sees_its_own_fold(labelled):
    rows, df = labelled
    got = collected(E.out_of_fold(df, ["cat"]))
    fold = {i: got[i]["fold"] for i, *_ in rows}
    for i, c, _ in rows:
        others = [r for r in rows if fold[r[0]] != fold[i]]
        prior = sum(y for *_, y in others) / len(others)
        ys = [y for _, k, y in others if k == c]
        assert math.isclose(got[i]["cat_target_enc"], (sum(ys) + 10 * prior) / (len(ys) + 10))


def test_shuffled_labels_carry_no_signal(spark):
    rng = random.Random(9)
    rows = [(i, rng.randrange(40), rng.randrange(2)) for i in range(3000)]
    df = E.out_of_fold(spark.createDataFrame(rows, "TransactionID long, cat int, isFraud int"), ["cat"])
    got = df.select("cat_target_enc", "isFraud").toPandas()
    assert abs(np.corrcoef(got.cat_target_enc, got.isFraud)[0, 1]) < 0.08


def test_single_row_category_without_smoothing_gets_the_prior(spark):
    df = spark.createDataFrame([(i, "x" if i else "only", i % 2) for i in range(40)], "TransactionID long, cat string, isFraud int")
    got = collected(E.out_of_fold(df, ["cat"], alpha=0.0))
    others = [r for r in got.values() if r["fold"] != got[0]["fold"]]
    assert math.isclose(got[0]["cat_target_enc"], sum(r["isFraud"] for r in others) / len(others))


def test_stratified_folds_are_even(labelled):
    rows, df = labelled
    n = {(r["isFraud"], r["fold"]): r["count"] for r in E.exact_stratified_folds(df).groupBy("isFraud", "fold").count().collect()}
    for y in (0, 1):
        sizes = [n[y, f] for f in range(5)]
        assert max(sizes) - min(sizes) <= 1


# ---- graph


def random_links(n, seed, hub=False):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        card = 1 if hub and i % 3 == 0 else rng.choice([None, *range(2, 2 + n // 3)])
        out.append((i, card, rng.choice([None, None, *range(n // 6)]), rng.choice([None, None, None, "d1", "d2", "d3"]), rng.choice([None] * 9 + ["m"]), rng.randrange(2)))
    return out


def nodes_of(r):
    return [(e, str(r[k + 1])) for k, e in enumerate(ENT) if r[k + 1] is not None]


def components(rows):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for r in rows:
        a = find(("txn", r[0]))
        for n in nodes_of(r):
            parent[find(n)] = a = find(a)
    size = {}
    for x in list(parent):
        size[find(x)] = size.get(find(x), 0) + 1
    return {r[0]: size[find(("txn", r[0]))] for r in rows}


@pytest.mark.parametrize("n,seed,hub", [(60, 1, False), (90, 2, True)])
def test_component_sizes(spark, n, seed, hub):
    rows = random_links(n, seed, hub)
    got = {r["TransactionID"]: r["connected_component_size"] for r in G.component_sizes(spark.createDataFrame(rows, LINKS)).collect()}
    assert got == components(rows)


def test_long_path_is_one_component(spark):
    # Each transaction joins card i with device i, the next one device i with card i + 1.
    rows = [(i, (i + 1) // 2, None, f"d{i // 2:03d}", None, 0) for i in range(60)]
    got = G.component_sizes(spark.createDataFrame(rows, LINKS)).agg(F.min("connected_component_size"), F.max("connected_component_size")).first()
    assert got[0] == got[1] == components(rows)[0]


def test_isolated_rows_and_stats(spark):
    rows = [(1, None, None, None, None, 0), (2, 5, None, None, None, 1), (3, 5, 7, None, None, 0)]
    df = spark.createDataFrame(rows, LINKS)
    assert {r[0]: r[1] for r in G.component_sizes(df).collect()} == {1: 1, 2: 4, 3: 4}
    s = G.graph_stats(df).first()
    assert (s["n_nodes"], s["n_edges"], s["n_txn"], s["n_card1"], s["n_DeviceInfo"]) == (5, 3, 3, 1, 0)
    assert sorted(r["n_nodes"] for r in G.component_table(df).collect()) == [1, 4]


def test_clustering_without_pairs(spark):
    rows = random_links(80, 4, True)
    sets = {r[0]: set(nodes_of(r)) for r in rows}
    got = {r[0]: r[1] for r in G.clustering(spark.createDataFrame(rows, LINKS)).collect()}
    for i, own in sets.items():
        near = [s for j, s in sets.items() if j != i and own & s]
        want = sum(len(own & s) / len(own | s) for s in near) / len(near) if near else 0.0
        assert math.isclose(got[i], want, abs_tol=1e-9), i


def test_clustering_at_any_size(spark):
    for n in (6, 60_000):
        df = spark.range(n).select(F.col("id").alias("TransactionID"), (F.col("id") % 3).cast("int").alias("card1"), *[F.lit(None).cast(t).alias(c) for c, t in (("addr1", "int"), ("DeviceInfo", "string"), ("P_emaildomain", "string"))])
        assert {r[0] for r in G.clustering(df).select("clustering_coefficient").distinct().collect()} == {1.0}


def pagerank(rows, damping=0.85, tol=1e-3, rounds=20):
    near = {}
    for r in rows:
        near.setdefault(("txn", r[0]), [])
        for n in nodes_of(r):
            near[("txn", r[0])].append(n)
            near.setdefault(n, []).append(("txn", r[0]))
    size = len(near)
    x = dict.fromkeys(near, 1 / size)
    for i in range(rounds):
        loose = sum(x[v] for v in near if not near[v])
        y = {v: damping * (sum(x[u] / len(near[u]) for u in near[v]) + loose / size) + (1 - damping) / size for v in near}
        done = sum(abs(y[v] - x[v]) for v in near) < size * tol
        x = y
        if done:
            return x, i + 1
    return dict.fromkeys(near, 1 / size), rounds


def test_page_rank(spark):
    rows = random_links(70, 8, True)
    df = spark.createDataFrame(rows, LINKS)
    for tol in (1e-3, 3e-4):
        want, rounds = pagerank(rows, tol=tol)
        got, n = G.page_rank(df, tolerance=tol)
        assert n == rounds
        for r in got.collect():
            assert math.isclose(r["pagerank_score"], want["txn", r["TransactionID"]], rel_tol=1e-9)
    flat, _ = G.page_rank(df, max_iterations=1, tolerance=1e-12)
    assert flat.select("pagerank_score").distinct().count() == 1


def test_rank_of_many_nodes_is_iterated_until_it_settles(spark):
    """Summed changes are below 2, so a stop at nodes / 1000 ends a graph of 2,000 nodes after its first round."""
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("addr1", "int"), ("DeviceInfo", "string"), ("P_emaildomain", "string"))]
    df = spark.range(3000).select(F.col("id").alias("TransactionID"), (F.col("id") % 1000).alias("card1"), *empty, F.lit(0).alias("isFraud"))
    # Three transactions a card: t = 0.85 * c / 3 + base, c = 0.85 * 3 * t + base.
    base = 0.15 / 4000
    want = (base + 0.85 * base / 3) / (1 - 0.85**2)
    assert all(math.isclose(r["pagerank_score"], want, rel_tol=1e-5) for r in CH.Graph().own(df).select("pagerank_score").collect())


def test_settled_rank_equals_rounds_without_end(spark):
    rows = [*random_links(70, 8, True), (70, None, None, None, None, 0)]
    want, _ = pagerank(rows, tol=1e-14, rounds=500)
    # A row that comes twice is no further node, and rows without an id have the rank of an isolated transaction.
    got = G.page_rank(spark.createDataFrame([*rows, rows[0], (None, None, None, None, None, 0)], LINKS))[0].collect()
    assert len(got) == 73
    for r in got:
        assert math.isclose(r["pagerank_score"], want["txn", 70 if r["TransactionID"] is None else r["TransactionID"]], rel_tol=1e-5), r
    flat = G.page_rank(spark.createDataFrame([(i, None, None, None, None, 0) for i in range(4)], LINKS))[0].collect()
    assert len(flat) == 4 and all(math.isclose(r["pagerank_score"], 0.25) for r in flat)


def test_rates_in_and_out_of_fold(spark):
    rows = random_links(90, 5)
    df = spark.createDataFrame(rows, LINKS).cache()
    full = {r[0]: r[1] for r in G.neighbour_rate(df, df).collect()}
    oof = {r[0]: r[1] for r in G.neighbour_rate_out_of_fold(df).collect()}
    fold = {r["TransactionID"]: r["f"] for r in df.select("TransactionID", G.hash_fold().alias("f")).collect()}
    for r in rows:
        for got, others in ((full, rows), (oof, [q for q in rows if fold[q[0]] != fold[r[0]]])):
            hits = n = 0
            for node in nodes_of(r):
                mine = [q[5] for q in others if node in nodes_of(q)]
                hits, n = hits + sum(mine), n + len(mine)
            want = hits / n if n else None
            assert (got[r[0]] is None) == (want is None) and (want is None or math.isclose(got[r[0]], want))


def test_held_out_rows_have_no_structure(spark):
    train = spark.createDataFrame([(1, 5, None, None, None, 1), (2, 5, None, None, None, 0)], LINKS)
    rows = spark.createDataFrame([(3, 5, None, None, None, 0), (4, 6, None, None, None, 0)], LINKS)
    got = collected(G.held_out_features(train, rows))
    assert got[3]["entity_degree_card1"] == 2 and got[3]["fraud_neighbor_rate"] == 0.5 and got[3]["pagerank_score"] is None
    assert got[4]["entity_degree_card1"] is None and got[4]["fraud_neighbor_rate"] is None


def test_indexed_edges_come_in_both_directions(spark):
    rows = random_links(30, 6)
    got = [(r["src"], r["dst"]) for r in G.indexed_edges(spark.createDataFrame(rows, LINKS)).collect()]
    assert len(got) == 2 * sum(len(nodes_of(r)) for r in rows)
    assert sorted(got) == sorted((b, a) for a, b in got)
    values = {n for r in rows for n in nodes_of(r)}
    assert {max(a, b) for a, b in got} == set(range(30, 30 + len(values)))


# ---- thinning


@pytest.fixture(scope="module")
def block(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(200, 3))
    rows = []
    for i in range(200):
        a, b, c = (float(v) for v in base[i])
        gone = i % 4 == 0
        rows.append((i, int(a + 0.2 * b > 0.3), a, 2 * a + 0.01 * b, b, None if gone else c, None if gone else -c + 0.01 * a, 7.0))
    return spark.createDataFrame(rows, "TransactionID long, isFraud int, V1 double, V2 double, V3 double, V10 double, V11 double, V4 double").cache()


def test_groups_and_pruning(block):
    groups = R.prune_correlated(block, "isFraud")
    assert [g.columns for g in groups] == [["V1", "V2", "V3", "V4"], ["V10", "V11"]]
    dropped = {d["column"]: d for g in groups for d in g.dropped}
    assert len(dropped) == 2 and ("V1" in dropped) != ("V2" in dropped) and ("V10" in dropped) != ("V11" in dropped)
    assert all(d["rho_to_kept"] > 0.95 for d in dropped.values())
    assert "V4" in groups[0].kept  # a constant column correlates with nothing
    assert set(R.apply_pruning(block, groups).columns) == set(block.columns) - set(dropped)


def test_group_projection(block):
    projections = R.fit_projections(block.drop("V4"))
    out = R.apply_projections(block.drop("V4"), projections).toPandas()
    first = projections[0]
    x = block.select("V1", "V2", "V3").toPandas().to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    values = np.linalg.eigvalsh(z.T @ z)[::-1]
    shares = values / values.sum()
    k = int(np.searchsorted(np.cumsum(shares), 0.95, side="right")) + 1
    assert len(first.names) == k and np.allclose(first.shares, shares[:k], atol=1e-9)
    assert np.allclose(sorted(out[first.names].var(ddof=0), reverse=True), values[:k] / len(x), rtol=1e-6)


def test_scree(block):
    got = [r["share"] for r in P.scree(block, ["V1", "V2", "V3"]).collect()]
    x = block.select("V1", "V2", "V3").toPandas().to_numpy()
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert np.allclose(got, values / values.sum(), atol=1e-9)


# ---- store and models


@pytest.mark.parametrize("name,ttl", [("card1_velocity_1h", 3600), ("card1_amt_mean_30d", 2592000), ("card1_fraud_v_ewm_lambda_0.5", 604800), ("pagerank_score", 86400),
                                      ("addr1_target_enc", 604800), ("addr1_target_enc_x", 86400), ("anything", 604800)])
def test_time_to_live(spark, name, ttl):
    assert spark.range(1).select(S.ttl_seconds(F.lit(name)).alias("t")).first()["t"] == ttl


def test_as_of_and_expiry(spark):
    snaps = spark.createDataFrame([("7", 100, 1.0, 5.0), ("7", 5000, 2.0, 6.0), ("8", 100, 9.0, 9.0)], "entity_id string, written_at long, card1_x double, card1_velocity_1h double")
    rows = spark.createDataFrame([(1, 99, 7), (2, 100, 7), (3, 4999, 7), (4, 5000, 7), (5, 5000 + 604800, 7), (6, 50, None), (7, 200000, 8)], "TransactionID long, TransactionDT long, card1 int")
    got = collected(S.as_of(rows, "card1", snaps, ["card1_x", "card1_velocity_1h"]))
    assert [got[i]["card1_x"] for i in range(1, 8)] == [None, 1.0, 1.0, 2.0, None, None, 9.0]
    assert [got[i]["card1_velocity_1h"] for i in range(1, 8)] == [None, 5.0, None, 6.0, None, None, None]


def test_newest_write_wins_and_empty_write(spark, tmp_path):
    wide = spark.createDataFrame([("7", 1.0)], "id string, card1_x double")
    assert not S.write_snapshot(S.to_long(wide.where("false"), "card1", "id", ["card1_x"], 1), str(tmp_path / "s"))
    for at, df in ((1, wide), (5, wide.withColumn("card1_x", F.lit(2.0)))):
        S.write_snapshot(S.to_long(df, "card1", "id", ["card1_x", "bad name"], at), str(tmp_path / "s"))
    store = spark.read.parquet(str(tmp_path / "s"))
    assert [S.visible(store, t).first()["value"] for t in (1, 4, 5)] == [1.0, 1.0, 2.0]
    assert S.visible(store, 0).count() == 0 and S.visible(store, 5 + 604800).count() == 0


def test_contributions_and_reasons(spark):
    long = spark.createDataFrame([(1, "log_amount", -2.0), (1, "hour_of_day", 1.0), (1, "zero", 0.0), (1, "pagerank_score", 0.5), (1, "card1_velocity_24h", 3.0), (2, "hour_of_day", -1.0)],
                                 "TransactionID long, feature string, value double")
    top = L.top_contributions(long, 3)
    assert [(r["feature"], r["direction"]) for r in top.where("TransactionID = 1").orderBy("rank").collect()] == [("card1_velocity_24h", "high"), ("log_amount", "low"), ("hour_of_day", "high")]
    texts = collected(L.reasons(top))
    assert len(texts[1]["reasons"]) == 3 and "low end" in texts[1]["reasons"][1] and 2 not in texts
    assert L.top_contributions(long, 0).count() == 0
    with pytest.raises(ValueError):
        L.top_contributions(long, -1)


def test_training_needs_both_classes(spark):
    with pytest.raises(ValueError):
        L.class_weight(spark.createDataFrame([(1,)], "isFraud int"))


def test_feature_families():
    found = L.feature_families([("amount", "log_amount"), ("decay", "V1")], ["card1", "V1"])
    assert found == {"card1": "raw", "log_amount": "amount", "V1": "decay"}


# ---- chain


def test_chain_on_later_rows(spark, tmp_path):
    rng = random.Random(12)
    rows = [(i, i * 700, round(rng.uniform(1, 90), 2), rng.randrange(6), rng.choice([None, 1, 2]), rng.choice([None, "a", "b"]), rng.choice([None, "gmail.com"]), "W", int(rng.random() < 0.3)) for i in range(160)]
    df = spark.createDataFrame(rows, "TransactionID long, TransactionDT long, TransactionAmt double, card1 long, addr1 int, DeviceInfo string, P_emaildomain string, ProductCD string, isFraud int")
    train, later = df.where("TransactionID < 120").cache(), df.where("TransactionID >= 120").cache()
    parts = [(n, make()) for n, make in CH.DEFAULT if n in ("amount", "missing", "velocity", "cold_start", "encoding", "decay")]
    chain = CH.FeatureChain(parts)
    own = chain.fit_transform(train)
    assert own.count() == 120 and set(train.columns) <= set(own.columns)
    assert {r["generator"] for r in chain.manifest(spark).collect()} == {n for n, _ in parts}
    alone, flowing = collected(chain.transform(later)), collected(chain.transform(later, train))
    whole = collected(CH.V.velocity(df))
    first = min(alone)
    assert alone[first]["card1_velocity_7d"] == 0 and flowing[first]["card1_velocity_7d"] == whole[first]["card1_velocity_7d"] > 0
    assert alone[first]["card1_v_ewm_lambda_0.05"] > 0  # decay reads the training state either way
    chain.save(spark, str(tmp_path / "fitted"))
    again = CH.FeatureChain([(n, make()) for n, make in CH.DEFAULT if n in dict(parts)]).load_tables(spark, str(tmp_path / "fitted"))
    assert collected(again.transform(later)) == alone


@pytest.fixture(scope="module")
def wide_rows(spark):
    """Rows with every column of the chain, a V block with a near copy, and card brands."""
    rng = random.Random(31)
    rows = []
    for i in range(200):
        v = rng.gauss(0, 1)
        rows.append((i, i * 500, rng.choice([None, round(rng.uniform(1, 90), 2)]), rng.choice([None, 1, 1, 2, 3, 4]), rng.choice([None, 1, 2]), rng.choice([None, "a", "b", "c"]),
                     rng.choice([None, "gmail.com", "corp.co.uk"]), rng.choice([None, "visa", "discover"]), int(rng.random() < 0.3), v, 2 * v + rng.gauss(0, 0.01), rng.gauss(0, 1), rng.choice([None, 1.0, 2.0])))
    kind = "TransactionID long, TransactionDT long, TransactionAmt double, card1 long, addr1 int, DeviceInfo string, P_emaildomain string, card4 string, isFraud int, V1 double, V2 double, V3 double, V4 double"
    df = spark.createDataFrame(rows, kind)
    return df.where("TransactionID < 140").cache(), df.where("TransactionID >= 140").cache()


def close(a, b):
    return a == b or (a is not None and b is not None and not isinstance(a, str) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


def test_slices_equal_the_joined_chain(spark, wide_rows):
    train, later = wide_rows
    plain, bucketed = CH.FeatureChain(), CH.FeatureChain()
    want = collected(plain.fit_transform(train)) | collected(plain.transform(later, train))
    with bucketed.slices(train, later, buckets=3) as wide:
        joined = wide._jdf.queryExecution().executedPlan().toString()
        got = collected(wide)
    assert bucketed.dropped == plain.dropped and set(plain.dropped) in ({"V1"}, {"V2"})
    assert sorted(bucketed.features) == sorted(plain.features)
    assert got.keys() == want.keys()
    for i, row in want.items():
        assert got[i]["slice"] == ("train" if i < 140 else "later")
        for c, v in row.items():
            assert close(got[i][c], v), (i, c, got[i][c], v)
    assert "card4_target_enc" in got[0] and "clustering_coefficient" in got[0]
    # The tiers are merged bucket by bucket: nothing is shuffled or broadcast.
    assert joined.count("SortMergeJoin") >= 5 and "Exchange" not in joined


def test_slices_refuse_later_rows_before_training(wide_rows):
    train, later = wide_rows
    with pytest.raises(ValueError, match="before the last training row"):
        with CH.FeatureChain([("amount", CH.Amount())]).slices(later, train):
            pass


def test_absent_encoding_columns_are_reported(wide_rows):
    part = CH.Encoding()
    with pytest.warns(UserWarning, match="card4"):
        part.fit(wide_rows[0].drop("card4"))
    assert part.absent == ("card4",) and part.columns == ("addr1", "P_emaildomain")


# ---- the boosted model


def test_contributions_follow_the_paths(spark):
    """Every row's path walked node by node, and the sums."""
    rng = random.Random(8)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1), rng.choice([None, rng.gauss(0, 1)])) for i in range(300)]
    rows = [(*r, int(r[1] + 0.5 * (r[3] or -1) + rng.gauss(0, 0.3) > 0)) for r in rows]
    df = spark.createDataFrame(rows, "TransactionID long, a double, b double, c double, isFraud int").repartition(3)
    names = ["a", "b", "c"]
    model, fill = L.train_boosted(df.where("TransactionID < 220"), df.where("TransactionID >= 220"), names, rounds=5, depth=3)
    paths = L.PathContributions.of(model, names)
    got = {}
    for r in L.boosted_contributions(df, model, names, fill).collect():
        got.setdefault(r["TransactionID"], {})[r["feature"]] = r["value"]
    roots = [t._call_java("rootNode") for t in model.trees]
    for i, *x, _ in rows:
        x = [fill[n] if v is None else v for n, v in zip(names, x)]
        want, base = dict.fromkeys(names, 0.0), 0.0
        for node, weight in zip(roots, model.treeWeights):
            base += weight * node.prediction()
            while node.subtreeDepth() > 0:
                split = node.split()
                child = node.leftChild() if x[split.featureIndex()] <= split.threshold() else node.rightChild()
                want[names[split.featureIndex()]] += weight * (child.prediction() - node.prediction())
                node = child
        assert math.isclose(base, paths.base, abs_tol=1e-12)
        assert all(math.isclose(got[i][n], want[n], abs_tol=1e-9) for n in names)
    top = L.top_contributions(L.boosted_contributions(df, model, names, fill), 1)
    assert top.count() <= 300 and {r["direction"] for r in top.collect()} == {"high", "low"}


def test_halving_finds_the_planted_optimum(spark):
    """27 draws, three rungs of 3, 9 and 27 parts of the rows: the winner of the full search, for a third of its rows."""
    train = spark.range(900).withColumnRenamed("id", "TransactionID")
    shares = []

    def measure(rows, val, features, label, parameters):
        n = rows.count()
        shares.append(n)
        return 0.9 - abs(math.log(parameters["step"] / 0.05)) / 10 + 0.001 * (parameters["depth"] % 2) * (900 - n) / 900

    found = L.search(train, train, [], 27, measure=measure).collect()
    full = max(range(27), key=lambda i: measure(train, None, None, None, L.sampled_parameters(27)[i]))
    assert found[0]["trial"] == full and found[0]["rung"] == 2 and found[0]["share"] == 1.0
    assert [sum(r["rung"] == k for r in found) for k in range(3)] == [18, 6, 3] and len(found) == 27
    assert sum(shares[:39]) < 0.4 * 27 * 900


def test_narrow_slices_leave_the_block_where_it_is(spark, wide_rows):
    """Generators that never look at the V block, without thinning: it is not written again, but still there to be read."""
    train, later = wide_rows
    chain = CH.FeatureChain([(n, make()) for n, make in CH.DEFAULT if n in ("velocity", "encoding")], thin_columns=False)
    with chain.slices(train, later, buckets=3) as wide:
        stored = [spark.table(f"{d.name}.transactions").columns for d in spark.catalog.listDatabases() if d.name.startswith("tidemark_")]
        got = collected(wide.select("TransactionID", "V1", "V4", "card1_velocity_1h"))
    assert stored and not any(c.startswith("V") for columns in stored for c in columns)
    source = collected(train.unionByName(later).select("TransactionID", "V1", "V4"))
    assert {k: (r["V1"], r["V4"]) for k, r in got.items()} == {k: (r["V1"], r["V4"]) for k, r in source.items()}
    with CH.FeatureChain([("missing", CH.Missing())], thin_columns=False).slices(train, later, buckets=3) as wide:
        assert "is_null_V4" in wide.columns


def test_signatures_add_up_hashes_once_per_pattern(spark):
    """Columns beyond one word of bits included; rows meet the hashes in two aggregates, however many columns there are."""
    columns = [f"V{i}" for i in range(1, 131)]
    rows = spark.range(300).select(F.col("id").alias("TransactionID"), *[F.when(F.col("id") % (2 + i % 5) != i % 2, F.col("id") * 1.0).alias(c) for i, c in enumerate(columns)])
    found = P.null_signatures(rows, columns)
    lines = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in x]
    assert lines[-1].count("bit_xor(") == 2
    got = {r["column"]: r for r in found.collect()}
    for c in ("V1", "V2", "V63", "V64", "V65", "V126", "V127", "V130"):
        gone = rows.where(F.col(c).isNull())
        want = gone.agg(F.bit_xor(F.xxhash64("TransactionID")), F.bit_xor(F.xxhash64(F.lit("second"), "TransactionID")), F.count(F.lit(1))).first()
        assert (got[c]["signature"], got[c]["n_missing"], got[c]["n"]) == (":".join(map(str, want)), want[2], 300)
    none = P.null_signatures(rows.limit(0), columns[:2]).collect()
    assert [tuple(r) for r in none] == [("V1", "0:0:0", 0, 0), ("V2", "0:0:0", 0, 0)]
