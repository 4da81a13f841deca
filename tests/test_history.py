"""Strictly-past features against a naive pass over each row's own past."""

from __future__ import annotations

import math
import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators import history as H
from tidemark.operators import velocity as V
from tidemark.operators.folds import Fold, past_fold
from tidemark.operators.leakcheck import future_leaks, leaks_of_any_past
from tidemark.operators.sessions import sessions

SCHEMA = "TransactionID long, TransactionDT long, TransactionAmt double, card1 long, addr1 int, DeviceInfo string, P_emaildomain string, isFraud int, hour_of_day int"


def make_rows(n: int, seed: int, span: int = 40 * 86400, step: int = 1800) -> list[tuple]:
    """Random rows with ties, NULLs everywhere, repeated amounts and one card with a third of them."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t = rng.randrange(0, span, step)
        card = None if rng.random() < 0.05 else 1 if rng.random() < 0.35 else rng.randrange(2, 9)
        amount = None if rng.random() < 0.1 else 19.99 if rng.random() < 0.3 else round(rng.uniform(1, 500), 2)
        rows.append((i, t, amount, card, rng.choice([None, 1, 2, 3]), rng.choice([None, "a", "b", "c", "d"]),
                     rng.choice([None, "x.com", "y.com"]), rng.randrange(2), (t // 3600) % 24))
    return rows


@pytest.fixture(scope="module")
def rows():
    return make_rows(260, 7)


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).cache()


def past(rows, r, key: int):
    return [] if r[key] is None else [p for p in rows if p[key] == r[key] and p[1] < r[1]]


def collected(df):
    return {r["TransactionID"]: r.asDict() for r in df.collect()}


def close(a, b, tol=1e-9):
    if a is None or b is None:
        return a is None and b is None
    return math.isclose(a, b, rel_tol=tol, abs_tol=tol)


ENT = {"card1": 3, "addr1": 4, "DeviceInfo": 5, "P_emaildomain": 6}


def test_velocity(frame, rows):
    windows = {"1h": 3600, "24h": 86400, "7d": 604800}
    got = collected(V.velocity(frame))
    assert len(got) == len(rows)
    for r in rows:
        for e, k in ENT.items():
            for w, s in windows.items():
                assert got[r[0]][f"{e}_velocity_{w}"] == sum(p[1] >= r[1] - s for p in past(rows, r, k)), (r, e, w)


def test_window_lower_bound_is_inclusive_and_ties_are_blind(spark):
    rows = [(1, 0, 1.0, 5, None, None, None, 0, 0), (2, 3600, 1.0, 5, None, None, None, 0, 1), (3, 3600, 1.0, 5, None, None, None, 0, 1), (4, 7201, 1.0, 5, None, None, None, 0, 2)]
    got = collected(V.velocity(spark.createDataFrame(rows, SCHEMA), ["card1"], {"1h": 3600}))
    assert [got[i]["card1_velocity_1h"] for i in (1, 2, 3, 4)] == [0, 1, 1, 0]


def test_amount_stats(frame, rows):
    got = collected(V.amount_stats(frame, {"card1": ["mean", "std", "max"], "addr1": ["mean", "std"]}, {"30d": 2592000, "2d": 172800}))
    for r in rows:
        for e, k in (("card1", 3), ("addr1", 4)):
            for w, s in (("30d", 2592000), ("2d", 172800)):
                a = [p[2] for p in past(rows, r, k) if p[1] >= r[1] - s and p[2] is not None]
                assert close(got[r[0]][f"{e}_amt_mean_{w}"], statistics.fmean(a) if a else None)
                assert close(got[r[0]][f"{e}_amt_std_{w}"], statistics.stdev(a) if len(a) > 1 else None, 1e-8)
                if e == "card1":
                    assert got[r[0]][f"card1_amt_max_{w}"] == (max(a) if a else None)


def test_equal_amounts_have_no_spread(spark):
    rows = [(i, i * 1000, 0.1 if i < 5 else 900.0, 5, None, None, None, 0, 0) for i in range(7)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = collected(V.amount_stats(frame, {"card1": ["std", "mean"]}, {"30d": 2592000}))
    assert [got[i]["card1_amt_std_30d"] for i in (2, 3, 4, 5)] == [0.0] * 4
    assert got[5]["card1_amt_mean_30d"] == 0.1
    z = collected(V.zscores(frame))
    assert close(z[5]["amt_zscore_vs_card1_history"], (900.0 - 0.1) / 1e-9, 1e-6)


def test_unsupported_statistic_and_missing_column(frame):
    with pytest.raises(ValueError):
        V.amount_stats(frame, {"card1": ["median"]})
    with pytest.raises(KeyError, match="card1.*isFraud|isFraud.*card1|card1"):
        V.velocity(frame.drop("card1"))


def test_behaviour(frame, rows):
    z, addr, dev = collected(V.zscores(frame)), collected(V.address_change(frame)), collected(V.device_change(frame))
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    for r in rows:
        p = [q for q in ordered if r[3] is not None and q[3] == r[3] and q[1] < r[1]]
        amounts = [q[2] for q in p if q[2] is not None]
        want = {"amt": 0.0, "gap": 0.0, "hour": 0.0, "addr": 0, "dev": 0}
        if amounts:
            if len(amounts) >= 2 and r[2] is not None:
                want["amt"] = (r[2] - statistics.fmean(amounts)) / (statistics.stdev(amounts) + 1e-9)
            gaps = [b[1] - a[1] for a, b in zip(p, p[1:])]
            if len(gaps) >= 2:
                want["gap"] = (r[1] - p[-1][1] - statistics.fmean(gaps)) / (statistics.stdev(gaps) + 1e-9)
            want["hour"] = abs(r[8] - sum(q[8] for q in p) / len(amounts))
            addresses = Counter(q[4] for q in p if q[4] is not None)  # counts keep first-seen order
            if addresses and r[4] is not None:
                want["addr"] = int(r[4] != addresses.most_common(1)[0][0])
            devices = {q[5] for q in p if q[5] is not None}
            want["dev"] = int(bool(devices) and r[5] is not None and r[5] not in devices)
        assert close(z[r[0]]["amt_zscore_vs_card1_history"], want["amt"], 1e-6), r
        assert close(z[r[0]]["time_since_last_txn_zscore"], want["gap"], 1e-6), r
        assert close(z[r[0]]["hour_deviation"], want["hour"]), r
        assert addr[r[0]]["addr_change_flag"] == want["addr"], r
        assert dev[r[0]]["device_change_flag"] == want["dev"], r


def test_cold_start(frame, rows):
    got = collected(V.cold_start(frame, ["card1", "DeviceInfo"]))
    for r in rows:
        for e in ("card1", "DeviceInfo"):
            assert got[r[0]][f"is_coldstart_{e}"] == int(len(past(rows, r, ENT[e])) < 3)


@pytest.fixture(scope="module")
def long_rows():
    # Long enough that the fastest rate passes through many super blocks.
    return make_rows(150, 11, span=200 * 86400, step=7000)


def test_decay(spark, long_rows):
    frame = spark.createDataFrame(long_rows, SCHEMA)
    got = collected(V.ewm(frame, ["card1", "addr1"]))
    for r in long_rows:
        for e in ("card1", "addr1"):
            for lam in (0.05, 0.1, 0.5):
                weights = [(math.exp(-lam * (r[1] - p[1]) / 3600), p[7]) for p in past(long_rows, r, ENT[e])]
                assert close(got[r[0]][f"{e}_v_ewm_lambda_{lam:g}"], sum(w for w, _ in weights), 1e-10)
                assert close(got[r[0]][f"{e}_fraud_v_ewm_lambda_{lam:g}"], sum(w * y for w, y in weights), 1e-10)


def test_half_life(spark):
    lam = 0.05
    half = int(math.log(2) / lam * 3600)
    rows = [(1, 0, 1.0, 5, None, None, None, 1, 0), (2, half, 1.0, 5, None, None, None, 0, 0)]
    got = collected(V.ewm(spark.createDataFrame(rows, SCHEMA), ["card1"], [lam]))
    assert abs(got[2]["card1_v_ewm_lambda_0.05"] - 0.5) < 1e-5
    assert abs(got[2]["card1_fraud_v_ewm_lambda_0.05"] - 0.5) < 1e-5 and got[1]["card1_v_ewm_lambda_0.05"] == 0.0


def test_end_state_and_held_out(spark, long_rows):
    frame = spark.createDataFrame(long_rows, SCHEMA)
    cut = 100 * 86400
    train = [r for r in long_rows if r[1] < cut]
    state = V.ewm_end_state(frame.where(F.col("TransactionDT") < cut), ["card1"])
    for s in state.collect():
        own = [r for r in train if str(r[3]) == s["value"]]
        last = max(r[1] for r in own)
        assert s["last_t"] == last
        assert close(s["v"], sum(math.exp(-s["lambda"] * (last - r[1]) / 3600) for r in own), 1e-10)
    got = collected(V.ewm_held_out(frame.where(F.col("TransactionDT") >= cut), state, ["card1"]))
    for r in (r for r in long_rows if r[1] >= cut):
        weights = [math.exp(-0.05 * (r[1] - p[1]) / 3600) for p in train if p[3] == r[3] and r[3] is not None]
        assert close(got[r[0]]["card1_v_ewm_lambda_0.05"], sum(weights), 1e-10) and got[r[0]]["backward_rows"] == 0
    back = V.ewm_held_out(frame.where(F.col("TransactionDT") < cut), state, ["card1"])
    assert back.agg(F.sum("backward_rows")).first()[0] > 0


def test_duplicate_rates(frame):
    with pytest.raises(ValueError):
        V.ewm(frame, ["card1"], [0.1, 0.1])


def test_leak_check_tells_honest_from_leaky(frame):
    ok = future_leaks(frame, lambda d: V.velocity(d, ["card1"]), "card1_velocity_7d", "card1", n=20).first()
    assert ok["violations"] == 0 and ok["sampled"] == 20
    leaky = future_leaks(frame, lambda d: d.select("TransactionID", "card1").join(d.groupBy("card1").count(), "card1").select("TransactionID", "count"), "count", "card1", n=20)
    assert leaky.first()["violations"] > 0


def test_hot_entity_is_split_into_blocks(spark):
    """A third of all rows on one card reach the window step as one row per second and day block."""
    rows = spark.range(30000).selectExpr("id", "cast(if(id % 3 = 0, 1, id) as string) as value", "'card1' as entity", "id % 500 * 60 as ts")
    inst = H.instants(rows)
    assert inst.where("value = '1'").count() <= 500
    plan = H.sliding(inst, {"1h": 3600})._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert any("blk" in line for line in exchanges)
    assert all("ts#" in line or "blk" in line for line in exchanges), exchanges


def test_an_old_past_stays_positive(spark):
    """Far more than two super blocks back: the decayed count is exp(-500), not 0; and a nearer past adds to it."""
    lam = 0.05
    gap = int(500 / lam) * 3600
    rows = [("card1", "a", 0, 1.0), ("card1", "a", gap, 0.0), ("card1", "a", gap + 3600, 1.0), ("card1", "b", 10, 1.0), ("card1", "b", 3610, 1.0), ("card1", "b", gap + 3610, 1.0)]
    inst = spark.createDataFrame(rows, "entity string, value string, ts long, w double")
    got = {(r["value"], r["ts"]): r["d_0_05"] for r in H.decayed(inst, [lam], {"d": "w"}).collect()}
    assert math.isclose(got["a", gap], math.exp(-500), rel_tol=1e-9)
    assert math.isclose(got["a", gap + 3600], math.exp(-500 - lam), rel_tol=1e-9)
    assert math.isclose(got["b", gap + 3610], math.exp(-500) + math.exp(-500 - lam), rel_tol=1e-9)


def test_a_leak_across_entities_is_seen(spark):
    rows = [(i, i * 100, float(i % 7), i % 3) for i in range(40)]
    df = spark.createDataFrame(rows, "TransactionID long, TransactionDT long, x double, card1 int")
    def whole(d, by):
        d = d.withColumn("g", F.lit(1))
        return d.join(d.groupBy(*by, "g").agg(F.avg("x").alias("m")), [*by, "g"])

    def past(d, by):
        return d.withColumn("m", F.expr(f"sum(x) OVER (PARTITION BY {', '.join([*by, '1'])} ORDER BY TransactionDT RANGE BETWEEN 50 PRECEDING AND CURRENT ROW)"))

    assert leaks_of_any_past(df, whole, "m", n=4).first()["violations"] == 4
    assert leaks_of_any_past(df, past, "m", n=4).first()["violations"] == 0
    assert leaks_of_any_past(df, past, "m", reach=50, n=4).first()["violations"] == 0
    assert leaks_of_any_past(df, whole, "m", reach=50, n=4).first()["violations"] == 4
    assert leaks_of_any_past(df.limit(0), past, "m").first()["sampled"] == 0


RISE = Fold(lambda: [], lambda s, r: [*s, r["TransactionAmt"]], lambda s: (max((k - j for j in range(len(s)) for k in range(j + 1, len(s) + 1) if all(a < b for a, b in zip(s[j:k - 1], s[j + 1:k]))), default=0), len(s)))


def test_folds_pass_from_round_to_round(spark):
    """Half of the rows on one card, ties within and across rounds, a repeated row, cards that end early."""
    rng = random.Random(4)
    rows = [(i, rng.randrange(60) * 10, float(rng.randrange(40)), None if i % 17 == 0 else 1 if i % 2 else rng.randrange(2, 9)) for i in range(130)]
    rows.append(rows[33])
    df = spark.createDataFrame(rows, "TransactionID long, TransactionDT long, TransactionAmt double, card1 long")
    want = []
    for i, t, _, c in rows:
        past = [a for _, _, a in sorted((t2, i2, a2) for i2, t2, a2, c2 in rows if c is not None and c2 == c and t2 < t)]
        want.append((i, *RISE.emit(past)))
    for size in (7, 1000):
        got = past_fold(df, "card1", RISE, ["TransactionAmt"], "longest int, n long", size)
        assert got.columns == ["TransactionID", "longest", "n"] and sorted(map(tuple, got.collect())) == sorted(want)
    assert past_fold(df.limit(0), "card1", RISE, ["TransactionAmt"], "longest int, n long").count() == 0
    assert past_fold(df.where("card1 is null"), "card1", RISE, ["TransactionAmt"], "longest int, n long").where("longest = 0").count() == 8


def test_sessions_cross_blocks(spark):
    """A hot card over several days without a pause, gaps of exactly the limit, ties, and no card."""
    rows = [(1, 600 * k) for k in range(1000)] + [(2, t) for t in (0, 0, 1799, 3599, 5398, 86399, 86400, 90000)] + [(None, 5)]
    df = spark.createDataFrame(rows, "card1 int, t long").repartition(4)
    got = sorted((r["entity"], r["start"], r["end"], r["n"], r["x"]) for r in sessions(df, "card1", F.col("t"), 1800, {"x": F.col("t")}).collect())
    want = []
    for card in (1, 2):
        for t in sorted(t for c, t in rows if c == card):
            if want and want[-1][0] == card and t < want[-1][2]:
                want[-1] = (card, want[-1][1], t + 1800, want[-1][3] + 1, want[-1][4] + t)
            else:
                want.append((card, t, t + 1800, 1, t))
    assert got == want and len(want) == 5
    assert sessions(df.limit(0), "card1", F.col("t"), 1800).count() == 0


def test_any_aggregate_of_the_strict_past(spark, frame, rows):
    got = {r["TransactionID"]: r for r in V.strict_past(frame, "card1", {"spread": F.stddev_samp("TransactionAmt"), "n": F.count("*")}, 5 * 86400).collect()}
    assert len(got) == len(rows)
    for r in rows:
        near = [x[2] for x in rows if r[3] is not None and x[3] == r[3] and r[1] - 5 * 86400 <= x[1] < r[1]]
        known = [a for a in near if a is not None]
        assert got[r[0]]["n"] == len(near)
        want = statistics.stdev(known) if len(known) > 1 else None
        assert got[r[0]]["spread"] is None if want is None else math.isclose(got[r[0]]["spread"], want, rel_tol=1e-9, abs_tol=1e-9)


def test_amount_beside_its_past_mean(spark):
    """Whether an amount equals the mean of two past ones is settled by their plain sum, as in SQL, not by rounding."""
    rng, data = random.Random(3), []
    for card in range(200):
        a, b = (rng.randrange(1, 20000) for _ in range(2))
        b += (a + b) % 2
        # Amounts after the one looked at must not count either.
        amounts = [a / 100, b / 100, (a + b) // 2 / 100, *[rng.randrange(1, 20000) / 100 for _ in range(3)]]
        data += [(card * 10 + i, i * 86400, x, card, None, None, None, 0, 0) for i, x in enumerate(amounts)]
    z = V.zscores(spark.createDataFrame(data, SCHEMA)).where("TransactionID % 10 = 2").collect()
    amount = {r[0]: r[2] for r in data}
    for r in z:
        k = r["TransactionID"]
        assert (r["amt_zscore_vs_card1_history"] == 0) == (amount[k] == (amount[k - 2] + amount[k - 1]) / 2)


def counted(df, counter):
    """`df` with an id column that counts how often its rows are made."""
    @F.udf("long")
    def seen(x):
        counter.add(1)
        return x

    return df.withColumn("TransactionID", seen("TransactionID"))


def test_leak_check_makes_its_rows_once(spark, frame, rows, monkeypatch):
    """A copy of the rows per sampled one must not make the rows again."""
    from tidemark.plans import point_in_time

    made = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(point_in_time, "tied", lambda spark, sf: counted(frame, made))
    found = {r["feature"]: r["violations"] for r in point_in_time.w15_any(spark, "").collect()}
    assert found["past rate"] == 0 and found["rows of a day"] == 0 and found["whole rate"] > 0
    assert made.value == len(rows)


def test_label_quality_makes_its_rows_once(spark, frame, rows):
    """Training passes over the rows many times; they come from one written table."""
    from tidemark.operators.model import label_quality

    made = spark.sparkContext.accumulator(0)
    got = label_quality(counted(frame, made), ["TransactionAmt", "hour_of_day"], folds=2)
    assert got.count() == len(rows)
    assert made.value == len(rows)
