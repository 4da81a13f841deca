"""Sources, sinks, cleaning, contracts and row features."""

from __future__ import annotations

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from tidemark import config
from tidemark.operators import basic as B
from tidemark.operators import clean as C
from tidemark.operators import contracts as K
from tidemark.operators.velocity import require_columns
from tidemark.sources import tables as S


def fail_text(excinfo) -> str:
    return str(excinfo.value)


def test_missing_csv_and_label_rules(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        S.read_transactions(spark, str(tmp_path / "absent"))
    df = spark.createDataFrame([(1, 10, 5.0)], "TransactionID long, TransactionDT long, TransactionAmt double")
    df.write.option("header", True).csv(str(tmp_path / "t"))
    with pytest.raises(ValueError):
        S.read_transactions(spark, str(tmp_path / "t"), "train")
    assert dict(S.read_transactions(spark, str(tmp_path / "t"), "test").dtypes)["TransactionAmt"] == "double"


def test_identity_headers(spark, tmp_path):
    spark.createDataFrame([(1, 2.0, "x")], "`TransactionID` long, `id-01` double, `id-12` string").write.option("header", True).csv(str(tmp_path / "i"))
    got = S.read_identity(spark, str(tmp_path / "i"))
    assert got.dtypes == [("TransactionID", "bigint"), ("id_01", "double"), ("id_12", "string")]


def test_merge_rejects_duplicates(spark):
    tx = spark.createDataFrame([(1,), (2,)], "TransactionID long")
    with pytest.raises(Exception, match="duplicate TransactionID in identity"):
        S.merge_identity(tx, spark.createDataFrame([(1, "a"), (1, "b")], "TransactionID long, d string")).collect()
    with pytest.raises(Exception, match="duplicate TransactionID in transactions"):
        S.merge_identity(tx.unionAll(tx), spark.createDataFrame([(1, "a")], "TransactionID long, d string")).collect()


def test_empty_append_leaves_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "a int")
    path = str(tmp_path / "alerts")
    assert not S.append_lines(df.where("a > 5"), path) and not os.path.exists(path)
    assert S.append_lines(df, path) and S.append_lines(df, path)
    assert spark.read.json(path).count() == 2


def test_audit_sink_refuses_bad_rows(spark, tmp_path):
    cols = "request_id string, score double, decision string, latency_ms double, created_at timestamp"
    import datetime

    now = datetime.datetime(2024, 1, 1)
    bad = spark.createDataFrame([("r1", 0.5, "maybe", 1.0, now)], cols)
    with pytest.raises(Exception, match="decision in"):
        S.append_predictions(bad, str(tmp_path / "p"))
    S.append_predictions(spark.createDataFrame([("r1", 0.5, "block", 0.0, now)], cols), str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q")).count() == 1


def test_file_hashes(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"hello")
    before = S.file_hashes(spark, str(tmp_path)).collect()
    assert [(r["file"], r["bytes"], r["sha256"]) for r in before] == [("a.bin", 5, hashlib.sha256(b"hello").hexdigest())]
    old = spark.createDataFrame(before)
    (tmp_path / "a.bin").write_bytes(b"world")
    (tmp_path / "b.bin").write_bytes(b"x")
    got = {r["file"]: r["state"] for r in S.compare_hashes(old, S.file_hashes(spark, str(tmp_path))).collect()}
    assert got == {"a.bin": "changed", "b.bin": "new"}


def test_null_amount_is_kept(spark):
    df = spark.createDataFrame([(1, None), (2, 0.0), (3, -1.0), (4, 2.0)], "TransactionID long, TransactionAmt double")
    assert sorted(r[0] for r in C.drop_invalid(df).collect()) == [1, 4]
    report = C.drop_report(df).first()
    assert (report["rows_in"], report["rows_out"], report["reason"], report["sample_ids"]) == (4, 2, "non_positive_amount", "2,3")
    assert C.drop_report(df.where("TransactionAmt > 0")).first()["reason"] is None


def test_calendar_of_the_anchor(spark):
    df = C.calendar(C.anchored(spark.createDataFrame([(0,), (86400 + 3600 * 5,)], "TransactionDT long")))
    assert [(r["hour"], r["day_of_week"], r["is_weekend"]) for r in df.orderBy("TransactionDT").collect()] == [(0, 4, 0), (5, 5, 1)]


def test_email_white_space(spark):
    df = spark.createDataFrame([("\t Gmail.COM \n",), (None,), ("",)], "m string")
    assert [r["m"] for r in C.standard_email(df, ["m", "absent"]).collect()] == ["gmail.com", None, ""]


def test_split_rules(spark):
    df = spark.createDataFrame([(1, 5, 0), (2, 10, 1), (3, 20, 0)], "TransactionID long, TransactionDT long, isFraud int")
    assert [r["split"] for r in C.with_split(df, 10, 20).orderBy("TransactionID").collect()] == ["train", "val", "test"]
    with pytest.raises(ValueError):
        C.with_split(df, 10, 10)
    with pytest.raises(ValueError, match="test"):
        C.require_full_splits(C.split_manifest(C.with_split(df, 10, 30), 10, 30))
    twice = C.with_split(df, 10, 20).unionAll(df.selectExpr("TransactionID", "15L as TransactionDT", "isFraud", "'val' as split"))
    got = C.overlap_report(twice).first()
    assert got["shared_ids"] == 2 and got["distinct_ids"] == 3 and got["rows"] == 6
    assert C.shared_ids(df.where("TransactionID < 3"), df.where("TransactionID > 1")).count() == 1


def test_stratified_take_keeps_shares(spark):
    df = spark.range(1000).selectExpr("id as TransactionID", "cast(id % 10 = 0 as int) as isFraud")
    got = {r["isFraud"]: r["n"] for r in C.stratified_take(df, 0.25).groupBy("isFraud").agg(F.count("*").alias("n")).collect()}
    assert got == {0: 225, 1: 25}


def test_required_columns_are_listed_sorted(spark):
    with pytest.raises(KeyError, match=r"\['a', 'b'\]"):
        require_columns(spark.range(1), ["b", "a", "id"])


def test_negative_amount_stops_the_job(spark):
    df = spark.createDataFrame([(-1.0,)], "TransactionAmt double")
    with pytest.raises(Exception, match="negative amount"):
        B.log_amount(df).collect()


def test_decile_outside_goes_to_the_top(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 101)], "TransactionAmt double")
    edges = B.decile_edges(df)
    asked = spark.createDataFrame([(0.5,), (1.0,), (10.9,), (10.95,), (100.0,), (500.0,), (None,)], "TransactionAmt double")
    assert [r["amount_decile"] for r in B.amount_decile(asked, edges).collect()] == [9, 0, 0, 1, 9, 9, 9]


def test_tied_edges_collapse(spark):
    df = spark.createDataFrame([(1.0,)] * 90 + [(2.0,)] * 10, "TransactionAmt double")
    assert B.decile_edges(df) == [1.0, 2.0] or len(B.decile_edges(df)) == 3


def test_mail_columns(spark):
    df = spark.createDataFrame([("gmail.com",), ("mail.yahoo.co.uk",), ("localhost",), (None,), ("tempr.email",), ("gmail",)], "m string")
    got = [tuple(r)[1:] for r in B.mail_columns(df, "m").collect()]
    assert got[0] == ("gmail", "com", 1, 0)
    assert got[1] == ("mail.yahoo.co", "uk", 0, 0)
    assert got[2] == ("localhost", "", 0, 0)
    assert got[3] == (None, None, None, None)
    assert got[4] == ("tempr", "email", 0, 1)
    assert got[5] == ("gmail", "", 1, 0)


def test_missing_threshold_is_strict(spark):
    rows = [(i, None if i < 5 else 1, None if i < 6 else 1) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, a int, b int")
    assert B.columns_often_missing(df) == ["b"]
    got = B.missing_indicators(df.drop("b"), ["b"]).agg(F.sum("is_null_b")).first()[0]
    assert got == 100


def test_raw_contract_reports_everything(spark):
    cols = ("TransactionID long, isFraud int, TransactionDT long, TransactionAmt double, ProductCD string, card1 long, card2 double, card3 double, card4 string, card5 double,"
            "card6 string, addr1 double, addr2 double, P_emaildomain string, R_emaildomain string, M1 string, M4 string, V1 double, extra string")
    good = (1, 0, 5, 1.0, "W", 7, None, None, "visa", None, "credit", None, None, None, None, "T", "M2", None, "x")
    assert K.violations(spark.createDataFrame([good], cols), K.RAW_TRANSACTIONS).count() == 0
    bad = (1, 2, -5, 0.0, "X", None, None, None, "amex", None, "debit", None, None, None, None, "Q", "M9", None, "x")
    got = {(r["rule"], r["column"]): r["n_bad"] for r in K.violations(spark.createDataFrame([good, bad], cols), K.RAW_TRANSACTIONS).collect()}
    assert got == {("unique", "TransactionID"): 1, ("one_of", "isFraud"): 1, ("at_least", "TransactionDT"): 1, ("above", "TransactionAmt"): 1, ("one_of", "ProductCD"): 1,
                   ("not_null", "card1"): 1, ("one_of", "card4"): 1, ("one_of", "M1"): 1, ("one_of", "M4"): 1}
    missing = K.violations(spark.createDataFrame([good], cols).drop("addr2"), K.RAW_TRANSACTIONS).collect()
    assert [(r["rule"], r["column"]) for r in missing] == [("required", "addr2")]
    assert K.FEATURE_TIER_5.version == 1 and len(K.FEATURE_TIER_5.rules) > len(K.INTERIM.rules)
    assert all(r.name != "card4" for r in K.MERGED.without(["card4"]).rules)


def test_fingerprint_ignores_order(spark):
    a = spark.createDataFrame([(1, "x")], "a int, b string")
    assert K.fingerprint(a) == K.fingerprint(a.select("b", "a")) != K.fingerprint(a.withColumn("a", F.col("a").cast("long")))


def test_narrow_types(spark):
    df = spark.createDataFrame([(1, 300, 70000, "a", "x"), (2, 5, 2, "b", "x"), (3, 5, 2, "c", "x")], "a long, b long, c long, s string, t string")
    got = {r["column"]: r["to_type"] for r in K.narrow_types(df).collect()}
    assert got == {"a": "tinyint", "b": "smallint", "c": "int", "s": "string", "t": "category"}
    assert dict(K.apply_types(df, list(got.items())).dtypes)["a"] == "tinyint"


def test_default_fixed_values():
    assert len(config.FREE_PROVIDERS) == 25 and len(config.DISPOSABLE_PROVIDERS) == 15 and config.EWM_LAMBDAS == [0.05, 0.1, 0.5]


def test_digests_stream_files_of_any_size(spark, tmp_path, monkeypatch):
    """Small files in folders, an empty one, hidden ones; then one of 3 GB, of which no task holds more than a chunk."""
    import shutil
    import subprocess

    (tmp_path / "in" / "deep").mkdir(parents=True)
    held = {"a.bin": b"hello", "deep/b.bin": bytes(9 << 20), "empty.bin": b"", "c.txt": b"x"}
    for name, data in held.items():
        (tmp_path / "in" / name).write_bytes(data)
    (tmp_path / "in" / "_SUCCESS").write_bytes(b"")
    want = sorted((n, len(d), hashlib.sha256(d).hexdigest()) for n, d in held.items())
    assert sorted(map(tuple, S.file_hashes(spark, str(tmp_path / "in")).collect())) == want
    assert sorted(map(tuple, S.file_hashes(spark, f"file://{tmp_path}/in", "*.bin").collect())) == [w for w in want if w[0].endswith("bin")]
    assert [tuple(r) for r in S.file_hashes(spark, str(tmp_path / "in" / "a.bin")).collect()] == [want[0]]
    with pytest.raises(Exception, match="absent"):
        S.file_hashes(spark, str(tmp_path / "absent")).collect()
    if shutil.disk_usage(tmp_path).free < 20 << 30:
        pytest.skip("small disk")
    size = (3 << 30) + 5
    with open(tmp_path / "in" / "large.bin", "wb") as f:
        f.truncate(size)  # sparse: takes no room
    known = subprocess.run(["sha256sum", str(tmp_path / "in" / "large.bin")], capture_output=True, text=True, check=True).stdout.split()[0]
    assert tuple(S.file_hashes(spark, str(tmp_path / "in"), "large*").first()) == ("large.bin", size, known)
