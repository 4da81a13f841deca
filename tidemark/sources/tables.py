"""Readers and writers for transactions, identities, splits, manifests, logs and snapshots."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.digests import FileDigests

KEY = "TransactionID"

TRANSACTION_FIELDS = {
    "TransactionID": T.LongType(), "isFraud": T.IntegerType(), "TransactionDT": T.LongType(),
    "TransactionAmt": T.DoubleType(), "ProductCD": T.StringType(), "card1": T.LongType(),
    "card2": T.DoubleType(), "card3": T.DoubleType(), "card4": T.StringType(), "card5": T.DoubleType(),
    "card6": T.StringType(), "addr1": T.DoubleType(), "addr2": T.DoubleType(), "dist1": T.DoubleType(),
    "dist2": T.DoubleType(), "P_emaildomain": T.StringType(), "R_emaildomain": T.StringType(),
}
NUMBERED_DOUBLE = re.compile(r"^(C\d{1,2}|D\d{1,2}|V\d{1,3}|id_(0\d|1[01]|1[3-4]|1[7-9]|2[0-24-6]|32))$")
DASHED_ID = re.compile(r"^id-(\d{2})$")


def csv_schema(columns: list[str], known: dict[str, T.DataType] | None = None) -> T.StructType:
    """Types for a header: named fields first, numbered blocks as double, the rest as string."""
    known = known or TRANSACTION_FIELDS
    return T.StructType([
        T.StructField(c, known.get(c) or (T.DoubleType() if NUMBERED_DOUBLE.match(c.replace("-", "_")) else T.StringType())) for c in columns
    ])


def _header(spark: SparkSession, path: str) -> list[str]:
    try:
        rows = spark.read.option("header", True).csv(path)
    except Exception as exc:  # Spark raises AnalysisException for a missing path
        if "PATH_NOT_FOUND" in str(exc):
            raise FileNotFoundError(path) from exc
        raise
    return rows.columns


def read_transactions(spark: SparkSession, path: str, split: str = "train") -> DataFrame:
    """Transactions from CSV with a declared schema; the test split carries no label."""
    if split not in ("train", "test"):
        raise ValueError(f"unknown split: {split}")
    columns = _header(spark, path)
    if (split == "train") != ("isFraud" in columns):
        raise ValueError("the train split must carry isFraud and the test split must not")
    return spark.read.schema(csv_schema(columns)).option("header", True).csv(path)


def read_identity(spark: SparkSession, path: str) -> DataFrame:
    """Identities from CSV; `id-01` style headers become `id_01`."""
    columns = _header(spark, path)
    df = spark.read.schema(csv_schema(columns)).option("header", True).csv(path)
    return df.withColumnsRenamed({c: DASHED_ID.sub(r"id_\1", c) for c in columns if DASHED_ID.match(c)})


def duplicate_keys(df: DataFrame, key: str = KEY) -> DataFrame:
    """Keys held by more than one row; reads the key column only."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def merge_identity(tx: DataFrame, identity: DataFrame, key: str = KEY, check: bool = True) -> DataFrame:
    """One-to-one left join. Unique keys on both sides also fix the row count.

    Keys are counted where the join has brought them together, so the guard costs no shuffle of its own;
    a repeated key stops the job that reads the result.
    """
    def single(df: DataFrame, side: str) -> DataFrame:
        stop = F.raise_error(F.concat(F.lit(f"duplicate {key} in {side}: "), F.col(key).cast("string"))).cast("boolean")
        counted = df.withColumn("__held", F.count(F.lit(1)).over(Window.partitionBy(key)))
        return counted.where(F.when(F.col("__held") > 1, stop).otherwise(True)).drop("__held")

    return single(tx, "transactions").join(single(identity, "identity"), key, "left") if check else tx.join(identity, key, "left")


def write_splits(df: DataFrame, path: str) -> None:
    """One folder per split, so a reader of one split skips the others."""
    df.write.mode("errorifexists").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("split") == split).drop("split")


def write_manifest(df: DataFrame, path: str) -> None:
    """A one-row JSON file with sorted keys."""
    df.select(*sorted(df.columns)).limit(1).coalesce(1).write.mode("errorifexists").json(path)


def read_manifest(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def append_lines(df: DataFrame, path: str) -> bool:
    """Append records as JSON lines; writes nothing, not even a file, for an empty frame."""
    return write_if_any(df, lambda rows: rows.write.mode("append").json(path))


def write_if_any(df: DataFrame, write) -> bool:
    """Write a frame that has rows. What the look at it computes is kept for the write."""
    rows = df.persist()
    try:
        if rows.isEmpty():
            return False
        write(rows)
        return True
    finally:
        rows.unpersist()


def check_predictions(df: DataFrame) -> DataFrame:
    """Rows the audit log must refuse, with the rule they break."""
    rules = F.array_compact(F.array(
        F.when(F.col("request_id").isNull(), F.lit("request_id not null")),
        F.when(F.col("score").isNull(), F.lit("score not null")),
        F.when(~F.coalesce(F.col("decision").isin("block", "allow"), F.lit(False)), F.lit("decision in (block, allow)")),
        F.when(~F.coalesce(F.col("latency_ms") >= 0, F.lit(False)), F.lit("latency_ms >= 0")),
    ))
    return df.withColumn("broken_rules", rules)


def append_predictions(df: DataFrame, path: str) -> None:
    """Append accepted rows by day; rows that break a rule stop the write."""
    checked = check_predictions(df)
    refusal = F.concat(F.lit("prediction breaks: "), F.concat_ws(", ", "broken_rules"), F.lit(" in request "), F.coalesce("request_id", F.lit("(none)")))
    good = checked.where(F.when(F.size("broken_rules") > 0, F.raise_error(refusal).cast("boolean")).otherwise(True))
    good.drop("broken_rules").withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)


def load_report(df: DataFrame, schema_version: int = 1) -> DataFrame:
    """Rows, columns, schema version and the plan's size estimate in bytes."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(len(df.columns)).cast("long").alias("columns"),
        F.lit(schema_version).cast("long").alias("schema_version"), F.lit(size).cast("long").alias("plan_bytes"))


def file_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Name below `path`, size and SHA-256 of each file whose name matches; files may be of any size."""
    spark.dataSource.register(FileDigests)
    return spark.read.format(FileDigests.name()).option("pattern", pattern).load(path)


def compare_hashes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files that are new, gone or changed between two manifests."""
    b = before.select("file", F.col("bytes").alias("old_bytes"), F.col("sha256").alias("old"))
    a = after.select("file", F.col("bytes").alias("new_bytes"), F.col("sha256").alias("new"))
    state = (F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "gone")
             .when((F.col("old") != F.col("new")) | (F.col("old_bytes") != F.col("new_bytes")), "changed").otherwise("same"))
    return b.join(a, "file", "full").select("file", state.alias("state"))
