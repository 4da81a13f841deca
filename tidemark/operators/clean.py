"""Row cleaning, calendar columns and time splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions.ordered import take_first
from tidemark.operators.leakcheck import hash_order

ID, TIME, AMOUNT, LABEL = "TransactionID", "TransactionDT", "TransactionAmt", "isFraud"
NON_POSITIVE = "non_positive_amount"
SAMPLE_IDS = 10


def bad_amount() -> Column:
    """A NULL amount is not bad: it is kept."""
    return F.coalesce(F.col(AMOUNT) <= 0, F.lit(False))


def drop_invalid(df: DataFrame) -> DataFrame:
    return df.where(~bad_amount())


def drop_report(df: DataFrame) -> DataFrame:
    """Rows in and out, drops by reason (reasons without drops left out) and the first ids dropped."""
    bad = df.where(bad_amount())
    ids = bad.orderBy(ID).limit(SAMPLE_IDS).agg(F.concat_ws(",", F.array_sort(F.collect_list(ID))).alias("sample_ids"))
    counts = df.agg(F.count(F.lit(1)).alias("rows_in"), F.count_if(bad_amount()).alias("dropped"))
    return counts.crossJoin(ids).select(
        "rows_in", (F.col("rows_in") - F.col("dropped")).alias("rows_out"),
        F.when(F.col("dropped") > 0, NON_POSITIVE).alias("reason"), "dropped", "sample_ids")


def anchored(df: DataFrame, anchor: str = config.ANCHOR) -> DataFrame:
    """`timestamp` = anchor + seconds, in UTC."""
    epoch = F.unix_seconds(F.lit(anchor).cast("timestamp"))
    return df.withColumn("timestamp", F.timestamp_seconds(epoch + F.col(TIME)))


def calendar(df: DataFrame) -> DataFrame:
    """`hour`, `day_of_week` (Monday 0) and `is_weekend` of `timestamp` in UTC."""
    return df.withColumns({
        "hour": F.hour("timestamp"),
        "day_of_week": F.weekday("timestamp"),
        "is_weekend": (F.weekday("timestamp") >= 5).cast("int"),
    })


def standard_email(df: DataFrame, columns: list[str]) -> DataFrame:
    """Lower case without surrounding white space; NULL stays, absent columns are skipped."""
    return df.withColumns({c: F.regexp_replace(F.lower(c), r"(?U)^\s+|\s+$", "") for c in columns if c in df.columns})


def with_split(df: DataFrame, train_end: int = config.TRAIN_END, val_end: int = config.VAL_END) -> DataFrame:
    if val_end <= train_end:
        raise ValueError("val_end must be after train_end")
    t = F.col(TIME)
    return df.withColumn("split", F.when(t < train_end, "train").when(t < val_end, "val").otherwise("test"))


def split_manifest(df: DataFrame, train_end: int, val_end: int, seed: int = config.SEED) -> DataFrame:
    """Counts, label rates and time range of every split, one row, one pass."""
    aggs = []
    for s in ("train", "val", "test"):
        here = F.col("split") == s
        aggs += [
            F.count_if(here).alias(f"n_{s}"),
            F.avg(F.when(here, F.col(LABEL).cast("double"))).alias(f"fraud_rate_{s}"),
            F.min(F.when(here, F.col(TIME))).alias(f"min_dt_{s}"),
            F.max(F.when(here, F.col(TIME))).alias(f"max_dt_{s}"),
        ]
    return df.agg(*aggs).select(
        "*", F.lit(train_end).cast("long").alias("train_end_dt"), F.lit(val_end).cast("long").alias("val_end_dt"), F.lit(seed).cast("long").alias("seed"))


def require_full_splits(manifest: DataFrame) -> None:
    row = manifest.first()
    empty = [s for s in ("train", "val", "test") if row[f"n_{s}"] == 0]
    if empty:
        raise ValueError(f"empty splits: {empty}")


def overlap_report(df: DataFrame) -> DataFrame:
    """Ids in two splits, distinct ids against rows, and whether the splits follow each other in time."""
    ids = df.groupBy(ID).agg(F.count(F.lit(1)).alias("n"), F.min("split").alias("a"), F.max("split").alias("b"))
    id_part = ids.agg(
        F.count_if(F.col("a") != F.col("b")).alias("shared_ids"), F.count(F.lit(1)).alias("distinct_ids"), F.sum("n").alias("rows"))

    def edge(agg, s):
        return agg(F.when(F.col("split") == s, F.col(TIME)))

    time_part = df.agg(
        (edge(F.max, "train") < edge(F.min, "val")).alias("train_before_val"),
        (edge(F.max, "val") < edge(F.min, "test")).alias("val_before_test"))
    return id_part.crossJoin(time_part)


def shared_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(ID).join(b.select(ID), ID, "left_semi").distinct()


def numeric_features(df: DataFrame, also_drop: list[str] | None = None) -> list[str]:
    """Numeric columns other than the id, time, label and calendar stamp."""
    skip = {ID, TIME, LABEL, "timestamp", *(also_drop or [])}
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [c for c, t in df.dtypes if c not in skip and (t in numeric or t.startswith("decimal"))]


def stratified_take(df: DataFrame, fraction: float, label: str = LABEL, seed: int = config.SEED) -> DataFrame:
    """Exactly round(fraction * n) rows of each class, in a seeded hash order."""
    # Eight hex digits order the rows; equal digits fall back to the id.
    h = F.conv(F.substring(hash_order(seed, ID), 1, 8), 16, 10).cast("long")
    rows = df.select(ID, label, h.alias("h"))
    return take_first(rows, [label], "h", ID, F.floor(F.col("total_n") * fraction + 0.5)).select(ID, label)


def hash_fold(id_col: str = ID, k: int = config.N_FOLDS, seed: int = config.SEED) -> Column:
    """A fold number any engine can reproduce."""
    return (F.conv(F.substring(hash_order(seed, id_col), 1, 8), 16, 10).cast("long") % k).cast("int")


def flatten_groups(df: DataFrame, groups: dict[str, list[str]], kind: str = "double") -> DataFrame:
    """Map columns to plain columns (missing keys NULL), dropping the maps; the label is unknown."""
    flat = [F.col(g)[k].cast(kind).alias(k) for g, keys in groups.items() for k in keys]
    keep = [c for c in df.columns if c not in groups]
    return df.select(*keep, *flat, F.lit(None).cast("int").alias(LABEL))
