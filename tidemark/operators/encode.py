"""Smoothed label encodings, with and without the row's own fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config
from tidemark.operators.clean import hash_fold

LABEL = "isFraud"


def smooth(hits: Column, n: Column, prior: Column, alpha: float) -> Column:
    """(hits + alpha * prior) / (n + alpha); the prior itself when there is nothing to divide by."""
    return F.when(n + alpha > 0, (hits + alpha * prior) / (n + alpha)).otherwise(prior)


def label_stats(df: DataFrame, column: str, label: str = LABEL, extra: list[str] | None = None) -> DataFrame:
    """Rows and labels per category; NULL is a category of its own."""
    return df.groupBy(F.col(column).alias("cat"), *(extra or [])).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("double")).alias("hits"))


def fit_encoding(df: DataFrame, column: str, alpha: float = config.ENCODING_ALPHA, label: str = LABEL) -> DataFrame:
    """One row per category: (cat, enc)."""
    prior = df.agg(F.avg(F.col(label).cast("double")).alias("prior"))
    stats = label_stats(df, column, label).crossJoin(F.broadcast(prior))
    return stats.select("cat", smooth(F.col("hits"), F.col("n"), F.col("prior"), alpha).alias("enc"))


def apply_encoding(df: DataFrame, column: str, encoding: DataFrame, prior: DataFrame) -> DataFrame:
    """Add `{column}_target_enc`; categories not seen in training get the prior (a one-row frame).

    The join side is not hinted: its measured size decides between a broadcast and a shuffle.
    """
    e = encoding.select(F.col("cat").alias("_cat"), F.col("enc").alias("_enc"))
    joined = df.join(e, F.col(column).eqNullSafe(F.col("_cat")), "left").crossJoin(F.broadcast(prior.toDF("_prior")))
    return joined.withColumn(f"{column}_target_enc", F.coalesce("_enc", "_prior")).drop("_cat", "_enc", "_prior")


def out_of_fold(df: DataFrame, columns: list[str], alpha: float = config.ENCODING_ALPHA, folds: int = config.N_FOLDS,
                label: str = LABEL, fold: Column | None = None) -> DataFrame:
    """Add `{column}_target_enc` from the other folds' rows only, with those folds' own prior.

    Each category is counted once per fold; the other folds are the total minus the row's own fold, so
    the table is scanned once per column instead of once per fold.
    """
    out = df.withColumn("fold", fold if fold is not None else hash_fold(k=folds))
    by_fold = out.groupBy("fold").agg(F.count(F.lit(1)).alias("fn"), F.sum(F.col(label).cast("double")).alias("fh"))
    everything = Window.partitionBy()  # over one row per fold
    prior = by_fold.select(F.col("fold").alias("_pf"), ratio_or_null(F.sum("fh").over(everything) - F.col("fh"), F.sum("fn").over(everything) - F.col("fn")).alias("_prior"))
    result = out
    for c in columns:
        stats = label_stats(out, c, label, ["fold"])
        total = Window.partitionBy("cat")  # at most one row per fold
        stats = stats.withColumns({"on": F.sum("n").over(total) - F.col("n"), "oh": F.sum("hits").over(total) - F.col("hits")})
        stats = stats.join(F.broadcast(prior), F.col("fold") == F.col("_pf"))
        stats = stats.select(F.col("cat").alias("_cat"), F.col("fold").alias("_fold"), smooth(F.col("oh"), F.col("on"), F.col("_prior"), alpha).alias(f"{c}_target_enc"))
        result = result.join(stats, (F.col("fold") == F.col("_fold")) & F.col(c).eqNullSafe(F.col("_cat")), "left").drop("_cat", "_fold")
    return result


def ratio_or_null(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def exact_stratified_folds(df: DataFrame, id_col: str = "TransactionID", label: str = LABEL, folds: int = config.N_FOLDS) -> DataFrame:
    """Folds of equal size within each label: position in a seeded hash order, modulo the fold count."""
    from tidemark.functions.ordered import cumulative
    from tidemark.operators.leakcheck import hash_order

    h = F.conv(F.substring(hash_order(config.SEED, id_col), 1, 8), 16, 10).cast("long")
    rows = df.select(id_col, label, h.alias("h"))
    counts = rows.groupBy(label, "h").agg(F.count(F.lit(1)).alias("n"))
    base = cumulative(counts, "h", ["n"], [label]).select(label, "h", "before_n")
    # Rows with equal hash digits are told apart by id; such groups are tiny by construction.
    tie = Window.partitionBy(label, "h").orderBy(id_col)
    ranked = rows.withColumn("tie", F.row_number().over(tie) - 1).join(base, [label, "h"])
    return ranked.select(id_col, label, ((F.col("before_n") + F.col("tie")) % folds).cast("int").alias("fold"))
