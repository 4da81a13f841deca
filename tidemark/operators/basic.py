"""Row features: amount, calendar, mail domain, missing values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions.ordered import exact_quantiles


def log_amount(df: DataFrame, amount: str = "TransactionAmt") -> DataFrame:
    checked = F.when(F.col(amount) < 0, F.raise_error(F.lit("negative amount")).cast("double")).otherwise(F.log1p(F.col(amount)))
    return df.withColumn("log_amount", checked)


def decile_edges(df: DataFrame, amount: str = "TransactionAmt", n: int = 10) -> list[float]:
    """Distinct quantile edges; at most n + 1 numbers come to the driver."""
    q = exact_quantiles(df, amount, [i / n for i in range(n + 1)])
    return sorted({r["quantile"] for r in q.select("quantile").collect()})


def amount_decile(df: DataFrame, edges: list[float], amount: str = "TransactionAmt") -> DataFrame:
    """Right-closed buckets with the lowest edge included; NULL and both outsides go to the top bucket."""
    top = len(edges) - 2
    a = F.col(amount)
    idx: Column = F.lit(0)
    for e in edges[1:-1]:
        idx = idx + F.when(a > F.lit(e), 1).otherwise(0)
    inside = (a >= F.lit(edges[0])) & (a <= F.lit(edges[-1]))
    return df.withColumn("amount_decile", F.when(inside, idx).otherwise(F.lit(top)).cast("int"))


def calendar_set(df: DataFrame, time_col: str = "TransactionDT", anchor: str = config.ANCHOR) -> DataFrame:
    ts = F.timestamp_seconds(F.unix_seconds(F.lit(anchor).cast("timestamp")) + F.col(time_col))
    hour, dow = F.hour(ts), F.weekday(ts)
    angle = hour * (2.0 * math.pi / 24.0)
    return df.withColumns({
        "hour_of_day": hour,
        "day_of_week": dow,
        "is_weekend": (dow >= 5).cast("int"),
        "is_business_hours": ((hour >= 9) & (hour < 17)).cast("int"),
        "hour_sin": F.sin(angle),
        "hour_cos": F.cos(angle),
    })


def mail_columns(df: DataFrame, column: str, free: list[str] | None = None, disposable: list[str] | None = None) -> DataFrame:
    """Provider and top-level domain (split at the last dot) and free / disposable flags; NULL in, NULL out."""
    c = F.col(column)
    dotted = c.contains(".")
    provider = F.when(dotted, F.regexp_extract(c, r"^([\s\S]*)\.[^.]*$", 1)).when(c.isNotNull(), c)
    tld = F.when(dotted, F.substring_index(c, ".", -1)).when(c.isNotNull(), F.lit(""))

    def listed(domains: list[str]) -> Column:
        heads = sorted({d.rsplit(".", 1)[0] for d in domains})
        return F.when(c.isNotNull(), (provider.isin(heads) | c.isin(sorted(domains))).cast("byte"))

    return df.withColumns({
        f"{column}_provider": provider,
        f"{column}_tld": tld,
        f"{column}_is_free": listed(free or config.FREE_PROVIDERS),
        f"{column}_is_disposable": listed(disposable or config.DISPOSABLE_PROVIDERS),
    })


def columns_often_missing(df: DataFrame, threshold: float = config.MISSING_THRESHOLD) -> list[str]:
    """Sorted columns whose NULL share exceeds the threshold; one pass, one row to the driver."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)]).first()
    return sorted(c for i, c in enumerate(df.columns) if row["n"] and row[f"m{i}"] / row["n"] > threshold)


def missing_indicators(df: DataFrame, columns: list[str]) -> DataFrame:
    """`is_null_{c}`; a column the frame does not have counts as missing everywhere."""
    return df.withColumns({
        f"is_null_{c}": F.col(f"`{c}`").isNull().cast("int") if c in df.columns else F.lit(1) for c in columns
    })
