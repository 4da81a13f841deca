"""Windowed rates over the decision log: built-in event-time aggregations with a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import config
from tidemark.operators.history import sliding
from tidemark.operators.monitor import bucket_quantile

TIME = "created_at"


def _edges(df: DataFrame) -> DataFrame:
    return df.withColumns({"window_start": F.unix_seconds("window.start"), "window_end": F.unix_seconds("window.end")}).drop("window")


def share(stream: DataFrame, hit: Column, size: str, slide: str | None, limit: float, delay: str = "10 minutes") -> DataFrame:
    """Rows, hits, share and breach per window."""
    g = stream.withWatermark(TIME, delay).groupBy(F.window(TIME, size, slide) if slide else F.window(TIME, size))
    out = g.agg(F.count(F.lit(1)).alias("total"), F.count_if(hit).alias("hits"))
    return _edges(out.withColumn("share", F.col("hits") / F.col("total"))).withColumn("breach", F.col("share") > limit)


def block_rate(stream: DataFrame, size: str = "5 minutes", slide: str | None = "1 minute", limit: float = 0.15) -> DataFrame:
    return share(stream, F.col("decision") == "block", size, slide, limit)


def error_rate(stream: DataFrame, size: str = "5 minutes", slide: str | None = None, limit: float = 0.01) -> DataFrame:
    return share(stream, F.col("status") >= 500, size, slide, limit)


def decision_mix(stream: DataFrame, size: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    return _edges(stream.withWatermark(TIME, delay).groupBy(F.window(TIME, size), "decision").agg(F.count(F.lit(1)).alias("n")))


def _bucket_counts(stream: DataFrame, value: Column, bounds: list[float], size: str, delay: str) -> DataFrame:
    g = stream.withWatermark(TIME, delay).withColumn("__x", value).groupBy(F.window(TIME, size))
    return _edges(g.agg(*[F.count_if(F.col("__x") <= b).alias(f"le{i}") for i, b in enumerate(bounds)], F.count("__x").alias("total")))


def _buckets(bounds: list[float]) -> Column:
    return F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"le{i}").alias("n")) for i, b in enumerate(bounds)],
                   F.struct(F.lit(float("inf")).alias("le"), F.col("total").alias("n")))


def latency_quantile(stream: DataFrame, q: float = 0.95, size: str = "5 minutes", limit: float = 0.1, delay: str = "10 minutes") -> DataFrame:
    """Latency quantile per window from the fixed buckets, in seconds."""
    counts = _bucket_counts(stream, F.col("latency_ms") / 1000.0, config.LATENCY_BOUNDS, size, delay)
    out = counts.withColumn("latency", bucket_quantile(_buckets(config.LATENCY_BOUNDS), F.col("total"), q))
    return out.select("window_start", "window_end", "total", "latency", (F.col("latency") > limit).alias("breach"))


def score_distribution(stream: DataFrame, size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Cumulative score counts per window: (window_start, le, n)."""
    counts = _bucket_counts(stream, F.col("score"), config.SCORE_BOUNDS, size, delay)
    return counts.select("window_start", F.explode(_buckets(config.SCORE_BOUNDS)).alias("b")).select(
        "window_start", F.when(F.col("b.le") < float("inf"), F.col("b.le")).alias("le"), F.col("b.n").alias("n"))


def disagreement(predictions: DataFrame, shadow: DataFrame, size: str = "15 minutes", limit: float = 0.1, delay: str = "10 minutes", wait: str = "5 minutes") -> DataFrame:
    """Share of differing decisions per window; a shadow result arrives at most `wait` after its request."""
    p = predictions.withWatermark(TIME, delay).select("request_id", TIME, "decision")
    s = shadow.withWatermark("shadow_at", delay).select(F.col("request_id").alias("shadow_request"), "shadow_at", "shadow_decision")
    in_time = F.expr(f"request_id = shadow_request AND shadow_at >= {TIME} AND shadow_at <= {TIME} + INTERVAL {wait}")
    j = p.join(s, in_time)
    out = j.groupBy(F.window(TIME, size)).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("decision") != F.col("shadow_decision")).alias("hits"))
    return _edges(out.withColumn("share", F.col("hits") / F.col("total"))).withColumn("breach", F.col("share") > limit)


def once_per_request(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Drop repeats of a request that arrive within the watermark."""
    return stream.withWatermark(TIME, delay).dropDuplicatesWithinWatermark(["request_id"])


def sustained(windows: DataFrame, hold: int, step: int) -> DataFrame:
    """Windows whose breach has lasted `hold` seconds: every evaluation since then, `step` apart, breached too."""
    breached = windows.where("breach").select(F.lit("rule").alias("entity"), F.lit("all").alias("value"), F.col("window_end").alias("ts"), F.lit(1).alias("n"))
    lasted = sliding(breached, {"hold": hold}).where(F.col("n_hold") >= hold // step)
    return windows.join(lasted.select(F.col("ts").alias("window_end")), "window_end", "left_semi")


def enrich(stream: DataFrame, snapshot: DataFrame, features: list[str], default: float = config.ENTITY_DEFAULT) -> DataFrame:
    """Stream rows with the newest snapshot of their client; clients without one get the default."""
    s = snapshot.select(F.col("entity_id").alias("client_id"), *features)
    return stream.join(s, "client_id", "left").fillna(default, features)


def card_sessions(stream: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes", entity: str = "client_id") -> DataFrame:
    """Bursts of an entity: requests, blocks and duration of each session, once the watermark has passed its end.

    Sessions are merged where rows are read before they are shuffled, so a hot entity sends sessions and not rows.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    g = stream.withWatermark(TIME, delay).groupBy(entity, F.session_window(TIME, gap).alias("window"))
    out = _edges(g.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("decision") == "block").alias("blocks")))
    return out.select(entity, "window_start", "window_end", "n", "blocks")
