"""Feature store tables: newest entity features, long rows with a time to live, reads as of a time."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import config
from tidemark.sources.tables import write_if_any


def glob_pattern(glob: str) -> str:
    return "^" + ".*".join(re.escape(part) for part in glob.split("*")) + "$"


def ttl_seconds(name: Column, patterns: list[tuple[str, int]] | None = None, default: int = config.DEFAULT_TTL) -> Column:
    """Time to live of a feature by its name: the first matching pattern decides."""
    out = None
    for glob, seconds in patterns or config.TTL_PATTERNS:
        hit = name.rlike(glob_pattern(glob))
        out = F.when(hit, seconds) if out is None else out.when(hit, seconds)
    return F.lit(default) if out is None else out.otherwise(default)


def newest(df: DataFrame, entity: str, features: list[str], time_col: str = "TransactionDT", id_col: str = "TransactionID") -> DataFrame:
    """Each entity value's newest row (lowest id on a tie), as `entity_id` and features.

    A maximum over a struct combines before the shuffle, so no entity is sorted or buffered.
    """
    latest = F.max_by(F.struct(*[F.col(f"`{c}`").alias(c) for c in features]), F.struct(F.col(time_col), -F.col(id_col)))
    out = df.where(F.col(entity).isNotNull()).groupBy(F.col(entity).cast("string").alias("entity_id")).agg(latest.alias("r"), F.max(time_col).alias("as_of"))
    return out.select("entity_id", "as_of", "r.*")


def to_long(wide: DataFrame, entity_type: str, id_col: str, features: list[str], written_at: int | Column) -> DataFrame:
    """One row per (entity, feature) with its expiry; names that break the pattern are refused."""
    at = F.lit(written_at).cast("long") if isinstance(written_at, int) else written_at.cast("long")
    usable = [f for f in features if re.match(config.FEATURE_NAME_PATTERN, f)]
    pairs = F.array(*[F.struct(F.lit(f).alias("feature_name"), F.col(f"`{f}`").cast("double").alias("value")) for f in usable])
    long = wide.select(F.lit(entity_type).alias("entity_type"), F.col(id_col).alias("entity_id"), at.alias("written_at"), F.explode(pairs).alias("p"))
    long = long.select("entity_type", "entity_id", "p.feature_name", "p.value", "written_at")
    return long.withColumn("expires_at", F.col("written_at") + ttl_seconds(F.col("feature_name")))


def write_snapshot(long: DataFrame, path: str) -> bool:
    """Append a snapshot; a frame without rows is no write."""
    return write_if_any(long, lambda rows: rows.write.mode("append").partitionBy("entity_type").parquet(path))


def visible(long: DataFrame, as_of: int | Column) -> DataFrame:
    """Values written at or before `as_of` and not expired then; the newest write wins."""
    at = F.lit(as_of).cast("long") if isinstance(as_of, int) else as_of
    live = long.where((F.col("written_at") <= at) & (F.col("expires_at") > at))
    latest = F.max_by(F.struct("value", "written_at", "expires_at"), F.col("written_at"))
    return live.groupBy("entity_type", "entity_id", "feature_name").agg(latest.alias("r")).select("entity_type", "entity_id", "feature_name", "r.*")


def entity_features(features: list[str], entity: str) -> list[str]:
    """Features kept per entity value: those named after the entity."""
    return [f for f in features if f.startswith(f"{entity}_")]


def snapshot(df: DataFrame, entities: list[str], features: list[str], limit: int | None = None) -> DataFrame:
    """Long snapshot of each entity value's newest features, stamped with the row's own time."""
    out = None
    for e in entities:
        names = entity_features(features, e)
        if not names:
            continue
        wide = newest(df, e, names)
        if limit is not None:
            wide = wide.orderBy(F.desc("as_of"), "entity_id").limit(limit)
        one = to_long(wide, e, "entity_id", names, F.col("as_of"))
        out = one if out is None else out.unionByName(one)
    return out


def as_of(rows: DataFrame, entity: str, snapshots: DataFrame, features: list[str], id_col: str = "TransactionID", time_col: str = "TransactionDT") -> DataFrame:
    """Each row's latest snapshot values at or before its own time, dropped once expired.

    `snapshots` is wide: (entity_id, written_at, features). Snapshots and row times are laid on one
    time line per entity value, and the latest snapshot is a running maximum over time blocks, so an
    entity with very many rows or snapshots is spread over blocks.
    """
    from tidemark.operators.history import running

    base = rows.select(F.col(id_col).alias("id"), F.col(entity).cast("string").alias("value"), F.col(time_col).cast("long").alias("ts"))
    state = F.struct(F.col("written_at"), *[F.col(f"`{f}`").alias(f) for f in features]).alias("state")
    written = snapshots.select(F.col("entity_id").alias("value"), F.col("written_at").alias("ts"), state).groupBy("value", "ts").agg(F.max("state").alias("state"))
    kind = written.schema["state"].dataType
    asked = base.where(F.col("value").isNotNull()).select("value", "ts").distinct().withColumn("state", F.lit(None).cast(kind))
    line = written.unionByName(asked).groupBy("value", "ts").agg(F.max("state").alias("state"))
    known = running(line, ["value"], maxs=["state"], inclusive=True).select("value", "ts", F.col("past_state").alias("state"))
    hit = base.where(F.col("value").isNotNull()).join(known, ["value", "ts"])
    cols = []
    for f in features:
        live = F.col("ts") < F.col("state.written_at") + ttl_seconds(F.lit(f))
        cols.append(F.when(live, F.col("state")[f]).alias(f))
    found = hit.select(F.col("id").alias(id_col), F.col("state.written_at").alias(f"{entity}_snapshot_at"), *cols)
    return rows.select(id_col).join(found, id_col, "left")


def assemble(rows: DataFrame, entity_parts: list[DataFrame | None], batch: DataFrame | None, features: list[str], id_col: str = "TransactionID") -> DataFrame:
    """The model's feature columns in order, as doubles, with `degraded_mode`.

    Row columns come first, entity values override them, batch values override both. A feature no source
    has becomes the default; a NULL among the row's own columns stays NULL. A source that is not
    available (None) leaves its defaults and marks the row degraded.
    """
    degraded = batch is None or any(p is None for p in entity_parts)
    own = set(rows.columns)
    joined = rows
    from_entity: set[str] = set()
    for p in entity_parts:
        if p is None:
            continue
        names = [c for c in p.columns if c != id_col]
        joined = joined.join(p.select(id_col, *[F.col(f"`{c}`").alias(f"e__{c}") for c in names]), id_col, "left")
        from_entity |= set(names)
    from_batch: set[str] = set()
    if batch is not None:
        names = [c for c in batch.columns if c != id_col]
        joined = joined.join(batch.select(id_col, *[F.col(c).alias(f"b__{c}") for c in names]), id_col, "left")
        from_batch = set(names)
    out = []
    for f in features:
        known_default = config.BATCH_DEFAULTS.get(f, config.BATCH_DEFAULTS["entity_degree_default"] if f.startswith("entity_degree_") else None)
        if f in from_batch:
            value = F.coalesce(F.col(f"b__{f}").cast("double"), F.lit(known_default if known_default is not None else config.ENTITY_DEFAULT))
        elif known_default is not None:
            value = F.lit(known_default)
        elif f in from_entity:
            value = F.coalesce(F.col(f"`e__{f}`").cast("double"), F.lit(config.ENTITY_DEFAULT))
        elif f in own:
            value = F.col(f"`{f}`").cast("string").try_cast("double") if dict(rows.dtypes)[f] == "string" else F.col(f"`{f}`").cast("double")
        else:
            value = F.lit(config.ENTITY_DEFAULT)
        out.append(value.alias(f))
    return joined.select(id_col, *out, F.lit(degraded).alias("degraded_mode"))
