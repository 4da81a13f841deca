"""Sessions of an entity: stretches of rows of which each follows the one before it within a gap.

Rows become instants by a partial aggregation and instants are cut into time blocks, so a hot entity is spread over
many tasks. Sessions are found inside a block first; an entity has at most as many of them in a block as gaps fit
into it, however many rows it has. Those that touch a block's border within the gap are then joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.history import DAY

FIRST = ["entity", "start"]


def _joined(parts: DataFrame, keys: list[str], gap: int, sums: list[str]) -> DataFrame:
    """Stretches (start, last) of one group that follow each other within the gap, added up."""
    order = Window.partitionBy(*keys).orderBy("start")
    cut = F.when(F.col("start") - F.lag("last").over(order) < gap, 0).otherwise(1)
    numbered = parts.withColumn("cut", cut).withColumn("session", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "session").agg(F.min("start").alias("start"), F.max("last").alias("last"), *[F.sum(c).alias(c) for c in sums]).drop("session")


def sessions(df: DataFrame, entity: str, time: Column, gap: int, sums: dict[str, Column] | None = None) -> DataFrame:
    """(entity, start, end, n, sums): `end` is `gap` seconds after the last row, which belongs to no session that starts then.

    `time` gives whole seconds, `sums` names numbers to be added up. Rows without the entity have no session.
    """
    names = ["n", *(sums or {})]
    rows = df.select(F.col(entity).alias("entity"), time.cast("long").alias("start"), F.lit(1).cast("long").alias("n"), *[c.alias(n) for n, c in (sums or {}).items()]).where(F.col("entity").isNotNull())
    inst = rows.groupBy(*FIRST).agg(*[F.sum(n).alias(n) for n in names]).withColumn("last", F.col("start"))
    inside = _joined(inst.withColumn("blk", F.floor(F.col("start") / max(DAY, gap))), ["entity", "blk"], gap, names)
    return _joined(inside.drop("blk"), ["entity"], gap, names).select("entity", "start", (F.col("last") + gap).alias("end"), *names)
