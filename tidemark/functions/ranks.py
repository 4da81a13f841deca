"""Dense positions of distinct values of any orderable type, without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in its low 33 bits


def dense_index(values: DataFrame, order: list[str], name: str = "idx", start: int = 1) -> DataFrame:
    """Add `name` = start, start + 1, ... in the order of `order`, which must identify rows.

    A distributed sort places rows; the position inside each partition is written with them, so the
    offsets computed afterwards belong to exactly that placement. Offsets: one row per partition.
    """
    mid = F.monotonically_increasing_id()
    placed = values.orderBy(*order).withColumn("__mid", mid)
    placed = placed.withColumns({"__part": F.shiftright("__mid", ROW_BITS), "__row": F.col("__mid").bitwiseAND(F.lit((1 << ROW_BITS) - 1))}).drop("__mid")
    stored = cut_lineage(placed, "dense-index")
    sizes = stored.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__offset"))
    out = stored.join(F.broadcast(offsets), "__part")
    return out.withColumn(name, F.col("__offset") + F.col("__row") + start).drop("__part", "__row", "__offset")
