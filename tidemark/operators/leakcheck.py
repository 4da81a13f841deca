"""Does a feature change when later rows are hidden?"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import SEED
from tidemark.session import cut_lineage

ID, TIME = "TransactionID", "TransactionDT"


def hash_order(seed: int, id_col: str):
    """A seeded order both engines reproduce."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def future_leaks(df: DataFrame, feature: Callable[[DataFrame], DataFrame], column: str, entity: str,
                 n: int = 50, seed: int = SEED, rtol: float = 1e-9, atol: float = 1e-12) -> DataFrame:
    """Recompute `feature` for `n` sampled rows on only the rows at or before each one.

    The sample size is fixed, so the sample is a bounded broadcast. Each sample sees its own copy of
    its entity's past, kept apart by prefixing ids and entity values with the sample id; the feature
    may therefore depend on rows of the same `entity` value only. `leaks_of_any_past` has no such limit.
    """
    sample = cut_lineage(df.orderBy(hash_order(seed, ID), ID).limit(n).select(
        F.col(ID).alias("s_id"), F.col(TIME).alias("s_time"), F.col(entity).alias("s_entity")), "leak-sample")
    known = df.join(F.broadcast(sample), (F.col(entity) == F.col("s_entity")) & (F.col(TIME) <= F.col("s_time")))
    # A row without the entity has no past: it is recomputed on itself.
    alone = df.join(F.broadcast(sample.where(F.col("s_entity").isNull())), F.col(ID) == F.col("s_id"))
    known = known.unionByName(alone)

    def tag(c: str):
        return F.when(F.col(c).isNotNull(), F.concat_ws("|", F.col("s_id").cast("string"), F.col(c).cast("string")))

    known = known.withColumn(entity, tag(entity)).withColumn(ID, tag(ID)).drop("s_time", "s_entity", "s_id")
    again = feature(known).select(F.col(ID).alias("key"), F.col(column).cast("double").alias("past_only"))
    now = feature(df).select(F.col(ID), F.col(column).cast("double").alias("as_built"))
    now = now.join(F.broadcast(sample.select(F.col("s_id").alias(ID))), ID)
    both = now.withColumn("key", F.concat_ws("|", F.col(ID).cast("string"), F.col(ID).cast("string"))).join(again, "key", "left")
    return _compared(both, rtol, atol)


def leaks_of_any_past(df: DataFrame, feature: Callable[[DataFrame, list[str]], DataFrame], column: str, reach: int | None = None,
                      n: int = 50, seed: int = SEED, rtol: float = 1e-9, atol: float = 1e-12) -> DataFrame:
    """The same for features that read rows of any entity, in one job.

    `feature(rows, by)` computes the feature apart for every value of the columns `by` and returns them beside the
    id and `column`. Each of the `n` sampled rows gets a copy of all rows up to its time, tagged with its id. With
    `reach`, the seconds that the feature looks back, a copy holds those rows only: rows and samples then meet on
    time buckets of that length, so a row is copied for the samples that can see it and no others.
    """
    sample = cut_lineage(df.orderBy(hash_order(seed, ID), ID).limit(n).select(F.col(ID).alias("s_id"), F.col(TIME).cast("long").alias("s_time")), "leak-sample")
    time = F.col(TIME).cast("long")
    if reach is None:
        known = df.join(F.broadcast(sample), time <= F.col("s_time"))  # n rows
    else:
        width = max(reach, 1)
        asked = sample.withColumn("s_bucket", F.explode(F.array(F.floor(F.col("s_time") / width), F.floor(F.col("s_time") / width) - 1)))
        known = df.join(F.broadcast(asked), (F.floor(time / width) == F.col("s_bucket")) & (time <= F.col("s_time")) & (time >= F.col("s_time") - reach)).drop("s_bucket")
    again = feature(known.drop("s_time"), ["s_id"]).where(F.col(ID) == F.col("s_id")).select("s_id", F.col(column).cast("double").alias("past_only"))
    now = feature(df, []).select(F.col(ID).alias("s_id"), F.col(column).cast("double").alias("as_built")).join(F.broadcast(sample.select("s_id")), "s_id")
    return _compared(now.join(again, "s_id", "left"), rtol, atol)


def _compared(both: DataFrame, rtol: float, atol: float) -> DataFrame:
    a, b = F.col("as_built"), F.col("past_only")
    same = (a.isNull() & b.isNull()) | (F.isnan(a) & F.isnan(b)) | (F.abs(a - b) <= atol + rtol * F.abs(b))
    return both.agg(
        F.count(F.lit(1)).alias("sampled"),
        F.sum((~F.coalesce(same, F.lit(False))).cast("long")).alias("violations"))
