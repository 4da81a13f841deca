"""The caller's own fold over an entity's strict past, for states that can't be merged from parts.

A fold is an initial state, an update by one row and what it shows of a state. A row sees what the state shows
after all rows of its entity with an earlier time; rows tied on a second don't see each other. Such a state has
to pass through an entity's rows in order, but not in one task: rows get their position in their entity from a
distributed sort, are cut into rounds of at most `block_rows` of an entity each, and every round hands the
state of its entities on to the next. A task holds one round of one entity at most, however many rows the entity
has; every round is written, so a lost executor costs one round.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.functions.ordered import cumulative
from tidemark.operators.velocity import ID, TIME, require_columns
from tidemark.session import cut_lineage, scratch_path

BLOCK_ROWS = 200_000  # rows of one entity that a task works on at once


@dataclass(frozen=True)
class Fold:
    """`initial()` gives a state, `update(state, row)` the next one (row: a dict), `emit(state)` a tuple of values."""

    initial: Callable[[], Any]
    update: Callable[[Any, dict], Any]
    emit: Callable[[Any], tuple]


def past_fold(df: DataFrame, entity: str, fold: Fold, payload: list[str], out: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per row of `df`: its id and the columns `out` (as DDL), what the fold shows of its entity's strict past.

    `update` gets the columns `payload`, in order of (time, id). A row without the entity has no past.
    """
    require_columns(df, [ID, TIME, entity, *payload])
    spark = df.sparkSession
    kind = spark.createDataFrame([], out).schema
    names = kind.fieldNames()
    rows = df.where(F.col(entity).isNotNull()).select(
        F.col(entity).cast("string").alias("value"), F.struct(F.col(TIME).cast("long").alias("ts"), F.col(ID).alias("id")).alias("at"), F.struct(*payload).alias("row"))
    held = rows.groupBy("value", "at").agg(F.collect_list("row").alias("rows"), F.count(F.lit(1)).alias("n"))  # one row unless ids repeat
    placed = cumulative(held, "at", ["n"], ["value"]).select("value", "at", "rows", F.floor(F.col("before_n") / block_rows).cast("int").alias("round"))
    seen, root = Observation(), scratch_path(spark, "fold")
    placed.observe(seen, F.max("round").alias("last")).write.partitionBy("round").parquet(f"{root}/rows")
    id_kind = dict(df.dtypes)[ID]
    made_kind = f"value string, id {id_kind}, made struct<{', '.join(f'`{f.name}`: {f.dataType.simpleString()}' for f in kind)}>, state binary"
    initial = cloudpickle.dumps(fold)

    def run(rows: pa.Table, before: pa.Table) -> pa.Table:
        own = cloudpickle.loads(initial)
        known = [s for s in before.column("state").to_pylist() if s is not None]
        state, last, shown = cloudpickle.loads(known[0]) if known else (own.initial(), None, None)
        ids, made = [], []
        for r in sorted(rows.select(["at", "rows"]).to_pylist(), key=lambda r: (r["at"]["ts"], r["at"]["id"])):
            if r["at"]["ts"] != last:
                last, shown = r["at"]["ts"], dict(zip(names, own.emit(state)))
            for row in r["rows"]:
                ids.append(r["at"]["id"])
                made.append(shown)
                state = own.update(state, row)
        value = rows.column("value")[0].as_py() if rows.num_rows else None
        kept = [cloudpickle.dumps((state, last, shown))] if rows.num_rows else []
        schema = pa.schema([("value", pa.string()), ("id", rows.schema.field("at").type.field("id").type), ("made", made_type), ("state", pa.binary())])
        return pa.table({"value": [value] * (len(ids) + len(kept)), "id": ids + [None] * len(kept), "made": made + [None] * len(kept), "state": [None] * len(ids) + kept}, schema=schema)

    from pyspark.sql.pandas.types import to_arrow_type

    made_type = to_arrow_type(kind)
    layout = spark.read.parquet(f"{root}/rows").schema if seen.get["last"] is not None else None
    found = []
    state = spark.createDataFrame([], "value string, state binary")
    for k in range(0 if layout is None else seen.get["last"] + 1):
        part = spark.read.schema(layout).parquet(f"{root}/rows").where(F.col("round") == k).select("value", "at", "rows")
        # Entities that ended in an earlier round go no further.
        going = state.join(part.select("value").distinct(), "value", "left_semi")
        made = cut_lineage(part.groupBy("value").cogroup(going.groupBy("value")).applyInArrow(run, made_kind), "fold-round")
        state = made.where(F.col("state").isNotNull()).select("value", "state")
        found.append(made.where(F.col("state").isNull()).select(F.col("id").alias(ID), *[F.col(f"made.`{c}`").alias(c) for c in names]))
    nothing = dict(zip(names, fold.emit(fold.initial())))
    alone = df.where(F.col(entity).isNull()).select(ID, *[F.lit(nothing[f.name]).cast(f.dataType).alias(f.name) for f in kind])
    for f in found:
        alone = alone.unionByName(f)
    return alone
