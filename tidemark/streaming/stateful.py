"""Point-in-time features over a stream, on Spark's own state.

Rows pass through three stateful operators of one query, all in append mode:

1. `dropDuplicatesWithinWatermark` takes each transaction once. Rows behind the watermark are dropped here and
   counted by Spark; `run` adds up the counts of the query's progress reports. A micro-batch drops by the
   watermark that the one before it handed seconds on by, so a row is either dropped or meets its second.
2. A watermarked aggregation turns rows into instants, one per (entity value, second), with the transactions of
   that second. An instant is handed on when the watermark has passed it, so nothing can join it any more,
   and a hot entity arrives as its seconds and not as its rows.
3. `transformWithStateInPandas` meets the instants in order of time. Entity values share a fixed number of hash buckets:
   a call and its state serve all values of a bucket, told apart by their full names, so calls do not grow with the
   number of values. For velocity the key is (bucket, time block): an instant asks in its own block and is remembered
   there and in the next one, the state grows by one chunk a batch, and a timer deletes it once the watermark has
   passed the block. For decayed sums the key is the bucket and the state a few numbers per value, whatever its past.

Out of it come long rows (transaction, entity, features); `wide` pivots what the sink holds. Progress and state live in the
shared folder: a lost executor or driver resumes from there, and a repeated batch replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark import config
from tidemark.operators import velocity as V
from tidemark.session import scratch_path
from tidemark.streaming.runner import run_to_end

ID, TIME, LABEL = V.ID, V.TIME, V.LABEL
AT = "_at"  # the transaction's second as a timestamp, for the watermark
NONE = "-"  # the entity of a transaction without any entity value
BUCKETS = 256  # of entity values: a state is kept and asked for many of them at once
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def instants(stream: DataFrame, entities: list[str], delay: int) -> DataFrame:
    """(entity, value, _at, ts, n, f, ids) of the rows that are on time, each second once the watermark has passed it."""
    kept = [ID, TIME, *([LABEL] if LABEL in stream.columns else [])]
    label = F.coalesce(F.col(LABEL).cast("double"), F.lit(0.0)) if LABEL in kept else F.lit(0.0)
    # Seconds count from the anchor; a watermark starts at 1970 and takes rows up to it as late.
    anchor = F.unix_seconds(F.lit(config.ANCHOR).cast("timestamp"))
    timed = stream.select(*kept, *entities, F.timestamp_seconds(anchor + F.col(TIME)).alias(AT))
    once = timed.withWatermark(AT, f"{delay} seconds").dropDuplicatesWithinWatermark([ID])
    pairs: list[Column] = [F.struct(F.lit(e).alias("entity"), F.col(e).cast("string").alias("value")) for e in entities]
    alone = F.struct(F.lit(NONE).alias("entity"), F.when(F.coalesce(*[F.col(e).cast("string") for e in entities]).isNull(), F.col(ID).cast("string")).alias("value"))
    long = once.select(ID, AT, label.alias("f"), F.explode(F.array(*pairs, alone)).alias("p")).where(F.col("p.value").isNotNull())
    return long.groupBy(F.col("p.entity").alias("entity"), F.col("p.value").alias("value"), AT).agg(
        F.count(F.lit(1)).alias("n"), F.sum("f").alias("f"), F.collect_list(ID).alias("ids")).withColumn("ts", F.unix_seconds(AT))


def _packed(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def bucket() -> Column:
    return F.pmod(F.xxhash64("entity", "value"), F.lit(BUCKETS)).alias("bucket")


class _Window(StatefulProcessor):
    """Rows in the windows before each instant of a block, for all entity values of a bucket at once."""

    def __init__(self, lengths: list[int]):
        self.lengths = lengths

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getListState("chunks", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new, block, blk = pd.concat(list(rows), ignore_index=True), max(self.lengths), int(key[1])
        held = ["entity", "value", "ts", "n"]
        known = [_unpacked(chunk[0]).to_pandas() for chunk in self.chunks.get()]
        if not known:
            # Nothing asks in this block once the watermark is past its end.
            self.handle.registerTimer((blk + 1) * block * 1000)
        self.chunks.appendValue((_packed(pa.Table.from_pandas(new[held], preserve_index=False)),))
        asks = new["ids"].notna().to_numpy()
        if not asks.any():
            return
        every = pd.concat([*known, new[held]], ignore_index=True)
        entity, ts = every.groupby(["entity", "value"], sort=False).ngroup().to_numpy(np.int64), every["ts"].to_numpy(np.int64)
        # One line of time per entity value, from the start of the block before.
        at = entity * (2 * block + 1) + ts - (blk - 1) * block
        order = np.argsort(at, kind="stable")
        line, before = at[order], np.concatenate([[0], np.cumsum(every["n"].to_numpy(np.int64)[order])])
        asked = at[len(every) - len(new):][asks]
        upto = before[np.searchsorted(line, asked)]
        found = new.loc[asks, ["entity", "value", "ids"]].reset_index(drop=True)
        for i, length in enumerate(self.lengths):
            found[f"n{i}"] = upto - before[np.searchsorted(line, asked - length)]
        yield found

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.chunks.clear()
        return iter(())

    def close(self) -> None:
        pass


class _Decay(StatefulProcessor):
    """Decayed counts and labels before each instant; the state is what they were right after the last one of each entity value of a bucket."""

    def __init__(self, lambdas: list[float]):
        self.lambdas = lambdas

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("sums", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True).sort_values(["entity", "value", "ts"], ignore_index=True)
        sums = {}
        if self.state.exists():
            sums = {(r["entity"], r["value"]): (r["at"], r["v"], r["f"]) for r in _unpacked(self.state.get()[0]).to_pylist()}
        names, ts = list(zip(new["entity"], new["value"])), new["ts"].to_numpy(np.int64)
        blank = [0.0] * len(self.lambdas)
        first = [k == 0 or names[k] != names[k - 1] for k in range(len(new))]
        last = np.concatenate([[0], ts[:-1]])
        for k in (k for k, opens in enumerate(first) if opens):
            last[k] = sums[names[k]][0] if names[k] in sums else 0
        decays = np.exp(np.outer(ts - last, np.array(self.lambdas) / -3600.0)).tolist()
        vs, fs = [], []
        for name, opens, t, n, label, gone in zip(names, first, ts.tolist(), new["n"].tolist(), new["f"].tolist(), decays):
            if opens:
                _, v, f = sums.get(name, (0, blank, blank))
            v, f = [x * g for x, g in zip(v, gone)], [x * g for x, g in zip(f, gone)]
            vs.append(v)
            fs.append(f)
            v, f = [x + n for x in v], [x + label for x in f]
            sums[name] = (t, v, f)
        kind = pa.schema([("entity", pa.string()), ("value", pa.string()), ("at", pa.int64()), ("v", pa.list_(pa.float64())), ("f", pa.list_(pa.float64()))])
        self.state.update((_packed(pa.Table.from_pylist([{"entity": e, "value": x, "at": t, "v": v, "f": f} for (e, x), (t, v, f) in sums.items()], kind)),))
        yield new[["entity", "value", "ids"]].assign(v=vs, f=fs)

    def close(self) -> None:
        pass


class FeatureStream:
    """What both jobs share: one query from rows to long features, its sink and its late rows."""

    label = ""

    def __init__(self, spark: SparkSession, entities: list[str] | None = None, delay: int = 0, root: str | None = None):
        self.spark, self.entities, self.delay = spark, entities or config.VELOCITY_ENTITIES, delay
        self.root = root or scratch_path(spark, self.label)
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)

    def features(self, inst: DataFrame) -> DataFrame:
        raise NotImplementedError

    def wide(self, long: DataFrame) -> DataFrame:
        raise NotImplementedError

    def run(self, stream: DataFrame) -> int:
        """Process what is available, from where the last run stopped; the number of late rows among it."""
        made = self.features(instants(stream, self.entities, self.delay))
        long = made.select(F.explode("ids").alias(ID), *[c for c in made.columns if c != "ids"])
        self.schema = long.schema
        return run_to_end(long, f"{self.root}/features", f"{self.root}/progress", "dedupeWithinWatermark")

    def output(self) -> DataFrame:
        """One row per transaction that the watermark has passed."""
        return self.wide(self.spark.read.schema(self.schema).parquet(f"{self.root}/features"))


class VelocityStream(FeatureStream):
    """`{entity}_velocity_{window}` for arriving rows."""

    label = "velocity-stream"

    def __init__(self, spark: SparkSession, entities: list[str] | None = None, windows: dict[str, int] | None = None, delay: int = 0, root: str | None = None):
        super().__init__(spark, entities, delay, root)
        self.windows = windows or config.VELOCITY_WINDOWS

    def features(self, inst: DataFrame) -> DataFrame:
        block = max(self.windows.values())
        # In the next block an instant only counts: it has no transactions that ask.
        own = F.floor(F.col("ts") / block)
        places = F.array(F.struct(own.alias("blk"), F.col("ids").alias("ids")), F.struct((own + 1).alias("blk"), F.lit(None).cast("array<long>").alias("ids")))
        dealt = inst.select(bucket(), "entity", "value", "ts", "n", F.explode(places).alias("p")).select("bucket", "entity", "value", "p.blk", "ts", "n", "p.ids")
        kind = "entity string, value string, ids array<long>, " + ", ".join(f"n{i} long" for i in range(len(self.windows)))
        return dealt.groupBy("bucket", "blk").transformWithStateInPandas(_Window(list(self.windows.values())), kind, "append", "EventTime")

    def wide(self, long: DataFrame) -> DataFrame:
        aggs = [F.coalesce(F.max(F.when(F.col("entity") == e, F.col(f"n{i}"))), F.lit(0)).alias(f"{e}_velocity_{w}") for e in self.entities for i, w in enumerate(self.windows)]
        return long.groupBy(ID).agg(*aggs)


class DecayStream(FeatureStream):
    """Decayed counts and labels for arriving rows."""

    label = "decay-stream"

    def __init__(self, spark: SparkSession, entities: list[str] | None = None, lambdas: list[float] | None = None, delay: int = 0, root: str | None = None):
        super().__init__(spark, entities, delay, root)
        self.lambdas = V.checked_lambdas(lambdas or config.EWM_LAMBDAS)

    def features(self, inst: DataFrame) -> DataFrame:
        kind = "entity string, value string, ids array<long>, v array<double>, f array<double>"
        return inst.select(bucket(), "entity", "value", "ts", "n", "f", "ids").groupBy("bucket").transformWithStateInPandas(_Decay(self.lambdas), kind, "append", "EventTime")

    def wide(self, long: DataFrame) -> DataFrame:
        aggs = [F.coalesce(F.max(F.when(F.col("entity") == e, F.col(w)[i])), F.lit(0.0)).alias(V.ewm_name(e, w, lam))
                for e in self.entities for i, lam in enumerate(self.lambdas) for w in ("v", "f")]
        return long.groupBy(ID).agg(*aggs)
