"""Starting streams over a table folder and reading back what they wrote."""

from __future__ import annotations

import threading
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from tidemark.session import ready, scratch_path
from tidemark.sources.tables import write_if_any

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet", files_per_batch: int | None = None) -> DataFrame:
    """New event files of a folder as a stream."""
    reader = ready(spark).readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def closed_event_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet", days: int = 3) -> DataFrame:
    """The event files of a folder, and one last event `days` after the latest: it moves the watermark past every window before it.

    Its own windows stay open, so it shows in no result.
    """
    events = ready(spark).read.schema(EVENT_SCHEMA).option("pathGlobFilter", pattern).parquet(folder)
    path = scratch_path(spark, "closing-event")
    closing_event(events, days).write.parquet(path)
    return event_stream(spark, folder, pattern).unionByName(spark.readStream.schema(EVENT_SCHEMA).parquet(path))


def closing_event(events: DataFrame, days: int) -> DataFrame:
    """One event `days` after the latest; none if there are none."""
    last = events.agg((F.max("ts") + F.make_dt_interval(F.lit(days))).alias("ts")).where(F.col("ts").isNotNull())
    return last.select(F.lit(-1).cast("long").alias("event_id"), "ts", F.lit(-1).cast("long").alias("user_id"), F.lit("close").alias("event_type"), F.lit(0.0).alias("value"), F.lit('{"k": 0}').alias("props"))


def split_event_stream(spark: SparkSession, folder: str, parts: int = 4, pattern: str = "events.parquet", close_days: int = 0) -> DataFrame:
    """The events of a folder as a stream of `parts` micro-batches: files by time, the later ones written later.

    With `close_days`, a last micro-batch holds one event so much later, which moves the watermark past all others.
    """
    events = ready(spark).read.schema(EVENT_SCHEMA).option("pathGlobFilter", pattern).parquet(folder)
    day = F.unix_seconds(F.col("ts").cast("timestamp"))
    span = events.agg(F.min(day).alias("lo"), F.max(day).alias("hi")).first()
    at = F.lit(0) if span["lo"] is None else F.least(F.floor((day - span["lo"]) * parts / max(span["hi"] - span["lo"] + 1, 1)), F.lit(parts - 1))
    return stream_of([events.where(at == k) for k in range(parts)] + ([closing_event(events, close_days)] if close_days else []))


def stream_of(batches: list[DataFrame], files: int = 4) -> DataFrame:
    """A stream that brings one frame after the other, a micro-batch of `files` files each; an empty frame is left out.

    Rows are dealt by the hash of all their columns and a number of their own, so files are alike in size
    and every frame with rows gives exactly `files` of them, empty ones included.
    """
    spark = batches[0].sparkSession
    path = scratch_path(spark, "event-files")
    for k, rows in enumerate(batches):
        rows.repartition(files).write.option("maxRecordsPerFile", 0).parquet(f"{path}/part={k}")
    return spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", files).parquet(f"{path}/part=*")


def drain(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Process everything available into Parquet files and read them back.

    Progress and state live in the shared folder, so a lost executor or driver resumes from there.
    """
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    query = (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", scratch_path(spark, f"{label}-progress"))
             .outputMode(mode).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


class _Dropped(StreamingQueryListener):
    """Adds up what one query drops at a stateful operator because the watermark had passed it."""

    def __init__(self, operator: str):
        self.operator, self.rows, self.ended = operator, Counter(), set()
        self.news = threading.Condition()

    def onQueryStarted(self, event):  # noqa: N802
        pass

    def onQueryProgress(self, event):  # noqa: N802
        p = event.progress
        self.rows[str(p.runId)] += sum(s.numRowsDroppedByWatermark for s in p.stateOperators if s.operatorName == self.operator)

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryTerminated(self, event):  # noqa: N802
        with self.news:
            self.ended.add(str(event.runId))
            self.news.notify_all()

    def of(self, run: str, seconds: float = 60.0) -> int:
        """The rows of an ended run; events come in order, so its end comes after its last progress."""
        with self.news:
            if not self.news.wait_for(lambda: run in self.ended, seconds):
                raise RuntimeError("the end of the query was not reported")
            return self.rows[run]


def run_to_end(stream: DataFrame, path: str, progress: str, operator: str) -> int:
    """Append everything available to Parquet files at `path`, from where `progress` stopped.

    Returns how many rows Spark dropped as late at the stateful operator of that name.
    """
    spark, dropped = stream.sparkSession, _Dropped(operator)
    spark.streams.addListener(dropped)
    try:
        query = (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", progress)
                 .outputMode("append").trigger(availableNow=True).start())
        query.awaitTermination()
        return dropped.of(str(query.runId))
    finally:
        spark.streams.removeListener(dropped)


def drain_batches(stream: DataFrame, progress: str, step) -> None:
    """Hand every available micro-batch to `step(batch, epoch)`; `progress` is the folder to resume from."""
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", progress).trigger(availableNow=True).start()
    query.awaitTermination()


def per_batch(fn: Callable[[DataFrame], DataFrame], store_path: str) -> Callable[[DataFrame, int], None]:
    """A step that writes `fn(batch)` as JSON lines under the batch's number; empty results write nothing."""
    def step(batch: DataFrame, epoch: int) -> None:
        write_if_any(fn(batch), lambda rows: rows.write.mode("overwrite").json(f"{store_path}/epoch={epoch}"))

    return step
