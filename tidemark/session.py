"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

SQL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def get_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "tidemark") -> SparkSession:
    """Local session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        # Small local shuffles would otherwise be merged into one or two tasks.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in SQL_DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ready(spark: SparkSession) -> SparkSession:
    """Pin the SQL settings results depend on (time zone) on a session we were handed."""
    for key, value in SQL_DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


SCRATCH_CODEC = "zstd"  # scratch tables are written once and read a few times: size counts more than speed
_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: `spark.checkpoint.dir`, or a local one in local mode only."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="tidemark-")
    return _LOCAL_DIRS[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, label: str, **measures: Column):
    """Write `df` to the shared folder and read it back.

    The written table survives lost executors and ends the plan, so iterative jobs do not grow
    their lineage and a consumer that reads the result twice does not recompute it. Aggregates given
    as `measures` are taken while the rows are written and returned beside the frame.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    if not measures:
        df.write.option("compression", SCRATCH_CODEC).parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    seen = Observation()
    df.observe(seen, *[c.alias(n) for n, c in measures.items()]).write.option("compression", SCRATCH_CODEC).parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get
