"""What the operators of this subpackage share: reading, folds, row packing, numbered rows, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

ROW = "row"  # the struct that carries the caller's columns, so that no name of ours can clash with theirs
BROADCAST_ROWS = 1_000_000  # narrow tables of ids up to this many rows may be broadcast, larger ones are shuffled


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, mod k; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % k


def packed(df: DataFrame, *columns: Column) -> DataFrame:
    """`columns`, and all columns of `df` in one struct named `row`."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW), *columns)


def unpacked(df: DataFrame, names: list[str]) -> list[Column]:
    return [F.col(f"{ROW}.`{c}`").alias(c) for c in names]


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint for a narrow table of at most BROADCAST_ROWS rows; beyond that the join shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def components(spark: SparkSession, links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches, from links (a, b) of longs.

    Alternating large-star and small-star steps turn the links into stars. Every step is written, so a
    lost executor costs one step at most, and the joins read written tables: the links of a hot node
    can be split between tasks. Nodes without a link don't appear.
    """
    def stored(frame: DataFrame):
        frame, seen = cut_lineage(frame, "llm-stars", n=F.count(F.lit(1)), x=F.bit_xor(F.xxhash64("u", "v")))
        return frame, (seen["n"], seen["x"])

    def least(pairs: DataFrame) -> DataFrame:
        """The smallest node that each u is linked to."""
        found, seen = cut_lineage(pairs.groupBy("u").agg(F.min("v").alias("m")), "llm-least", n=F.count(F.lit(1)))
        return small_side(found, seen["n"])

    ordered = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    pairs, seen = stored(ordered.distinct())
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = both.join(least(both), "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = cut_lineage(up.where("u != v").distinct(), "llm-large")
        low = least(large)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        pairs, now = stored(small.where("u != v").distinct())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
