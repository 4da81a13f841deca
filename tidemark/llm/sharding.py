"""Resharding by minimum-cost flow (operator 8).

Rows lie in old shards; new shards get capacities in bytes. A flow from old shards to new ones, where a
byte that stays in its place costs nothing and any other costs one, moves the fewest bytes. The graph has
a node per old and new shard, not per row, and is solved on the driver by successive shortest paths.

Each old shard is read as one sequence of rows. A row's place in it is its offset inside its task's run of
the shard plus the totals of the runs before, so a shard of any size is spread over tasks. The flow cuts
the sequence into at most (old + new) transfers, the staying one first; a row goes where its first byte falls, so
new shards differ from their capacities by at most a row at each cut. Then the affected files are
written: a new shard that neither gains nor loses a row keeps its old files.

Defined cases: null text has no bytes, and its row the size 1 like an empty text's; null or repeated ids are
carried as they are; extra columns are carried in a struct; an empty table gives no rows and no files.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import small_side
from tidemark.session import cut_lineage

SHARDS = 16
OLD_SHARDS = 64  # files of a table are taken together into at most that many old shards


def cheapest_transfers(sizes: list[int], capacities: list[int]) -> dict[tuple[int, int], int]:
    """Bytes from each old to each new shard: all of them, within the capacities, moving as few as possible.

    Successive shortest paths with potentials over source, old shards, new shards, sink. Old shard i and
    new shard i are the same place.
    """
    old, new = len(sizes), len(capacities)
    if sum(sizes) > sum(capacities):
        raise ValueError("the new shards are too small")
    s, t, n = old + new, old + new + 1, old + new + 2
    graph: list[list[int]] = [[] for _ in range(n)]
    to, room, cost = [], [], []

    def edge(a: int, b: int, most: int, price: int) -> None:
        for x, y, r, c in ((a, b, most, price), (b, a, 0, -price)):
            graph[x].append(len(to))
            to.append(y), room.append(r), cost.append(c)

    for i, size in enumerate(sizes):
        edge(s, i, size, 0)
    between = {}
    for i, size in enumerate(sizes):
        for j in range(new):
            between[i, j] = len(to)
            edge(i, old + j, size, int(i != j))
    for j, capacity in enumerate(capacities):
        edge(old + j, t, capacity, 0)
    high = [0] * n
    while True:
        far, via, heap = [float("inf")] * n, [-1] * n, [(0, s)]
        far[s] = 0
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for e in graph[x]:
                if room[e] and (nd := d + cost[e] + high[x] - high[to[e]]) < far[to[e]]:
                    far[to[e]], via[to[e]] = nd, e
                    heapq.heappush(heap, (nd, to[e]))
        if via[t] < 0:
            break
        high = [h + (f if f < float("inf") else 0) for h, f in zip(high, far)]
        push, x = sum(sizes), t
        while x != s:
            push, x = min(push, room[via[x]]), to[via[x] ^ 1]
        x = t
        while x != s:
            room[via[x]] -= push
            room[via[x] ^ 1] += push
            x = to[via[x] ^ 1]
    return {k: moved for k, e in between.items() if (moved := room[e ^ 1])}


def even_capacities(total: int, shards: int) -> list[int]:
    """Equal capacities that just hold the total."""
    return [total // shards + (k < total % shards) for k in range(shards)]


def old_shards_of_files(df: DataFrame, most: int = OLD_SHARDS) -> Column:
    """The old shard of a row read from files: its file's place among the table's files, in at most `most` runs of files."""
    files = sorted({f.rsplit("/", 1)[-1] for f in df.inputFiles()})
    if not files:
        return F.lit(0)
    runs = min(len(files), most)
    firsts = [files[k * len(files) // runs] for k in range(runs)]
    name = F.col("_metadata.file_name")
    shard = F.lit(0)
    for k, first in enumerate(firsts[1:], 1):
        shard = F.when(name >= first, k).otherwise(shard)
    return shard


def placed(df: DataFrame, old: Column, text: str = "text", shards: int = SHARDS, capacities: list[int] | None = None) -> DataFrame:
    """Columns of `df` in the struct `row`, `size`, `old`, `shard` and `slot`: where every row goes."""
    spark = df.sparkSession
    size = F.coalesce(F.octet_length(F.col(f"`{text}`").cast("string")), F.lit(0)).cast("long") + 1
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), size.alias("size"), old.cast("int").alias("old"))
    kind = rows.schema["row"].dataType.simpleString()

    def number(batches):
        part, bytes_, count = TaskContext.get().partitionId(), {}, {}
        for batch in batches:
            own, sizes = batch.column(2).to_numpy(), batch.column(1).to_numpy()
            start, place = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
            for k in np.unique(own).tolist():
                at = np.flatnonzero(own == k)
                ends = np.cumsum(sizes[at])
                start[at] = bytes_.get(k, 0) + ends - sizes[at]
                place[at] = count.get(k, 0) + np.arange(len(at))
                bytes_[k], count[k] = bytes_.get(k, 0) + int(ends[-1]), count.get(k, 0) + len(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(own), part, np.int32)), pa.array(start), pa.array(place)], names=["row", "size", "old", "part", "start", "place"])

    stored = cut_lineage(rows.mapInArrow(number, f"row {kind}, size long, old int, part int, start long, place long"), "llm-numbered")
    runs, seen = cut_lineage(stored.groupBy("old", "part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "llm-runs", n=F.count(F.lit(1)))
    ahead = Window.partitionBy("old").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = runs.select("old", "part", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_before") for c in ("bytes", "n")])
    totals = {r["old"]: r["b"] for r in runs.groupBy("old").agg(F.sum("bytes").alias("b")).collect()}  # one row per old shard
    sizes = [totals.get(k, 0) for k in range(max(totals, default=-1) + 1)]
    flow = cheapest_transfers(sizes, capacities or even_capacities(sum(sizes), shards)) if sizes else {}
    cuts = []  # (old shard, first byte, new shard): its own place first, then the others in order
    for i in range(len(sizes)):
        at = 0
        for j in sorted((j for a, j in flow if a == i), key=lambda j: (j != i, j)):
            cuts.append((i, at, j))
            at += flow[i, j]
    moves = spark.createDataFrame(cuts, "old int, first long, shard int").groupBy("old").agg(F.sort_array(F.collect_list(F.struct("first", "shard"))).alias("moves"))
    whole = stored.join(F.broadcast(moves), "old").join(small_side(before, seen["n"]), ["old", "part"])  # one row per old shard, of at most as many moves as new shards
    first = F.col("start") + F.col("bytes_before")
    target = F.element_at(F.filter("moves", lambda m: m["first"] <= first), -1)["shard"]
    aimed = whole.select("row", "size", "old", (F.col("place") + F.col("n_before")).alias("place"), target.alias("shard"))
    # A transfer is a run of rows of its old shard: slots follow from the counts of the transfers into a shard.
    pieces = aimed.groupBy("shard", "old").agg(F.min("place").alias("least"), F.count(F.lit(1)).alias("n"))
    into = Window.partitionBy("shard").orderBy((F.col("old") != F.col("shard")), "old").rowsBetween(Window.unboundedPreceding, -1)
    base = pieces.select("shard", "old", (F.coalesce(F.sum("n").over(into), F.lit(0)) - F.col("least")).alias("base"))
    return aimed.join(F.broadcast(base), ["shard", "old"]).select("row", "size", "old", "shard", (F.col("place") + F.col("base")).alias("slot"))  # at most old * new rows


def affected(rows: DataFrame) -> list[int]:
    """The shards that gain or lose a row; all others keep their files."""
    found = rows.where("old != shard").select(F.explode(F.array("old", "shard")).alias("k")).distinct().collect()  # at most old + new shards
    return sorted(r["k"] for r in found)


def reshard(df: DataFrame, old: Column, path: str, text: str = "text", shards: int = SHARDS, capacities: list[int] | None = None) -> DataFrame:
    """Rewrite the affected shards as folders `shard=k` of Parquet files under `path`; returns the resharded table.

    Its columns are `row`, `size`, `old`, `slot` and `shard`. Rows of shards that nothing enters or leaves
    are read from where they are.
    """
    rows = placed(df, old, text, shards, capacities)
    changed = affected(rows)
    rows.where(F.col("shard").isin(changed)).write.partitionBy("shard").parquet(path)
    written = df.sparkSession.read.schema(rows.schema).parquet(path)
    return written if len(changed) >= max(shards, len(capacities or [])) else written.unionByName(rows.where(~F.col("shard").isin(changed)))
