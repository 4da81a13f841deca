"""Centroid clustering with PCA-rotated filtering, exact in integers (operator 13).

A vector of `dimensions` components becomes integers floor(SCALE * x). Rounds of assignment and means
follow, all in integers; ties go to the smaller centroid number. No vector is compared with a centroid that
provably isn't nearest:

1. one pass sums components and their products; the eigenvectors of the covariance are a rotation that
   gathers the variance in the leading coordinates. It only decides how much can be skipped, never a result;
2. every vector is stored with its LEADING rotated coordinates and the norm of the others. For a
   centroid rotated alike, the squared distance of the leading coordinates plus the squared difference of
   the two norms is a lower bound of the squared distance (triangle inequality in the other coordinates);
3. the centroid with the least bound is measured exactly; only those whose bound, less a margin for
   rounding, doesn't exceed the best exact distance so far are measured as well.

A round is one pass over the stored rows with at most `k` centroids shared; tasks return sums per centroid,
which Spark adds up, and only `k` sums reach the driver. A hot cluster costs no more than another.

Defined cases: vectors that are null, of another length, or hold null or non-finite components are left
out, as are those with a component beyond LARGEST, whose squared distances leave 64 bits; null vec_ids draw
as empty text and stay null; repeated rows count each; ties of the starting hash are broken by the
components; with fewer than `k` vectors there are as many centroids; an empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

K, ROUNDS, DIMENSIONS, SCALE = 8, 10, 64, 1024
LEADING = 16  # rotated coordinates that are kept
LARGEST = 1 << 17  # components beyond it would take squared distances out of 64 bits
ROWS_AT_ONCE = 8192
STORED = "vec_id long, x array<int>, leading array<double>, rest double"


@dataclass
class Model:
    """Integer centroids with their rotated coordinates."""

    rotation: np.ndarray
    centroids: np.ndarray  # int64, one row each

    def __post_init__(self):
        self.leading, self.rest = rotated(self.centroids, self.rotation)


def rotated(x: np.ndarray, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading coordinates, and the norm of the others."""
    turned = x.astype(np.float64) @ rotation
    return turned[:, :LEADING], np.sqrt((turned[:, LEADING:] ** 2).sum(1))


def assigned(x: np.ndarray, leading: np.ndarray, rest: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row, the exact squared distance, and how many distances were measured."""
    rows, k = np.arange(len(x)), len(model.centroids)
    bound = np.empty((len(x), k))
    own = (leading ** 2).sum(1) + rest ** 2
    for j in range(k):
        bound[:, j] = ((leading - model.leading[j]) ** 2).sum(1) + (rest - model.rest[j]) ** 2
        bound[:, j] -= 1e-9 * (own + (model.leading[j] ** 2).sum() + model.rest[j] ** 2) + 1e-6
    cluster = bound.argmin(1)
    first, distance, measured = cluster.copy(), np.empty(len(x), np.int64), len(x)
    for j in range(k):
        some = rows[first == j]
        distance[some] = ((x[some] - model.centroids[j]) ** 2).sum(1)
    for j in range(k):
        some = rows[(bound[:, j] <= distance) & (first != j)]
        found = ((x[some] - model.centroids[j]) ** 2).sum(1)
        better = (found < distance[some]) | (found == distance[some]) & (j < cluster[some])
        distance[some[better]], cluster[some[better]] = found[better], j
        measured += len(some)
    return cluster, distance, measured


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, width)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def _integers(df: DataFrame, vec_id: str, embedding: str, dimensions: int) -> DataFrame:
    """(vec_id, x): the integer vectors of the rows that take part."""
    held = F.col(f"`{embedding}`").cast("array<double>")
    inside = F.forall(held, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST))
    whole = F.transform(held, lambda x: F.floor(x * SCALE).cast("int"))
    return df.where((F.size(held) == dimensions) & inside).select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), whole.alias("x"))


def _rotation(vectors: DataFrame, n: int, dimensions: int) -> np.ndarray:
    """Eigenvectors of the covariance of all rows, widest first."""
    def run(batches):
        total = np.zeros((dimensions + 1, dimensions))
        for batch in _parts(batches):
            x = _matrix(batch.column(0), dimensions, np.float64)
            total[:-1] += x.T @ x
            total[-1] += x.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(dimensions + 1), pa.int64()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "v"])

    parts = vectors.select("x").mapInArrow(run, "i long, v array<double>").select("i", F.posexplode("v").alias("j", "v"))
    out = np.zeros((dimensions + 1, dimensions))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # dimensions squared numbers
        out[r["i"], r["j"]] = r["v"]
    mean = out[-1] / n
    _, columns = np.linalg.eigh(out[:-1] / n - np.outer(mean, mean))
    return np.ascontiguousarray(columns[:, ::-1])


def _turned(vectors: DataFrame, rotation: np.ndarray) -> DataFrame:
    def run(batches):
        for batch in _parts(batches):
            leading, rest = rotated(_matrix(batch.column(1), len(rotation), np.int64), rotation)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(leading), pa.list_(pa.float64())), pa.array(rest)], names=["vec_id", "x", "leading", "rest"])

    return vectors.mapInArrow(run, STORED)


def _means(stored: DataFrame, model: Model) -> np.ndarray:
    """Floors of the exact means of each centroid's vectors; an empty centroid stays."""
    shared = stored.sparkSession.sparkContext.broadcast(model)
    k, width = model.centroids.shape

    def run(batches):
        total = np.zeros((k, width + 1), np.int64)  # components and the number of rows
        for batch in _parts(batches):
            x = _matrix(batch.column(0), width, np.int64)
            cluster, _, _ = assigned(x, _matrix(batch.column(1), min(LEADING, width), np.float64), batch.column(2).to_numpy(), shared.value)
            for j in range(k):
                some = cluster == j
                total[j, :-1] += x[some].sum(0)
                total[j, -1] += some.sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int64()), pa.array(list(total), pa.list_(pa.int64()))], names=["cluster", "v"])

    parts = stored.select("x", "leading", "rest").mapInArrow(run, "cluster long, v array<long>").select("cluster", F.posexplode("v").alias("i", "v"))
    sums: dict[int, dict[int, int]] = {}
    for r in parts.groupBy("cluster", "i").agg(F.sum(F.col("v").cast("decimal(28,0)")).alias("v")).collect():  # k * (width + 1) numbers
        sums.setdefault(r["cluster"], {})[r["i"]] = int(r["v"])
    shared.unpersist()
    out = model.centroids.copy()
    for j, own in sums.items():
        if own[width]:
            out[j] = [own[i] // own[width] for i in range(width)]
    return out


def cluster(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, measured) of every vector that takes part, and the final centroids."""
    spark = df.sparkSession
    vectors, seen = cut_lineage(_integers(df, vec_id, embedding, dimensions), "llm-integers", n=F.count(F.lit(1)))
    kind = "vec_id long, cluster int, distance long, measured long"
    if not seen["n"]:
        return spark.createDataFrame([], kind), np.zeros((0, dimensions), np.int64)
    draw = F.sha2(F.concat(F.lit("3:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    start = np.array([r["x"] for r in vectors.orderBy(draw, "x").limit(k).collect()], np.int64)
    rotation = _rotation(vectors, seen["n"], dimensions)
    stored = cut_lineage(_turned(vectors, rotation), "llm-rotated")
    model = Model(rotation, start)
    for _ in range(rounds):
        now = _means(stored, model)
        if np.array_equal(now, model.centroids):
            break  # every further round would give the same
        model = Model(rotation, now)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in _parts(batches):
            x = _matrix(batch.column(1), dimensions, np.int64)
            found, distance, n = assigned(x, _matrix(batch.column(2), min(LEADING, dimensions), np.float64), batch.column(3).to_numpy(), shared.value)
            measured = np.zeros(len(x), np.int64)
            measured[:1] = n
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.astype(np.int32)), pa.array(distance), pa.array(measured)], names=["vec_id", "cluster", "distance", "measured"])

    return cut_lineage(stored.mapInArrow(run, kind), "llm-clusters"), model.centroids


def summary(clustered: DataFrame, centroids: np.ndarray) -> DataFrame:
    """`clustered` with `cluster_inertia`, `inertia` and `centroid_sha256`; sums beyond 64 bits are null."""
    spark = clustered.sparkSession
    exact = F.sum(F.col("distance").cast("decimal(28,0)"))
    sums = {r["cluster"]: int(r["v"]) for r in clustered.groupBy("cluster").agg(exact.alias("v")).collect()}  # one row a centroid
    whole = sum(sums.values())
    fits = lambda x: x if x < 1 << 63 else None
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    rows = [(j, fits(sums.get(j, 0)), fits(whole), digest(c)) for j, c in enumerate(centroids.tolist())]
    of_cluster = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return clustered.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS) -> str:
    """The query over `embeddings`, with every distance measured."""
    kept = f"len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE) AND abs(x::DOUBLE) <= {LARGEST})) = {dimensions}"
    steps = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [floor({SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding] AS x FROM embeddings WHERE {kept})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), x) - 1 AS j, x FROM v QUALIFY j < {k})",
    ]
    for t in range(rounds + 1):
        # Squares add up exactly in doubles below 2^53.
        steps.append(f"d{t} AS (SELECT r, j, list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(v.x, c{t}.x)])::BIGINT AS d FROM v, c{t})")
        steps.append(f"a{t} AS MATERIALIZED (SELECT r, arg_min(j, d * {k} + j) AS j, min(d) AS d FROM d{t} GROUP BY r)")
        if t < rounds:
            steps.append(f"s{t} AS (SELECT a.j, i, sum(v.x[i])::BIGINT AS s, count(*) AS n FROM a{t} a JOIN v USING (r), range(1, {dimensions + 1}) t(i) GROUP BY a.j, i)")
            steps.append(f"c{t + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.x, c.x) AS x FROM c{t} c LEFT JOIN (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM s{t} GROUP BY j) m USING (j))")
    last = rounds
    return f"""WITH {', '.join(steps)}
SELECT v.vec_id, a.j::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.j))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
    sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{last} a JOIN v USING (r) JOIN c{last} c USING (j)"""
