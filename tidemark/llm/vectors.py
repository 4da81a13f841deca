"""Near-duplicate vectors by an exact metric range join (operator 2).

Vectors are scaled to length 1, where a cosine of at least c is a Euclidean distance of at most
r = sqrt(2 - 2 c). Only vectors of equal label and dimension are compared. In every label with many
vectors some are taken as pivots, in proportion to its size and at most MAX_PIVOTS altogether, so what is
sent to executors has a fixed bound.

1. A vector's home is the cell of its nearest pivot. By the triangle inequality a vector u within r of a
   vector at home in cell i has d(u, i) <= d(u, home) + 2 r; and since such a vector lies between the
   least and the greatest distance of the cell, also low(i) - r <= d(u, i) <= high(i) + r. u is copied
   to the cells that meet both. Every neighbour of a home vector is then a member of its cell.
2. Cells join independently. Home vectors of a large cell are dealt into blocks of about BLOCK, and so
   are its members; each pair of a home block and a member block is a task's group of bounded size. A
   task compares them in double precision and returns, per home vector, the number of vectors linked to
   it and at most one link per component it sees: counts and spanning links, never pairs.
3. Equal vectors are collapsed first: a representative stands for its copies, which are counted and
   labelled by multiplicity.
4. Connected components of the spanning links give the classes.

Defined cases: a null label links with nothing, nor do vectors that are null, empty, zero or hold null or
non-finite numbers; they are components of their own. Repeated rows of one id are copies of one vector
and link with each other; a null id comes last when components are named. Extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components
from tidemark.session import cut_lineage

COSINE = 0.93
PER_PIVOT = 1024  # vectors of a label for one pivot: if every vector had to be copied to every cell, that would cost no more than dealing the label into blocks
LABEL_PIVOTS, MAX_PIVOTS = 256, 8192
BLOCK = 2048  # vectors of a home or member block, in the mean
SLACK = 1e-7  # covers rounding of distances; candidates are compared by their cosine


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def cleaned(df: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(uid, id, label, v): v is the vector as doubles of length 1, null where it links with nothing."""
    raw = df.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{embedding}`").cast("array<double>").alias("v"))

    def scale(batches):
        for batch in batches:
            out, rows = [], batch.column(3)
            for x in rows:
                v = None if x.values is None else np.array(x.values.to_numpy(zero_copy_only=False), np.float64)
                if v is not None and len(v) and np.isfinite(v).all() and (top := np.abs(v).max()) > 0:
                    v = v / top
                    out.append(v / np.sqrt((v * v).sum()))
                else:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.list_(pa.float64()))], names=["uid", "id", "label", "v"])

    return raw.mapInArrow(scale, "uid long, id long, label string, v array<double>")


def _pivots(reps: DataFrame) -> dict[tuple[str, int], np.ndarray]:
    """Pivots per (label, dimension): those with the least hashes among about twice as many drawn."""
    sizes = reps.groupBy("label", "d").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") >= 2 * PER_PIVOT)
    total = sizes.agg(F.sum("held")).first()[0] or 0
    if not total:
        return {}
    want = F.least(F.lit(LABEL_PIVOTS), F.floor(F.col("held") / PER_PIVOT), F.floor(F.col("held") * MAX_PIVOTS / total)).cast("int")
    sizes = sizes.withColumn("want", want).where("want >= 2")
    drawn = reps.join(sizes, ["label", "d"]).withColumn("h", F.xxhash64("rep", "v")).where(F.pmod(F.col("h"), F.lit(1 << 30)) < F.col("want") / F.col("held") * 2 * (1 << 30))
    found: dict[tuple[str, int], list] = {}
    for r in drawn.orderBy("h").limit(2 * MAX_PIVOTS).select("label", "d", "want", "v").collect():  # the number of pivots is the bound
        own = found.setdefault((r["label"], r["d"]), [])
        if len(own) < r["want"]:
            own.append(r["v"])
    return {k: np.array(v) for k, v in found.items()}


def _distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (v @ pivots.T), 0))


def links(reps: DataFrame, cosine: float = COSINE) -> tuple[DataFrame, DataFrame]:
    """(rep, linked) with the copies linked to each representative, itself not counted, and spanning links (a, b); `reps` has rep, label, d, v, n."""
    spark, r = reps.sparkSession, float(np.sqrt(max(2 - 2 * cosine, 0))) + SLACK
    shared = spark.sparkContext.broadcast(_pivots(reps))

    def home(batches):
        for batch in batches:
            label, d = batch.column(1).to_pylist(), batch.column(2).to_numpy()
            cell, dist = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for key, rows in _by_key(label, d).items():
                if (p := shared.value.get(key)) is not None:
                    far = _distances(_matrix(batch.column(3).take(pa.array(rows)), key[1]), p)
                    cell[rows], dist[rows] = far.argmin(1), far.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(dist)], names=["rep", "label", "d", "v", "n", "cell", "dist"])

    homes = cut_lineage(reps.select("rep", "label", "d", "v", "n").mapInArrow(home, "rep long, label string, d int, v array<double>, n long, cell int, dist double"), "llm-homes")
    shells = homes.groupBy("label", "d", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("low"), F.max("dist").alias("high"))
    # Of labels with pivots only: at most MAX_PIVOTS rows, of which every cell holds at least its pivot.
    with_pivots = spark.createDataFrame([(k[0], k[1]) for k in shared.value], "label string, d int") if shared.value else None
    known = {}
    if with_pivots is not None:
        for s in shells.join(F.broadcast(with_pivots), ["label", "d"]).collect():
            known.setdefault((s["label"], s["d"]), {})[s["cell"]] = (s["low"], s["high"])
    bounds = spark.sparkContext.broadcast(known)

    def spread(batches):
        for batch in batches:
            label, d, cell = batch.column(1).to_pylist(), batch.column(2).to_numpy(), batch.column(5).to_numpy()
            rows, to = [np.arange(batch.num_rows)], [cell]
            for key, own in _by_key(label, d).items():
                if (p := shared.value.get(key)) is not None:
                    far = _distances(_matrix(batch.column(3).take(pa.array(own)), key[1]), p)
                    low, high = (np.array([bounds.value[key].get(c, (np.inf, -np.inf))[k] for c in range(len(p))]) for k in (0, 1))
                    near = (far <= far.min(1)[:, None] + 2 * r) & (far >= low - r) & (far <= high + r)
                    near[np.arange(len(own)), cell[own]] = False
                    i, c = np.nonzero(near)
                    rows.append(own[i])
                    to.append(c.astype(np.int32))
            rows, to = np.concatenate(rows), np.concatenate(to).astype(np.int32)
            out = batch.select([0, 1, 2, 3, 4]).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(to), pa.array(to == cell[rows])], names=["rep", "label", "d", "v", "n", "cell", "home"])

    members = homes.mapInArrow(spread, "rep long, label string, d int, v array<double>, n long, cell int, home boolean")
    sizes = members.groupBy("label", "d", "cell").agg(F.count(F.when(F.col("home"), 1)).alias("homes"), F.count(F.lit(1)).alias("all")).where("homes > 0")
    cut = lambda c: F.greatest(F.ceil(F.col(c) / BLOCK), F.lit(1)).cast("int")
    dealt = members.join(sizes, ["label", "d", "cell"]).withColumns({"hs": cut("homes"), "ms": cut("all")})
    slot = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    side = lambda home, i, j: dealt.where(F.lit(True) if not home else F.col("home")).select("rep", "label", "d", "cell", "v", "n", F.lit(home).alias("home"), i.alias("i"), j.alias("j"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    met = side(True, slot("hs"), every("ms")).unionByName(side(False, every("hs"), slot("ms")))

    def compare(table: pa.Table) -> pa.Table:
        home = table.column("home").to_numpy()
        rep, n = table.column("rep").to_numpy(), table.column("n").to_numpy()
        v = _matrix(table.column("v").combine_chunks(), table.column("d")[0].as_py())
        a, b = np.flatnonzero(home), np.flatnonzero(~home)
        near = (v[a] @ v[b].T >= cosine) & (rep[a][:, None] != rep[b][None, :])
        linked = near @ n[b]
        start, end = _spanning(near, rep[a], rep[b])
        m = len(a)
        return pa.table({"rep": np.concatenate([rep[a], start]), "linked": np.concatenate([linked, np.zeros(len(start), np.int64)]), "other": pa.array(np.concatenate([np.zeros(m, np.int64), end]), pa.int64(), mask=np.arange(m + len(end)) < m)})

    compared = cut_lineage(met.groupBy("label", "d", "cell", "i", "j").applyInArrow(compare, "rep long, linked long, other long"), "llm-compared")
    counts = compared.where("other IS NULL").groupBy("rep").agg(F.sum("linked").alias("linked"))
    return counts, compared.where("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b"))


def _by_key(label: list, d: np.ndarray) -> dict[tuple, np.ndarray]:
    held: dict[tuple, list[int]] = {}
    for k, key in enumerate(zip(label, d.tolist())):
        held.setdefault(key, []).append(k)
    return {k: np.array(v) for k, v in held.items()}


def _spanning(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (left, right) that connect what the matrix connects: each row to its first column, each column to its first row, as needed."""
    rows = np.flatnonzero(near.any(1))
    cols = np.flatnonzero(near.any(0))
    first = near[rows].argmax(1)
    start, end = [left[rows]], [right[first]]
    parent = {int(x): int(x) for x in np.unique(np.concatenate([left, right]))}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(left[rows].tolist(), right[first].tolist()):
        parent[find(x)] = find(y)
    more = []
    for c in cols.tolist():
        mine = int(right[c])
        roots = {}
        for k in np.flatnonzero(near[:, c]).tolist():
            roots.setdefault(find(int(left[k])), k)
        for root, k in roots.items():
            if find(mine) != find(root):
                parent[find(root)] = find(mine)
                more.append((int(left[k]), mine))
    if more:
        start.append(np.array([x for x, _ in more], np.int64))
        end.append(np.array([y for _, y in more], np.int64))
    return np.concatenate(start).astype(np.int64), np.concatenate(end).astype(np.int64)


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of `df`."""
    spark = df.sparkSession
    rows = cut_lineage(cleaned(df, vec_id, embedding, label), "llm-vectors")
    usable = rows.where("label IS NOT NULL AND v IS NOT NULL").withColumns({"d": F.size("v"), "key": F.sha2(F.concat_ws(",", F.transform("v", lambda x: x.cast("string"))), 256)})
    classes = cut_lineage(usable.groupBy("label", "d", "key").agg(F.min("uid").alias("rep"), F.count(F.lit(1)).alias("n")), "llm-vector-classes")
    reps = classes.join(usable.select(F.col("uid").alias("rep"), "v"), "rep")
    counts, found = links(reps, cosine)
    roots = components(spark, found)
    of_class = classes.join(counts, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left").select(
        "label", "d", "key", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    alone = rows.where("label IS NULL OR v IS NULL").select("uid", "id", F.lit(0).cast("long").alias("n_links"), F.col("uid").alias("root"))
    every = cut_lineage(usable.select("uid", "id", "label", "d", "key").join(of_class, ["label", "d", "key"]).select("uid", "id", "n_links", "root").unionByName(alone), "llm-vector-roots")
    heads = every.groupBy("root").agg(F.min("id").alias("component_id"))
    return every.join(heads, "root").select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLE = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)),
unit AS (SELECT vec_id, label, len(e) AS d, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS u FROM v WHERE list_sum(list_transform(e, lambda x: x * x)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.label = b.label AND a.d = b.d AND a.vec_id <> b.vec_id WHERE list_dot_product(a.u, b.u) >= {COSINE}),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
class AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN class c ON c.a = e.vec_id
"""
