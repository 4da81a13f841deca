"""Thinning a wide block of numbered columns: groups by missing-value pattern, then pruning or PCA.

Rows are only touched by aggregations; the choices are made on matrices with one entry per pair of
columns of a group.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.profile import null_signatures, numbered

LIMIT = 0.95


@dataclass
class Group:
    group_id: int
    signature: str
    columns: list[str]
    kept: list[str] = field(default_factory=list)
    dropped: list[dict] = field(default_factory=list)


def pattern_groups(df: DataFrame, columns: list[str] | None = None, id_col: str = "TransactionID") -> list[Group]:
    """Columns with equal missing-value patterns, larger groups first; one row per column is collected."""
    columns = columns or numbered(df.columns)
    by_sig: dict[str, list[str]] = {}
    for r in null_signatures(df, columns, id_col).collect():
        by_sig.setdefault(r["signature"], []).append(r["column"])
    ordered = sorted(by_sig.items(), key=lambda kv: (-len(kv[1]), min(kv[1])))
    return [Group(i, sig, sorted(cols, key=lambda c: int(c[1:]))) for i, (sig, cols) in enumerate(ordered)]


def group_moments(df: DataFrame, blocks: list[list[str]]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(rows, means, covariances) of each block of columns, over the rows where all of its columns are filled.

    Two scans whatever the number of blocks: column means, then sums around them inside tasks. Only sums,
    one number per pair of columns of a block, are shuffled and reach the driver.
    """
    columns = sorted({c for block in blocks for c in block})
    if not columns:
        return []
    filled = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    middle = filled.agg(*[F.avg(F.nanvl(c, F.lit(None).cast("double"))).alias(c) for c in columns]).first()
    shift = np.array([middle[c] or 0.0 for c in columns])
    places = [[columns.index(c) for c in block] for block in blocks]

    def add(batches):
        held = [np.zeros(1 + len(at) + len(at) ** 2) for at in places]
        for batch in batches:
            rows = np.column_stack([np.asarray(c.to_numpy(zero_copy_only=False), float) for c in batch.columns]) - shift
            for k, at in enumerate(places):
                x = rows[:, at]
                x = x[~np.isnan(x).any(1)]
                held[k] += np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
        for k, part in enumerate(held):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), k, np.int32)), pa.array(np.arange(len(part), dtype=np.int32)), pa.array(part)], names=["block", "at", "v"])

    sums = [np.zeros(1 + len(at) + len(at) ** 2) for at in places]
    for r in filled.mapInArrow(add, "block int, at int, v double").groupBy("block", "at").agg(F.sum("v").alias("v")).collect():
        sums[r["block"]][r["at"]] = r["v"]
    out = []
    for at, v in zip(places, sums):
        d, n = len(at), max(v[0], 1.0)
        mean = v[1: d + 1] / n
        out.append((int(v[0]), shift[at] + mean, v[d + 1:].reshape(d, d) / n - np.outer(mean, mean)))
    return out


def _correlations(n: int, covariance: np.ndarray) -> np.ndarray:
    """|rho|; 0 where it is undefined."""
    if n < 2:
        return np.zeros_like(covariance)
    sd = np.sqrt(np.maximum(np.diag(covariance), 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.abs(np.nan_to_num(covariance / np.outer(sd, sd), nan=0.0, posinf=0.0, neginf=0.0))


def prune_correlated(df: DataFrame, target: str, columns: list[str] | None = None, limit: float = LIMIT) -> list[Group]:
    """Within a group, keep columns by their correlation with the target unless too close to one already kept.

    All columns of a group are missing on the same rows, so one matrix per group holds every pairwise
    correlation; all matrices come from one pass.
    """
    groups = pattern_groups(df, columns)
    wide = [g for g in groups if len(g.columns) > 1]
    moments = {g.group_id: m for g, m in zip(wide, group_moments(df, [[*g.columns, target] for g in wide]))}
    for g in groups:
        if len(g.columns) == 1:
            g.kept = list(g.columns)
            continue
        n, _, covariance = moments[g.group_id]
        m = _correlations(n, covariance)
        at = {c: i for i, c in enumerate(g.columns)}
        to_target = {c: float(m[i, len(g.columns)]) for c, i in at.items()}
        for c in sorted(g.columns, key=lambda c: (-to_target[c], c)):
            close = next((k for k in g.kept if m[at[c], at[k]] > limit), None)
            if close is None:
                g.kept.append(c)
            else:
                g.dropped.append({"column": c, "anchor": close, "rho_to_kept": float(m[at[c], at[close]]), "rho_to_target": to_target[c]})
    return groups


def apply_pruning(df: DataFrame, groups: list[Group]) -> DataFrame:
    return df.drop(*[d["column"] for g in groups for d in g.dropped])


@dataclass
class Projection:
    group: Group
    means: list[float]
    stds: list[float]
    components: list[list[float]]
    shares: list[float]
    names: list[str]


def fit_projections(df: DataFrame, columns: list[str] | None = None, variance: float = 0.95) -> list[Projection]:
    """Per group, principal components of the standardised columns up to the variance share."""
    out, groups = [], pattern_groups(df, columns)
    for g, (n, means, covariance) in zip(groups, group_moments(df, [g.columns for g in groups])):
        if len(g.columns) == 1 or n < 2:
            g.kept = list(g.columns)
            continue
        stds = np.sqrt(np.maximum(np.diag(covariance), 0))
        stds[stds == 0] = 1.0
        held, axes = np.linalg.eigh(covariance / np.outer(stds, stds))
        order = np.argsort(-held)
        shares = np.maximum(held[order], 0) / max(np.maximum(held, 0).sum(), 1e-300)
        k = min(int(np.searchsorted(np.cumsum(shares), variance, side="right")) + 1, len(shares))
        names = [f"v_group_{g.group_id}_pc_{i}" for i in range(k)]
        g.kept, g.dropped = names, [{"column": c, "anchor": f"v_group_{g.group_id}"} for c in g.columns]
        out.append(Projection(g, means.tolist(), stds.tolist(), axes[:, order[:k]].T.tolist(), [float(x) for x in shares[:k]], names))
    return out


def apply_projections(df: DataFrame, projections: list[Projection]) -> DataFrame:
    """Replace each group's columns by its components; a NULL counts as 0 before standardising.

    A group is one array and one matrix product per batch, however many columns it has.
    """
    out = df
    for k, p in enumerate(projections):
        out = out.withColumn(f"__pc_{k}", _projected(p)(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in p.group.columns])))
    parts = {name: F.get(f"__pc_{k}", F.lit(i)) for k, p in enumerate(projections) for i, name in enumerate(p.names)}
    return out.withColumns(parts).drop(*[f"__pc_{k}" for k in range(len(projections))], *[c for p in projections for c in p.group.columns])


def _projected(p: Projection):
    means, stds, axes = np.array(p.means), np.array(p.stds), np.array(p.components).T

    @F.arrow_udf("array<double>")
    def run(column: pa.Array) -> pa.Array:
        x = (column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(means)) - means) / stds
        made = x @ axes
        return pa.FixedSizeListArray.from_arrays(pa.array(made.ravel()), axes.shape[1]).cast(pa.list_(pa.float64()))

    return run


def manifest(groups: list[Group], spark) -> DataFrame:
    """One row per column: its group and whether it stays, or what it was dropped for."""
    rows = []
    for g in groups:
        rows += [(g.group_id, c, "kept", None, None, None) for c in g.kept]
        rows += [(g.group_id, d["column"], "dropped", d.get("anchor"), d.get("rho_to_kept"), d.get("rho_to_target")) for d in g.dropped]
    return spark.createDataFrame(rows, "group_id int, column string, state string, anchor string, rho_to_kept double, rho_to_target double")


def manifest_json(groups: list[Group]) -> str:
    kept = sum(len(g.kept) for g in groups)
    return json.dumps({"schema_version": 1, "n_groups": len(groups), "n_columns_input": sum(len(g.columns) for g in groups),
                       "n_columns_output": kept, "groups": [asdict(g) for g in groups]}, sort_keys=True)


