"""Quality classifier: a regularised quadratic discriminant (operator 6).

Every text becomes a few transformed statistics. The sums each class needs (count, sum of the vectors and
of their outer products) are added up inside tasks and then over tasks, so training covers all labelled
rows and the driver sees two rows of sums. Each class covariance is shrunk towards the mean of both and
then towards its own diagonal; its Cholesky factor is inverted once and travels with the model. A text's
evidence is the difference of the two Gaussian log densities plus the prior log odds; the score flattens
it, monotonically, into (0, 1) without saturating: sigmoid(sign(x) log(1 + |x|)).

Defined cases: null text counts as empty, whose statistics are defined and scored like any other; a null
id belongs to fold 0, which never trains; labels other than 0 and 1, null labels, labels without a
document and repeated label rows are ignored; with fewer than two rows of either class every text gets
the smoothed share of label 1 (0.5 without labels). An input column named like a new one is replaced.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.chunks import Texts, blocks, encoded, words
from tidemark.llm.common import fold, unpacked

FOLDS = 5
ACCEPT = 0.3
TOWARDS_MEAN, TOWARDS_DIAGONAL, RIDGE = 0.2, 0.1, 1e-3
_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "symbol": b"#*$%&|<>", "bang": b"!?", "digit": b"0123456789", "space": b" \t\n\r\x0b\x0c", "point": b".,;:'\"()-"}
_KIND = np.zeros(256, np.int64)
for _k, _held in enumerate(_CLASSES.values()):
    _KIND[list(_held)] = _k + 1
STATISTICS = ["words", *_CLASSES, "word_length", "different", "commonest", "compressed"]


def statistics(column: pa.Array) -> np.ndarray:
    """Transformed statistics of each text: shares on a log scale, with an offset that keeps rare events small."""
    texts = Texts(column)
    n, size = texts.n, np.diff(texts.at)
    kinds = len(_CLASSES) + 1
    own = np.repeat(np.arange(n), size)
    counts = np.bincount(own * kinds + _KIND[texts.bytes], minlength=n * kinds).reshape(n, kinds)[:, 1:].astype(float)
    data, offsets, before = words(texts)
    codes, _ = encoded(data, offsets)
    n_words = np.diff(before).astype(float)
    pairs, times = np.unique((np.repeat(np.arange(n), np.diff(before)) << 32) + codes, return_counts=True)
    of = pairs >> 32
    different = np.bincount(of, minlength=n).astype(float)
    most = np.zeros(n)
    np.maximum.at(most, of, times)
    packed_size = np.array([len(zlib.compress(texts.bytes[a:b].tobytes(), 1)) for a, b in zip(texts.at, texts.at[1:])], float)
    some, any_words = np.maximum(size, 1)[:, None], np.maximum(n_words, 1)
    offset = np.array([0.02, 0.005, 0.005, 0.01, 0.02, 0.01])
    return np.column_stack([np.log1p(n_words), np.log(counts / some + offset), np.log((size - counts[:, 4]) / any_words + 1), np.log(different / any_words + 0.02),
                            np.log(most / any_words + 0.02), np.log(packed_size / (size + 16.0))])


@dataclass
class Discriminant:
    """Means, inverted Cholesky factors and log determinants of the classes 0 and 1, and the prior log odds."""

    means: np.ndarray | None
    factors: np.ndarray | None
    log_dets: np.ndarray | None
    prior: float

    def evidence(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.prior)
        density = []
        for mean, factor, log_det in zip(self.means, self.factors, self.log_dets):
            z = (x - mean) @ factor.T
            density.append(-0.5 * (np.einsum("ij,ij->i", z, z) + log_det))
        return density[1] - density[0] + self.prior

    def score(self, x: np.ndarray) -> np.ndarray:
        e = self.evidence(x)
        if self.means is None:
            return 1 / (1 + np.exp(-e))
        return 1 / (1 + np.exp(-np.sign(e) * np.log1p(np.abs(e))))


def discriminant(sums: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> Discriminant:
    """The model of (count, sum of vectors, sum of outer products) per class."""
    n = [sums[k][0] if k in sums else 0.0 for k in (0, 1)]
    prior = float(np.log((n[1] + 1) / (n[0] + 1)))
    if min(n) < 2:
        return Discriminant(None, None, None, prior)
    means = [sums[k][1] / n[k] for k in (0, 1)]
    covariances = [(sums[k][2] - n[k] * np.outer(means[k], means[k])) / (n[k] - 1) for k in (0, 1)]
    pooled = (covariances[0] + covariances[1]) / 2
    factors, log_dets = [], []
    for c in covariances:
        c = (1 - TOWARDS_MEAN) * c + TOWARDS_MEAN * pooled
        c = (1 - TOWARDS_DIAGONAL) * c + TOWARDS_DIAGONAL * np.diag(np.diag(c)) + RIDGE * np.eye(len(c))
        lower = np.linalg.cholesky((c + c.T) / 2)
        factors.append(np.linalg.inv(lower))
        log_dets.append(2 * np.log(np.diag(lower)).sum())
    return Discriminant(np.array(means), np.array(factors), np.array(log_dets), prior)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Discriminant:
    """Learn from the labelled documents outside fold 0; statistics are joined to labels, so no text is shuffled."""
    d = len(STATISTICS)

    def measure(batches):
        for batch in (b for whole in batches for b in blocks(whole, 1)):
            x = statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), d).cast(pa.list_(pa.float64()))], names=["doc_id", "x"])

    train = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where((fold(F.col("doc_id"), FOLDS) != 0) & F.col("doc_id").isNotNull())
    known = labels.select(F.col("doc_id").cast("long"), F.col(f"`{label}`").cast("int").alias("y")).where("y IN (0, 1)").distinct()

    def add(batches):
        held = {}
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy().reshape(-1, d)
            for k in np.unique(y).tolist():
                own = x[y == k]
                part = np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
                held[k] = held.get(k, 0) + part
        for k, part in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(part), pa.int32()), pa.array(np.arange(len(part), dtype=np.int32)), pa.array(part)], names=["y", "at", "v"])

    measured = train.mapInArrow(measure, "doc_id long, x array<double>").join(known, "doc_id").select("y", "x")
    sums = measured.mapInArrow(add, "y int, at int, v double").groupBy("y", "at").agg(F.sum("v").alias("v")).collect()
    found = {}
    for k in {r["y"] for r in sums}:
        v = np.array([r["v"] for r in sorted((r for r in sums if r["y"] == k), key=lambda r: r["at"])])
        found[k] = (v[0], v[1: d + 1], v[d + 1:].reshape(d, d))
    return discriminant(found)


def score(df: DataFrame, model: Discriminant, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of `df` (all by default) and `score`, `predicted`. Only the text goes to Python."""
    @F.arrow_udf("double")
    def scores(column: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([column], names=["t"])
        parts = [model.score(statistics(b.column(0))) for b in blocks(batch, 0)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    names = [c for c in (keep or df.columns) if c.lower() not in ("score", "predicted")]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), scores(F.col(f"`{text}`").cast("string")).alias("score"))
    return rows.select(*unpacked(rows, names), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def accepted(df: DataFrame, model: Discriminant, text: str = "text") -> DataFrame:
    """The rows of `df` with a score of at least ACCEPT, with its columns."""
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("whole"), F.col(f"`{text}`").alias("text"))
    return score(whole, model, keep=["whole"]).where("predicted = 1").select(*[F.col(f"whole.`{c}`").alias(c) for c in df.columns])
