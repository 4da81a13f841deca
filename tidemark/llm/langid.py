"""Language identification by a convolutional network over bytes (operator 9).

Texts (A to Z lower-cased) are cut into windows of WINDOW bytes that cover them whole (the last one is padded). A window's bytes
are embedded; filters of several widths slide over them, each keeps its greatest response, and a softmax
over those gives the language. A text's language is the one with the greatest mean probability over its
windows; that mean is the score.

The network is trained in numpy on the driver on at most SAMPLE windows per language and about SAMPLE_IN_ALL in all, which
languages share evenly; every language of a labelled document is learned. The windows come from
labelled documents, drawn evenly: per language, windows with the least hashes of (id, position), found in two
distributed steps. It is a few thousand numbers, sent to tasks, which score windows in batches.

Defined cases: a text that is null or has no letter is `und` with score 0; null languages and null ids don't
train; a single language is always predicted, with score 1; without any labelled text every language is
`und`. Repeated rows are scored each; extra columns are kept, those named like a result column replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.chunks import Texts, blocks
from tidemark.llm.common import unpacked

WINDOW = 128
SAMPLE = 3000  # training windows per language at most
SAMPLE_IN_ALL = 200 * SAMPLE  # training windows at most, but one of each language at least
SPARE = 30  # windows drawn beyond half as many again as are wanted, so that a small share isn't missed
EMBEDDED, FILTERS, WIDTHS = 8, 16, (2, 3, 4)
EPOCHS, LEAST_STEPS, BATCH, RATE, DECAY = 6, 800, 64, 4e-3, 1e-5
PAD = 256
UNKNOWN = "und"
WINDOWS_AT_ONCE = 512


@dataclass
class Network:
    """Embedding (257, EMBEDDED), one matrix of all filters over the widest window, biases, output layer and the languages."""

    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    languages: list[str]

    def features(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greatest responses of each filter (after a rectifier), their places, and the embedded neighbourhoods."""
        wide = max(WIDTHS)
        padded = np.concatenate([x, np.full((len(x), wide - 1), PAD, x.dtype)], 1)
        around = np.lib.stride_tricks.sliding_window_view(padded, wide, axis=1)
        seen = self.embedding[around].reshape(len(x) * x.shape[1], -1)
        response = (seen @ self.filters).reshape(len(x), x.shape[1], -1)
        best = response.argmax(1)
        top = np.take_along_axis(response, best[:, None, :], 1)[:, 0] + self.bias
        return np.maximum(top, 0), best, around

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        wide = max(WIDTHS)
        padded = np.concatenate([x, np.full((len(x), wide - 1), PAD, x.dtype)], 1)
        e = self.embedding[padded]
        seen = np.concatenate([e[:, k: k + x.shape[1]] for k in range(wide)], 2).reshape(len(x) * x.shape[1], -1)
        top = np.maximum((seen @ self.filters).reshape(len(x), x.shape[1], -1).max(1) + self.bias, 0)
        return _softmax(top @ self.out + self.out_bias)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _mask() -> np.ndarray:
    """Which rows of the filter matrix each filter uses: a filter of width w sees w of the widest window's bytes."""
    wide = max(WIDTHS)
    return np.concatenate([np.repeat(np.arange(wide) < w, EMBEDDED)[:, None].repeat(FILTERS, 1) for w in WIDTHS], 1).astype(np.float32)


def train(x: np.ndarray, y: np.ndarray, languages: list[str], seed: int = 5) -> Network:
    """Adam on the cross entropy; `x` windows of byte codes, `y` positions in `languages`."""
    rng = np.random.default_rng(seed)
    mask, n_filters = _mask(), FILTERS * len(WIDTHS)
    net = Network(rng.normal(0, 0.3, (257, EMBEDDED)).astype(np.float32), rng.normal(0, 0.2, mask.shape).astype(np.float32) * mask, np.zeros(n_filters, np.float32),
                  rng.normal(0, 0.2, (n_filters, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32), languages)
    net.embedding[PAD] = 0
    names = ("embedding", "filters", "bias", "out", "out_bias")
    first, second = ({k: np.zeros_like(getattr(net, k)) for k in names} for _ in range(2))
    step = 0
    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // max(len(x), 1)))
    for _ in range(epochs if len(languages) > 1 else 0):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            rows = order[at: at + BATCH]
            top, best, around = net.features(x[rows])
            wrong = _softmax(top @ net.out + net.out_bias)
            wrong[np.arange(len(rows)), y[rows]] -= 1
            wrong /= len(rows)
            back = (wrong @ net.out.T) * (top > 0)
            # Each filter learns from the one place it responded to most.
            held = around[np.arange(len(rows))[:, None], best]
            seen = net.embedding[held].reshape(len(rows), n_filters, -1)
            grads = {"out": top.T @ wrong, "out_bias": wrong.sum(0), "bias": back.sum(0), "filters": np.einsum("nfk,nf->kf", seen, back) * mask}
            spread = (net.filters.T[None] * back[:, :, None]).reshape(len(rows), n_filters, -1, EMBEDDED)
            grads["embedding"] = np.zeros_like(net.embedding)
            np.add.at(grads["embedding"], held, spread)
            grads["embedding"][PAD] = 0
            step += 1
            for k in names:
                value = getattr(net, k)
                g = grads[k] + DECAY * value
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                value -= (RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


_LOWER = np.arange(256, dtype=np.int16)
_LOWER[65:91] += 32


def windows(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts as byte codes with A to Z lower-cased, and the number of windows before each text."""
    size = np.diff(texts.at)
    counts = -(-size // WINDOW)
    before = np.concatenate([[0], np.cumsum(counts)])
    out = np.full((before[-1], WINDOW), PAD, np.int16)
    doc = np.repeat(np.arange(texts.n), size)
    place = np.arange(len(texts.bytes)) - texts.at[:-1][doc]
    out[before[:-1][doc] + place // WINDOW, place % WINDOW] = _LOWER[texts.bytes]
    return out, before


def fit(docs: DataFrame, train_rows: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Network | None:
    """Train on rows that `train_rows` marks and whose language isn't null; None without any."""
    known = docs.where(F.coalesce(train_rows, F.lit(False)) & F.col(f"`{lang}`").isNotNull() & (F.octet_length(F.col(f"`{text}`").cast("string")) > 0)).select(
        F.col(f"`{lang}`").cast("string").alias("lang"), F.octet_length(F.col(f"`{text}`").cast("string")).cast("long").alias("size"), F.col(f"`{doc_id}`").cast("string").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    sizes = known.groupBy("lang").agg(F.sum(F.ceil(F.col("size") / WINDOW)).alias("n")).collect()  # a row per language
    if not sizes:
        return None
    each = min(SAMPLE, max(1, SAMPLE_IN_ALL // len(sizes)))
    rates = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, (1.5 * each + SPARE) / r["n"])) for r in sizes], "lang string, share double")
    share = F.col("share")
    starts = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / WINDOW) - 1)
    key = lambda k: F.pmod(F.xxhash64("id", "size", k), F.lit(1 << 31))
    chosen = known.join(F.broadcast(rates), "lang").select("lang", "text", F.explode(F.transform(F.filter(starts, lambda k: key(k) < share * (1 << 31)), lambda k: F.struct(k.alias("k"), key(k).alias("h")))).alias("w"))
    cut = chosen.select("lang", F.col("w.h").alias("h"), F.substring(F.col("text").cast("binary"), F.col("w.k").cast("int") * WINDOW + 1, F.lit(WINDOW)).alias("bytes"))
    ranked = cut.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "bytes"))).where(F.col("r") <= each)
    rows = ranked.select("lang", "bytes").toArrow()  # at most SAMPLE_IN_ALL windows, or one of each language
    languages = sorted(set(rows.column("lang").to_pylist()))
    x = np.full((rows.num_rows, WINDOW), PAD, np.int16)
    for k, b in enumerate(rows.column("bytes").to_pylist()):
        x[k, : len(b)] = _LOWER[np.frombuffer(b, np.uint8)]
    place = {v: k for k, v in enumerate(languages)}
    y = np.array([place[v] for v in rows.column("lang").to_pylist()])
    order = np.lexsort((y, *x.T[:16]))  # rows arrive in any order
    return train(x[order], y[order], languages)


def predict(df: DataFrame, net: Network | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of `df` (all by default), `lang_pred` and `score`."""
    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def run(column: pa.Array) -> pa.Array:
        names, scores = [], []
        for part in blocks(pa.RecordBatch.from_arrays([column], names=["t"]), 0):
            texts = Texts(part.column(0))
            x, before = windows(texts)
            if net is None:
                names += [UNKNOWN] * texts.n
                scores.append(np.zeros(texts.n))
                continue
            p = np.concatenate([net.probabilities(x[k: k + WINDOWS_AT_ONCE]) for k in range(0, len(x), WINDOWS_AT_ONCE)]) if len(x) else np.zeros((0, len(net.languages)), np.float32)
            sums = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p.astype(np.float64), 0)])
            mean = (sums[before[1:]] - sums[before[:-1]]) / np.maximum(np.diff(before), 1)[:, None]
            best = mean.argmax(1)
            letters = np.array([_lettered(texts, k) for k in range(texts.n)], bool)
            names += [net.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist())]
            scores.append(np.where(letters, np.clip(mean[np.arange(texts.n), best], 0, 1), 0.0))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=["lang_pred", "score"])

    names = [c for c in (keep or df.columns) if c.lower() not in ("lang_pred", "score")]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), run(F.col(f"`{text}`").cast("string")).alias("found"))
    return rows.select(*unpacked(rows, names), "found.lang_pred", "found.score")


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _lettered(texts: Texts, k: int) -> bool:
    a, b = texts.at[k], texts.at[k + 1]
    head = texts.bytes[a: min(b, a + 256)]
    return bool(_LETTER[head].any()) or bool(_LETTER[texts.bytes[a:b]].any()) or any(c.isalpha() for c in texts.text(k))
