"""Language-model scores by context-tree weighting over bytes (operator 7), with a word unigram as base line.

The model. Letters A to Z are lower-cased; a text is its UTF-8 bytes, then one end byte (255, which UTF-8
never uses), after DEPTH zero bytes of context. A byte is eight binary choices. Each choice has a node in the
context tree of every depth 0..DEPTH of preceding bytes; a node's estimate is Krichevsky-Trofimov's, and a
node's weighted probability is the mean of its own estimate and the product of its children's. All of
that depends only on how often each (context, byte) occurs in the training texts, so

1. tasks count (DEPTH + 1)-grams of all texts, with how often they occur in training texts, and a
   shuffle adds the counts up;
2. grams are grouped by their last two context bytes: a group holds whole subtrees, and has at most
   256^(DEPTH - 1) rows whatever the corpus. Depths 0 and 1 have at most 257 * 255 nodes and are
   finished on the driver;
3. each gram's log probability mixes the estimates along its path; a context that training never saw
   is left out, and the mixture ends at the deepest one seen;
4. the table of grams is sent to the texts in slices of at most SLICE rows, one pass over the texts per
   slice (byte grams saturate: slices grow far slower than the corpus), and partial sums are added.

The base line needs counts of all words. Each block of texts is coded against its own word list; the lists
(not the tokens) are shuffled by word to get the corpus counts and back by block. A frequent word has one
entry per block, so it is no hot key.

Defined cases: null text is empty and is scored as its end alone; without training texts counts are 0 and
every choice has probability 1/2; rows are told apart by id and text, so ids may repeat or be null, and
repeated rows get a result each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.chunks import Texts, blocks, encoded, words
from tidemark.session import cut_lineage, scratch_path

DEPTH = 5
END = 255
SLICE = 2_000_000
WORD_BLOCK = 8 << 20
GRAM_BLOCK = 1 << 20
MERGE_AT = 1_000_000  # counted grams a task holds before it merges them
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_HALF = np.log(0.5)


def grams(texts: Texts, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """The (depth + 1)-gram that ends at each byte and each text's end, and where each text's grams start."""
    doc = np.arange(texts.n)
    held = np.zeros(len(texts.bytes) + texts.n * (depth + 1), np.uint8)
    inner = np.zeros(len(held), bool)
    ends = texts.at[1:] + doc * (depth + 1) + depth
    pad = (texts.at[:-1] + doc * (depth + 1))[:, None] + np.arange(depth)
    inner[:] = True
    inner[pad.ravel()] = False
    inner[ends] = False
    held[inner] = _LOWER[texts.bytes]
    held[ends] = END
    inner[ends] = True
    key = held.astype(np.uint64)
    wide = key.copy()
    for k in range(1, depth + 1):
        wide[k:] |= key[:-k] << np.uint64(8 * k)
    return wide[inner], texts.at + np.arange(texts.n + 1)


def _counted(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate([k for k, _ in pairs]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([n for _, n in pairs]), len(keys))


def count_grams(rows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(gram, n): every gram of the texts and its occurrences in training texts; `rows` has text and train."""
    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in (b for whole in batches for b in blocks(whole, 0, GRAM_BLOCK)):
            found, at = grams(Texts(batch.column(0)), depth)
            coded = pa.array(found).dictionary_encode()
            train = np.repeat(batch.column(1).to_numpy(zero_copy_only=False).astype(np.float32), np.diff(at))
            keys = coded.dictionary.to_numpy()
            held.append((keys, np.bincount(coded.indices.to_numpy(), train, len(keys))))
            size += len(keys)
            if size > MERGE_AT:
                held = [_counted(held)]
                size = len(held[0][0])
                if size > MERGE_AT // 2:
                    yield _pairs(*held[0])
                    held, size = [], 0
        if held:
            yield _pairs(*_counted(held))

    return rows.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _pairs(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=["gram", "n"])


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma(x) for x >= 1/2: Stirling's series after moving x up by eight."""
    low = np.zeros_like(x)
    for k in range(8):
        low += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - low


def log_estimate(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with n0 zeros and n1 ones."""
    return np.where(n0 + n1 > 0, _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1.0) - np.log(np.pi), 0.0)


class Depth:
    """Nodes of one depth: counts, estimates and weighted probabilities; `at` has the node of each (gram, choice)."""

    def __init__(self, names: np.ndarray, bits: np.ndarray, n: np.ndarray):
        self.names, at = np.unique(names.ravel(), return_inverse=True)
        self.at = at.reshape(names.shape)
        weight = np.repeat(n, names.shape[1]).astype(float)
        ones = bits.ravel() == 1
        self.n0 = np.bincount(self.at.ravel(), weight * ~ones, len(self.names))
        self.n1 = np.bincount(self.at.ravel(), weight * ones, len(self.names))
        self.estimate = log_estimate(self.n0, self.n1)
        self.weighted = self.estimate

    def mix(self, children: np.ndarray) -> None:
        self.weighted = _HALF + np.logaddexp(self.estimate, children)

    def predict(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The node's own probability of each choice made, and whether training saw the node."""
        n0, n1 = self.n0[self.at], self.n1[self.at]
        return (np.where(bits == 1, n1, n0) + 0.5) / (n0 + n1 + 1.0), n0 + n1 > 0


def subtrees(found: np.ndarray, n: np.ndarray, top: int, depth: int = DEPTH) -> tuple[list[Depth], np.ndarray, np.ndarray]:
    """Depths `top`..`depth` of the grams' trees, the choices of each gram's byte, and the nodes they are made in."""
    found = found.astype(np.uint64)
    byte = (found & np.uint64(255)).astype(np.int64)[:, None]
    shift = np.arange(8)
    nodes = (1 << shift) | (byte >> (8 - shift))
    bits = (byte >> (7 - shift)) & 1
    levels = []
    for d in range(top, depth + 1):
        context = (found >> np.uint64(8)) & np.uint64((1 << 8 * d) - 1)
        levels.append(Depth((context[:, None] << np.uint64(8)) | nodes.astype(np.uint64), bits, n))
    for d in range(depth - 1, top - 1, -1):
        upper, lower = levels[d - top], levels[d - top + 1]
        parent = (((lower.names >> np.uint64(8)) & np.uint64((1 << 8 * d) - 1)) << np.uint64(8)) | (lower.names & np.uint64(255))
        upper.mix(np.bincount(np.searchsorted(upper.names, parent), lower.weighted, len(upper.names)))
    return levels, bits, nodes


def _mixed(own: np.ndarray, weight: np.ndarray, deeper: np.ndarray, seen: np.ndarray) -> np.ndarray:
    return np.where(seen, weight * own + (1 - weight) * deeper, own)


def model(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(gram, log10_p) for every counted gram."""
    spark = counts.sparkSession
    keyed = cut_lineage(counts.withColumn("context", F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF)).cast("int")), "llm-grams")

    def columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return table.column("gram").to_numpy(), table.column("n").to_numpy()

    def tops(table: pa.Table) -> pa.Table:
        level = subtrees(*columns(table), 2, depth)[0][0]
        last = ((level.names >> np.uint64(8)) & np.uint64(255)).astype(np.int32)
        return pa.table({"last": last, "node": (level.names & np.uint64(255)).astype(np.int32), "n0": level.n0, "n1": level.n1, "w": level.weighted})

    sums = keyed.groupBy("context").applyInArrow(tops, "last int, node int, n0 double, n1 double, w double")
    rows = sums.groupBy("last", "node").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "w")]).toArrow()  # at most 256 * 255 rows
    n0, n1, below = (np.zeros((256, 256)) for _ in range(3))
    at = rows.column("last").to_numpy(), rows.column("node").to_numpy()
    for held, name in ((n0, "n0"), (n1, "n1"), (below, "w")):
        held[at] = rows.column(name).to_numpy()
    upper = []  # of depth 1, then 0: own probability of a one, weight of the own estimate, whether seen
    for _ in range(2):
        estimate = log_estimate(n0, n1)
        weighted = _HALF + np.logaddexp(estimate, below)
        upper.append(((n1 + 0.5) / (n0 + n1 + 1.0), np.exp(_HALF + estimate - weighted), n0 + n1 > 0))
        n0, n1, below = n0.sum(0), n1.sum(0), weighted.sum(0)
    shared = spark.sparkContext.broadcast(upper)

    def scores(table: pa.Table) -> pa.Table:
        found, n = columns(table)
        levels, bits, nodes = subtrees(found, n, 2, depth)
        p, seen = levels[-1].predict(bits)
        for level in levels[-2::-1]:
            own, now = level.predict(bits)
            p, seen = _mixed(own, np.exp(_HALF + level.estimate - level.weighted)[level.at], p, seen), now
        last = ((found >> 8) & 255)[:, None]
        for k, (one, weight, known) in enumerate(shared.value):
            place = (last, nodes) if k == 0 else nodes
            own = np.where(bits == 1, one[place], 1 - one[place])
            p, seen = _mixed(own, weight[place], p, seen), known[place]
        return pa.table({"gram": found, "log10_p": np.log10(p).sum(1)})

    return keyed.groupBy("context").applyInArrow(scores, "gram long, log10_p double")


def score_texts(rows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(uid, score): log10 probability of each text; `rows` has uid, text and train, and rows of one uid are equal."""
    spark, key = rows.sparkSession, rows.schema["uid"].dataType.simpleString()
    table, seen = cut_lineage(model(count_grams(rows.select("text", "train"), depth), depth), "llm-tree", n=F.count(F.lit(1)))
    slices = max(1, -(-seen["n"] // SLICE))
    parts = []
    for k in range(slices):
        own = table.where(F.pmod(F.xxhash64("gram"), F.lit(slices)) == k).toArrow()
        order = np.argsort(own.column("gram").to_numpy())
        shared = spark.sparkContext.broadcast((own.column("gram").to_numpy()[order].astype(np.uint64), own.column("log10_p").to_numpy()[order]))

        def run(batches, shared=shared):
            keys, values = shared.value
            for batch in (b for whole in batches for b in blocks(whole, 1, GRAM_BLOCK)):
                found, at = grams(Texts(batch.column(1)), depth)
                coded = pa.array(found).dictionary_encode()
                asked = coded.dictionary.to_numpy()
                place = np.minimum(np.searchsorted(keys, asked), max(len(keys) - 1, 0))
                each = np.where(keys[place] == asked, values[place], 0.0) if len(keys) else np.zeros(len(asked))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.add.reduceat(each[coded.indices.to_numpy()], at[:-1]))], names=["uid", "score"])

        parts.append(cut_lineage(rows.select("uid", "text").mapInArrow(run, f"uid {key}, score double").withColumn("slice", F.lit(k)), "llm-slice"))
        shared.unpersist()
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    return total.groupBy("uid", "slice").agg(F.max("score").alias("score")).groupBy("uid").agg(F.sum("score").alias("score"))


def word_base(rows: DataFrame) -> DataFrame:
    """(uid, train, n_tokens, n_known, train_tokens, base_score) per row, from the words of the texts and one end per text."""
    spark, key = rows.sparkSession, rows.schema["uid"].dataType.simpleString()

    def code(batches):
        part, block = TaskContext.get().partitionId(), 0
        names = ["kind", "block", "uid", "train", "codes", "code", "word", "n"]
        for batch in (b for whole in batches for b in blocks(whole, 1, WORD_BLOCK)):
            texts = Texts(batch.column(1))
            data, offsets, before = words(texts, _LOWER[texts.bytes])
            codes, different = encoded(data, offsets)
            train = np.repeat(batch.column(2).to_numpy(zero_copy_only=False).astype(float), np.diff(before))
            own = (part << 24) + block
            block += 1
            m, v = batch.num_rows, len(different)
            yield pa.RecordBatch.from_arrays([pa.array([0] * m, pa.int32()), pa.array([own] * m, pa.int64()), batch.column(0), batch.column(2), pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.array(codes, pa.int32())),
                                              pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64())], names=names)
            n = np.bincount(codes, train, v).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(v, np.int32)), pa.array(np.full(v, own, np.int64)), pa.nulls(v, batch.column(0).type), pa.nulls(v, pa.bool_()), pa.nulls(v, pa.list_(pa.int32())),
                                              pa.array(np.arange(v, dtype=np.int32)), pa.array(different, pa.binary()), pa.array(n)], names=names)

    path = scratch_path(spark, "llm-words")
    coded = rows.select("uid", "text", "train").mapInArrow(code, f"kind int, block long, uid {key}, train boolean, codes array<int>, code int, word binary, n long")
    coded.write.partitionBy("kind").parquet(path)
    held = spark.read.schema(coded.schema).parquet(path)
    by_word = Window.partitionBy("word")
    listed = held.where("kind = 1").select("block", "code", "n", F.sum("n").over(by_word).alias("c"), F.row_number().over(by_word.orderBy("block")).alias("k"))
    listed, seen = cut_lineage(listed, "llm-word-counts", tokens=F.coalesce(F.sum("n"), F.lit(0)), words=F.coalesce(F.sum(F.when((F.col("k") == 1) & (F.col("c") > 0), 1)), F.lit(0)))
    ends = rows.where("train").count()
    tokens, kinds = seen["tokens"] + ends, seen["words"] + (ends > 0)

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        counts = np.zeros(right.num_rows, np.float64)
        counts[right.column("code").to_numpy()] = right.column("c").to_numpy()
        own = left.combine_chunks().column("codes").combine_chunks()
        own = own.chunk(0) if isinstance(own, pa.ChunkedArray) else own
        sizes = np.diff(own.offsets.to_numpy())
        doc = np.repeat(np.arange(len(own)), sizes)
        c = counts[own.flatten().to_numpy()]
        scale = np.log10(tokens + (kinds + 1.0))
        n = sizes + 1
        base = np.bincount(doc, np.log10(c + 1), len(own)) + np.log10(ends + 1.0) - n * scale
        known = np.bincount(doc, c > 0, len(own)).astype(np.int64) + (ends > 0)
        return pa.table({"uid": left.column("uid"), "train": left.column("train"), "n_tokens": n.astype(np.int64), "n_known": known, "base_score": base})

    grouped = held.where("kind = 0").select("block", "uid", "train", "codes").groupBy("block").cogroup(listed.select("block", "code", "c").groupBy("block"))
    return grouped.applyInArrow(add, f"uid {key}, train boolean, n_tokens long, n_known long, base_score double").withColumn("train_tokens", F.lit(int(tokens)).cast("long"))


def score(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score) for every row; `train` marks the rows to learn from."""
    own, body = F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`").cast("string")
    # Rows of equal id and text have equal scores, so that is all a row's key needs to tell apart.
    uid = F.struct(own.alias("doc_id"), F.unhex(F.md5(F.coalesce(body, F.lit("")).cast("binary"))).alias("digest"))
    rows = docs.select(uid.alias("uid"), body.alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    found = word_base(rows).join(score_texts(rows).withColumnsRenamed({"uid": "key"}), F.col("uid").eqNullSafe(F.col("key")))
    return found.select("uid.doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score")
