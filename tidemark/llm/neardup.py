"""Near-duplicate documents by improved consistent weighted sampling (operator 10).

A text's elements are its five-word shingles (of lower-cased words), a repeated shingle counting as one
element per occurrence, so that term frequency is part of the multiset. An element weighs 1 to 2,
by inverse document frequency of its shingle.

1. Frequencies are exact. Texts form blocks of a few MB (runs of row numbers, whose starts are all that reaches
   the driver); each block sends its different shingles with the number of its documents that hold them to
   ranges of the hash, of which there are as many as the corpus needs. A range adds up, and tells the blocks
   which shingles are so frequent that their weight isn't the one of a shingle of a single document. Every
   text's weight steps are written beside its samples.
2. Texts with equal words form a class; one representative of each goes on. Improved consistent weighted sampling draws `BANDS * ROWS` samples per representative: for an element of
   weight S, t = floor(ln S / r + b), ln y = r (t - b), ln a = ln c - ln y - r, and the element with the
   least a is the sample. r, c (Gamma(2, 1)) and b (uniform) come from a pool indexed by a hash of the
   element, another hash for each sample. An element's weight is the same in all texts, so t needs no
   place in the sample.
3. Representatives that agree on the ROWS samples of a band share a bucket. Buckets of up to SMALL members
   give pairs; larger ones are dealt into blocks, and every two blocks of a bucket meet in a task of their
   own, which looks up overlaps in an index of its shingles and returns links that span them, never pairs.
4. Candidates are verified on whole texts: weighted Jaccard similarity of at least 0.8. Pairs with a plain
   Jaccard similarity of the same elements of at least 0.8 are linked as well: in a large group of copies
   the shared shingles are frequent and weigh less than the edits, which must not hide near copies.
5. Connected components of the links are the groups; the smallest id names a group, and its row is kept.

Defined cases: null text is a group of its own; texts without words are equal to each other; a text of
fewer than five words is one shingle; repeated rows are copies, of which one is kept; ids may be null
(they come last) or repeated; extra columns are carried in a struct; an empty table gives no rows. A very long
text is a block of its own and is compared whole; ties between ids are settled by the order of rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.chunks import BLOCK_BYTES, Texts, blocks, encoded, words
from tidemark.llm.common import components, small_side, unpacked
from tidemark.session import cut_lineage

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 4
DF_BUCKETS = 1 << 20  # ranges of shingles that are counted together, at most
RANGE_BYTES = 16 << 20  # text per such range, where that makes at least LEAST_RANGES
LEAST_RANGES = 256  # a shingle's first byte follows from its range
ROW_BYTES = 64  # what a row counts in a block beside its text
ZSTD_LEVEL = 5  # of the texts of a block on their way to its shingles
LEVELS = 16  # steps of the element weights between 1 and 2
POOL_BITS = 15
SMALL = 8  # members of a bucket that are compared as pairs
BLOCK = 384  # mean members of a block of a larger bucket
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """Scramble the bits of 64-bit hashes."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def elements(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """Element hashes of all texts, which of them are first occurrences, where each text's elements start, a digest of each text's words, and the elements' shingles."""
    texts = Texts(column)
    data, offsets, before = words(texts)
    codes, different = encoded(data, offsets)
    lowered = [w.lower() if w.isascii() else w.decode().lower().encode() for w in different]
    hashed = np.fromiter((xxhash.xxh64_intdigest(w) for w in lowered), np.uint64, len(lowered))[codes] if len(codes) else np.zeros(0, np.uint64)
    n_words = np.diff(before)
    digests = [hashlib.blake2b(hashed[a:b].tobytes(), digest_size=16).digest() for a, b in zip(before[:-1].tolist(), before[1:].tolist())]
    counts = np.where(n_words >= SHINGLE, n_words - SHINGLE + 1, (n_words > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(counts)])
    doc = np.repeat(np.arange(texts.n), counts)
    place = before[:-1][doc] + np.arange(len(doc)) - at[:-1][doc]
    last = before[1:][doc]
    found = np.zeros(len(doc), np.uint64)
    for k in range(SHINGLE):
        inside = place + k < last
        found = _mixed(found * _U(31) + np.where(inside, hashed[np.minimum(place + k, max(len(hashed) - 1, 0))], _U(0)) + _U(k)) if len(doc) else found
    order = np.argsort(found, kind="stable")
    again = np.zeros(len(doc), bool)
    again[1:] = (found[order][1:] == found[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    first, base = np.ones(len(doc), bool), found
    if again.any():
        head = np.maximum.accumulate(np.where(again, 0, np.arange(len(doc))))
        times = np.zeros(len(doc), np.uint64)
        times[order] = (np.arange(len(doc)) - head).astype(np.uint64)
        first = times == 0
        found = np.where(first, found, _mixed(found + times * _U(0x9E3779B97F4A7C15)))
    return found, first, at, digests, base


def _block_starts(texts: DataFrame) -> np.ndarray:
    """The least uid of each block of texts; a block holds about BLOCK_BYTES and rows numbered by one task."""
    def cut(batches):
        size, last = BLOCK_BYTES, -1
        for batch in batches:
            starts = []
            for uid, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if size >= BLOCK_BYTES or uid >> 33 != last >> 33:
                    starts.append(uid)
                    size = 0
                size, last = size + n + ROW_BYTES, uid
            yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int64())], names=["start"])

    sizes = texts.select("uid", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n"))
    return np.sort(sizes.mapInArrow(cut, "start long").toArrow().column("start").to_numpy())


def in_blocks(texts: DataFrame, starts) -> DataFrame:
    """(block, held): the rows (uid, id, text) of each block, in one or more compressed stretches; `starts` is a broadcast."""
    def run(batches):
        packed = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=ZSTD_LEVEL))
        for batch in (b for whole in batches for b in blocks(whole, 2)):
            block = np.searchsorted(starts.value, batch.column(0).to_numpy(), side="right") - 1
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            held = []
            for a, b in zip(cuts, cuts[1:]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=packed) as out:
                    out.write_batch(batch.slice(a, b - a))
                held.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(block[cuts[:-1]], pa.int64()), pa.array(held, pa.binary())], names=["block", "held"])

    return texts.select("uid", "id", "text").mapInArrow(run, "block long, held binary")


def _rows_of(held: pa.ChunkedArray) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(part.as_buffer()).read_all() for part in held]).combine_chunks()


def _stored_shingles(shingles: np.ndarray) -> bytes:
    """All but the first byte of sorted shingles, byte by byte, which compresses."""
    return shingles.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 1:].T.tobytes()


def _read_shingles(held: bytes, first: int) -> np.ndarray:
    out = np.full((len(held) // 7, 8), first, np.uint8)
    out[:, 1:] = np.frombuffer(held, np.uint8).reshape(7, -1).T
    return out.view(">u8").ravel().astype(np.uint64)


def frequent_shingles(texts: DataFrame, starts, size: int, documents: int) -> DataFrame:
    """(block, shingles, levels): the shingles of each block, in several rows, whose weight step isn't that of a shingle of one document; `starts` is a broadcast."""
    bits = int(np.clip(np.ceil(np.log2(max(size / RANGE_BYTES, LEAST_RANGES))), np.log2(LEAST_RANGES), np.log2(DF_BUCKETS)))
    common = levels(np.ones(1, np.int64), documents)[0]

    def count(batches):
        for batch in (b for whole in batches for b in blocks(whole, 1)):
            block = np.searchsorted(starts.value, batch.column(0).to_numpy(), side="right") - 1
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for a, b in zip(cuts, cuts[1:]):
                _, first, _, _, base = elements(batch.column(1).slice(a, b - a))
                found, n = np.unique(base[first], return_counts=True)
                own = (found >> _U(64 - bits)).astype(np.int64)
                edges = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(found)] if len(found) else [0]
                parts = list(zip(edges, edges[1:]))
                yield pa.RecordBatch.from_arrays([
                    pa.array([own[x] for x, _ in parts], pa.int64()), pa.array([block[a]] * len(parts), pa.int64()), pa.array([_stored_shingles(found[x:y]) for x, y in parts], pa.binary()),
                    pa.array([n[x:y].astype(np.uint32).tobytes() for x, y in parts], pa.binary())], names=["part", "block", "shingles", "n"])

    def add(table: pa.Table) -> pa.Table:
        first = table.column("part")[0].as_py() >> (bits - 8)
        block = table.column("block").to_numpy()
        held = [_read_shingles(x, first) for x in table.column("shingles").to_pylist()]
        flat, n = np.concatenate(held), np.frombuffer(b"".join(table.column("n").to_pylist()), np.uint32)
        row = np.repeat(np.arange(len(held), dtype=np.int32), [len(x) for x in held])
        order = np.argsort(flat, kind="stable")
        flat, n, row = flat[order], n[order], row[order]
        at = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
        level = np.repeat(levels(np.add.reduceat(n.astype(np.int64), at), documents), np.diff(np.append(at, len(flat))))
        some = np.flatnonzero(level != common)
        some = some[np.argsort(row[some], kind="stable")]
        rows, at = np.unique(row[some], return_index=True)
        ends = np.append(at[1:], len(some))
        return pa.table({"block": pa.array(block[rows], pa.int64()), "shingles": pa.array([flat[some[x:y]].tobytes() for x, y in zip(at, ends)], pa.binary()),
                         "levels": pa.array([level[some[x:y]].tobytes() for x, y in zip(at, ends)], pa.binary())})

    return texts.mapInArrow(count, "part long, block long, shingles binary, n binary").groupBy("part").applyInArrow(add, "block long, shingles binary, levels binary")


def levels(df: np.ndarray, documents: int) -> np.ndarray:
    """The weight step 0..LEVELS for each number of documents: weight = 1 + step / LEVELS."""
    if documents < 2:
        return np.full(len(df), LEVELS, np.uint8)
    idf = np.log((documents + 1) / (np.minimum(df, documents) + 1)) / np.log(documents + 1)
    return np.rint(np.clip(idf, 0, 1) * LEVELS).astype(np.uint8)


class Sampler:
    """Consistent weighted samples from pooled random numbers."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        size = 1 << POOL_BITS
        r, c, b = rng.gamma(2.0, 1.0, size), rng.gamma(2.0, 1.0, size), rng.uniform(0, 1, size)
        weight = np.log1p(np.arange(LEVELS + 1) / LEVELS)[:, None]
        t = np.floor(weight / r + b)
        ln_a = np.log(c) - r * (t - b) - r
        # Ranks order like the values and fit the upper half of one 64-bit key.
        self.rank = np.argsort(np.argsort(ln_a.ravel(), kind="stable"), kind="stable").astype(np.uint64) << _U(32)
        self.factors = rng.integers(1 << 32, 1 << 63, BANDS * ROWS, dtype=np.uint64) * _U(2) + _U(1)

    def bands(self, found: np.ndarray, level: np.ndarray, at: np.ndarray) -> np.ndarray:
        """BANDS hashes for each text with elements."""
        some = np.flatnonzero(np.diff(at))
        out = np.zeros((BANDS, len(some)), np.uint64)
        if not len(some):
            return out
        start, row = at[some], level.astype(np.uint64) << _U(POOL_BITS)
        low = found & _U(0xFFFFFFFF)
        shift = _U(64 - POOL_BITS)
        for k, factor in enumerate(self.factors):
            key = self.rank[((found * factor) >> shift) + row] | low
            sample = np.minimum.reduceat(key, start) & _U(0xFFFFFFFF)
            band = k // ROWS
            out[band] = _mixed(out[band] * _U(0x100000001B3) + sample + _U(k + 1))
        return out


def _weighted(found: np.ndarray, at: np.ndarray, level: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text: sorted elements and their weights."""
    weight = 1.0 + level / LEVELS
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        order = np.argsort(found[a:b])
        out.append((found[a:b][order], weight[a:b][order]))
    return out


def _held(texts: pa.Array, steps: pa.Array):
    """Sorted elements and weights of texts whose weight steps are known."""
    found, _, at, _, _ = elements(texts)
    return _weighted(found, at, np.frombuffer(b"".join(steps.to_pylist()), np.uint8))


def similar(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> bool:
    """Weighted or plain Jaccard similarity of two texts' elements of at least SIMILARITY."""
    _, i, _ = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = a[1][i].sum()
    plain = len(a[0]) + len(b[0]) - len(i)
    weighted = a[1].sum() + b[1].sum() - both
    return plain > 0 and (len(i) >= SIMILARITY * plain - 1e-9 or both >= SIMILARITY * weighted - 1e-9)


def spanning_links(ids: list[int], held: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Links between similar texts that connect whatever all such links connect."""
    n = len(ids)
    sizes = np.array([len(e) for e, _ in held])
    total = np.array([w.sum() for _, w in held])
    flat, doc = np.concatenate([e for e, _ in held]), np.repeat(np.arange(n), sizes)
    weight = np.concatenate([w for _, w in held])
    order = np.argsort(flat, kind="stable")
    flat, doc, weight = flat[order], doc[order], weight[order]
    names, first = np.unique(flat, return_index=True)
    ends = np.append(first[1:], len(flat))
    root = np.arange(n)
    links = []
    for i in range(n):
        if (root == root[0]).all():
            break
        at = np.searchsorted(names, held[i][0])
        width = ends[at] - first[at]
        rows = np.repeat(first[at] - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())
        common = np.bincount(doc[rows], minlength=n)
        both = np.bincount(doc[rows], weights=weight[rows], minlength=n)
        near = (common >= SIMILARITY * (sizes[i] + sizes - common) - 1e-9) | (both >= SIMILARITY * (total[i] + total - both) - 1e-9)
        near &= root != root[i]
        for j in np.flatnonzero(near).tolist():
            if root[j] != root[i]:
                links.append((ids[i], ids[j]))
                root[root == root[j]] = root[i]
    return links


def _candidates(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b) of small buckets, and (band, i, j, uid) of blocks of larger ones that must meet."""
    spark = reps.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = reps.select("uid", F.explode("bands").alias("band")).repartition(n, "band")
    sizes = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = cut_lineage(rows.join(sizes, "band"), "llm-buckets")
    few = shared.where(F.col("n") <= SMALL).groupBy("band").agg(F.sort_array(F.collect_list("uid")).alias("u"))
    pairs = few.select(F.explode(F.flatten(F.transform("u", lambda x, i: F.transform(F.slice("u", i + 2, F.size("u")), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p")).select("p.a", "p.b").distinct()
    dealt = shared.where(F.col("n") > SMALL).withColumn("of", F.ceil(F.col("n") / BLOCK)).withColumn("own", F.pmod(F.xxhash64("uid", "band"), F.col("of")))
    met = dealt.select("band", "uid", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)).alias("other"))
    return pairs, met.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "uid")


def groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per row of `df`: a struct `row` of the columns `keep`, `id`, `component_id` and `kept`."""
    spark = df.sparkSession
    carried = list(dict.fromkeys([*(keep or []), doc_id, text]))
    whole = F.col(f"row.`{text}`").cast("string")
    stored, seen = cut_lineage(df.select(F.monotonically_increasing_id().alias("uid"), F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row")), "llm-rows",
                               size=F.coalesce(F.sum(F.octet_length(whole)), F.lit(0)), documents=F.count(whole))
    own, body = F.col(f"row.`{doc_id}`").cast("long").alias("id"), whole.alias("text")
    texts = stored.select("uid", body)
    size, documents = seen["size"], seen["documents"]
    starts = spark.sparkContext.broadcast(_block_starts(texts))
    sampler = spark.sparkContext.broadcast(Sampler())
    common = levels(np.ones(1, np.int64), documents)[0]

    def sign(rows: pa.Table, listed: pa.Table) -> pa.Table:
        rows = _rows_of(rows.column("held"))
        held = pa.concat_arrays(rows.column("text").chunks) if rows.num_rows else pa.array([], pa.string())
        found, _, at, digests, base = elements(held)
        known = np.frombuffer(b"".join(listed.column("shingles").to_pylist()), np.uint64)
        step = np.frombuffer(b"".join(listed.column("levels").to_pylist()), np.uint8)
        level = np.full(len(found), common, np.uint8)
        if len(known):
            order = np.argsort(known)
            known, step = known[order], step[order]
            place = np.minimum(np.searchsorted(known, base), len(known) - 1)
            level = np.where(known[place] == base, step[place], level)
        bands = sampler.value.bands(found, level, at).T.astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(np.where(np.diff(at) > 0, BANDS, 0))]).astype(np.int32)
        uid = rows.column("uid").to_pylist()
        own = [int(u).to_bytes(8, "big") if gone else d for u, gone, d in zip(uid, held.is_null().to_pylist(), digests)]
        return pa.table({"uid": pa.array(uid, pa.int64()), "id": rows.column("id"), "words": pa.array(own, pa.binary()), "bands": pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.ravel())),
                         "levels": pa.array([level[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())})

    listed = frequent_shingles(texts, starts, size, documents)
    dealt = in_blocks(stored.select("uid", own, body), starts)
    signed = cut_lineage(dealt.groupBy("block").cogroup(listed.groupBy("block")).applyInArrow(sign, "uid long, id long, words binary, bands array<long>, levels binary"), "llm-samples")
    classes = signed.groupBy("words").agg(F.min("uid").alias("rep"))
    reps = signed.join(classes.select(F.col("rep").alias("uid")), "uid", "left_semi").select("uid", "bands")
    pairs, met = _candidates(reps)
    pairs, seen = cut_lineage(pairs, "llm-pairs", n=F.count(F.lit(1)))

    def verify(batches):
        for batch in (b for whole in batches for b in blocks(whole, 2)):
            left, right = _held(batch.column(2), batch.column(4)), _held(batch.column(3), batch.column(5))
            good = [similar(x, y) for x, y in zip(left, right)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    steps = signed.select("uid", "levels")
    named = small_side(pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct(), 2 * seen["n"])
    wanted = texts.join(named, "uid", "left_semi").join(steps.join(named, "uid", "left_semi"), "uid")
    t = [wanted.select(F.col("uid").alias(k), F.col("text").alias(f"text_{k}"), F.col("levels").alias(f"levels_{k}")) for k in ("a", "b")]
    linked = pairs.join(t[0], "a").join(t[1], "b").select("a", "b", "text_a", "text_b", "levels_a", "levels_b").mapInArrow(verify, "a long, b long")

    def span(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids = table.column("uid").to_pylist()
        found = spanning_links(ids, _held(table.column("text").combine_chunks(), table.column("levels"))) if len(ids) > 1 else []
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    spanned = met.join(steps, "uid").join(texts, "uid").groupBy("band", "i", "j").applyInArrow(span, "a long, b long")
    roots = components(spark, linked.unionByName(spanned))
    # Both joins of rows to classes and groups read written tables: a hot one can then be split between tasks.
    of_class, seen = cut_lineage(classes.join(roots, F.col("rep") == F.col("node"), "left").select("words", F.coalesce("root", "rep").alias("root")), "llm-classes", n=F.count(F.lit(1)))
    of_row = cut_lineage(signed.select("uid", "id", "words").join(small_side(of_class, seen["n"]), "words").select("uid", "id", "root"), "llm-roots")
    heads = of_row.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid")).alias("head")).select("root", F.col("head.id").alias("component_id"), F.col("head.uid").alias("head"))
    heads, seen = cut_lineage(heads, "llm-heads", n=F.count(F.lit(1)))
    named = of_row.join(small_side(heads, seen["n"]), "root").select("uid", "component_id", (F.col("uid") == F.col("head")).alias("kept"))
    if not keep:
        return named.join(of_row.select("uid", "id"), "uid").select("id", "component_id", "kept")
    return stored.select("uid", "row", own).join(named, "uid").select("row", "id", "component_id", "kept")


def deduplicated(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `df` without near duplicates: one of each group, with its columns."""
    found = groups(df, doc_id, text, keep=df.columns).where("kept")
    return found.select(*unpacked(found, df.columns))
