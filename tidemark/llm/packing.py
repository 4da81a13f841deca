"""Best-fit packing by exact-complement hashing (operator 5).

Documents become pieces of at most `capacity` tokens. Only the number of pieces of each length matters
to the plan, so the driver sees one histogram of at most `capacity` numbers, whatever the corpus size:

1. singles, pairs and triples of lengths that sum to the gap of a longer piece are looked up in indexes
   of the available lengths and consumed as often as the counts allow: those sequences are full;
2. what is left is placed best-fit, longest first, into the smallest gap that takes it.

Both steps move whole multiplicities, never single pieces. The plan is a short table of runs: "pieces
first..last of this length go to these sequences at this offset". Pieces get their number among those
of equal length from a counter inside the task and the totals of the tasks before it, so no length,
however common, is sorted or collected.

Defined cases: null or empty text is the end token alone; a null doc_id stays null; repeated rows are
packed each; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.chunks import ODD_SPACE, Texts, blocks, encoded, tiles
from tidemark.session import cut_lineage

CAPACITY = 2048
END_ID = 0
CACHE_CHUNKS = 200_000  # token ids of that many different runs are kept in a worker: about 40 MB
LONG = 64  # bytes of a run that is not remembered
TEXT_AT_ONCE = 2 << 20  # bytes of text worked on at once; a longer text is worked on alone
_ODD = re.compile(f"[{ODD_SPACE}]")
_NEWLINE = b"\n"


class ByteBpe:
    """Ids of a byte-level vocabulary file of the tokenizers library, as little-endian unsigned 32-bit bytes.

    No token crosses from one run of non-spaces (with the space before it) into the next, so each
    different run is encoded once and remembered. The merges run in tiktoken on the ranks of the same
    file, several times faster than the library the file is made for; tests hold the ids against it.
    """

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        to_byte = {c: b for b, c in _byte_names().items()}
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        vocab = held["model"]["vocab"]
        ranks = {bytes(to_byte[c] for c in token): i for token, i in vocab.items() if token not in self.special}
        merged = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in held["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError("token ids don't follow the order of the merges")
        self._encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._newline = ranks[_NEWLINE]
        self._known: dict[bytes, bytes] = {}
        self._marks = re.compile("(" + "|".join(re.escape(s) for s in self.special) + ")") if self.special else None

    def _learn(self, chunks: list[bytes]) -> None:
        """Encode new runs together: between lines, a newline is a token of its own."""
        plain = [c for c in chunks if not c.isspace() and (c.isascii() or not _ODD.search(c.decode()))]
        for c in set(chunks).difference(plain):
            self._known[c] = array("I", self._encoding.encode_ordinary(c.decode())).tobytes()
        ids = self._encoding.encode_to_numpy(_NEWLINE.join(plain).decode()).astype("<u4", copy=False) if plain else np.zeros(0, "<u4")
        cuts = np.flatnonzero(ids == self._newline)
        raw = ids.tobytes()
        for c, a, b in zip(plain, [0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), len(raw)]):
            self._known[c] = raw[a:b]

    def one(self, text: str) -> bytes:
        """Ids of one text that may hold any white space and special tokens."""
        found = []
        for part in self._marks.split(text) if self._marks else [text]:
            if part in self.special:
                found.append(array("I", [self.special[part]]).tobytes())
            else:
                found.append(array("I", self._encoding.encode_ordinary(part)).tobytes())
        return b"".join(found)

    def __call__(self, column: pa.Array) -> list[bytes]:
        texts = Texts(column)
        offsets, before = tiles(texts)
        codes, different = encoded(texts.bytes, offsets)
        new = [c for c in different if c not in self._known]
        if new and len(self._known) + len(new) > CACHE_CHUNKS:
            self._known.clear()
            new = different
        if new:
            self._learn(new)
        own = list(map(self._known.__getitem__, different))
        for c in different:
            if len(c) > LONG:
                del self._known[c]  # long runs are rare and would fill the memory
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // 4
        ids = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)), pa.array(np.frombuffer(b"".join(own), "<u4"))).take(pa.array(codes))
        flat = ids.flatten().to_numpy()
        at = np.concatenate([[0], np.cumsum(sizes[codes] if len(codes) else np.zeros(0, np.int64))])[before]
        out = [flat[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        odd = texts.odd()
        raw = texts.bytes.tobytes() if self.special else b""
        if any(s.encode() in raw for s in self.special):
            odd.update(i for i in range(texts.n) if any(s in texts.text(i) for s in self.special))
        for i in odd:
            out[i] = self.one(texts.text(i))
        return out


def _byte_names() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte: itself, or the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_ENCODERS: dict[str, ByteBpe] = {}


def encoder(path: str) -> ByteBpe:
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteBpe(path)
    return _ENCODERS[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of every document, each with its number among the pieces of equal length in its task.

    A document of n tokens (the end token counts) is one piece if n <= capacity. Otherwise it is cut into
    full pieces, and the first piece takes the remainder. `with_ids` adds the ids as an array.
    """
    def run(batches):
        encode, part, end = encoder(tokenizer), TaskContext.get().partitionId(), array("I", [END_ID]).tobytes()
        seen = np.zeros(capacity + 1, np.int64).tolist()
        for batch in (b for whole in batches for b in blocks(whole, 1, TEXT_AT_ONCE)):
            ids, piece, start, length, crc, nth, raw = [], [], [], [], [], [], []
            for doc, tokens in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                tokens += end
                n, at, k = len(tokens) // 4, 0, 0
                while at < n:
                    size = (n - at) % capacity or capacity
                    own = tokens[4 * at: 4 * (at + size)]
                    ids.append(doc), piece.append(k), start.append(at), length.append(size), crc.append(zlib.crc32(own)), nth.append(seen[size])
                    if with_ids:
                        raw.append(np.frombuffer(own, "<u4").astype(np.int32))
                    seen[size] += 1
                    at, k = at + size, k + 1
            columns = [pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                       pa.array([part] * len(ids), pa.int32()), pa.array(nth, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            if with_ids:
                columns.append(pa.array(raw, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, number of such sequences) for so many pieces of each length.

    Of the plans with complements of up to three, two and one pieces, the one with the fewest sequences:
    filling a gap with several small pieces leaves fewer of them for best fit.
    """
    return min((_plan(counts, capacity, most) for most in (3, 2, 1)), key=lambda p: sum(n for _, n in p))


def _plan(counts: dict[int, int], capacity: int, most: int) -> list[tuple[tuple[int, ...], int]]:
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    made: list[tuple[tuple[int, ...], int]] = []

    def consume(*lengths: int) -> bool:
        """As many sequences of exactly these lengths as the counts allow; whether one of them ran out."""
        times = {x: lengths.count(x) for x in lengths}
        n = int(min(left[x] // t for x, t in times.items()))
        if n:
            made.append((lengths, n))
            for x, t in times.items():
                left[x] -= t * n
        return n > 0

    if left[capacity]:
        consume(capacity)
    for top in range(capacity - 1, 0, -1):
        gap = capacity - top
        if left[top]:
            consume(top, gap)
        if left[top] and most > 1:
            a = np.arange(gap - 1, (gap - 1) // 2, -1)  # the larger of the two, b = gap - a
            for x in a[(left[a] > 0) & (left[gap - a] > 0)].tolist():
                if not left[top]:
                    break
                consume(top, x, gap - x)
        if left[top] and most > 2 and gap >= 3:
            held = (left[:gap] > 0).astype(np.float32)
            sums = np.convolve(held, held)[:gap] > 0.5  # pair index: sums two available lengths can have
            a = np.arange(gap - 2, (gap - 1) // 3, -1)
            for x in a[(left[a] > 0) & sums[gap - a]].tolist():
                if not left[top] or not left[x]:
                    continue
                rest = gap - x
                b = np.arange(min(x, rest - 1), (rest - 1) // 2, -1)
                for y in b[(left[b] > 0) & (left[rest - b] > 0)].tolist():
                    if not left[top] or not left[x]:
                        break
                    consume(top, x, y, rest - y)
    # What has no exact complement is placed best-fit, longest first; groups of equal sequences move together.
    gaps: list[int] = []
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def add(lengths: tuple[int, ...], n: int) -> None:
        gap = capacity - sum(lengths)
        if gap not in groups:
            groups[gap] = []
            insort(gaps, gap)
        groups[gap].append((lengths, n))

    for length in range(capacity - 1, 0, -1):
        n = int(left[length])
        while n:
            k = bisect_left(gaps, length)
            if k == len(gaps):
                each = capacity // length
                if n >= each:
                    add((length,) * each, n // each)
                if n % each:
                    add((length,) * (n % each), 1)
                break
            gap = gaps[k]
            lengths, m = groups[gap].pop()
            if not groups[gap]:
                del groups[gap]
                gaps.pop(k)
            used = min(n, m)
            if m > used:
                add(lengths, m - used)
            add((*lengths, length), used)
            n -= used
    return made + [g for gap in gaps for g in groups[gap]]


def runs(planned: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """The plan by length and number: from `first` on, pieces of `length` go to `sequence`, `sequence` + 1, ... at `offset`."""
    rows, used, sequence = [], {}, 0
    for lengths, n in planned:
        at = 0
        for x in lengths:
            first = used.get(x, 0)
            rows.append((x, first, sequence, at))
            used[x] = first + n
            at += x
        sequence += n
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 4).T
    return dict(zip(("length", "first", "sequence", "offset"), columns))


_NUMBER_BITS = 48  # (length, number) as one key


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every document with its place: `sequence_id` and `offset`."""
    spark = docs.sparkSession
    if capacity >= 1 << 15:
        raise ValueError("capacity must be below 32768")
    stored = cut_lineage(pieces(docs, tokenizer, capacity), "llm-pieces")
    totals = stored.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in totals.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    found = runs(plan(histogram, capacity))
    keys = (found["length"] << _NUMBER_BITS) + found["first"]
    shared = spark.sparkContext.broadcast((keys, found["first"], found["sequence"], found["offset"]))
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("part", "length", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    numbered = stored.join(before, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("number"))

    def place(batches):
        keys, first, sequence, offset = shared.value
        for batch in batches:
            length, number = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            at = np.searchsorted(keys, (length << _NUMBER_BITS) + number, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence[at] + number - first[at]), pa.array(offset[at])], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return numbered.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
