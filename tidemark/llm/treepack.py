"""First-fit decreasing with a tournament tree, in randomised groups of documents (operator 12).

1. Every document is tokenised where it lies. Its full pieces of `capacity` tokens are sequences of their
   own; the remainder of fewer tokens still has to find a place.
2. Remainders are dealt into groups of about GROUP documents by a hash of task and row number, so that a
   group is a random share of the documents and copies or a hot source are spread over all groups. A
   group holds one remainder of each of its documents at most: about GROUP times `capacity` token ids
   however long the texts are. Full pieces are dealt the same way, without their ids.
3. In a group, remainders are placed longest first into the first bin that takes them. The leaves of a
   tournament tree are the bins' free capacities and each inner node the larger of its two, so the first
   bin that fits is found by one walk down the tree.
4. Sequences whose length is a power of two need no padding. What the others still lack is filled by
   cutting up the emptiest bins of the group, and what remains of the last one is cut into powers of
   two: no padding is left, at the cost of at most one cut a gap.

Groups know nothing of each other: a lost executor costs its groups only. Rows are numbered in the order
in which their task reads them, so `docs` must be a stored table or follow from one without a shuffle.

Defined cases: null or empty text is the end token alone; a very long text gives many full pieces; equal
lengths are placed in order of arrival in their group; repeated rows are packed each; a null doc_id stays
null; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.chunks import Texts, blocks, encoded, words

CAPACITY = 2048
END_ID = 1
GROUP = 4096  # mean documents of a group
# What the tokenizer's file must say, so that runs can be encoded one by one.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
CACHE_RUNS = 300_000  # runs whose ids a worker remembers in each of two generations: about 60 MB each
LONG = 64  # bytes of a run that is not remembered
TEXT_AT_ONCE = 4 << 20  # bytes of text worked on at once; a longer text is worked on alone
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = True


class RunEncoder:
    """Ids of a tokenizer of the tokenizers library that lowers letters, drops white space and splits words from punctuation.

    Texts are cut into runs: at white space, and where an ASCII letter meets an ASCII mark other than an apostrophe.
    No token of such a vocabulary crosses these cuts. ASCII letters are lowered before equal runs are looked for.
    The new runs of a block are encoded by the library in one call with a special token between them, and
    remembered; runs that were not met again while as many others came are forgotten. A block in which a special
    token occurs (or would, once lowered) is cut at white space only.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task for every core
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        added = self._library.get_added_tokens_decoder()
        special = {t.content: i for i, t in added.items() if t.special and not (t.normalized or t.single_word)}
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        if not special or held["normalizer"] != NORMALIZER or held["pre_tokenizer"] != PRE_TOKENIZER:
            raise ValueError("not a tokenizer whose runs can be told from its file")
        self._mark, self._mark_id = next(iter(special.items()))
        self._added = re.compile("|".join(re.escape(t.content) for t in added.values()).encode(), re.IGNORECASE)
        self._young: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}
        self.kind = np.dtype("<u2" if self._library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")  # holds every id

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self._library.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _learn(self, runs: list[bytes]) -> dict[bytes, bytes]:
        plain = [r for r in runs if not self._added.search(r)]
        found = {r: self._ids(r.decode()).tobytes() for r in set(runs).difference(plain)}
        if plain:
            ids, width = self._ids(self._mark.join([r.decode() for r in plain])), self.kind.itemsize
            at = (width * np.flatnonzero(ids == self._mark_id)).tolist()
            raw = ids.tobytes()
            found.update((r, raw[a:b]) for r, a, b in zip(plain, [0, *[x + width for x in at]], [*at, len(raw)]))
        return found

    def _of(self, different: list[bytes]) -> list[bytes]:
        young, old = self._young, self._old
        own = [young.get(r) for r in different]
        missing = [k for k, ids in enumerate(own) if ids is None]
        for k in missing:
            own[k] = old.get(different[k])
        learnt = self._learn([different[k] for k in missing if own[k] is None])
        for k in missing:
            r = different[k]
            if own[k] is None:
                own[k] = learnt[r]
            if len(r) <= LONG:  # longer runs are rare and would fill the memory
                young[r] = own[k]
        if len(young) > CACHE_RUNS:
            self._young, self._old = {}, young
        return own

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where those of each text start."""
        texts = Texts(column)
        if self._added.search(texts.bytes):
            data, offsets, before = words(texts)
        else:
            raw = texts.bytes
            data, offsets, before = words(texts, np.where((raw >= 65) & (raw <= 90), raw | 32, raw))
            letter, mark = _LETTER[data], _MARK[data]
            cut = np.zeros(len(data) + 1, bool)
            cut[1:-1] = letter[:-1] & mark[1:] | mark[:-1] & letter[1:]
            cut[offsets] = True
            starts, offsets = offsets[before], np.flatnonzero(cut)
            before = np.searchsorted(offsets, starts)
        codes, different = encoded(data, offsets)
        if not different:
            return np.zeros(0, self.kind), np.zeros(len(before), np.int64)
        own = self._of(different)
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // self.kind.itemsize
        held = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)])), pa.array(np.frombuffer(b"".join(own), self.kind)))
        return held.take(pa.array(codes)).flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes[codes])])[before]


_ENCODERS: dict[str, RunEncoder] = {}


def encoder(path: str) -> RunEncoder:
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = RunEncoder(path)
    return _ENCODERS[path]


class Tournament:
    """Free capacities of bins in a complete binary tree; every inner node holds the larger of its children."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(bins - 1, 0).bit_length()
        self.tree = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Take `size` from the first bin that has it; its number. There must be one."""
        tree, node = self.tree, 1
        while node < self.leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        found = node - self.leaves
        tree[node] -= size
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
        return found


def first_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Numbers of the pieces of each bin: longest first, each into the first bin that takes it."""
    free, bins = Tournament(len(sizes), capacity), []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        at = free.place(sizes[k])
        if at == len(bins):
            bins.append([])
        bins[at].append(k)
    return bins


def _padded(used: int, capacity: int) -> bool:
    return 0 < used < capacity and used & (used - 1) != 0


def filled(sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (piece, start in it, length) of which none needs padding."""
    sequences = [[(k, 0, sizes[k]) for k in held] for held in first_fit(sizes, capacity)]
    total = [sum(n for _, _, n in s) for s in sequences]
    # Fullest first: the gaps in front are filled from the emptiest bins behind.
    rest = sorted((k for k, n in enumerate(total) if _padded(n, capacity)), key=lambda k: -total[k])
    done = [s for k, s in enumerate(sequences) if not _padded(total[k], capacity)]
    left, right = 0, len(rest) - 1
    while left < right:
        taker, giver = rest[left], rest[right]
        gap = capacity - total[taker]
        k, start, n = sequences[giver].pop()
        take = min(gap, n)
        sequences[taker].append((k, start, take))
        total[taker] += take
        total[giver] -= take
        if take < n:
            sequences[giver].append((k, start + take, n - take))
        if total[taker] == capacity:
            left += 1
        if total[giver] == 0:
            right -= 1
    for at in rest[:left]:
        done.append(sequences[at])
    if left == right:
        last, used = sequences[rest[left]], total[rest[left]]
        while used:
            size = 1 << (used.bit_length() - 1)
            part, room = [], size
            while room:
                k, start, n = last.pop(0)
                take = min(room, n)
                part.append((k, start, take))
                if take < n:
                    last.insert(0, (k, start + take, n - take))
                room -= take
            done.append(part)
            used -= size
    return done


PIECES = "group long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_M64 = (1 << 64) - 1


def _mixed(x: int) -> int:
    x = ((x ^ (x >> 33)) * 0xFF51AFD7ED558CCD) & _M64
    x = ((x ^ (x >> 33)) * 0xC4CEB9FE1A85EC53) & _M64
    return x ^ (x >> 33)


def pieces(docs: DataFrame, tokenizer: str, groups: int, capacity: int = CAPACITY, seed: int = 0) -> DataFrame:
    """Full pieces of each document, without ids, and its remainder with them, each dealt to a group."""
    def run(batches):
        encode, part, nth = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([END_ID], encode.kind)
        for batch in (b for whole in batches for b in blocks(whole, 1, TEXT_AT_ONCE)):
            flat, at = encode(batch.column(1))
            out = {name.split()[0]: [] for name in PIECES.split(", ")}
            for doc, a, b in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                n = b - a + 1
                ids = np.append(flat[a:b], end)
                for start in range(0, n, capacity):
                    own = ids[start: start + capacity]
                    whole = len(own) == capacity
                    for name, value in zip(out, (_mixed((part << 40) + nth ^ _mixed(seed + 1)) % groups, doc, start, len(own), zlib.crc32(own.astype("<u4")) if whole else None, n, None if whole else own.tobytes())):
                        out[name].append(value)
                    nth += 1
            types = [pa.int64()] * 6 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, group: int = GROUP, seed: int = 0) -> DataFrame:
    """One row per piece of every document with its place: `sequence_id` and `offset`."""
    groups = max(1, -(-docs.select("doc_id").count() // group))

    def place(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        number = table.column("group")[0].as_py()
        doc, start, tokens = (table.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens"))
        ids, length, crc = table.column("ids").to_pylist(), table.column("length").to_pylist(), table.column("ids_crc32").to_pylist()
        full = [k for k, held in enumerate(ids) if held is None]
        open_ = [k for k, held in enumerate(ids) if held is not None]
        rows = [(doc[k], start[k], length[k], crc[k], tokens[k], s, 0) for s, k in enumerate(full)]
        for s, sequence in enumerate(filled([length[k] for k in open_], capacity), len(full)):
            at = 0
            for k, first, n in sequence:
                k = open_[k]
                own = np.frombuffer(ids[k], f"<u{len(ids[k]) // length[k]}")[first: first + n].astype("<u4")
                rows.append((doc[k], start[k] + first, n, zlib.crc32(own), tokens[k], s, at))
                at += n
        columns = zip(*rows)
        names = [c.split()[0] for c in PLACED.split(", ")]
        held = {name: pa.array(values, pa.int64()) for name, values in zip(names, columns)}
        held["sequence_id"] = pa.array([(number << 32) + s for s in held["sequence_id"].to_pylist()], pa.int64())
        return pa.table(held)

    return pieces(docs, tokenizer, groups, capacity, seed).groupBy("group").applyInArrow(place, PLACED)
