"""BPE encoding and decoding by speculation and verification (operator 4).

Encoding a batch: every different run of non-spaces is normalised and split into words once. For the
different words that are new,

1. greedy longest match over the vocabulary proposes tokens (one pass of an Aho-Corasick automaton);
2. every adjacent pair of proposed tokens is checked at once in numpy: two tokens are compatible if no
   merge would have joined the symbols at their border while both were still alive;
3. a word whose pairs are all compatible has its exact encoding already; the others, and those whose
   greedy match doesn't end on a word end, are merged pair by pair, lowest rank first.

Decoding takes the strings of the ids and joins them as the file's decoder says (none: by one space).

Defined cases: null text is encoded as empty text, to no ids, and decodes to empty text; special tokens
inside a text are single ids as in the library. Repeated rows, empty tables and extra columns need no
care: the operator adds one column to rows packed in a struct and keeps their columns.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.chunks import Texts, blocks, encoded, words
from tidemark.llm.common import unpacked
from tidemark.llm.packing import _byte_names

_END = "\x00"  # stands for the end-of-word suffix: one character, so that the automaton sees one symbol
_NONE = np.int64(1) << 40  # later than any merge
TEXT_AT_ONCE, TOKENS_AT_ONCE = 2 << 20, 1 << 20  # bytes and tokens of a part; a longer text is a part of its own
LONG = 64  # bytes of a run that is not remembered
CACHE_RUNS = 250_000  # different runs whose ids a worker remembers


class WordBpe:
    """Vocabulary, merges and the pair tables of a word-end BPE file of the tokenizers library."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model = held["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        self.normalise = _normaliser(held["normalizer"])
        self.pattern = regex.compile(_split_pattern(held["pre_tokenizer"]))
        self.names = {b: c for b, c in _byte_names().items()}  # for str.translate on latin-1 text
        size = max(max(vocab.values()), *self.special.values()) + 1
        self.strings = pa.array([s for s, _ in sorted([*vocab.items(), *self.special.items()], key=lambda x: x[1])], pa.string())
        if len(self.strings) != size:
            raise ValueError("ids have gaps")
        symbol = lambda s: s[: -len(self.suffix)] + _END if self.suffix and s.endswith(self.suffix) else s
        self.symbols = {symbol(s): i for s, i in vocab.items()}
        self.made = np.zeros(len(model["merges"]), np.int64)  # the token that each merge gives
        ranks: dict[tuple[int, int], int] = {}
        left, right, born = np.full(size, -1, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        for k, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            ranks[x, y], self.made[k] = k, z
            if born[z] < 0:
                left[z], right[z], born[z] = x, y, k
        self.left, self.right, self.born, self.size = left, right, born, size
        keys = np.array([x * size + y for x, y in ranks], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array(list(ranks.values()), np.int64)[order]
        self.greedy = ahocorasick.Automaton()
        for s, i in self.symbols.items():
            # A token may be proposed only if merging its own symbols gives it back.
            if len(s.replace(_END, "")) == 1 or born[i] >= 0:
                self.greedy.add_word(s, (i, len(s)))
        self.greedy.make_automaton()
        self._known: dict[bytes, bytes] = {}  # ids as 32-bit bytes
        self._words: dict[str, bytes] = {}

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether token a followed by token b is what merging their joined symbols gives.

        From the two tokens down to the symbols at their border: a pair of symbols is merged if its rank
        comes before the merge that consumed the left one, and not after the one that consumed the right
        one (equal merges go from left to right).
        """
        good = np.ones(len(a), bool)
        open_ = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        ends_x, ends_y = np.full(len(a), _NONE), np.full(len(a), _NONE)
        while len(open_):
            rank = self._ranks(x, y)
            rank[rank == _NONE] = 2 * _NONE
            joined = (rank < ends_x) & (rank <= ends_y)
            good[open_[joined]] = False
            more = ~joined & ((self.born[x] >= 0) | (self.born[y] >= 0))
            open_, x, y, ends_x, ends_y = open_[more], x[more], y[more], ends_x[more], ends_y[more]
            down_x = self.born[x] > self.born[y]  # the symbol made last is taken apart first
            ends_x = np.where(down_x, self.born[x], ends_x)
            ends_y = np.where(down_x, ends_y, self.born[y])
            x, y = np.where(down_x, self.right[x], x), np.where(down_x, y, self.left[y])
        return good

    def merged(self, marked: list[str]) -> list[bytes]:
        """Exact merges of words with their end marks: in each round every word makes its lowest-ranked merge, wherever it occurs.

        A merge of higher rank than the round's can't come first, and the pairs a merge creates rank after
        it, so a round does what merging one pair at a time would. Equal symbols in a row pair up from the left.
        """
        symbols = self.symbols
        parts = [[*(symbols[c] for c in w[:-2]), symbols[w[-2:]]] for w in marked]
        word = np.repeat(np.arange(len(parts)), np.fromiter(map(len, parts), np.int64, len(parts)))
        ids = np.fromiter((i for p in parts for i in p), np.int64, len(word))
        out = [b""] * len(parts)

        def settle(ids: np.ndarray, word: np.ndarray) -> None:
            cuts = np.flatnonzero(np.diff(word)) + 1
            raw = ids.astype("<i4").tobytes()
            for w, a, b in zip(word[np.append(0, cuts)].tolist() if len(word) else [], [0, *cuts.tolist()], [*cuts.tolist(), len(ids)]):
                out[w] = raw[4 * a: 4 * b]

        while len(ids):
            rank = np.full(len(ids), _NONE)  # of the pair that starts here
            rank[:-1] = np.where(word[1:] == word[:-1], self._ranks(ids[:-1], ids[1:]), _NONE)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(first, len(ids)))
            lowest = np.repeat(np.minimum.reduceat(rank, first), sizes)
            done = lowest == _NONE
            if done.any():
                settle(ids[done], word[done])
                ids, word, rank, lowest = ids[~done], word[~done], rank[~done], lowest[~done]
            here = rank == lowest
            if not len(here):
                break
            head = here.copy()
            head[1:] &= ~here[:-1]
            since = np.arange(len(here)) - np.maximum.accumulate(np.where(head, np.arange(len(here)), 0))
            here &= since % 2 == 0
            at = np.flatnonzero(here)
            ids[at] = self.made[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, word = ids[keep], word[keep]
        return out

    def _ranks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = x * self.size + y
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NONE)

    def encode_words(self, new: list[str]) -> int:
        """Remember the ids of words; returns how many of them had to be merged exactly."""
        marked = [w + _END for w in new]
        joined = "".join(marked)
        found = list(self.greedy.iter_long(joined))
        last = np.fromiter((at for at, _ in found), np.int64, len(found))
        ids = np.fromiter((v[0] for _, v in found), np.int64, len(found))
        wide = np.fromiter((v[1] for _, v in found), np.int64, len(found))
        cuts = np.cumsum(np.fromiter(map(len, marked), np.int64, len(marked)))
        of = np.searchsorted(cuts, last, side="right")
        failed = np.zeros(len(new), bool)
        # The tokens of a word cover it up to its end mark, or greedy matching left a piece out.
        failed[np.bincount(of, wide, len(new)).astype(np.int64) != np.diff(np.append(0, cuts))] = True
        same = np.flatnonzero(of[1:] == of[:-1])
        pairs, back = np.unique(ids[same] * self.size + ids[same + 1], return_inverse=True)
        failed[of[same[~self.compatible(pairs // self.size, pairs % self.size)[back]]]] = True
        start = (4 * np.searchsorted(of, np.arange(len(new) + 1))).tolist()
        raw = ids.astype("<i4").tobytes()
        for k, (w, bad) in enumerate(zip(new, failed.tolist())):
            if not bad:
                self._words[w] = raw[start[k]: start[k + 1]]
        again = np.flatnonzero(failed).tolist()
        self._words.update(zip([new[k] for k in again], self.merged([marked[k] for k in again])))
        return int(failed.sum())

    def split(self, runs: list[str]) -> list[list[str]]:
        """Words of each run of non-spaces, in byte-level characters."""
        found = [[line] if line.isalpha() else self.pattern.findall(line) for line in self.normalise("\n".join(runs)).split("\n")]
        return [ws if all(w.isascii() and w.isprintable() for w in ws) else [w.encode().decode("latin-1").translate(self.names) for w in ws] for ws in found]

    def _learn(self, runs: list[bytes]) -> None:
        parts = self.split([r.decode() for r in runs]) if runs else []
        known = self._words
        new = list(dict.fromkeys(w for ws in parts for w in ws if w not in known))
        if new:
            self.encode_words(new)
        for r, ws in zip(runs, parts):
            self._known[r] = known[ws[0]] if len(ws) == 1 else b"".join([known[w] for w in ws])
        for w in new:
            if len(w) > LONG:
                del known[w]

    def one(self, text: str) -> np.ndarray:
        """Ids of a text with special tokens in it."""
        marks = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")")
        found = []
        for part in marks.split(text):
            if part in self.special:
                found.append(np.array([self.special[part]], np.int32))
            else:
                found += [x for x in self(pa.array([part], pa.large_string())).to_pylist()]
        return np.concatenate([np.asarray(x, np.int32) for x in found]) if found else np.zeros(0, np.int32)

    def __call__(self, column: pa.Array) -> pa.LargeListArray:
        """The ids of each text."""
        texts = Texts(column)
        raw = texts.bytes.tobytes() if self.special else b""
        marked = [i for i in range(texts.n) if any(s in texts.text(i) for s in self.special)] if any(s.encode() in raw for s in self.special) else []
        data, offsets, before = words(texts)
        codes, runs = encoded(data, offsets)
        new = [r for r in runs if r not in self._known]
        if new and len(self._known) + len(new) > CACHE_RUNS:
            self._known.clear()
            self._words.clear()
            new = runs
        if new:
            self._learn(new)
        own = [self._known[r] for r in runs]
        for r in runs:
            if len(r) > LONG:
                del self._known[r]  # long runs are rare and would fill the memory
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // 4
        held = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)), pa.array(np.frombuffer(b"".join(own), "<i4")))
        flat = held.take(pa.array(codes)).flatten()
        at = np.concatenate([[0], np.cumsum(sizes[codes] if len(codes) else np.zeros(0, np.int64))])[before].astype(np.int64)
        out = pa.LargeListArray.from_arrays(pa.array(at), flat)
        if marked:
            every = out.to_pylist()
            for i in marked:
                every[i] = self.one(texts.text(i)).tolist()
            out = pa.array(every, pa.large_list(pa.int32()))
        return out

    def decode(self, ids: pa.Array) -> pa.Array:
        """The text of each list of ids; null stays null."""
        counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        starts = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        joined = pc.binary_join(pa.ListArray.from_arrays(starts, self.strings.take(ids.flatten())), " ")
        return pc.if_else(ids.is_valid(), joined, pa.scalar(None, pa.string()))


def _normaliser(spec: dict | None) -> Callable[[str], str]:
    """The file's normalizer as a function of runs without ASCII white space, joined by newlines."""
    steps: list[Callable[[str], str]] = []
    for step in (spec or {}).get("normalizers", [spec] if spec else []):
        if step["type"] == "NFC":
            steps.append(lambda s: unicodedata.normalize("NFC", s))
        elif step["type"] == "Replace" and step["pattern"].get("Regex") == r"\s+":
            continue  # words hold no white space, and runs are split at it before
        elif step["type"] == "Lowercase":
            steps.append(_lower)
        else:
            raise ValueError(f"normalizer not known: {step}")

    def run(text: str) -> str:
        for step in steps:
            text = step(text)
        return text

    return run


def _lower(text: str) -> str:
    """Lower case of each character by itself: no final sigma."""
    return text.lower() if "\u03a3" not in text else "".join(c.lower() for c in text)


def _split_pattern(spec: dict) -> str:
    for step in spec.get("pretokenizers", [spec]):
        if step["type"] == "Split":
            if step["behavior"] != "Removed" or not step["invert"]:
                raise ValueError("the split must keep its matches only")
            return step["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
    raise ValueError("no split pattern")


_TOKENIZERS: dict[str, WordBpe] = {}


def tokenizer(path: str) -> WordBpe:
    """One tokenizer per worker process and file."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordBpe(path)
    return _TOKENIZERS[path]


def _added(df: DataFrame, source: Column, parts, fn, kind: str, name: str, keep: list[str] | None) -> DataFrame:
    """The columns `keep` of `df` and the column `name`, which replaces one of that name; a batch is worked on and returned in parts of bounded size."""
    names = [c for c in (keep or df.columns) if c.lower() != name.lower()]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), source.alias("given"))
    row_type = rows.schema["row"].dataType.simpleString()

    def run(batches):
        for batch in (p for whole in batches for p in parts(whole)):
            yield pa.RecordBatch.from_arrays([batch.column(0), fn(batch.column(1))], names=["row", "made"])

    return rows.mapInArrow(run, f"row {row_type}, made {kind}").select(*unpacked(df, names), F.col("made").alias(name))


def _by_tokens(batch: pa.RecordBatch):
    """Parts of a batch of id lists with about TOKENS_AT_ONCE tokens."""
    counts = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    block = (np.cumsum(counts) - counts) // TOKENS_AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(counts)] if len(counts) else [0]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of `df` (all by default) and the token ids of `text` in the array column `ids`."""
    part = lambda batch: blocks(batch, 1, TEXT_AT_ONCE)
    return _added(df, F.col(f"`{text}`").cast("string"), part, lambda column: tokenizer(path)(column).cast(pa.list_(pa.int32())), "array<int>", ids, keep)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of `df` (all by default) and the text of the id lists in `ids`; null ids give null."""
    return _added(df, F.col(f"`{ids}`").cast("array<int>"), _by_tokens, lambda column: tokenizer(path).decode(column), "string", text, keep)
