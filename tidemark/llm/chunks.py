"""Texts of an Arrow batch cut into runs at white space, without a Python object per run."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 4 << 20  # texts are worked on in blocks of about this size; a longer text is a block of its own
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Lead bytes of the white space outside ASCII: U+0085, U+00A0, U+1680, U+2000-200A, U+2028, U+2029, U+202F, U+205F, U+3000.
ODD_SPACE = "\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LEAD = np.zeros(256, bool)
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True


class Texts:
    """The UTF-8 bytes of some texts in one buffer; text i is bytes[at[i]:at[i + 1]]. Null counts as empty."""

    def __init__(self, column: pa.Array):
        held = pc.fill_null(column, "").cast(pa.large_binary())
        offsets = np.frombuffer(held.buffers()[1], np.int64)[held.offset: held.offset + len(held) + 1] if len(held) else np.zeros(1, np.int64)
        data = held.buffers()[2] if len(held) else None
        self.bytes = np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
        self.at = offsets - offsets[0]
        self.n = len(held)

    def text(self, i: int) -> str:
        return self.bytes[self.at[i]: self.at[i + 1]].tobytes().decode()

    def odd(self) -> set[int]:
        """Texts with white space outside ASCII."""
        found = set()
        at = np.flatnonzero(_LEAD[self.bytes])
        if len(at):
            b, last = self.bytes, len(self.bytes) - 1
            one, two = b[np.minimum(at + 1, last)], b[np.minimum(at + 2, last)]
            lead = b[at]
            hit = (lead == 0xC2) & ((one == 0x85) | (one == 0xA0)) | (lead == 0xE1) & (one == 0x9A) & (two == 0x80)
            hit |= (lead == 0xE2) & ((one == 0x80) & ((two <= 0x8A) | (two == 0xA8) | (two == 0xA9) | (two == 0xAF)) | (one == 0x81) & (two == 0x9F))
            hit |= (lead == 0xE3) & (one == 0x80) & (two == 0x80)
            found.update((np.searchsorted(self.at, at[hit], side="right") - 1).tolist())
        return found

    def firsts(self) -> np.ndarray:
        """Marks the first byte of each text."""
        marks = np.zeros(len(self.bytes) + 1, bool)
        marks[self.at[:-1]] = True
        return marks[:-1]


def blocks(batch: pa.RecordBatch, column: int, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch whose texts come to about `limit` bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(sizes):
        return
    block = (np.cumsum(sizes) - sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def encoded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Codes and the different byte strings of data[offsets[i]:offsets[i + 1]]."""
    if len(offsets) < 2:
        return np.zeros(0, np.int32), []
    held = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    found = held.dictionary_encode()
    return found.indices.to_numpy(), found.dictionary.to_pylist()


def words(texts: Texts, data: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs without ASCII white space): their bytes joined, their offsets there, and the number of words before each text."""
    data = texts.bytes if data is None else data
    inner = ~_SPACE[data]
    cut = texts.firsts()
    cut[1:] |= ~inner[:-1]
    cut[:1] = True
    start = np.flatnonzero(inner & cut)
    ends = inner.copy()
    ends[:-1] &= ~inner[1:] | cut[1:]
    return data[inner], np.concatenate([[0], np.cumsum(np.flatnonzero(ends) + 1 - start)]), np.searchsorted(start, texts.at)


def tiles(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of runs that cover the texts, and the number of runs before each text.

    A run is a word with the one space right before it, or the white space that is left between words:
    a byte-level vocabulary's first split never crosses their borders.
    """
    data, first = texts.bytes, texts.firsts()
    if not len(data):
        return np.zeros(1, np.int64), np.zeros(texts.n + 1, np.int64)
    space = _SPACE[data]
    after = np.zeros(len(data), bool)
    after[1:] = space[:-1]
    after &= ~first
    start = first | (space & ~after)
    word = np.flatnonzero(~space & after)
    start[word - 1] = True
    start[word[data[word - 1] != 32]] = True
    at = np.flatnonzero(start)
    return np.append(at, len(data)), np.searchsorted(at, texts.at)
