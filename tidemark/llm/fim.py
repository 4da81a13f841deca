"""Fill-in-the-middle transformation over a set of token boundaries (operator 11).

A text is cut into units, `[A-Za-z]+|[^A-Za-z]` matched left to right over code points, and two numbers
drawn from the document's id say after how many units the prefix and the middle end. The ends of all
units form a set of byte offsets, kept like a Roaring bitmap: chunks of 2^16 offsets, each in the
smallest of three containers (sorted array, bitmap, runs), with the cumulative cardinality before each.
A cut offset is `select(k)`: a search over the cardinalities finds the container, and the container
selects locally: by index, by the run that holds the rank, or by the counted words of the bitmap.

A text is walked chunk by chunk, so beside the text itself only its containers are held: two bytes a
unit at most, and 8 KB a chunk at most. Every text is worked on alone; nothing is shuffled.

Output: `psm` is <P>prefix<S>suffix<M>middle, `spm` is <S>suffix<P>prefix<M>middle, `plain` the text.
`restore` rebuilds the text from output and form. A text that holds a marker is left plain, and no marker
can arise across a cut (a marker starts with the only `<` in it), so the first marker found is the real one.

Defined cases: null text counts as empty, which is plain; a null id draws from the text `1:` alone; very
long texts are cut whole; ties (both draws equal) give an empty middle; repeated rows get equal results;
an empty table gives no rows; columns of the caller that are named like a new one are replaced by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.chunks import blocks
from tidemark.llm.common import unpacked

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20  # of 100 draws each
CHUNK = 1 << 16
TEXT_AT_ONCE = 2 << 20  # bytes of text that are returned together; a longer text goes alone
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


class Array:
    """Sorted offsets, two bytes each."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.low[k])


class Runs:
    """Stretches of consecutive offsets: their starts, and how many offsets come before each."""

    def __init__(self, low: np.ndarray, first: np.ndarray):
        self.start, self.before = low[first].astype(np.uint16), first.astype(np.uint16)

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.start[run]) + k - int(self.before[run])


class Bitmap:
    """One bit per offset, and the number of bits set before each 64-bit word."""

    def __init__(self, marks: np.ndarray):
        held = np.zeros(CHUNK, bool)
        held[: len(marks)] = marks
        self.words = np.packbits(held, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)[:-1]])

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, side="right")) - 1
        inside = np.flatnonzero(np.unpackbits(self.words[word: word + 1].view(np.uint8), bitorder="little"))
        return 64 * word + int(inside[k - int(self.before[word])])


def container(marks: np.ndarray) -> tuple[Array | Runs | Bitmap, int]:
    """The smallest container for the marked offsets of a chunk, and their number."""
    low = np.flatnonzero(marks)
    first = np.flatnonzero(np.append(True, np.diff(low) != 1)) if len(low) else low
    sizes = {"array": 2 * len(low), "runs": 4 * len(first), "bitmap": CHUNK // 8}
    kind = min(sizes, key=sizes.get)
    return (Array(low) if kind == "array" else Runs(low, first) if kind == "runs" else Bitmap(marks)), len(low)


class Boundaries:
    """Byte offsets at which the units of a text end."""

    def __init__(self, data: np.ndarray):
        self.containers, counts = [], [0]
        for at in range(0, len(data), CHUNK):
            # A unit ends before every lead byte that isn't a letter after a letter, and at the end of the text.
            seen = data[at: at + CHUNK + 1]
            letter = _LETTER[seen]
            ends = ((seen[1:] & 0xC0) != 0x80) & ~(letter[1:] & letter[:-1])
            if at + CHUNK >= len(data):
                ends = np.append(ends, True)
            held, n = container(ends)
            self.containers.append(held)
            counts.append(n)
        self.before = np.cumsum(counts)  # offsets in the containers before each one

    def __len__(self) -> int:
        return int(self.before[-1])

    def cut(self, units: int) -> int:
        """The offset at which the first `units` units end."""
        if units == 0:
            return 0
        chunk = int(np.searchsorted(self.before, units - 1, side="right")) - 1
        return chunk * CHUNK + self.containers[chunk].select(units - 1 - int(self.before[chunk])) + 1


def _chars(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def transformed(raw: bytes, draws: tuple[int, int, int, int]) -> tuple[int, str, int | None, int | None, bytes]:
    """Units, form, code points of prefix and middle (None if plain) and the output of one text."""
    data = np.frombuffer(raw, np.uint8)
    held = Boundaries(data)
    n = len(held)
    if not raw or draws[2] % 100 >= PLAIN_FROM or any(m.encode() in raw for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, raw
    a, b = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    x, y = held.cut(a), held.cut(b)
    prefix, middle, suffix = raw[:x], raw[x:y], raw[y:]
    p, s, m = PREFIX.encode() + prefix, SUFFIX.encode() + suffix, MIDDLE.encode() + middle
    form, output = ("spm", s + p + m) if draws[3] % 100 < SPM_BELOW else ("psm", p + s + m)
    return n, form, _chars(data[:x]), _chars(data[x:y]), output


def _draws(doc_id: Column) -> list[Column]:
    """The first four 8-digit groups of the SHA-256 of `1:` and the id."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def transform(df: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of `df` (all by default) and `n`, `form`, `prefix_chars`, `middle_chars`, `output`."""
    new = ["n", "form", "prefix_chars", "middle_chars", "output"]
    names = [c for c in (keep or df.columns) if c.lower() not in new]
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    rows = df.select(row, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("given"), *_draws(F.col(f"`{doc_id}`")))

    def run(batches):
        for batch in (b for whole in batches for b in blocks(whole, 1, TEXT_AT_ONCE)):
            draws = zip(*(batch.column(k).to_pylist() for k in range(2, 6)))
            # A view of the text's bytes, without decoding them.
            made = [transformed(raw, d) for raw, d in zip(batch.column(1).cast(pa.large_binary()).to_pylist(), draws)]
            n, form, prefix, middle, output = zip(*made) if made else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.large_binary()).cast(pa.large_string()).cast(pa.string())],
                names=["row", *new])

    made = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string")
    return made.select(*unpacked(made, names), *new)


def restored(output: Column, form: Column) -> Column:
    """The text that `output` in the given form was made from; built-in functions only."""
    first, second = F.when(form == "psm", F.locate(SUFFIX, output)).otherwise(F.locate(PREFIX, output)), F.locate(MIDDLE, output)
    head = output.substr(F.lit(len(PREFIX) + 1), first - len(PREFIX) - 1)
    body = output.substr(first + len(SUFFIX), second - first - len(SUFFIX))
    middle = output.substr(second + len(MIDDLE), F.greatest(F.char_length(output), F.lit(1)))
    return F.when(form == "plain", output).when(form == "psm", F.concat(head, middle, body)).otherwise(F.concat(body, middle, head))


#: Rows of the query over `documents`, without containers.
ORACLE = f"""
WITH cut AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents
), drawn AS (
    SELECT *, len(units) AS n, [('0x' || substr(d, 8 * k + 1, 8))::BIGINT FOR k IN range(4)] AS h FROM cut
), formed AS (
    SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h[3] % 100 >= {PLAIN_FROM} THEN 'plain'
             WHEN h[4] % 100 < {SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parts AS (
    SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS p, coalesce(array_to_string(units[a + 1:b], ''), '') AS m, coalesce(array_to_string(units[b + 1:], ''), '') AS s FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM parts
"""
