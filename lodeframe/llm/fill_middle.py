"""Fill-in-the-middle transformation with cuts from a compressed set of boundaries.

A text is cut into units: runs of ASCII letters, and every other code point by itself.
The ends of units, with 0 before them, are a set of code point offsets.  It is kept
as containers of 2**16 offsets each: a sorted array where few are set, runs where the
set ones lie together, else a bitmap.  Cumulative cardinalities over the
containers lead from "the k-th boundary" to one container, and a select inside that
container gives the offset, for both cuts of a document.

Every document is handled by itself in one pass over the table: no row moves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.frames import mapped

#: Marks of the parts: before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Offsets of one container.
SPAN = 1 << 16
#: An array container holds at most so many offsets: beyond it, a bitmap takes fewer bytes.
ARRAY_MOST = 4096
#: Code points whose boundaries are found at once.
CHUNK_CHARS = SPAN * 4
#: Code points of output given back at once, about.
OUT_CHARS = 1 << 19

_BITS = np.array([[i for i in range(8) if b >> i & 1] + [0] * (8 - b.bit_count()) for b in range(256)], np.uint8)


class ArrayContainer:
    """Sorted 16-bit offsets."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.low[k])


class BitmapContainer:
    """One bit an offset, with the number of bits set before every block of 64 bytes."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(SPAN, bool)
        bits[low] = True
        self.bytes = np.packbits(bits, bitorder="little")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.bytes).reshape(-1, 64).sum(axis=1, dtype=np.int64))))

    def select(self, k: int) -> int:
        block = int(np.searchsorted(self.before, k, "right")) - 1
        k -= int(self.before[block])
        part = self.bytes[block * 64 : block * 64 + 64]
        reached = np.cumsum(np.bitwise_count(part), dtype=np.int64)
        at = int(np.searchsorted(reached, k, "right"))
        k -= int(reached[at - 1]) if at else 0
        return (block * 64 + at) * 8 + int(_BITS[part[at], k])


class RunContainer:
    """First offsets of runs of consecutive ones, with the number of offsets before each run."""

    def __init__(self, low: np.ndarray):
        first = np.flatnonzero(np.concatenate(([True], np.diff(low) != 1)))
        self.start, self.before = low[first].astype(np.uint16), first.astype(np.int32)

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.start[run]) + k - int(self.before[run])


def container(low: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest container of sorted distinct offsets below ``SPAN``."""
    runs = 1 + int(np.count_nonzero(np.diff(low) != 1))
    if 6 * runs < min(2 * len(low), SPAN // 8):
        return RunContainer(low)
    return ArrayContainer(low) if len(low) <= ARRAY_MOST else BitmapContainer(low)


class BoundarySet:
    """A set of offsets, filled in ascending order."""

    def __init__(self) -> None:
        self.high: list[int] = []
        self.parts: list[ArrayContainer | BitmapContainer | RunContainer] = []
        #: boundaries before each container, and all of them at the end
        self.before = [0]

    def add(self, offsets: np.ndarray) -> None:
        """Adds sorted offsets; all of one container come in one call."""
        high = offsets >> 16
        cuts = np.flatnonzero(np.diff(high)) + 1
        for part in np.split(offsets, cuts) if len(offsets) else []:
            self.high.append(int(part[0]) >> 16)
            self.parts.append(container(part & (SPAN - 1)))
            self.before.append(self.before[-1] + len(part))

    def __len__(self) -> int:
        return self.before[-1]

    def select(self, k: int) -> int:
        """The k-th smallest offset, from 0."""
        i = int(np.searchsorted(self.before, k, "right")) - 1
        return (self.high[i] << 16) + self.parts[i].select(k - self.before[i])


def boundaries(text: str) -> BoundarySet:
    """0 and the ends of all units of a text, in code points."""
    out = BoundarySet()
    joined = False  # whether the letter run goes on from the chunk before
    for at in range(0, len(text) + 1, CHUNK_CHARS):
        part = text[at : at + CHUNK_CHARS]
        code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        folded = code | 32
        letter = (folded >= 97) & (folded <= 122) & (code < 128)
        inside = letter & np.concatenate(([joined], letter[:-1])) if len(letter) else letter
        found = np.flatnonzero(~inside) + at
        if len(part) < CHUNK_CHARS:
            found = np.append(found, len(text))  # the end is a boundary, 0 of an empty text as well
        out.add(found)
        joined = bool(letter[-1]) if len(letter) else joined
    return out


def draws(doc_id: int | None, seed: str = "1:") -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers that depend on the id only; a null id counts as empty."""
    digest = hashlib.sha256(f"{seed}{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def transform(text: str, numbers: tuple[int, int, int, int], plain_from: int = 90, spm_below: int = 20) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix, of the middle, output) of a text."""
    bounds = boundaries(text)
    n = len(bounds) - 1
    h1, h2, h3, h4 = numbers
    if not text or h3 % 100 >= plain_from or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    one, two = bounds.select(low), bounds.select(high)
    prefix, middle, suffix = text[:one], text[one:two], text[two:]
    if h4 % 100 < spm_below:
        return n, "spm", one, two - one, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return n, "psm", one, two - one, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def restore(output: str, form: str) -> str:
    """The text that :func:`transform` made ``output`` from."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, rest = output[len(first) :].split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    return one + middle + two if form == "psm" else two + middle + one


def _transformed(plain_from: int, spm_below: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string()), ("restored", pa.string())])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, chars = [], 0
            for i, value in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                n, form, prefix, middle, output = transform(value.as_py() or "", draws(i), plain_from, spm_below)
                rows.append((i, n, form, prefix, middle, output, restore(output, form)))
                chars += len(output)
                if chars > OUT_CHARS:  # output and restored text are both as long as the text
                    yield made(rows)
                    rows, chars = [], 0
            if rows:
                yield made(rows)

    return run


def fill_in_middle(docs: DataFrame, plain_percent: int = 10, spm_percent: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n, form, prefix_chars, middle_chars, output, restored``.

    ``n`` counts the units of the text.  Four numbers hashed from the id choose two cuts
    among the n + 1 boundaries and the form: ``plain`` (the text as it is) for
    ``plain_percent`` of the ids, ``spm`` (suffix first) for ``spm_percent`` of the others, else
    ``psm`` (prefix first).  A text that holds one of the marks stays plain, as does an
    empty one; null counts as empty.  Lengths are in code points, null for plain rows.
    ``restored`` is rebuilt from ``output`` and ``form`` alone.  Rows that share an id or have
    none are cut by the same numbers, each at its own boundaries; other columns
    are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return mapped(docs, _transformed(100 - plain_percent, spm_percent), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, restored string")
